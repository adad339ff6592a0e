"""One query for each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import automaton, bpe, decontaminate, fim, filters, language, lines, pages, pii, ppm, quality, simhash, topk
from recordloom.llm.common import table

# repeated passages of over 50 words, less the parts of them in sentences that reach beyond either end
PASSAGE_RUN = 40


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.ppm_scores(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents")))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_repeats(table(spark, sf_dir, "documents"), unit="sentence", min_run=PASSAGE_RUN)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("n_found", F.size("pii_spans"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    runs = F.zip_with("scan.starts", "scan.ends", lambda start, end: (end - start).cast("long"))
    names = F.array_sort(F.transform("scan.items", lambda item: item.cast("string")))
    n_hit = F.aggregate(runs, F.lit(0).cast("long"), lambda total, n: total + n)
    return found.select(
        "doc_id",
        F.col("scan.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("scan.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("scan.starts") > 0).alias("contaminated"),
    )


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.restored(fim.fill_in_middle(table(spark, sf_dir, "documents"))))


def op12_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.digests(automaton.encode_decode(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ppm, op2_bpe, op3_lines, op4_language, op5_quality, op6_topk, op7_pii, op8_simhash, op9_pages, op10_decontaminate,
        op11_fim, op12_filters, op13_automaton,
    )
}
