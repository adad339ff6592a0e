"""One query per operator, each over whole tables."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import fields as fld
from recordloom.functions import prompts, records, similarity, text
from recordloom.operators import documents, kept, lookup, order, python_batches, split, tfidf, vectors
from recordloom.operators import records as record_ops
from recordloom.plans import build, evaluate, training
from recordloom.session import configure
from recordloom.sources import csv, tables
from recordloom.sources import documents as document_files
from recordloom.sources.scratch import scratch_path
from workload import tables as derived

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

SCHEMA_STR = "{'lang': 'str', 'source': 'str'}"
MAPPING = {"name": "p_name", "brand": "p_brand", "size": "p_size"}
DIGITS = 6
SKETCH_ERROR = 0.02


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    QUERIES[function.__name__] = run
    return run


def rounded(value: Column | str, name: str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value, DIGITS).alias(name)


def _labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = derived.table(spark, sf_dir, "documents")
    return lookup.lookup(
        docs, derived.label_records(spark, sf_dir), "doc_id", {"structured": F.lit("{}")}, spread_by="doc_id"
    )


def _parsed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.parse_pairs(derived.pairs(spark, sf_dir), "expected_json", "predicted_json")


def _parsed_nested_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.parse_pairs(derived.nested_pairs(spark, sf_dir), "expected_json", "predicted_json")


PAIR = ("pair_id", "expected_json", "predicted_json")

# --- sources and sinks --------------------------------------------------------------


@query
def s1_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "pairs-csv")
    rows = _labelled_documents(spark, sf_dir).select("doc_id", F.col("text").alias("raw"), "structured")
    csv.write_csv(rows, path)
    back = csv.read_csv(spark, path)
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), "raw", "structured")


@query
def s3_training_table(spark, sf_dir):
    path = scratch_path(spark, "training")
    formatted = training.format_training_data(derived.dirty_records(spark, sf_dir), model_name="base")
    tables.write_training_table(formatted, path)
    return tables.read_table(spark, path)


@query
def s4_doc_scan(spark, sf_dir):
    pages = derived.table(spark, sf_dir, "pages").where(document_files.has_suffix("url", "#top"))
    return pages.select("page_id", document_files.file_name("url").alias("file_name"), F.col("html").alias("text"))


@query
def s6_export_split(spark, sf_dir):
    path = scratch_path(spark, "export")
    docs = derived.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    tables.export_splits(split.split_exact(docs, "doc_id"), path, fmt="json")
    return spark.read.schema("doc_id bigint, lang string, source string, split string").json(path)


# --- projections and filters --------------------------------------------------------


@query
def p1_concat_pages(spark, sf_dir):
    return documents.join_pages(derived.table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query
def p1b_chunk(spark, sf_dir):
    return documents.split_into_chunks(derived.table(spark, sf_dir, "documents"), "doc_id", "text", 1000, 100)


@query
def p2_strip_apostrophes(spark, sf_dir):
    return derived.dirty_records(spark, sf_dir).select(
        "id", text.strip_apostrophes("input").alias("input"), text.strip_apostrophes("output").alias("output")
    )


@query
def p3_strip_escapes(spark, sf_dir):
    return derived.model_outputs(spark, sf_dir).select(
        "id", text.strip_backslashes("generated_output").alias("stripped")
    )


@query
def p5_pack_record(spark, sf_dir):
    customers = derived.table(spark, sf_dir, "customer")
    doubtful = customers.withColumn("c_acctbal", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    return doubtful.select(
        "c_custkey",
        record_ops.pack_record(doubtful, "c_name").alias("record"),
        record_ops.pack_record(doubtful, "c_name", null_as="None").alias("record_none"),
    )


@query
def p6_prompt(spark, sf_dir):
    docs = derived.table(spark, sf_dir, "documents")
    model = F.when(F.col("lang") == "en", "Some-Instruct-7b").otherwise("base")
    return docs.select("doc_id", prompts.render_prompt(F.lit(SCHEMA_STR), "text", model).alias("preprocessed_input"))


@query
def p7_text(spark, sf_dir):
    packed = _labelled_documents(spark, sf_dir)
    prompt = prompts.render_prompt(F.lit(SCHEMA_STR), "text", "model-INSTRUCT")
    return packed.select("doc_id", prompts.render_training_text(prompt, "structured").alias("text"))


@query
def p12_quarantine(spark, sf_dir):
    return training.quarantine(derived.dirty_records(spark, sf_dir)).select("id", "reason")


# --- joins --------------------------------------------------------------------------


@query
def j1_metadata_lookup(spark, sf_dir):
    return _labelled_documents(spark, sf_dir).select("doc_id", "source", "structured")


@query
def j2_field_outer(spark, sf_dir):
    return evaluate.field_rows(_parsed_pairs(spark, sf_dir), *PAIR)


@query
def j2_nested_fields(spark, sf_dir):
    return evaluate.field_rows(_parsed_nested_pairs(spark, sf_dir), *PAIR)


@query
def j4_nested_missing(spark, sf_dir):
    return evaluate.missing_fields(_parsed_nested_pairs(spark, sf_dir), *PAIR)


@query
def j4_missing_fields(spark, sf_dir):
    return evaluate.missing_fields(_parsed_pairs(spark, sf_dir), *PAIR)


@query
def j5_pairwise_cosine(spark, sf_dir):
    matrix = evaluate.similarity_matrix(_parsed_pairs(spark, sf_dir), *PAIR)
    return matrix.select("pair_id", "left", "right", rounded("cosine", "cosine"))


@query
def j6_cross_block(spark, sf_dir):
    block = evaluate.similarity_block(_parsed_pairs(spark, sf_dir), *PAIR)
    return block.select("pair_id", "left", "right", rounded("cosine", "cosine"))


@query
def j6_block_embedded(spark, sf_dir):
    block = evaluate.similarity_block(_parsed_pairs(spark, sf_dir), *PAIR, embedder=md5_embedder)
    return block.select("pair_id", "left", "right", rounded("cosine", "cosine"))


# --- aggregations -------------------------------------------------------------------


@query
def a1_key_jaccard(spark, sf_dir):
    aligned = evaluate.with_fields(_parsed_pairs(spark, sf_dir), *PAIR[1:])
    return aligned.select("pair_id", rounded(fld.key_jaccard("fields"), "jaccard_similarity"))


@query
def a2_key_overlap(spark, sf_dir):
    overlap = evaluate.record_similarities(_parsed_pairs(spark, sf_dir), *PAIR, raw=False)
    return overlap.select("pair_id", rounded("key_similarity", "key_similarity"))


@query
def a3_value_match(spark, sf_dir):
    aligned = evaluate.with_fields(_parsed_pairs(spark, sf_dir), *PAIR[1:])
    return aligned.select("pair_id", rounded(fld.value_match("fields"), "value_similarity"))


@query
def a4_seq_mean(spark, sf_dir):
    aligned = evaluate.with_fields(_parsed_pairs(spark, sf_dir), *PAIR[1:])
    return aligned.select("pair_id", rounded(evaluate.mean_sequence_ratio("fields"), "textual_similarity_seq"))


def _value_arrays(spark, sf_dir):
    pairs = _parsed_pairs(spark, sf_dir)
    return pairs.select(
        "pair_id",
        evaluate.value_texts("expected_json", flat=True).alias("l_texts"),
        evaluate.value_texts("predicted_json", flat=True).alias("r_texts"),
    )


@query
def a5_tfidf_mean(spark, sf_dir):
    means = tfidf.mean_pair_tfidf(_value_arrays(spark, sf_dir), "pair_id", "l_texts", "r_texts")
    return means.select("pair_id", rounded("tfidf_mean", "tfidf_mean"))


@query
def a6_list_similarity(spark, sf_dir):
    ordered = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    lists = (
        derived.table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(ordered.alias("lines"))
        .select(
            "l_orderkey",
            F.parse_json(F.to_json(F.transform("lines", lambda x: x["l_quantity"]))).alias("l"),
            F.parse_json(
                F.to_json(F.transform(F.filter("lines", lambda x: x["l_quantity"] > 10), lambda x: x["l_linenumber"]))
            ).alias("r"),
        )
    )
    return lists.select("l_orderkey", rounded(similarity.list_similarity("l", "r"), "similarity"))


@query
def a7_decision_score(spark, sf_dir):
    scores = evaluate.decision_scores(_parsed_pairs(spark, sf_dir), *PAIR)
    return scores.select("pair_id", rounded("similarity_score", "similarity_score"))


@query
def a8_weighted_mape(spark, sf_dir):
    compared = evaluate.compare(_parsed_pairs(spark, sf_dir), *PAIR, score_div_100=True)
    return compared.select("pair_id", rounded("weighted_mape", "weighted_mape"))


@query
def a9_seq_budget(spark, sf_dir):
    docs = derived.table(spark, sf_dir, "documents")
    largest = training.sequence_budget(docs, "text").select(F.lit("all rows").alias("mode"), "tokens", "budget")
    first = training.sequence_budget(docs, "text", key="doc_id").select(F.lit("first row").alias("mode"), "tokens", "budget")
    return largest.unionByName(first)


@query
def a9_seq_percentiles(spark, sf_dir):
    return training.sequence_budgets(derived.table(spark, sf_dir, "documents"), "text", percentiles=(0.5, 0.95, 1.0))


@query
def a9_seq_sketch(spark, sf_dir):
    """Percentiles of sketches kept for each source: whether each one's true rank is within the stated error."""
    docs = derived.table(spark, sf_dir, "documents")
    budgets = training.sketch_budgets(training.token_sketch(docs, "text", by=("source",)))
    histogram = docs.select(text.token_count("text").alias("n")).where("n IS NOT NULL").groupBy("n").agg(F.count("*").alias("rows"))
    # three budgets at most meet each number of tokens
    ranked = histogram.join(F.broadcast(budgets)).groupBy("percentile").agg(
        (F.sum(F.when(F.col("n") < F.col("tokens"), F.col("rows")).otherwise(0)) / F.sum("rows")).alias("below"),
        (F.sum(F.when(F.col("n") <= F.col("tokens"), F.col("rows")).otherwise(0)) / F.sum("rows")).alias("reached"),
    )
    within = (F.col("below") <= F.col("percentile") + SKETCH_ERROR) & (F.col("reached") >= F.col("percentile") - SKETCH_ERROR)
    return ranked.select("percentile", within.alias("within"))


@query
def a11_signature(spark, sf_dir):
    docs = derived.table(spark, sf_dir, "documents")
    labels = derived.table(spark, sf_dir, "labels")
    return record_ops.table_signature(docs.join(labels, "doc_id", "left"))


@query
def a12_last_wins(spark, sf_dir):
    part = derived.table(spark, sf_dir, "part")
    record = F.to_json(
        F.struct(
            F.struct(F.col("p_size").alias("in cm"), F.col("p_type").alias("kind")).alias("size"),
            F.struct((F.col("p_size") + 1).alias("cm")).alias("size in"),
            F.col("p_name").alias("size kind"),
            F.col("p_brand").alias("brand"),
        )
    )
    parsed = part.select(F.col("p_partkey").alias("id"), records.parse_record(record).alias("record"))
    return evaluate.last_win_rows(parsed, "id", "record")


@query
def a14_mean_pool(spark, sf_dir):
    pooled = vectors.mean_pool(derived.table(spark, sf_dir, "embeddings"), "label", "embedding")
    places = pooled.select("label", F.posexplode("mean_vector").alias("pos", "mean"))
    return places.select("label", "pos", rounded("mean", "mean"))


@query
def a15_schema_profile(spark, sf_dir):
    return record_ops.schema_profile(derived.pairs(spark, sf_dir), "predicted_json")


@query
def a15_merged_schema(spark, sf_dir):
    merged = record_ops.merged_schema(derived.nested_pairs(spark, sf_dir), "predicted_json")
    return merged.withColumn("types", F.array_join("types", ","))


# --- row order ----------------------------------------------------------------------


@query
def w1_stop_first_bad(spark, sf_dir):
    formatted = training.format_training_data(derived.dirty_records(spark, sf_dir), on_error="stop")
    return formatted.select("id", "output", "preprocessed_input", "text")


@query
def w2_schema_carry(spark, sf_dir):
    formatted = training.format_training_data(derived.dirty_records(spark, sf_dir), on_error="stop")
    return formatted.select("id", "schema_str")


@query
def w1_stop_inside(spark, sf_dir):
    formatted = training.format_training_data(derived.dirty_records(spark, sf_dir, late=True), on_error="stop")
    return formatted.select("id", "output", "preprocessed_input", "text")


@query
def w2_schema_carry_inside(spark, sf_dir):
    formatted = training.format_training_data(derived.dirty_records(spark, sf_dir, late=True), on_error="stop")
    return formatted.select("id", "schema_str")


@query
def w3_split_exact(spark, sf_dir):
    return split.split_exact(derived.table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query
def w3_split_hash(spark, sf_dir):
    return derived.table(spark, sf_dir, "documents").select("doc_id", split.split_by_hash("doc_id").alias("split"))


@query
def w4_row_index(spark, sf_dir):
    events = derived.table(spark, sf_dir, "events").select("event_id", "event_type")
    return order.row_index(events, "event_id")


@query
def l1_input_example(spark, sf_dir):
    formatted = training.format_training_data(derived.dirty_records(spark, sf_dir))
    return order.first_rows(formatted.select("id", *tables.TRAINING_COLUMNS), "id")


@query
def l2_canonical(spark, sf_dir):
    pairs = derived.pairs(spark, sf_dir)
    return pairs.select(
        "pair_id", records.json_text(records.parse_record("predicted_json")).alias("canonical")
    )


@query
def l2_nested_canonical(spark, sf_dir):
    orders = derived.nested_records(spark, sf_dir)
    return orders.select("id", records.json_text(records.parse_record("record_json")).alias("canonical"))


# --- sets ---------------------------------------------------------------------------


@query
def x1_key_sets(spark, sf_dir):
    keys = _parsed_pairs(spark, sf_dir).select(
        "pair_id",
        F.map_keys(records.as_map("expected_json")).alias("l"),
        F.map_keys(records.as_map("predicted_json")).alias("r"),
    )

    def shown(value: Column, name: str) -> Column:
        return F.array_join(F.array_sort(value), ",").alias(name)

    return keys.select(
        "pair_id",
        shown(F.array_union("l", "r"), "all_keys"),
        shown(F.array_intersect("l", "r"), "common_keys"),
        shown(F.array_except("l", "r"), "left_only"),
        shown(F.array_except("r", "l"), "right_only"),
    )


# --- scalar functions ---------------------------------------------------------------


@query
def f1_repair(spark, sf_dir):
    return derived.dirty_records(spark, sf_dir).select("id", text.repair_record_text("output").alias("repaired"))


@query
def f2_quotes(spark, sf_dir):
    return derived.model_outputs(spark, sf_dir).select(
        "id", text.single_to_double_quotes("generated_output").alias("quoted")
    )


@query
def f3_first_object(spark, sf_dir):
    return derived.model_outputs(spark, sf_dir).select(
        "id", text.first_json_object("generated_output").alias("first_object")
    )


@query
def f4_strict_parse(spark, sf_dir):
    return derived.model_outputs(spark, sf_dir).select(
        "id", records.parse_record("generated_output").isNotNull().alias("parses")
    )


@query
def f5_parse_cascade(spark, sf_dir):
    return derived.model_outputs(spark, sf_dir).select(
        "id", records.json_text(records.parse_output("generated_output")).alias("record")
    )


def _renamed(spark, sf_dir, mapping, direction):
    record = records.as_map(records.parse_record("record_json"))
    renamed = records.rename_keys(record, mapping, direction)
    return derived.records(spark, sf_dir).select("id", records.map_json_text(renamed).alias("record"))


@query
def f6_rename_schema_to_json(spark, sf_dir):
    # a chain (p_type to p_kind to kind), a key that does not occur, and a collision (p_size to p_name)
    mapping = {"p_type": "p_kind", "p_kind": "kind", "absent": "x", "p_size": "p_name"}
    return _renamed(spark, sf_dir, mapping, "schema_to_json")


@query
def f6_rename_json_to_schema(spark, sf_dir):
    return _renamed(spark, sf_dir, MAPPING, "json_to_schema")


@query
def f7_type_names(spark, sf_dir):
    entries = derived.nested_records(spark, sf_dir).select(
        "id", F.explode_outer(F.map_entries(records.as_map(records.parse_record("record_json")))).alias("e")
    ).where("e IS NOT NULL")
    return entries.select("id", F.col("e.key").alias("key"), records.type_name(F.col("e.value")).alias("type"))


@query
def f8_schema_str(spark, sf_dir):
    record = records.as_map(records.parse_record("record_json"))
    return derived.nested_records(spark, sf_dir).select("id", records.schema_text(record).alias("schema_str"))


@query
def f9_flatten(spark, sf_dir):
    nested = derived.nested_records(spark, sf_dir).select("id", records.parse_record("record_json").alias("record"))
    return record_ops.explode_fields(nested, "record").select("id", "path", "type", "text")


@query
def f11_seq_ratio(spark, sf_dir):
    return derived.pairs(spark, sf_dir).select(
        "pair_id", rounded(similarity.sequence_ratio("expected_json", "predicted_json"), "ratio")
    )


@query
def f11_lev_ratio(spark, sf_dir):
    return derived.pairs(spark, sf_dir).select(
        "pair_id", rounded(similarity.levenshtein_ratio("expected_json", "predicted_json"), "ratio")
    )


@query
def f12_raw_similarity(spark, sf_dir):
    measured = evaluate.record_similarities(_parsed_pairs(spark, sf_dir), *PAIR)
    return measured.select("pair_id", rounded("key_similarity", "key_similarity"), rounded("raw_similarity", "raw_similarity"))


@query
def f13_char_overlap(spark, sf_dir):
    return derived.pairs(spark, sf_dir).select(
        "pair_id", rounded(similarity.char_overlap("expected_json", "predicted_json"), "overlap")
    )


@query
def f14_value_similarity(spark, sf_dir):
    both = _parsed_pairs(spark, sf_dir).select(
        "pair_id",
        F.explode_outer(F.map_entries(records.as_map("expected_json"))).alias("e"),
        records.as_map("predicted_json").alias("other"),
    )
    common = both.where(F.map_contains_key("other", F.col("e.key")))
    score = similarity.value_similarity(F.col("e.value"), F.element_at("other", F.col("e.key")))
    return common.select("pair_id", F.col("e.key").alias("key"), rounded(score, "similarity"))


@query
def f15_tokens(spark, sf_dir):
    tokenised = derived.table(spark, sf_dir, "documents").select("doc_id", text.tokens("text").alias("tokens"))
    return tokenised.select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens")
    )


@query
def f16_tfidf(spark, sf_dir):
    weights = tfidf.corpus_tfidf(derived.wide_table(spark, sf_dir, "documents"), "doc_id", "text")
    return weights.select("doc_id", "term", "tf", "df", rounded("tfidf", "tfidf"))


@query
def f18_tfidf_similarity(spark, sf_dir):
    cosines = tfidf.pair_tfidf(_value_arrays(spark, sf_dir), "pair_id", "l_texts", "r_texts")
    return cosines.select("pair_id", "pos", rounded("tfidf_cosine", "tfidf_cosine"))


@query
def f22_decisions(spark, sf_dir):
    details = evaluate.decision_details(_parsed_pairs(spark, sf_dir), *PAIR)
    return details.select("pair_id", "path", "decision")


@query
def f25_run_id(spark, sf_dir):
    events = derived.table(spark, sf_dir, "events")
    return events.select(
        "event_id", text.run_id("ts").alias("run_id"), text.run_path("runs/training", "event_type", "ts").alias("run_path")
    )


@query
def f27_pca(spark, sf_dir):
    points = vectors.principal_components(derived.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return points.select("vec_id", *[rounded(F.abs(f"pc{i}"), f"pc{i}") for i in (1, 2, 3)])


# --- user models --------------------------------------------------------------------


def length_generator(config: dict):
    """Stand-in for a model: answers with the length of the text in the prompt."""
    limit = config["max_new_tokens"]

    def answer(prompt_texts: list[str]) -> list[str]:
        found = [re.search(r"TEXT_DATA: (.*)\n            ---", p, re.DOTALL) for p in prompt_texts]
        return [f'Sure: {{"chars": {len(m.group(1))}, "limit": {limit}}}' for m in found]

    return answer


HASH_SIZE = 16


def md5_embedder():
    """Stand-in for an encoder: word counts at places given by the MD5 sum of the word."""
    word = re.compile(r"[^\W]+")

    def vectors_of(texts: list[str]) -> list[list[float]]:
        out = []
        for value in texts:
            counts = [0.0] * HASH_SIZE
            for w in word.findall(value.lower()):
                counts[int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % HASH_SIZE] += 1.0
            out.append(counts)
        return out

    return vectors_of


@query
def u1_batch_generate(spark, sf_dir):
    docs = derived.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("input"))
    prompted = training.format_training_data(docs, schema_str=SCHEMA_STR, key="doc_id")
    generated = python_batches.generate(prompted, length_generator, config={"max_new_tokens": 50})
    return generated.select("doc_id", "generated_output")


@query
def u1_generate_unprompted(spark, sf_dir):
    docs = derived.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("input"))
    schema = {"lang": "str", "source": "str"}
    generated = evaluate.generate_texts(docs, length_generator, schema, config={"max_new_tokens": 50})
    return generated.select("doc_id", "preprocessed_input", "generated_output")


@query
def u1_generate_kept(spark, sf_dir):
    docs = derived.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("input"))
    generated = evaluate.generate_texts(
        docs, length_generator, SCHEMA_STR, config={"max_new_tokens": 50}, path=scratch_path(spark, "texts"), version="length"
    )
    return generated.select("doc_id", "generated_output")


@query
def u2_embed_kept(spark, sf_dir):
    part = derived.table(spark, sf_dir, "part").select("p_partkey", prompts.field_text(F.lit("p_name"), "p_name").alias("field"))
    path = scratch_path(spark, "vectors")
    embedded = kept.embed_kept(part, "field", md5_embedder, path, "md5", spread_by=["p_partkey"], slices=4)
    shown = F.array_join(F.transform("vector", lambda v: v.cast("int").cast("string")), ",")
    return embedded.select("p_partkey", "field", shown.alias("vector"))


@query
def u2_embed_distinct(spark, sf_dir):
    part = derived.table(spark, sf_dir, "part").select("p_partkey", prompts.field_text(F.lit("p_name"), "p_name").alias("field"))
    embedded = python_batches.embed_distinct(part, "field", md5_embedder, spread_by=["p_partkey"])
    shown = F.array_join(F.transform("vector", lambda v: v.cast("int").cast("string")), ",")
    return embedded.select("p_partkey", "field", shown.alias("vector"))


# --- compositions -------------------------------------------------------------------


@query
def c0_build_pairs(spark, sf_dir):
    turns = derived.table(spark, sf_dir, "conversations")
    metadata = derived.label_records(spark, sf_dir).withColumnRenamed("doc_id", "conv_id")
    pairs = build.pairs_from_documents(turns, metadata, "conv_id", "turn", "text", "structured")
    return build.rename_pair_columns(pairs)


@query
def c1_training_text(spark, sf_dir):
    formatted = training.format_training_data(
        derived.dirty_records(spark, sf_dir), mapping=MAPPING, model_name="some-Instruct"
    )
    return formatted.select("id", "preprocessed_input", "output", "text", "schema_str")


@query
def c2_prepare(spark, sf_dir):
    prepared = training.prepare_training(derived.dirty_records(spark, sf_dir), scratch_path(spark, "prepared"))
    return prepared.dataset.select("id", "input", "output", "preprocessed_input", "text", "split")


@query
def c3_basic_similarity(spark, sf_dir):
    measured = evaluate.basic_similarities(_parsed_pairs(spark, sf_dir), *PAIR)
    return measured.select("pair_id", *[rounded(name, name) for name in measured.columns if name != "pair_id"])


@query
def c4_similarity_tfidf(spark, sf_dir):
    measured = evaluate.similarities_with_tfidf(_parsed_pairs(spark, sf_dir), *PAIR, sequence=False)
    return measured.select("pair_id", *[rounded(name, name) for name in measured.columns if name != "pair_id"])


@query
def c6_decision_detail(spark, sf_dir):
    details = evaluate.decision_details(_parsed_pairs(spark, sf_dir), *PAIR)
    return details.select("pair_id", "path", "l_text", "r_text", rounded("similarity", "similarity"), "decision")


@query
def c6_nested_detail(spark, sf_dir):
    details = evaluate.decision_details(_parsed_nested_pairs(spark, sf_dir), *PAIR)
    return details.select("pair_id", "path", "l_text", "r_text", rounded("similarity", "similarity"), "decision")


@query
def c7_nested_compare(spark, sf_dir):
    compared = evaluate.compare(_parsed_nested_pairs(spark, sf_dir), *PAIR)
    return compared.select("pair_id", *[rounded(name, name) for name in compared.columns if name != "pair_id"])


@query
def c6_decision_embedded(spark, sf_dir):
    details = evaluate.decision_details(_parsed_pairs(spark, sf_dir), *PAIR, embedder=md5_embedder)
    return details.select("pair_id", "path", rounded("similarity", "similarity"), "decision")


def _compared(spark, sf_dir):
    return evaluate.compare(_parsed_pairs(spark, sf_dir), *PAIR)


@query
def c7_compare(spark, sf_dir):
    compared = _compared(spark, sf_dir)
    return compared.select("pair_id", *[rounded(name, name) for name in compared.columns if name != "pair_id"])


@query
def c7_corpus(spark, sf_dir):
    summary = evaluate.corpus_summary(_compared(spark, sf_dir))
    return summary.select("pairs", *[rounded(name, name) for name in summary.columns if name != "pairs"])


@query
def c8_plot_points(spark, sf_dir):
    points = evaluate.plot_points(_parsed_pairs(spark, sf_dir), *PAIR)
    return points.select("pair_id", "label", *[rounded(name, name) for name in ("x", "y", "z")])


@query
def c9_evaluate(spark, sf_dir):
    scored = evaluate.evaluate_outputs(derived.model_outputs(spark, sf_dir), "id", "expected_json")
    return scored.select("id", *[rounded(name, name) for name in scored.columns if name != "id"])


@query
def training_pairs(spark, sf_dir):
    """Documents with their labels, packed into records and formatted as training rows."""
    docs = lookup.lookup(
        derived.table(spark, sf_dir, "documents"), derived.table(spark, sf_dir, "labels"), "doc_id", {}
    )
    packed = docs.select("doc_id", "text", "lang", "source", "quality", "toxic")
    record = record_ops.pack_record(packed.drop("doc_id"), "text")
    pairs = packed.select(F.col("doc_id").alias("id"), F.col("text").alias("input"), record.alias("output"))
    formatted = training.format_training_data(pairs, model_name="base", repair="safe")
    return formatted.select("id", *tables.TRAINING_COLUMNS)
