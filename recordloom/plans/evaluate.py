"""Scoring predicted records against expected ones.

A table of pairs has a unique key and two VARIANT columns. Fields are aligned inside the
row (see `recordloom.functions.fields`), so the measures, the decisions and the weighted
error come out of the scan stage without a shuffle. Only a plugged-in embedder needs to
move data.

Arrays become rows by the outer generators: for the inner ones the optimizer adds a filter on
the size of the array below them, which computes the whole array a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.columns import let, over
from recordloom.functions.fields import (
    COMPARE_THRESHOLD,
    DECISION_THRESHOLD,
    LEAVES_TYPE,
    ON_BOTH_SIDES,
    TO_COMPARE,
    align_fields,
    decision_score,
    decision_sql,
    key_jaccard,
    key_overlap,
    last_wins,
    value_match,
    weighted_error,
)
from recordloom.functions.prompts import field_text
from recordloom.functions.records import (
    as_map,
    flatten_record,
    json_text,
    parse_output,
    parse_record,
    top_level_fields,
)
from recordloom.functions.similarity import (
    FIELD_BAG_COSINE,
    dense_cosine,
    dot_sql,
    norm,
    sequence_ratio,
    sequence_ratios,
    sparse_cosine_sql,
    sparse_dot_sql,
)
from recordloom.operators.kept import generate_kept
from recordloom.operators.python_batches import EmbedderFactory, GeneratorFactory, embed_distinct, generate
from recordloom.operators.records import explode_pairs
from recordloom.functions.tfidf import mean_cosine, pair_tfidf
from recordloom.operators.vectors import LEFT, RIGHT, cosine_table, labelled_words, pair_points
from recordloom.plans.training import with_prompt

# Recommended weights of the four measures.
RECOMMENDED_WEIGHTS = {
    "jaccard_similarity": 0.48,
    "value_similarity": 0.04,
    "textual_similarity_seq": 0.0,
    "similarity_score": 0.48,
}


def parse_pairs(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Replace two JSON text columns by the records in them."""
    return df.withColumns({expected: parse_record(expected), predicted: parse_record(predicted)})


def with_fields(
    pairs: DataFrame, left: str, right: str, flat: bool = True
) -> DataFrame:
    """Add `fields`, the aligned fields of the two records; a null record counts as empty."""

    def leaves(record: str) -> Column:
        found = flatten_record(record) if flat else top_level_fields(record)
        return F.coalesce(found, F.array().cast(LEAVES_TYPE))

    return pairs.withColumn("fields", align_fields(leaves(left), leaves(right)))


def field_rows(pairs: DataFrame, key: str, left: str, right: str, **options) -> DataFrame:
    """Full outer match of the fields of each pair as rows: key, path and both values."""
    return with_fields(pairs, left, right, **options).select(key, F.inline_outer("fields")).where("path IS NOT NULL")


def missing_fields(pairs: DataFrame, key: str, left: str, right: str, **options) -> DataFrame:
    """Fields that one of the two records lacks, with the side that lacks it."""
    rows = field_rows(pairs, key, left, right, **options)
    side = F.when(F.col("l_type").isNull(), LEFT).when(F.col("r_type").isNull(), RIGHT)
    return rows.select(key, "path", side.alias("missing_in")).where(F.col("missing_in").isNotNull())


def last_win_rows(df: DataFrame, key: str, record: str) -> DataFrame:
    """One row per path of each record; on equal paths the last value stands."""
    leaves = last_wins(flatten_record(record))
    return df.select(key, F.inline_outer(leaves)).where("path IS NOT NULL")


# --- basic similarities -------------------------------------------------------------


def mean_sequence_ratio(fields: str, autojunk: bool = True) -> Column:
    """Mean sequence ratio of the values of common fields; 0 when there are none.

    Equal values count 1 without being sent to Python.
    """
    differing = f"filter({fields}, f -> {TO_COMPARE})"
    scores = sequence_ratios(
        F.expr(f"transform({differing}, f -> f.l_text)"), F.expr(f"transform({differing}, f -> f.r_text)"), autojunk
    )
    return over(
        lambda scores, common: f"""if({common} > 0,
            (aggregate({scores}, 0D, (total, x) -> total + x) + {common} - size({scores})) / {common}, 0D)""",
        scores=scores,
        common=F.expr(f"size(filter({fields}, f -> {ON_BOTH_SIDES}))"),
    )


def basic_similarities(
    pairs: DataFrame, key: str, left: str, right: str, flat: bool = True, sequence: bool = True, **options
) -> DataFrame:
    """Key, value and text similarity of each pair."""
    aligned = with_fields(pairs, left, right, flat, **options)
    measures = {
        "jaccard_similarity": key_jaccard("fields"),
        "value_similarity": value_match("fields"),
    }
    if sequence:
        measures["textual_similarity_seq"] = mean_sequence_ratio("fields")
    return aligned.select(key, *[value.alias(name) for name, value in measures.items()])


def value_texts(record: str, flat: bool = False) -> Column:
    """Texts of the values of a record in the order of its keys."""
    leaves = last_wins(flatten_record(record)) if flat else top_level_fields(record)
    return F.coalesce(leaves.getField("text"), F.array().cast("array<string>"))


def similarities_with_tfidf(
    pairs: DataFrame, key: str, left: str, right: str, flat: bool = False, sequence: bool = True
) -> DataFrame:
    """`basic_similarities` on unflattened records, with the mean TF-IDF similarity of their values.

    Everything comes out of the row: the leaves of both records are taken once, for the fields and for the texts.
    """

    def leaves(record: str) -> Column:
        found = last_wins(flatten_record(record)) if flat else top_level_fields(record)
        return F.coalesce(found, F.array().cast(LEAVES_TYPE))

    taken = pairs.select(key, leaves(left).alias("_l"), leaves(right).alias("_r"))
    aligned = taken.select(
        key,
        align_fields("_l", "_r").alias("fields"),
        pair_tfidf(F.col("_l").getField("text"), F.col("_r").getField("text")).alias("_cosines"),
    )
    measures = {
        "jaccard_similarity": key_jaccard("fields"),
        "value_similarity": value_match("fields"),
    }
    if sequence:
        measures["textual_similarity_seq"] = mean_sequence_ratio("fields")
    tfidf = F.coalesce(mean_cosine("_cosines"), F.lit(0.0)).alias("textual_similarity_tfidf")
    return aligned.select(key, *[value.alias(name) for name, value in measures.items()], tfidf)


def record_similarities(pairs: DataFrame, key: str, left: str, right: str, raw: bool = True) -> DataFrame:
    """Top-level key overlap and sequence ratio of the sorted JSON texts; both 0 when a record is empty."""

    def keys(record: str) -> Column:
        return F.coalesce(F.map_keys(as_map(record)), F.array().cast("array<string>"))

    measured = pairs.select(
        key, left, right, keys(left).alias("_l"), keys(right).alias("_r")
    )
    overlap = key_overlap("_l", "_r").alias("key_similarity")
    if not raw:
        return measured.select(key, overlap)
    usable = (F.size("_l") > 0) & (F.size("_r") > 0)
    texts = [
        F.when(usable, json_text(record, item_sep=", ", key_sep=": ")).alias(name)
        for record, name in ((left, "l"), (right, "r"))
    ]
    # through a generator: inside one projection the function would be given the whole expression to evaluate
    written = measured.select(key, overlap, F.explode_outer(F.array(F.struct(*texts))).alias("_texts"))
    ratio = F.coalesce(sequence_ratio(F.col("_texts.l"), F.col("_texts.r")), F.lit(0.0))
    return written.select(key, "key_similarity", ratio.alias("raw_similarity"))


# --- decisions ----------------------------------------------------------------------


def with_decisions(
    pairs: DataFrame,
    key: str,
    left: str,
    right: str,
    threshold: float = DECISION_THRESHOLD,
    embedder: EmbedderFactory | None = None,
    **options,
) -> DataFrame:
    """Add `decisions`, one STRUCT<path, l_text, r_text, similarity, decision> per field of each pair.

    Values are compared by the cosine of their word counts or, with an embedder, of their
    vectors. Only fields found on both sides with different values are compared at all.
    """
    aligned = with_fields(pairs, left, right, **options)
    if embedder is None:
        return aligned.withColumn("decisions", F.expr(_decisions_sql(threshold, FIELD_BAG_COSINE)))
    scored = aligned.join(_embedded_scores(aligned, key, embedder), key, "left")
    looked_up = "element_at(_scores, f.path)"
    return scored.withColumn("decisions", F.expr(_decisions_sql(threshold, looked_up))).drop("_scores")


def _similarity_sql(similarity: str) -> str:
    """Similarity of the two values of an aligned field `f`, null where one is missing."""
    return f"CASE WHEN {TO_COMPARE} THEN {similarity} WHEN f.l_text = f.r_text THEN 1D END"


def _decisions_sql(threshold: float, similarity: str) -> str:
    score = _similarity_sql(similarity)
    row = f"""struct(f.path AS path, f.l_text AS l_text, f.r_text AS r_text, score AS similarity,
        {decision_sql("score", threshold)} AS decision)"""
    return f"transform(fields, f -> {let(score, 'score', row)})"


def _embedded_scores(aligned: DataFrame, key: str, embedder: EmbedderFactory) -> DataFrame:
    fields = aligned.select(key, F.expr(f"explode_outer(filter(fields, f -> {TO_COMPARE})) AS f"))
    fields = fields.where("f IS NOT NULL")
    texts = F.array(
        *[
            F.struct(F.lit(side).alias("side"), field_text(F.col("f.path"), F.col(f"f.{side}_text")).alias("text"))
            for side in ("l", "r")
        ]
    )
    rows = fields.select(key, F.col("f.path").alias("path"), F.inline_outer(texts))
    vectors = embed_distinct(rows, "text", embedder, spread_by=[key, "path", "side"])
    sides = vectors.groupBy(key, "path").agg(
        F.max(F.when(F.col("side") == "l", F.col("vector"))).alias("l"),
        F.max(F.when(F.col("side") == "r", F.col("vector"))).alias("r"),
    )
    cosine = dense_cosine("l", "r", norm("l"), norm("r"))
    entries = F.collect_list(F.struct("path", cosine.alias("cosine")))
    return sides.groupBy(key).agg(F.map_from_entries(entries).alias("_scores"))


def decision_details(
    pairs: DataFrame,
    key: str,
    left: str,
    right: str,
    threshold: float = DECISION_THRESHOLD,
    embedder: EmbedderFactory | None = None,
    flat: bool = True,
) -> DataFrame:
    """One row per field of each pair with both values, their similarity and the decision.

    Without an embedder nothing of other fields is needed, so the fields are opened to rows and decided there.
    """
    if embedder is not None or not flat:
        decided = with_decisions(pairs, key, left, right, threshold, embedder, flat=flat)
        return decided.select(key, F.inline_outer("decisions")).where("path IS NOT NULL")
    rows = explode_pairs(pairs.select(key, left, right), left, right)
    scored = rows.alias("f").selectExpr("*", f"{_similarity_sql(FIELD_BAG_COSINE)} AS similarity")
    decision = F.expr(decision_sql("similarity", threshold)).alias("decision")
    return scored.alias("f").select(key, "path", "l_text", "r_text", "similarity", decision)


def _score(decisions: str = "decisions") -> Column:
    return decision_score(decisions)


def decision_scores(pairs: DataFrame, key: str, left: str, right: str, **options) -> DataFrame:
    """Share of the fields of each pair whose decision counts as correct."""
    return with_decisions(pairs, key, left, right, **options).select(key, _score().alias("similarity_score"))


def compare(
    pairs: DataFrame,
    key: str,
    left: str,
    right: str,
    weights: dict[str, float] | None = None,
    threshold: float = COMPARE_THRESHOLD,
    embedder: EmbedderFactory | None = None,
    sequence: bool | None = None,
    score_div_100: bool = False,
    **options,
) -> DataFrame:
    """All measures of each pair and their weighted error.

    The sequence ratio is left out when its weight is 0, unless `sequence` asks for it.
    `score_div_100` divides the decision score by 100 once more before its error is taken.
    """
    weights = dict(RECOMMENDED_WEIGHTS if weights is None else weights)
    if sequence is None:
        sequence = weights.get("textual_similarity_seq") != 0
    decided = with_decisions(pairs, key, left, right, threshold, embedder, **options)
    measures = {
        "jaccard_similarity": key_jaccard("fields"),
        "value_similarity": value_match("fields"),
        "similarity_score": _score(),
    }
    if sequence:
        measures["textual_similarity_seq"] = mean_sequence_ratio("fields")
    measured = decided.select(key, *[value.alias(name) for name, value in measures.items()])
    metrics = {name: F.col(name) for name in measures}
    if score_div_100:
        metrics["similarity_score"] = metrics["similarity_score"] / 100
    if not sequence and weights.get("textual_similarity_seq") not in (None, 0):
        raise ValueError("textual_similarity_seq has a weight, so it must be computed")
    return measured.withColumn("weighted_mape", weighted_error(metrics, weights))


def corpus_summary(compared: DataFrame) -> DataFrame:
    """Mean of every measure over a compared table, with the number of pairs."""
    measures = [
        f.name for f in compared.schema.fields if f.dataType.simpleString() == "double"
    ]
    return compared.agg(F.count(F.lit(1)).alias("pairs"), *[F.avg(name).alias(name) for name in measures])


# --- data behind plots --------------------------------------------------------------


WORD_COSINE = sparse_cosine_sql("l.vector", "r.vector")
DENSE_COSINE = f"if(l.norm > 0 AND r.norm > 0, {dot_sql('l.vector', 'r.vector')} / (l.norm * r.norm), 0D)"


def _with_vectors(pairs: DataFrame, key: str, left: str, right: str, embedder: EmbedderFactory | None = None) -> DataFrame:
    """Key and the labelled vectors of both sides, `_l` and `_r`: exact word counts, or vectors of an embedder."""
    sides = ((left, LEFT, "_l"), (right, RIGHT, "_r"))
    if embedder is None:
        vectors = [labelled_words(last_wins(flatten_record(record)), side).alias(name) for record, side, name in sides]
        return pairs.select(key, *vectors)
    listed = [
        over(
            lambda leaves, side=side, name=name: f"""transform(coalesce({leaves}, CAST(array() AS {LEAVES_TYPE})), (x, i) ->
                struct('{name}' AS side, i AS place, concat(x.path, ' ({side})') AS label, concat(x.path, ': ', x.text) AS text))""",
            leaves=last_wins(flatten_record(record)),
        )
        for record, side, name in sides
    ]
    rows = pairs.select(key, F.inline_outer(F.concat(*listed)))
    embedded = embed_distinct(rows, "text", embedder, spread_by=[key, "side", "place"])
    entry = F.struct("place", "label", "vector", norm("vector").alias("norm"))
    held = [F.sort_array(F.collect_list(F.when(F.col("side") == name, entry))).alias(name) for _, _, name in sides]
    return embedded.groupBy(key).agg(*held)


def similarity_matrix(
    pairs: DataFrame, key: str, left: str, right: str, embedder: EmbedderFactory | None = None
) -> DataFrame:
    """Cosine of every field of both records with every other, as rows."""
    both = _with_vectors(pairs, key, left, right, embedder).select(key, F.concat("_l", "_r").alias("_all"))
    return cosine_table(both, key, "_all", "_all", DENSE_COSINE if embedder else WORD_COSINE)


def similarity_block(
    pairs: DataFrame, key: str, left: str, right: str, embedder: EmbedderFactory | None = None
) -> DataFrame:
    """The part of `similarity_matrix` that sets the left fields against the right ones."""
    both = _with_vectors(pairs, key, left, right, embedder)
    return cosine_table(both, key, "_l", "_r", DENSE_COSINE if embedder else WORD_COSINE)


def plot_points(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Three coordinates for every field of each pair, from the principal components of the pair's word counts."""
    both = _with_vectors(pairs, key, left, right).select(key, F.concat("_l", "_r").alias("_all"))
    products = f"transform(_all, l -> transform(_all, r -> CAST({sparse_dot_sql('l.vector', 'r.vector')} AS DOUBLE)))"
    # through a generator: inside one projection the function would be given the whole expression to evaluate
    multiplied = both.select(key, "_all", F.explode_outer(F.array(F.expr(products))).alias("_products"))
    placed = multiplied.withColumn("_points", pair_points("_products", 3))
    rows = """inline_outer(zip_with(_all, _points,
        (f, p) -> struct(f.label AS label, p[0] AS x, p[1] AS y, p[2] AS z)))"""
    return placed.select(key, F.expr(rows)).where("label IS NOT NULL")


# --- from model outputs -------------------------------------------------------------


def evaluate_outputs(
    df: DataFrame,
    key: str,
    expected: str,
    generated: str = "generated_output",
    mapping: dict[str, str] | None = None,
    **options,
) -> DataFrame:
    """Parse generated texts and compare them with the expected JSON; unparsable ones count as empty records.

    `mapping` renames the keys of the generated records to those of the expected ones first.
    """
    predicted = parse_output(generated, mapping).alias("_predicted")
    pairs = df.select(key, parse_record(expected).alias("_expected"), predicted)
    return compare(pairs, key, "_expected", "_predicted", **options)


def generate_texts(
    df: DataFrame,
    factory: GeneratorFactory,
    schema: str | dict = "",
    model_name: str = "",
    config: dict | None = None,
    path: str | None = None,
    version: str = "",
    spread_by: list[str] | None = None,
) -> DataFrame:
    """Prompts where the table has none, and one generated text per row.

    With a `path` the texts are kept there under `version`, and only prompts that have none go to the model.
    """
    prompted = with_prompt(df, schema, model_name)
    if path is None:
        return generate(prompted, factory, config=config)
    return generate_kept(prompted, factory, path, version, spread_by or df.columns[:1], config=config)


def generate_and_evaluate(
    df: DataFrame,
    key: str,
    expected: str,
    factory: GeneratorFactory,
    config: dict | None = None,
    schema: str | dict = "",
    **options,
) -> DataFrame:
    """Generate a text per row and score it; rows without prompts get one that shows `schema`."""
    return evaluate_outputs(generate_texts(df, factory, schema, config=config), key, expected, **options)
