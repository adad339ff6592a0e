"""Model results kept by the text they were made from, so that no text goes to the model twice.

The results are a table in a shared folder, keyed by a digest of the text and of a `version` that names the model and
its settings. A run passes only the texts that the table lacks to the model and appends their results in slices, one job
each: a run that is broken off loses the slice it was in, and the next one goes on from there.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators.lookup import FREQUENT_KEYS, join_by_frequency
from recordloom.operators.python_batches import GENERATION_DEFAULTS, EmbedderFactory, GeneratorFactory, embed, generate
from recordloom.sources.scratch import scratch_path

SLICES = 16
KNOWN = -1
DIGEST = "_digest"


def digest(text: Column | str, version: str) -> Column:
    """128-bit digest of a text under a version, as text; null for a null text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.md5(F.concat(F.lit(version), F.lit("\0"), text))


def _stored(spark: SparkSession, path: str, values: str) -> DataFrame:
    """The table of results; made empty if there is none."""
    schema = f"{DIGEST} string, {values}"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def keep_results(
    df: DataFrame,
    text: str,
    path: str,
    version: str,
    values: str,
    compute: Callable[[DataFrame], DataFrame],
    spread_by: list[str],
    slices: int = SLICES,
) -> DataFrame:
    """Add the columns `values` (a DDL text), computed once per distinct text, ever, and kept under `path`.

    `compute` gets the rows (`_digest`, `text`) that are missing and returns (`_digest`, values). The call runs the
    jobs that fill the table; the result reads it. Texts are counted with partial aggregation, only digests are joined
    back, and the most frequent ones come from a broadcast of fixed size. One run at a time may fill a table.
    Null texts get null values.
    """
    if slices < 1:
        raise ValueError("slices must be at least 1")
    spark = df.sparkSession
    stored = _stored(spark, path, values)
    wanted = (
        df.where(F.col(text).isNotNull())
        .groupBy(digest(text, version).alias(DIGEST))
        .agg(F.any_value(text).alias("text"), F.count(F.lit(1)).alias("_n"))
    )
    known = wanted.join(stored.select(DIGEST, F.lit(True).alias("_known")), DIGEST, "left")
    slice_of = F.pmod(F.xxhash64(DIGEST), F.lit(slices)).cast("int")
    marked = known.select(
        DIGEST,
        F.when(F.col("_known").isNull(), F.col("text")).alias("text"),
        "_n",
        F.when(F.col("_known").isNull(), slice_of).otherwise(KNOWN).alias("_slice"),
    )
    todo = scratch_path(spark, "todo")
    marked.write.partitionBy("_slice").parquet(todo)
    listed = spark.read.schema(f"{DIGEST} string, text string, _n long, _slice int").parquet(todo)
    # a folder name for each slice, so at most `slices` rows
    for place in sorted(row[0] for row in listed.where(F.col("_slice") != KNOWN).select("_slice").distinct().collect()):
        rows = listed.where(F.col("_slice") == place).select(DIGEST, "text")
        spread = rows.repartition(spark.sparkContext.defaultParallelism, DIGEST)
        compute(spread).write.mode("append").parquet(path)
    filled = _stored(spark, path, values)
    names = [name for name in filled.columns if name != DIGEST]
    frequent = listed.orderBy(F.desc("_n"), DIGEST).limit(FREQUENT_KEYS).select(DIGEST)
    # a row without a text gets a key of its own that no text has, so such rows are spread
    own = F.concat(F.lit("none "), F.xxhash64(*spread_by).cast("string"))
    joined = join_by_frequency(
        df.withColumn(DIGEST, F.coalesce(digest(text, version), own)),
        filled,
        DIGEST,
        "_n",
        values=names,
        spread_by=spread_by,
        hot_values=filled.join(F.broadcast(frequent), DIGEST, "left_semi"),
    )
    return joined.drop(DIGEST)


def embed_kept(
    df: DataFrame, text: str, factory: EmbedderFactory, path: str, version: str, spread_by: list[str], slices: int = SLICES
) -> DataFrame:
    """Add `vector`; only texts without one under this `path` and `version` go to the model."""

    def compute(rows: DataFrame) -> DataFrame:
        return rows.select(DIGEST, embed("text", factory).alias("vector"))

    return keep_results(df, text, path, version, "vector array<float>", compute, spread_by, slices)


def generate_kept(
    df: DataFrame,
    factory: GeneratorFactory,
    path: str,
    version: str,
    spread_by: list[str],
    prompt: str = "preprocessed_input",
    output: str = "generated_output",
    config: dict | None = None,
    slices: int = SLICES,
) -> DataFrame:
    """Add one generated text per prompt; equal prompts share one text.

    The generation settings are part of the version: other settings generate anew.
    """
    settings = json.dumps({**GENERATION_DEFAULTS, **(config or {})}, sort_keys=True)

    def compute(rows: DataFrame) -> DataFrame:
        return generate(rows, factory, "text", output, config).select(DIGEST, output)

    return keep_results(df, prompt, path, f"{version} {settings}", f"`{output}` string", compute, spread_by, slices)
