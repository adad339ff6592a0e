"""Train and evaluation split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.columns import as_column

# Default share of evaluation rows and seed.
TEST_SIZE = 0.3
SEED = 1738

TRAIN = "train"
EVAL = "eval"
BUCKET_DIGITS = 5  # hexadecimal digits: 16 ** 5 buckets
RESOLUTION = 10_000


def _hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def split_exact(df: DataFrame, key: str, test_size: float = TEST_SIZE, seed: int = SEED) -> DataFrame:
    """Add `split` so that exactly ``ceil(test_size * n)`` rows are evaluation rows.

    The rows with the least hash of (seed, key) are chosen, without sorting the table: a
    histogram over about a million hash buckets tells the bucket in which the limit falls,
    and only the keys of that one bucket are ranked. The rows then compare themselves with
    the limit, so the full-width table is neither shuffled nor sorted. Keys must be unique.
    """
    hashed = df.select(
        F.struct(_hash(F.col(key), seed).alias("hash"), F.col(key).alias("key")).alias("rank_by")
    ).withColumn("bucket", F.substring("rank_by.hash", 1, BUCKET_DIGITS))
    counts = hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # One row per bucket, so this window sees a fixed number of rows at any table size.
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    limit = (
        counts.withColumn("upto", F.sum("n").over(upto))
        .withColumn("wanted", F.ceil(F.lit(float(test_size)) * F.sum("n").over(everything)))
        .where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted")))
        .select(F.struct("bucket", (F.col("wanted") - F.col("upto") + F.col("n")).alias("place")).alias("limit"))
    ).scalar()
    last = (
        hashed.where(F.col("bucket") == limit["bucket"])
        .withColumn("place", F.row_number().over(Window.orderBy("rank_by")))
        .where(F.col("place") == limit["place"])
        .select("rank_by")
    )
    own = F.struct(_hash(F.col(key), seed).alias("hash"), F.col(key).alias("key"))
    return df.withColumn("split", F.when(own <= last.scalar(), EVAL).otherwise(TRAIN))


def split_by_hash(
    key: Column | str, test_size: float = TEST_SIZE, seed: int = SEED
) -> Column:
    """Split label from the row alone: about `test_size` of the rows, no pass over the table."""
    place = F.conv(F.substring(_hash(as_column(key), seed), 1, 8), 16, 10).cast("bigint") % RESOLUTION
    return F.when(place < round(test_size * RESOLUTION), EVAL).otherwise(TRAIN)
