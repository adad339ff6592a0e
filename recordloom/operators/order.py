"""Row order without a global sort: consecutive row numbers and first rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EXAMPLE_ROWS = 5


def row_index(df: DataFrame, key: str, name: str = "row") -> DataFrame:
    """Number the rows 0, 1, 2, … in the order of a unique numeric key.

    The key range is cut at quantiles, rows are numbered inside each slice and shifted by
    the number of rows in the slices before it. Only the cut points and one count per slice
    are global; both are as many as there are shuffle partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.approxQuantile(key, [i / parts for i in range(1, parts)], 0.001))) if parts > 1 else []
    bounds = F.array(*[F.lit(cut) for cut in cuts]) if cuts else F.array().cast("array<double>")
    part = F.size(F.filter(bounds, lambda cut: cut < F.col(key)))
    counts = df.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return (
        df.withColumn("_part", part)
        .withColumn("_inside", inside)
        .join(F.broadcast(shifts), "_part")
        .withColumn(name, F.col("_shift") + F.col("_inside"))
        .select(*df.columns, name)
    )


def first_rows(df: DataFrame, key: str, n: int = EXAMPLE_ROWS) -> DataFrame:
    """The first `n` rows by key: an example of the input or a preview."""
    return df.orderBy(key).limit(n)


def row_at(df: DataFrame, key: str, value: int | None = None) -> DataFrame:
    """The row with the given key, or the one with the least key."""
    return df.where(F.col(key) == value) if value is not None else first_rows(df, key, 1)
