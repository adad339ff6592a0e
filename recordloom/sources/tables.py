"""Tables written by the package: training tables and split exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The columns of a training table, in order.
TRAINING_COLUMNS = ("input", "preprocessed_input", "output", "text")


def table_from_rows(spark: SparkSession, rows: Sequence, schema: T.StructType | str) -> DataFrame:
    """A small metadata table from rows at hand, with an explicit schema."""
    return spark.createDataFrame(rows, schema)


def spread_few_splits(df: DataFrame) -> DataFrame:
    """Spread a scan of fewer splits than there are cores over all of them.

    Row-wise work on a table in one small file would otherwise run on one core. A table with
    more splits than cores, any large one, is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_training_table(df: DataFrame, path: str, fmt: str = "parquet", keep: Sequence[str] = ()) -> None:
    """Overwrite a training table with its four columns, and with `keep` in front of them.

    Any format the session has a package for can be named, among them ``delta``. The
    session stays open.
    """
    df.select(*keep, *TRAINING_COLUMNS).write.format(fmt).mode("overwrite").save(path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def export_splits(df: DataFrame, path: str, split: str = "split", fmt: str = "parquet") -> None:
    """Write every row once, in one folder per split value; ``json`` gives JSON Lines.

    Reading the folder gives the full set, reading a sub-folder (or filtering on the split
    column, which prunes the others) gives one part.
    """
    df.write.partitionBy(split).format(fmt).mode("overwrite").save(path)
