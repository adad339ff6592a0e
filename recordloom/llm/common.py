"""Helpers the operators share: reading tables, cutting lineage, Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.sources.scratch import scratch_path

BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = "2000"
PIECE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; batches sent to Python are kept to a number of rows that long texts allow."""
    spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the plan above starts from the files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(key: Column | str, divisor: int) -> Column:
    """crc32 of the key as text, modulo a divisor; a null key counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(divisor)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a piece hold about `limit` bytes; a longer text is a piece of its own."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for row, length in enumerate(lengths):
            if held and held + length > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += length
        if start < batch.num_rows:
            yield batch.slice(start)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow form of a Spark DDL schema of the simple types used here."""
    kinds = {
        "long": pa.int64(),
        "int": pa.int32(),
        "double": pa.float64(),
        "string": pa.string(),
        "binary": pa.binary(),
        "boolean": pa.bool_(),
        "array<long>": pa.list_(pa.int64()),
        "array<int>": pa.list_(pa.int32()),
        "array<double>": pa.list_(pa.float64()),
        "array<string>": pa.list_(pa.string()),
    }
    return pa.schema([(part.split()[0], kinds[part.split()[1]]) for part in schema.split(", ")])


def map_texts(
    df: DataFrame, text: str, function: Callable[[pa.RecordBatch], dict], schema: str, limit: int = PIECE_BYTES
) -> DataFrame:
    """Apply a function to pieces of a table; it returns one list or array for each column of the schema."""
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text, limit):
            found = function(piece)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[field.name], type=field.type) for field in target], schema=target
            )

    return df.mapInArrow(run, schema)
