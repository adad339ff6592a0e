"""Folders of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.columns import as_column


def scan_documents(
    spark: SparkSession,
    path: str,
    suffix: str = ".pdf",
    decoder_factory: Callable[[], Callable[[bytes], list[str]]] | None = None,
) -> DataFrame:
    """One row per page of every file in a folder whose name ends in `suffix` (case matters).

    Sub-folders are not visited. `decoder_factory` is called once per Python worker and gives
    a function from the bytes of a file to its pages; without it a file is one page of UTF-8
    text and no Python is involved.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*{suffix}")
        .load(path)
        .select(F.col("_metadata.file_name").alias("file_name"), "content")
    )
    if decoder_factory is None:
        return files.select("file_name", F.lit(0).alias("pos"), F.decode("content", "UTF-8").alias("text"))

    @F.pandas_udf("array<string>")
    def pages(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decode = decoder_factory()
        for batch in batches:
            yield batch.map(lambda content: list(decode(content)))

    decoded = files.select("file_name", F.posexplode_outer(pages("content")).alias("pos", "text"))
    return decoded.where("pos IS NOT NULL")


def has_suffix(name: Column | str, suffix: str) -> Column:
    """The same file-name test for tables that hold the documents already; it reaches the scan."""
    return F.endswith(as_column(name), F.lit(suffix))


def file_name(path: Column | str) -> Column:
    return F.substring_index(as_column(path), "/", -1)
