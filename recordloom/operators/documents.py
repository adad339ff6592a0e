"""Documents from their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.text import chunks


def join_pages(parts: DataFrame, document: str, pos: str, text: str) -> DataFrame:
    """One row per document: its parts in order, joined by a blank.

    Each result is one cell, so a document must fit a cell; nothing else is gathered.
    """
    ordered = F.array_sort(F.collect_list(F.struct(pos, text)))
    joined = F.array_join(F.transform(ordered, lambda part: part[text]), " ")
    return parts.groupBy(document).agg(joined.alias(text))


def split_into_chunks(df: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """One row per overlapping piece of each text."""
    pieces = df.select(key, F.posexplode_outer(chunks(text, size, overlap)).alias("pos", "chunk"))
    return pieces.where("pos IS NOT NULL")
