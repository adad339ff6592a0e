"""From documents and metadata, or from a wide table, to pairs of text and record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.text import strip_apostrophes
from recordloom.operators.documents import join_pages
from recordloom.operators.lookup import lookup
from recordloom.operators.records import pack_record

EMPTY_RECORD_TEXT = "{}"


def pairs_from_documents(
    pages: DataFrame, records: DataFrame, document: str, pos: str, text: str, record: str
) -> DataFrame:
    """Pages joined into documents, apostrophes removed, each with its record or an empty one."""
    documents = join_pages(pages, document, pos, text).withColumn("raw", strip_apostrophes(text))
    found = lookup(
        documents.select(document, "raw"),
        records.select(document, F.col(record).alias("structured")),
        document,
        {"structured": F.lit(EMPTY_RECORD_TEXT)},
    )
    return found.select(document, "raw", "structured")


def pairs_from_table(df: DataFrame, text: str, null_as: str | None = None) -> DataFrame:
    """The text column next to a record packed from all the other columns."""
    return df.select(F.col(text).alias("raw"), pack_record(df, text, null_as).alias("structured"))


def rename_pair_columns(pairs: DataFrame) -> DataFrame:
    return pairs.withColumnsRenamed({"raw": "input", "structured": "output"})
