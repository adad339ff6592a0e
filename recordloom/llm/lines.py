"""Repeated lines, sentences and paragraphs across documents: the earliest stays, later ones are cut out."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import cut, pieces

UNITS = {
    "line": re.compile(r"[^\n]+"),
    "sentence": re.compile(r"[^\n.!?]*(?:[.!?]+(?![\s.!?])[^\n.!?]*)*[.!?]*"),
    "paragraph": re.compile(r"(?:(?!\n[ \t\r]*\n)[\s\S])+"),
}
MIN_WORDS = 1
MIN_RUN = 1
# a unit that makes up more than one in so many units is looked up in a broadcast; there are fewer such units than this
HOT_SHARE = 1000

Unit = tuple[int, int, int, bytes]


def units(text: str, unit: str, min_words: int) -> list[Unit]:
    """Start, end, number of words and digest of each unit of at least `min_words` words; case and white space make no
    difference, and white space at either end belongs to no unit."""
    found = []
    for match in UNITS[unit].finditer(text):
        whole = match.group()
        words = whole.lower().split()
        if len(words) >= max(1, min_words):
            digest = hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=16).digest()
            start = match.start() + len(whole) - len(whole.lstrip())
            found.append((start, match.start() + len(whole.rstrip()), len(words), digest))
    return found


def long_runs(spans: list[dict], min_run: int) -> list[dict]:
    """The repeated units, in order, that stand in a row of neighbours of `min_run` words or more together."""
    found, run, words = [], [], 0
    for span in spans:
        if run and span["place"] != run[-1]["place"] + 1:
            found += run if words >= min_run else []
            run, words = [], 0
        run.append(span)
        words += span["words"]
    return found + (run if words >= min_run else [])


def without_spans(text: str, spans: list[dict]) -> str:
    """The text without the units; blanks after one go along, and the line break if nothing of its line is left."""
    kept, done, line_start = [], 0, True
    for span in spans:
        part = text[done : span["start"]]
        kept.append(part)
        if part:
            line_start = part.endswith("\n") or (line_start and not part.strip())
        done = span["end"]
        while text[done : done + 1] in (" ", "\t", "\r"):
            done += 1
        if line_start and text[done : done + 1] == "\n":
            done += 1
    return "".join([*kept, text[done:]])


def _unit_rows(docs: DataFrame, unit: str, min_words: int) -> DataFrame:
    keys = [("id", pa.int64()), ("hash", pa.int64()), ("none", pa.bool_())]
    own = [("place", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("digest", pa.binary())]
    schema = pa.schema(keys + own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows = [
                (*key, place, start, end, words, digest)
                for text, *key in zip(*(batch.column(name).to_pylist() for name in ("text", "id", "hash", "none")), strict=True)
                for place, (start, end, words, digest) in enumerate(units(text or "", unit, min_words))
            ]
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    ddl = "id long, hash long, none boolean, place int, start int, end int, words int, digest binary"
    return docs.select("text", "id", "hash", "none").mapInArrow(run, ddl)


def _later(found: DataFrame) -> DataFrame:
    """Units that also occur earlier, with the place of the earliest: (id, hash, span)."""
    rank = F.struct("none", "id", "start", "hash")
    first = found.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = cut(first, "first")
    hot = first.where(F.col("n") * HOT_SHARE > found.count())
    served = found.join(F.broadcast(hot), "digest")
    rare = found.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    joined = served.unionAll(rare.join(first.join(F.broadcast(hot.select("digest")), "digest", "left_anti"), "digest"))
    own = F.struct("none", "id", "start", "hash")
    place = F.struct(
        "place",
        "start",
        "end",
        "words",
        F.when(~F.col("first.none"), F.col("first.id")).alias("first_doc"),
        F.col("first.start").alias("first_start"),
    )
    return joined.where(own != F.col("first")).select("id", "hash", place.alias("span"))


def without_repeats(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    unit: str = "line",
    min_words: int = MIN_WORDS,
    min_run: int = MIN_RUN,
) -> DataFrame:
    """(doc_id, text, removed array of (start, end, first_doc, first_start)) for every row.

    Units (lines, sentences, which end at a line break too, or paragraphs) of one word or more are compared unless
    `min_words` asks for more; shorter ones and blank ones stay. Of equal units the one with the smallest (id, offset)
    stays, a null id last. A later one goes if it and the later ones next to it have `min_run` words or more together,
    so that with a `min_run` of some size common short units stay and repeated passages go. The spans give its place in
    the original text, and where the unit stays (null for a row without an id). A line of which nothing is left goes
    with its line break. Words are parted by white space.

    Rows that repeat entirely (id and text) share one rank and lose the same units. Null texts stay null, empty ones
    empty; an empty table gives an empty result; other columns are not read. A unit's earliest place is pre-aggregated
    before its shuffle, units that occur once leave after that. Units that are more than one in `HOT_SHARE` of all are
    fewer than that and broadcast, so no task of the join meets more than that share of the rows for one unit.
    """
    key = F.col(id_column).cast("long")
    narrow = docs.select(
        key.alias("doc_id"),
        F.col(text).alias("text"),
        F.coalesce(key, F.xxhash64(F.lit("no id"), F.col(text))).alias("id"),
        F.xxhash64(F.col(text)).alias("hash"),
        key.isNull().alias("none"),
    )
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first_doc", pa.int64()), ("first_start", pa.int32())])
    removed_type = "array<struct<start:int,end:int,first_doc:long,first_start:int>>"
    later = _later(cut(_unit_rows(narrow, unit, min_words), "units"))
    # a span comes once for each repeated row of its document
    grouped = later.groupBy("id", "hash").agg(F.sort_array(F.collect_set("span")).alias("spans"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [long_runs(spans, min_run) for spans in batch.column("spans").to_pylist()]
            rows = [place for place, spans in enumerate(kept) if spans]
            found = pa.array([[{f.name: span[f.name] for f in kind} for span in kept[i]] for i in rows], pa.list_(kind))
            some = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column("id"), some.column("hash"), found], names=["id", "hash", "removed"])

    spans = cut(grouped.mapInArrow(runs, f"id long, hash long, removed {removed_type}"), "spans")
    joined = narrow.join(spans, ["id", "hash"], "left").select("doc_id", "text", "removed")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            removed = [spans or [] for spans in batch.column("removed").to_pylist()]
            texts = [
                without_spans(value, spans) if spans else value
                for value, spans in zip(batch.column("text").to_pylist(), removed, strict=True)
            ]
            columns = [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(removed, pa.list_(kind))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "removed"])

    return joined.mapInArrow(rewrite, f"doc_id long, text string, removed {removed_type}")
