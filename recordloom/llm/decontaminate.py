"""Benchmark passages in documents, by one Aho-Corasick scan of the normalised text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import pieces, text_bytes

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BENCHMARK_BYTES = 32 << 20


def normal_words(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def windows(text: bytes, size: int) -> list[bytes]:
    """All runs of `size` words of a benchmark text; a shorter text that has words is one window."""
    words = normal_words(text)
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class Scanner:
    """The automaton over all windows. Texts are searched as Latin-1, one character a byte, with a blank at each
    end of each word, so that windows match whole words only and offsets count bytes."""

    def __init__(self, items: list[tuple[int, bytes]], size: int) -> None:
        owners: dict[bytes, set[int]] = {}
        for item, text in items:
            for window in windows(text, size):
                owners.setdefault(window, set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for window, names in owners.items():
            padded = f" {window.decode('latin-1')} "
            self.automaton.add_word(padded, (len(padded), window.count(b" ") + 1, sorted(names)))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def scan(self, text: bytes) -> tuple[int, list[int], list[int], list[int]]:
        """Number of words; starts and ends (exclusive) of hit runs of words; items found."""
        words = normal_words(text)
        if self.empty or not words:
            return len(words), [], [], []
        line = f" {b' '.join(words).decode('latin-1')} "
        found = [(end + 1 - length, count, names) for end, (length, count, names) in self.automaton.iter(line)]
        if not found:
            return len(words), [], [], []
        blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        first = np.searchsorted(blanks, np.array([start for start, _, _ in found])).tolist()
        runs = sorted((start, start + count) for start, (_, count, _) in zip(first, found, strict=True))
        starts, ends = [runs[0][0]], [runs[0][1]]
        for start, end in runs[1:]:
            if start <= ends[-1]:
                ends[-1] = max(ends[-1], end)
            else:
                starts.append(start)
                ends.append(end)
        return len(words), starts, ends, sorted({name for _, _, names in found for name in names})


def word_offsets(text: bytes, starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    """Character offsets in the original text of runs of words."""
    if not starts:
        return [], []
    spans = [match.span() for match in WORD.finditer(text.lower())]
    cuts = sorted({spans[i][0] for i in starts} | {spans[i - 1][1] for i in ends})
    places, done, count = {}, 0, 0
    for place in cuts:
        count += len(text[done:place].decode("utf-8", "replace"))
        places[place], done = count, place
    return [places[spans[i][0]] for i in starts], [places[spans[i - 1][1]] for i in ends]


def benchmark_parts(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[tuple[list[tuple[int, bytes]], bool]]:
    """Benchmark texts in parts of bounded size, and whether a part is the last; a part is what one automaton holds and
    one broadcast carries."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("text"))
    items = items.where("item IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-2 * total // limit)) if total > limit else 1
    for part in range(parts):
        rows = items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        yield [(row.item, row.text.encode()) for row in rows.collect()], part == parts - 1


def _merged(first: tuple, second: tuple) -> tuple[int, list[int], list[int], list[int]]:
    """The union of what two automata found in one text."""
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted(zip((*first[1], *second[1]), (*first[2], *second[2]), strict=True)):
        if starts and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return second[0], starts, ends, sorted({*first[3], *second[3]})


FOUND = (
    ("n_words", "long", pa.int64()),
    ("starts", "array<int>", pa.list_(pa.int32())),
    ("ends", "array<int>", pa.list_(pa.int32())),
    ("char_starts", "array<int>", pa.list_(pa.int32())),
    ("char_ends", "array<int>", pa.list_(pa.int32())),
    ("items", "array<long>", pa.list_(pa.int64())),
)
HIDDEN = "__scan_"


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = 10,
    limit: int = BENCHMARK_BYTES,
) -> DataFrame:
    """The rows of a table with a struct `scan`: word count, hit runs of words, characters they cover, items found.

    Texts are lower-cased (A-Z) and cut into words of digits, letters and all that is not ASCII. `size` words of
    an item that stand in a row in a text are a hit, as is a whole item of fewer words. Null and empty texts have
    no words; an empty benchmark, null item ids and items without words hit nothing; repeated items count once.
    Columns of the table keep their names; a column called `scan` is replaced. One automaton holds the benchmark;
    beyond `limit` bytes it is cut into several, which scan in turn, so that no broadcast grows with it. No
    shuffle: rows stay in place, and repeated rows come out as often as they went in.
    """
    kept = [name for name in docs.columns if name != "scan"]
    found = docs.select(*kept)
    for items, _ in benchmark_parts(benchmark, item_id, item_text, limit):
        found = _scan_part(found, kept, text, docs.sparkSession.sparkContext.broadcast(items), size)
    return found.select(*kept, F.struct(*(F.col(HIDDEN + name).alias(name) for name, _, _ in FOUND)).alias("scan"))


def _without(value: str | None, starts: list[int], ends: list[int]) -> str | None:
    """The text without the characters between starts and ends."""
    if not starts:
        return value
    return "".join(value[start:end] for start, end in zip([0, *ends], [*starts, len(value)], strict=True))


def _scan_part(docs: DataFrame, kept: list[str], text: str, items, size: int, cut_out: bool = False) -> DataFrame:
    """Columns `kept` with what was found so far; or, to `cut_out`, with the passages taken from the texts instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(items.value, size)
        for batch in pieces(batches, text):
            columns: dict[str, list] = {name: [] for name, _, _ in FOUND}
            before = None
            if HIDDEN + "starts" in batch.schema.names:
                before = [batch.column(HIDDEN + name).to_pylist() for name in ("n_words", "starts", "ends", "items")]
            for row, value in enumerate(text_bytes(batch.column(text))):
                result = scanner.scan(value)
                if before:
                    result = _merged(tuple(part[row] for part in before), result)
                chars = word_offsets(value, result[1], result[2])
                for name, part in zip(columns, (*result[:3], *chars, result[3]), strict=True):
                    columns[name].append(part)
            arrays = [batch.column(name) for name in kept]
            if cut_out:
                runs = zip(batch.column(text).to_pylist(), columns["char_starts"], columns["char_ends"], strict=True)
                arrays[kept.index(text)] = pa.array([_without(*row) for row in runs], type=pa.string())
                yield pa.RecordBatch.from_arrays(arrays, names=kept)
                continue
            arrays += [pa.array(columns[name], type=kind) for name, _, kind in FOUND]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *(HIDDEN + name for name in columns)])

    if cut_out:
        return docs.mapInArrow(run, docs.select(*kept).schema)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields]
    fields += [f"{HIDDEN}{name} {kind}" for name, kind, _ in FOUND]
    return docs.mapInArrow(run, ", ".join(fields))


def without_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = 10,
    limit: int = BENCHMARK_BYTES,
) -> DataFrame:
    """The table with the hit passages cut out of the texts; texts without a hit (and nulls) stay as they are.

    The scan of the last part of the benchmark cuts as well, so a text goes to Python once for each part.
    """
    found, kept = docs, docs.columns
    for items, last in benchmark_parts(benchmark, item_id, item_text, limit):
        found = _scan_part(found, kept, text, docs.sparkSession.sparkContext.broadcast(items), size, last)
    return found
