"""Near-duplicate groups of texts by SimHash and a hierarchical index in Gray order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import cut, map_texts, text_bytes
from recordloom.llm.components import components

SEED = 42
FANOUT = 16
CROWDED = 4096
QUERY_ROWS = 2048
INDEX_ROWS = 200_000


def text_fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit fingerprint: each bit as in over half of the shingles' hashes; a text without words has 0."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        units = [b" ".join(words)]
    else:
        units = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(unit, SEED) for unit in units), np.uint64)
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].astype("<u8", copy=False)
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id long, fp long) for every row. Null and empty texts have fingerprint 0; other columns are not read."""

    def run(batch: pa.RecordBatch) -> dict:
        values = [text_fingerprint(value, shingle) for value in text_bytes(batch.column("text"))]
        return {"doc_id": batch.column("doc_id"), "fp": np.array(values, np.uint64).view(np.int64)}

    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_texts(narrow, "text", run, "doc_id long, fp long")


# --- index --------------------------------------------------------------------------


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each 64-bit pattern in the reflected Gray sequence."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchical index over keyed fingerprints, sorted by key and Gray rank.

    A node covers a run of `FANOUT` nodes below it within one key and keeps the bits on which all its
    fingerprints agree. Walking down from the roots, the differences of a query to a node's own bits are added to
    those found above; a whole node is left as soon as the sum exceeds the limit.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.lexsort((gray_rank(values), keys))
        self.order, self.keys, self.values = order, keys[order], values[order]
        full = ~np.uint64(0)
        level = (self.keys, self.values, np.full(len(values), full))
        self.levels = [level]
        self.starts: list[np.ndarray] = []
        while len(level[0]) and np.any(level[0][1:] == level[0][:-1]):
            keys_below, pattern, mask = level
            first = np.r_[True, keys_below[1:] != keys_below[:-1]]
            head = np.flatnonzero(first)
            place = np.arange(len(keys_below)) - np.repeat(head, np.diff(np.r_[head, len(keys_below)]))
            starts = np.flatnonzero(place % FANOUT == 0)
            ones = np.bitwise_and.reduceat(pattern & mask, starts)
            zeros = np.bitwise_and.reduceat(~pattern & mask, starts)
            level = (keys_below[starts], ones, ones | zeros)
            self.levels.append(level)
            self.starts.append(np.r_[starts, len(keys_below)])

    def links(self, limit: int) -> np.ndarray:
        """A forest over sorted positions that joins all fingerprints of a key linked by up to `limit` bits."""
        size = len(self.values)
        label = np.arange(size)
        top_keys, top_pattern, top_mask = self.levels[-1]
        root_of = np.searchsorted(top_keys, self.keys)
        for begin in range(0, size, QUERY_ROWS):
            query = np.arange(begin, min(begin + QUERY_ROWS, size))
            node = root_of[query]
            known = top_mask[node]
            spent = np.bitwise_count((self.values[query] ^ top_pattern[node]) & known).astype(np.int64)
            uniform = self._uniform(label)
            for depth in range(len(self.levels) - 1, 0, -1):
                keep = spent <= limit
                keep &= uniform[depth][node] != label[query]  # the whole node already hangs together with the query
                query, node, known, spent = query[keep], node[keep], known[keep], spent[keep]
                starts = self.starts[depth - 1]
                width = starts[node + 1] - starts[node]
                step = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                child = np.repeat(starts[node], width) + step
                query, known, spent = (np.repeat(part, width) for part in (query, known, spent))
                _, pattern, mask = self.levels[depth - 1]
                spent = spent + np.bitwise_count((self.values[query] ^ pattern[child]) & mask[child] & ~known)
                node, known = child, mask[child]
            keep = (spent <= limit) & (label[query] != label[node])
            label = _merge(label, query[keep], node[keep])
        return label

    def _uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """For each node the label its whole range shares, or -1."""
        low = high = label
        found = [label]
        for starts in self.starts:
            low, high = np.minimum.reduceat(low, starts[:-1]), np.maximum.reduceat(high, starts[:-1])
            found.append(np.where(low == high, low, -1))
        return found


def _merge(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels after joining the groups of the given pairs; a label is the smallest position of its group."""
    while len(left):
        a, b = label[left], label[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while True:
            next_label = label[label]
            if np.array_equal(next_label, label):
                break
            label = next_label
        open_ = label[left] != label[right]
        left, right = left[open_], right[open_]
    return label


# --- routing ------------------------------------------------------------------------


def _dealt(keyed: DataFrame, width: int, parts: int) -> DataFrame:
    """(fp, key, rest) to one row for each of `parts` ranges of the `width` bits in `rest`.

    The range extends the key and leaves `rest`. Values that differ in fewer bits than there are ranges agree on
    one range at least, so they meet under one of the new keys.
    """
    size = width // parts
    options = []
    for i in range(parts):
        low = i * size
        own = width - low if i == parts - 1 else size
        value = F.shiftrightunsigned("rest", low).bitwiseAND((1 << own) - 1)
        above = F.shiftleft(F.shiftrightunsigned("rest", low + own), low) if low + own < 64 else F.lit(0)
        rest = above.bitwiseOR(F.col("rest").bitwiseAND((1 << low) - 1))
        options.append(F.struct(F.xxhash64("key", F.lit(i), value).alias("key"), rest.alias("rest")))
    return keyed.select("fp", F.explode(F.array(*options)).alias("o")).select("fp", "o.key", "o.rest")


def keyed(values: DataFrame, limit: int, crowd: int = CROWDED, depth: int = 3) -> DataFrame:
    """(fp, key): fingerprints at most `limit` bits apart share a key.

    A key that more than `crowd` fingerprints share is dealt again by ranges of its remaining bits, so no pair is
    lost and no task gets the crowd; what shares all keys after `depth` rounds differs in 27 bits at most.
    """
    width, parts = 64, limit + 1
    found = _dealt(values.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest")), width, parts)
    done = []
    for _ in range(depth - 1):
        width -= width // parts
        if width < parts:
            break
        crowded = cut(found.groupBy("key").count().where(F.col("count") > crowd).select("key"), "crowded")
        if crowded.isEmpty():
            break
        done.append(found.join(crowded, "key", "left_anti").select("fp", "key"))
        found = _dealt(found.join(crowded, "key", "left_semi"), width, parts)
    for part in done:
        found = found.select("fp", "key").unionAll(part)
    return found.select("fp", "key")


def links(values: DataFrame, limit: int = 3, crowd: int = CROWDED) -> DataFrame:
    """Distinct fingerprints (fp) to (u, v): a forest for each key that joins all fingerprints within the limit."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def joined(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        held = pa.Table.from_batches(rows)
        index = GrayIndex(held.column("key").to_numpy(), held.column("fp").to_numpy().view(np.uint64))
        label = index.links(limit)
        moved = np.flatnonzero(label != np.arange(len(label)))
        own = index.values.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(own[moved]), pa.array(own[label[moved]])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            keys = batch.column("key").to_numpy()
            if size >= INDEX_ROWS:  # rows come sorted: what is held can end where the key changes
                last = rows[-1].column("key")[-1].as_py()
                cutting = int(np.searchsorted(keys, last, side="right"))
                rows.append(batch.slice(0, cutting))
                if cutting < len(keys):
                    yield joined(rows)
                    rows, size = [], 0
                batch = batch.slice(cutting)
            if batch.num_rows:
                rows.append(batch)
                size += batch.num_rows
        if rows:
            yield joined(rows)

    routed = keyed(values, limit, crowd).repartition("key").sortWithinPartitions("key")
    return routed.mapInArrow(run, "u long, v long")


def near_groups(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 3, limit: int = 3
) -> DataFrame:
    """One row for each row of the table: (doc_id, fp, component_id, root).

    Fingerprints link at `limit` or fewer differing bits; component_id is the smallest id that can be reached and
    root the smallest fingerprint. Texts without words (null, empty, blank) share fingerprint 0 and so form a
    group. Repeated rows come out as often as they went in; a null id never becomes a component id unless the
    group has no other. An empty table gives an empty result.
    """
    marked = cut(fingerprints(docs, id_column, text, shingle), "fingerprints")
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = components(links(first.select("fp"), limit))
    tree = first.join(linked.withColumnRenamed("u", "fp"), "fp", "left")
    tree = tree.select("fp", "first", F.coalesce("v", "fp").alias("root"))
    smallest = tree.groupBy("root").agg(F.min("first").alias("component_id"))
    named = tree.join(smallest, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id", "root")
