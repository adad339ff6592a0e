"""Near copies of texts by the exact Jaccard similarity of their word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm import simhash
from recordloom.llm.common import BATCH_SETTING, cut, map_texts, pieces
from recordloom.llm.components import components

SEED = 42
SHINGLE = 5
# similarity that links two texts, as a fraction
SHARE, OF = 4, 5
# shingles in `COMMON` or more of one in `SAMPLE` texts come last in the order of shingles; this bears on speed only
SAMPLE, COMMON, COMMON_KEPT = 16, 4, 100_000
# keys, of 16 bytes and a few numbers, that may be sent to every executor; more go through a shuffle
BROADCAST_KEYS = 500_000
# 64-bit words of the parities of a set, by which its distance from another set is bounded from below
WORDS = 8
# rows of a shingle that are set against each other in one group; more are dealt out in blocks
GROUP_ROWS = 2_000
# texts taken at once; their sets of shingles are larger than they are
PIECE_BYTES = 1 << 20
ROWS_AT_ONCE = "400"


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words, without case; fewer words are one run, no words none."""
    words = [word.encode("utf-8", "replace") for word in (text or "").lower().split()]
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        units = [b" ".join(words)]
    else:
        units = map(b" ".join, zip(*(islice(words, i, None) for i in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(unit, SEED) for unit in units), np.uint64))


def _node(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.astype("<u8").tobytes(), digest_size=16).digest()


def _parities(found: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each of `WORDS` * 64 places.

    Two sets differ in at least as many shingles as their parities differ in places.
    """
    counts = np.bincount((found % np.uint64(WORDS * 64)).astype(np.int64), minlength=WORDS * 64)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _common(keyed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of a sample of the texts, sorted, and their counts."""

    def run(batch: pa.RecordBatch) -> dict:
        values = [shingles(text).view(np.int64) for text in batch.column("text").to_pylist()]
        return {"token": np.concatenate(values) if values else []}

    some = keyed.where(F.xxhash64("__row") % SAMPLE == 0).select("text").distinct()
    counts = map_texts(some, "text", run, "token long", PIECE_BYTES).groupBy("token").count().where(F.col("count") >= COMMON)
    rows = counts.orderBy(F.desc("count"), "token").limit(COMMON_KEPT).collect()
    tokens = np.array([row[0] for row in rows], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.array([row[1] for row in rows], np.int64)[order]


def _nodes(keyed: DataFrame) -> DataFrame:
    """One row for each distinct set of shingles: (id, n, prefix, parities, SimHash fingerprint, first row that has it).

    All sets are sorted in one order. Two sets as similar as asked share a shingle among the first
    n - ceil(n * share) + 1 of each, whatever the order is.
    """
    common, counts = _common(keyed)

    def run(batch: pa.RecordBatch) -> dict:
        made: dict[str, list] = {"node": [], "n": [], "fp": [], "prefix": [], "parities": []}
        for text in batch.column("text").to_pylist():
            found = shingles(text)
            rank = np.zeros(len(found), np.int64)
            if len(common):
                place = np.minimum(np.searchsorted(common, found), len(common) - 1)
                rank = np.where(common[place] == found, counts[place], 0)
            n = len(found)
            kept = n - -(-n * SHARE // OF) + 1 if n else 0
            made["node"].append(_node(found))
            made["n"].append(n)
            made["fp"].append(_fingerprint(text))
            made["parities"].append(_parities(found))
            made["prefix"].append(found[np.lexsort((found, rank))[:kept]].view(np.int64))
        return made | {"__row": batch.column("__row"), "doc_id": batch.column("doc_id")}

    schema = "node binary, n int, fp long, prefix array<long>, parities array<long>, __row binary, doc_id long"
    marked = map_texts(keyed.select("__row", "doc_id", "text"), "text", run, schema, PIECE_BYTES)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("first")
    same = [F.first(name).alias(name) for name in ("n", "prefix", "parities")]
    sets = marked.groupBy("node").agg(first, *same, F.min("fp").alias("fp"))
    # the numbers are written with the rows, so they stay the same when a task is run again
    return cut(sets.select(F.monotonically_increasing_id().alias("id"), "n", "prefix", "parities", "fp", "first"), "nodes")


def _fingerprint(text: str | None) -> int:
    value = simhash.text_fingerprint((text or "").encode("utf-8", "replace"), SHINGLE)
    return value - (1 << 64) if value >> 63 else value


def _fingerprint_links(nodes: DataFrame) -> DataFrame:
    """Candidates (u, v) of SimHash: every node with the first of those its fingerprint reaches in the Gray-order index."""
    found = components(simhash.links(nodes.select("fp").distinct())).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = nodes.select("id", "fp").join(found, "fp", "left").select("id", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("id").alias("v"))
    return rooted.join(first, "root").where("id <> v").select(F.col("id").alias("u"), "v")


def _may_link(a: str, b: str) -> Column:
    """Whether two sets can be similar enough if the shingle at the given places is the first they share."""
    n_a, n_b = F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
    most = F.least(n_a - F.col(f"{a}.place"), n_b - F.col(f"{b}.place"))
    return _similar(most, n_a, n_b)


def _similar(common: Column, n_a: Column, n_b: Column) -> Column:
    return common * (SHARE + OF) >= (n_a + n_b) * SHARE


def _may_be_similar(a: str, b: str) -> Column:
    """Whether the parities of two sets leave it open that the sets are similar enough."""
    apart = sum(F.bit_count(F.col(f"{a}.parities")[i].bitwiseXOR(F.col(f"{b}.parities")[i])) for i in range(WORDS))
    n = F.col(f"{a}.n").cast("long") + F.col(f"{b}.n")
    # |A| + |B| = 2 * common + apart
    return apart * (SHARE + OF) <= n * (OF - SHARE)


def _candidates(apart: DataFrame) -> DataFrame:
    """Pairs (u, v) of rows (token, id, n, place, root, parities, blocks) of one token, of different roots, that may be similar.

    A token of several `blocks` is dealt out over blocks * blocks groups; each pair of its rows meets in one of them.
    """

    def met(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        a, b = a.alias("a"), b.alias("b")
        same = [F.col(f"a.{name}") == F.col(f"b.{name}") for name in on]
        open_ = (F.col("a.id") > F.col("b.id")) & (F.col("a.root") != F.col("b.root"))
        pairs = a.join(b, [*same, open_, _may_link("a", "b"), _may_be_similar("a", "b")])
        return pairs.select(F.col("a.id").alias("u"), F.col("b.id").alias("v"))

    few, many = apart.where("blocks = 1"), apart.where("blocks > 1")
    own, every = F.pmod(F.xxhash64("id"), "blocks"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = many.select("*", own.alias("line"), every.alias("column"))
    right = many.select("*", every.alias("line"), own.alias("column"))
    return met(few, few, ["token"]).unionAll(met(left, right, ["token", "line", "column"])).distinct()


def _small(table: DataFrame, weight: Column | None = None) -> DataFrame:
    """A table of keys with a broadcast hint if its rows (or the sum of `weight`) are few; it is written and counted."""
    table = cut(table, "keys")
    held = table.agg(F.sum(F.lit(1) if weight is None else weight)).first()[0] or 0
    return F.broadcast(table) if held <= BROADCAST_KEYS else table


def _sets_of(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, others, tokens): the shingles of the texts whose rows `wanted` (__row, id, others) names.

    The texts stay where they are as long as the names may be broadcast. Of equal rows each task answers one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answered: set[int] = set()
        for piece in pieces(batches, "text", PIECE_BYTES):
            fresh = [i for i, one in enumerate(piece.column("id").to_pylist()) if one not in answered and not answered.add(one)]
            piece = piece.take(pa.array(fresh, pa.int64()))
            tokens = [shingles(text).view(np.int64) for text in piece.column("text").to_pylist()]
            columns = [piece.column("id"), piece.column("others"), pa.array(tokens, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "others", "tokens"])

    texts = keyed.select("__row", "text").join(wanted, "__row").select("id", "others", "text")
    return texts.mapInArrow(run, "id long, others array<long>, tokens array<long>")


def _confirmed(pairs: DataFrame, nodes: DataFrame, keyed: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) of nodes whose sets of shingles are similar enough.

    Both sets of a pair meet by v: that of u goes there from the scan of the texts, once for each v.
    """
    rows = nodes.select("id", F.col("first.__row").alias("__row"))
    asking = pairs.groupBy("u").agg(F.collect_set("v").alias("others")).withColumnRenamed("u", "id").join(rows, "id")
    asked = pairs.select(F.col("v").alias("id")).distinct().join(rows, "id")
    asked = asked.withColumn("others", F.lit(None).cast("array<long>"))
    asking = _small(asking, F.size("others"))
    left = _sets_of(keyed, asking).select(F.col("id").alias("u"), F.explode("others").alias("v"), F.col("tokens").alias("a"))
    right = _sets_of(keyed, _small(asked)).select(F.col("id").alias("v"), F.col("tokens").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    both = left.join(right, "v").where(_similar(common, F.size("a"), F.size("b")))
    return both.select("u", "v").distinct()


def _kept_only(keyed: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows whose keys are kept, equal rows once.

    The keys to leave out, and those of equal rows, are few next to the texts: as long as they may be broadcast no text
    is shuffled but those of equal rows.
    """
    copies = keyed.groupBy("__row").agg(F.count("*").alias("copies"))
    known = copies.join(kept.withColumn("kept", F.lit(True)), "__row", "left")
    listed = cut(known.where("kept IS NULL OR copies > 1").select("__row", F.col("kept").isNotNull().alias("repeated")), "listed")
    if listed.count() > BROADCAST_KEYS:
        return keyed.join(kept, "__row", "left_semi").dropDuplicates(["__row"])
    single = keyed.join(F.broadcast(listed), "__row", "left_anti")
    repeated = keyed.join(F.broadcast(listed.where("repeated").select("__row")), "__row", "left_semi")
    return single.unionAll(repeated.dropDuplicates(["__row"]))


def first_rows(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The table with one row for each group of near copies: that with the smallest id, a null id last.

    Texts link at a Jaccard similarity of 4/5 or more of their sets of five-word shingles (hashes of 64 bits), without
    case; linked texts form groups. Texts of fewer words link if their words are the same; texts without words
    (null, empty, blank) form one group. Ids may be null or repeated: rows are told apart by all their columns,
    and repeated rows count once. An empty table gives an empty result.

    No similar pair is lost: candidates have near SimHash fingerprints, or share a shingle in the prefixes of their sets
    (a similarity of 4/5 leaves about ten bits apart, more than the index of fingerprints reaches), and each is confirmed. What
    hangs together after texts were set against one other text for each shingle is not compared again; of the rest, pairs
    whose sets differ too much by the parities of their shingles are no candidates. Shuffles carry
    numbers of rows and shingles; a text moves only when keys are too many to be broadcast (`BROADCAST_KEYS`).
    """
    docs.sparkSession.conf.set(BATCH_SETTING, ROWS_AT_ONCE)
    # a null field is left out of the JSON text, so it differs from any value
    row = F.substring(F.unhex(F.sha2(F.to_json(F.struct(*docs.columns)), 256)), 1, 16)
    names = [F.col(f"`{name}`") for name in docs.columns]
    keyed = docs.select(row.alias("__row"), F.struct(*names).alias("__fields"))
    narrow = docs.select(row.alias("__row"), F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    nodes = _nodes(narrow)
    # both branches read the same columns, so one shuffle serves the counts and the join
    placed = nodes.select("id", "n", F.posexplode("prefix").alias("place", "token")).repartition("token")
    # the text with the fewest rarer shingles before a shared one is the nearest to all others
    least = placed.groupBy("token").agg(F.min_by("id", "place").alias("least"), F.count("n").alias("held"), F.max("place").alias("last"))
    shared = cut(placed.join(least.where("held > 1 AND last >= 0").select("token", "least"), "token"), "shared")
    # one text for each shingle against the others
    hub = shared.where("id = least").alias("h")
    others = shared.where("id <> least").alias("o")
    star = others.join(hub, F.col("o.token") == F.col("h.token")).where(_may_link("o", "h"))
    star = star.select(F.col("o.id").alias("u"), F.col("h.id").alias("v"))
    star = cut(star.unionAll(_fingerprint_links(nodes)).distinct(), "star")
    linked = cut(_confirmed(star, nodes, narrow), "linked")
    # those still apart against each other
    rooted = components(linked).select(F.col("u").alias("id"), F.col("v").alias("root"))
    apart = shared.join(rooted, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = apart.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("held"))
    mixed = mixed.where("low <> high").select("token", F.ceil(F.col("held") / GROUP_ROWS).alias("blocks"))
    apart = cut(apart.join(mixed, "token").join(nodes.select("id", "parities"), "id"), "apart")
    rest = _candidates(apart)
    rest = cut(rest.join(star, ["u", "v"], "left_anti"), "rest")
    found = components(linked.unionAll(_confirmed(rest, nodes, narrow))).withColumnRenamed("u", "id")
    groups = nodes.select("id", "first").join(found, "id", "left").groupBy(F.coalesce("v", "id").alias("root"))
    kept = groups.agg(F.min("first").alias("first")).select(F.col("first.__row").alias("__row"))
    return _kept_only(keyed, cut(kept, "kept")).select("__fields.*")
