"""How filters interact: what each removes, and what another would have removed before it, for every order of them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The five filters in the order of their mask bits, and their limits.
FILTERS = "ABCDE"
MIN_WORDS = 50
DISTINCT_PERCENT = 65
CAPITAL_PERCENT = 5
WORD_GAPS = r"[\x20\x09-\x0D]+"
CAPITALS = "[^A-Z]+"
MARKS = r"[#$%&*|]"

MAX_FILTERS = 8


def text_failures(text: Column) -> Column:
    """Bits of the filters that look at one text alone: short, repetitive, capitals, marks; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, WORD_GAPS), lambda word: word != "")
    # The lengths come out of one evaluation of the words: a struct inside an array that is opened again.
    counted = F.transform(
        F.array(words), lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct"))
    )
    capitals = F.length(F.regexp_replace(text, CAPITALS, ""))

    def bits(counts: Column) -> Column:
        checks = (
            counts["words"] < MIN_WORDS,
            counts["distinct"].cast("long") * 100 < counts["words"].cast("long") * DISTINCT_PERCENT,
            capitals.cast("long") * 100 > F.length(text).cast("long") * CAPITAL_PERCENT,
            F.rlike(text, F.lit(MARKS)),
        )
        return reduce(Column.__add__, (F.when(check, 1 << i).otherwise(0) for i, check in enumerate(checks)))

    return F.get(F.transform(counted, bits), F.lit(0))


def mask_counts(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of each part fail each set of filters, and their labels.

    Bit i of the mask is set if filter i of `FILTERS` fails. A null part or text counts as empty. A document fails E if
    its text is that of a smaller id anywhere in the table; a null id is neither smaller nor larger than another. It is
    good or toxic if a label row of its id says so. Texts are compared by their SHA-256 sums. No group of copies meets
    in one task: rows are counted by sum, part and labels before the smallest id of a sum is looked up, and texts are read
    once.
    """
    narrow = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("digest"),
        text_failures(F.col(text)).cast("byte").alias("mask"),
    )
    marks = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.col("quality") == 1).alias("good"),
        (F.col("toxic") == 1).alias("toxic"),
    )
    marks = marks.where("good OR toxic").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    flags = [F.coalesce(F.col(name), F.lit(False)).alias(name) for name in ("good", "toxic")]
    labelled = narrow.join(marks, "doc_id", "left").select("doc_id", "part", "digest", "mask", *flags)
    # Rows with the same id and text are one row with a count, so the smallest id of a group carries how often it stands.
    rows = labelled.groupBy("doc_id", "digest", "part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    groups = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without_id"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("low"),
    )
    # One row for each part and label of a text is left, so no window holds more rows than that, whatever its copies.
    placed = groups.withColumn("first_id", F.min("low.doc_id").over(Window.partitionBy("digest")))
    first = F.col("without_id") + F.when(F.col("low.doc_id") == F.col("first_id"), F.col("low.n")).otherwise(0)
    split = placed.select(
        "part", "good", "toxic",
        F.inline(F.array(
            F.struct(F.col("mask").cast("int").alias("mask"), first.alias("n")),
            F.struct((F.col("mask") + 16).cast("int").alias("mask"), (F.col("n") - first).alias("n")),
        )),
    ).where("n > 0")
    return split.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


class RemovalRanks:
    """For every order of k filters and every failure mask: the step that removes a document, k + 1 for none."""

    def __init__(self, k: int) -> None:
        self.orders = np.array(list(permutations(range(k))), np.int64)
        # Inverse permutations: positions[order, filter] is the step at which the filter comes.
        positions = np.argsort(self.orders, axis=1) + 1
        bits = np.arange(1 << k)[:, None] >> np.arange(k) & 1
        # Min-plus product of masks (0 where a filter fails, infinity where it passes) and positions.
        penalty = np.where(bits == 1, 0, k + 1)
        self.steps = np.minimum((penalty[:, None, :] + positions[None, :, :]).min(axis=2), k + 1)
        at = np.arange(1, k + 1)
        fails = bits[:, self.orders] == 1
        self.removed = (self.steps[:, :, None] == at).astype(np.int64)
        self.redundant = (fails & (self.steps[:, :, None] < at)).astype(np.int64)

    def totals(self, weights: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Weights by mask, one row for each part, spread over orders and steps: (parts, orders, steps)."""
        flat = weights @ table.reshape(len(table), -1)
        return flat.reshape(len(weights), *table.shape[1:])


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every step of every order of the filters, for each part of a table like that of `mask_counts`.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley); `filters` names
    up to eight filters by one letter each, bit i of `mask` belongs to letter i. One row for each part carries
    2^k counts into the task; the tables of removal steps depend on k alone. An empty table gives an empty result.
    """
    k = len(filters)
    if not 0 < k <= MAX_FILTERS or len(set(filters)) != k:
        raise ValueError(f"filters must be 1 to {MAX_FILTERS} different letters")
    names = ("n", "good", "toxic")
    entries = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*names))))

    def by_mask(name: str) -> Column:
        """Counts as an array with a place for every mask."""
        count = lambda mask: F.coalesce(F.try_element_at(F.col("found"), mask)[name], F.lit(0).cast("long"))
        return F.transform(F.sequence(F.lit(0), F.lit((1 << k) - 1)), count).alias(name)

    parts = counts.groupBy("part").agg(entries.alias("found")).select("part", *map(by_mask, names))
    kinds = {"part": pa.string(), "filter_order": pa.string(), "step": pa.int32()}
    measures = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    schema = pa.schema([*kinds.items(), *((name, pa.int64()) for name in measures)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = RemovalRanks(k)
        orders = ["".join(filters[i] for i in order) for order in ranks.orders]
        rows = len(orders) * k
        for batch in batches:
            for start in range(0, batch.num_rows, max(1, 200_000 // rows)):
                piece = batch.slice(start, max(1, 200_000 // rows))
                n, good, toxic = (
                    piece.column(name).flatten().to_numpy().reshape(piece.num_rows, 1 << k) for name in names
                )
                removed = ranks.totals(n, ranks.removed)
                alone = n[:, 1 << np.arange(k)]
                value = np.zeros((piece.num_rows, k), np.int64)
                for step in range(k):
                    np.add.at(value, (slice(None), ranks.orders[:, step]), removed[:, :, step])
                found = {
                    "kept": n.sum(axis=1)[:, None, None] - removed.cumsum(axis=2),
                    "removed": removed,
                    "redundant": ranks.totals(n, ranks.redundant),
                    "unique_fails": alone[:, ranks.orders],
                    "good_lost": ranks.totals(good, ranks.removed),
                    "toxic_lost": ranks.totals(toxic, ranks.removed),
                    "shapley": value[:, ranks.orders],
                }
                columns = [
                    piece.column("part").take(pa.array(np.repeat(np.arange(piece.num_rows), rows))),
                    pa.array(np.tile(np.repeat(np.array(orders, object), k), piece.num_rows), pa.string()),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), piece.num_rows * len(orders))),
                    *(pa.array(found[name].reshape(-1)) for name in measures),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return parts.mapInArrow(
        run, ", ".join(["part string, filter_order string, step int", *(f"{name} long" for name in measures)])
    )


def filter_audit(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """`interactions` of the five filters over documents; `names` as for `mask_counts`."""
    return interactions(mask_counts(docs, labels, **names))
