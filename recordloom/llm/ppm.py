"""Language-model scores: prediction by partial matching over a byte-context trie, and a word-frequency base."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import cut, remainder, text_bytes

ORDER = 5
EDGE = b"\xff"  # occurs in no UTF-8 text: stands before the text and, as a symbol, for its end
END_WORD = b"\n"
PART_BYTES = 32 << 20
SLICE_BYTES = 1 << 20
WAITING = 1_500_000
LOG10 = np.log10


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The symbol with its `ORDER` bytes of context as one number, for every symbol, and the symbols of each text."""
    pad = EDGE * ORDER
    data = np.frombuffer(pad + pad.join(text + EDGE for text in texts), np.uint8)
    key = np.zeros(max(0, len(data) - ORDER), np.int64)
    for i in range(ORDER + 1):
        key <<= 8
        key |= data[i : len(key) + i]
    lengths = np.fromiter((len(text) + 1 for text in texts), np.int64, len(texts))
    starts = np.cumsum(lengths + ORDER) - lengths - ORDER
    keep = np.zeros(len(key), bool)
    if len(texts):
        edges = np.zeros(len(key) + 1, np.int8)
        edges[starts] += 1
        np.subtract.at(edges, starts + lengths, 1)
        keep = np.cumsum(edges[:-1], dtype=np.int8) > 0
    return key[keep], lengths


def slices(column: pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Start, end and texts of slices of about `limit` bytes; only the texts of one slice are made at a time."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
    start, held = 0, 0
    for place, length in enumerate(lengths):
        if held and held + length > limit:
            yield start, place, text_bytes(column.slice(start, place - start))
            start, held = place, 0
        held += length + 1
    if start < len(lengths):
        yield start, len(lengths), text_bytes(column.slice(start))


def text_words(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the counts of each."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, count = key[order], count[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[first], np.add.reduceat(count, first) if len(key) else count


def _ordered(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, and the value of each."""
    order = np.argsort(keys)
    return keys[order], values[order]


class Counts:
    """Counts of 64-bit keys, summed in order whenever many wait."""

    def __init__(self) -> None:
        self.keys, self.counts, self.waiting = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.waiting += len(keys)
        if self.waiting > WAITING:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order, and their counts."""
        keys, counts = _summed(self.keys, self.counts)
        self.keys, self.counts, self.waiting = [keys], [counts], 0
        return keys, counts


class Lookup:
    """Places of keys in a sorted array: by a table of hashes, and by bisection where two keys share a slot."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        self.slots = np.zeros(1 << bits, np.int32)
        self.slots[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def places(self, wanted: np.ndarray) -> np.ndarray:
        """Places of keys that all are in the array."""
        found = self.slots[self._slot(wanted)]
        other = np.flatnonzero(self.keys[found] != wanted)
        found[other] = np.searchsorted(self.keys, wanted[other])
        return found


def _gather(table: pa.Table) -> pa.Table:
    """Distinct grams (kind 0) and words (kind 1) of a part of the texts, with their counts in training texts."""
    part = table.column("part")[0].as_py()
    held = table.column("held_out").to_numpy()
    symbols, words = Counts(), Counts()
    for start, end, texts in slices(table.column("text")):
        own: Counter = Counter()
        for text, out in zip(texts, held[start:end], strict=True):
            if out:
                for word in text_words(text):
                    own.setdefault(word, 0)
            else:
                own.update(text_words(text))
        words.add(np.fromiter(map(word_key, own), np.int64, len(own)), np.fromiter(own.values(), np.int64, len(own)))
        found, lengths = grams(texts)
        found, n = np.unique(np.where(np.repeat(held[start:end], lengths), ~found, found), return_counts=True)
        n[found < 0] = 0  # held out: asked for, not counted
        symbols.add(np.where(found < 0, ~found, found), n)
    words.add(np.array([word_key(END_WORD)]), np.array([(~held).sum()]))
    both = symbols.total(), words.total()
    key, count = (np.concatenate(columns) for columns in zip(*both, strict=True))
    kind = np.repeat(np.array([0, 1], np.int32), [len(keys) for keys, _ in both])
    return pa.table({"part": np.full(len(key), part), "kind": kind, "key": key, "c": count})


def code_lengths(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of the last symbol of each gram after its context; all grams end in the same two bytes of
    context, and all of that context are given. `pairs`: in how many two-byte contexts a symbol follows a byte.

    The longest contexts have the counts of the training texts, shorter ones count in how many different longer
    contexts a symbol follows (update exclusion). Each symbol of a context gives half a count to the escape (method
    D). An escape excludes the symbols of the longer context: symbols of a context all occur in the shorter ones, so
    what is left there is its count less the mass of the longer context's symbols.
    """
    value, done = np.zeros(len(keys)), np.zeros(len(keys), bool)
    out_mass, out_kinds = np.zeros(len(keys)), np.zeros(len(keys))
    seen_pairs = pairs > 0
    zero = seen_pairs.sum(axis=0).astype(float)
    symbol, last = keys & 0xFF, (keys >> 8) & 0xFF
    tables, above, weight = {}, keys, counts
    for order in range(ORDER, 1, -1):
        short, place = np.unique(above & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
        tables[order] = short, np.bincount(place, weight, len(short))
        above, weight = short, tables[order][1] > 0
    levels = {}
    for order, (short, c) in tables.items():
        if order > 2:
            parent, mass = tables[order - 1]
            below = mass[np.searchsorted(parent, short & ((1 << 8 * order) - 1))]
        else:
            below = pairs[(short >> 8) & 0xFF, short & 0xFF]
        contexts, at = np.unique(short >> 8, return_inverse=True)
        seen = c > 0
        n, d, x = (np.bincount(at, w, len(contexts)) for w in (c, seen, np.where(seen, below, 0)))
        own = np.searchsorted(short, keys & ((1 << 8 * (order + 1)) - 1))
        levels[order] = (c[own], n[at[own]], d[at[own]], x[at[own]])
    levels[1] = (
        pairs[last, symbol],
        pairs.sum(axis=1)[last],
        seen_pairs.sum(axis=1)[last],
        np.where(seen_pairs, zero, 0).sum(axis=1)[last],
    )
    levels[0] = (zero[symbol], np.full(len(keys), zero.sum()), np.full(len(keys), (zero > 0).sum()), np.zeros(len(keys)))
    for order in range(ORDER, -1, -1):
        c, n, d, x = levels[order]
        left, escape = n - out_mass, (d - out_kinds) / 2
        hit = ~done & (c > 0)
        value[hit] += LOG10((c[hit] - 0.5) / left[hit])
        miss = ~done & (c == 0) & (escape > 0)
        value[miss] += LOG10(escape[miss] / left[miss])
        done |= hit
        known = n > 0
        out_mass, out_kinds = np.where(known, x, out_mass), np.where(known, d, out_kinds)
    value[~done] -= LOG10(256 - (zero > 0).sum())
    return value


def ppm_scores(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", held_out_of: int = 10, part_bytes: int = PART_BYTES
) -> DataFrame:
    """One row for each row: held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).

    Rows whose crc32(id as text) mod `held_out_of` is 0 are held out; all others train both models. The trie holds
    every context of up to `ORDER` bytes of all training texts, so it grows with the corpus and is never broadcast:
    each part of the texts (about `part_bytes`) asks for the grams and words it contains by a join. The contexts
    that end in the same two bytes meet in one task, of prose about a
    fiftieth of all distinct grams for the commonest pair; single bytes are counted in a table of
    256 x 256. Words are matched by 64-bit hashes. Null and empty texts score their end only. Without training
    rows the base has N = V = 0 and the model is uniform. A null id counts as empty text when hashed; repeated rows
    train and come out as often as they occur; an empty table gives an empty result.
    """
    narrow = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
        (remainder(id_column, held_out_of) == 0).alias("held_out"),
    )
    size = narrow.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = size // part_bytes + 1
    dealt = narrow.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)))
    asked = cut(dealt.groupBy("part").applyInArrow(_gather, "part long, kind int, key long, c long"), "grams")
    total = cut(asked.groupBy("key", "kind").agg(F.sum("c").alias("c")), "counts")
    words = total.where("kind = 1")
    n_train, n_kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    pairs = np.zeros((256, 256))
    three = total.where("kind = 0 AND c > 0").select(F.col("key").bitwiseAND(0xFFFFFF).alias("key")).distinct()
    two = three.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("pair")).agg(F.count("*").alias("c"))
    for row in two.collect():  # at most 256 x 256 rows
        pairs[row.pair >> 8, row.pair & 0xFF] = row.c

    def weigh(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy()
        return pa.table({"kind": np.zeros(len(keys), np.int32), "key": keys, "value": code_lengths(keys, table.column("c").to_numpy(), pairs)})

    context = F.shiftright("key", 8).bitwiseAND(0xFFFF).alias("context")
    weighed = total.where("kind = 0").select("key", "c", context).groupBy("context")
    valued = weighed.applyInArrow(weigh, "kind int, key long, value double")
    valued = valued.unionAll(words.select("kind", "key", F.col("c").cast("double").alias("value")))
    answers = asked.select("part", "kind", "key").join(valued, ["key", "kind"]).select("part", "kind", "key", "value")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_())]
        + [(name, pa.int64()) for name in ("n_tokens", "n_known", "train_tokens")]
        + [(name, pa.float64()) for name in ("base_score", "score")]
    )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        kind, key, value = (right.column(name).to_numpy() for name in ("kind", "key", "value"))
        (grammar, length), (vocabulary, count) = (_ordered(key[kind == k], value[kind == k]) for k in (0, 1))
        del kind, key, value
        grammar = Lookup(grammar)
        tokens, known, base, each = [], [], [], []
        scale = np.log10(n_train + 0.1 * (n_kinds + 1))
        unknown = float(np.log10(0.1))

        def word_cost(c: float) -> float:
            return float(np.log10(c + 0.1)) if c else unknown

        end_cost = word_cost(count[np.searchsorted(vocabulary, word_key(END_WORD))])
        for _, _, texts in slices(left.column("text")):
            sequence, lengths = grams(texts)
            each.append(np.add.reduceat(length[grammar.places(sequence)], np.cumsum(lengths) - lengths))
            split = list(map(text_words, texts))
            own = list(set().union(*split))
            wanted = np.fromiter(map(word_key, own), np.int64, len(own))
            cost = dict(zip(own, map(word_cost, count[np.searchsorted(vocabulary, wanted)]), strict=True))
            for found in split:
                costs = [cost[word] for word in found]
                costs.append(end_cost)
                tokens.append(len(costs))
                known.append(len(costs) - costs.count(unknown))
                base.append(sum(costs) - len(costs) * scale)
        each = np.concatenate(each)
        trained = np.full(left.num_rows, n_train)
        return pa.table([left.column("doc_id"), left.column("held_out"), tokens, known, trained, base, each], schema=schema)

    return (
        dealt.groupBy("part")
        .cogroup(answers.groupBy("part"))
        .applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )
