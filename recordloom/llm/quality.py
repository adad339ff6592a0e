"""Document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.common import map_texts, pieces, remainder, text_bytes

PASSAGE = 700
FIT_ROWS = 4000
FIT_BYTES = 64 << 20
HIDDEN = 16
THRESHOLD = 0.3
_MARKS = [i for i in range(33, 127) if not chr(i).isalnum()]
_FEATURES = len(_MARKS) + 12


def passages(text: bytes) -> list[bytes]:
    """The whole text in passages of about `PASSAGE` bytes, cut behind blanks where there are any near."""
    found, start = [], 0
    while len(text) - start > PASSAGE * 3 // 2:
        end = text.find(b" ", start + PASSAGE, start + PASSAGE * 3 // 2) + 1 or start + PASSAGE
        found.append(text[start:end])
        start = end
    found.append(text[start:])
    return found


def encode(passage: bytes) -> list[float]:
    """Features of a passage: shares of kinds of characters and of single marks, shape and repetition of words."""
    counts = np.bincount(np.frombuffer(passage, np.uint8), minlength=256)
    size = max(1, len(passage))
    words = passage.split()
    number = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1)
    shares = counts / size
    used = shares[shares > 0]
    lines = counts[10] + 1
    return [
        *np.log1p(200 * shares[_MARKS]),
        shares[97:123].sum(),
        shares[65:91].sum(),
        shares[48:58].sum(),
        shares[128:].sum(),
        shares[32],
        10 * shares[10],
        float(lengths.mean()) / 10,
        float(lengths.std()) / 10,
        len({word.lower() for word in words}) / number,
        float(-(used * np.log(used)).sum()) / 3 if len(used) else 0.0,
        np.log1p(number / lines) / 3,
        np.log1p(number) / 5,
    ]


def bag(text: bytes) -> np.ndarray:
    return np.array([encode(passage) for passage in passages(text)], np.float32)


class AttentionModel:
    """Gated attention over encoded passages: the passages' weighted sum is scored by a logistic layer."""

    def __init__(self, seed: int = 7) -> None:
        draw = np.random.default_rng(seed)
        near = lambda *shape: draw.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.mean, self.scale = np.zeros(_FEATURES), np.ones(_FEATURES)
        self.weights = {
            "w": near(_FEATURES, HIDDEN), "v": near(HIDDEN, HIDDEN), "u": near(HIDDEN, HIDDEN),
            "a": near(HIDDEN), "c": near(HIDDEN), "b": np.zeros(1),
        }

    def _forward(self, x: np.ndarray, sizes: np.ndarray) -> dict:
        p = self.weights
        starts = np.cumsum(sizes) - sizes
        h = np.tanh(x @ p["w"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-np.clip(h @ p["u"], -30, 30)))
        e = (t * g) @ p["a"]
        e = np.exp(np.clip(e - np.repeat(np.maximum.reduceat(e, starts), sizes), -60, 0))
        attention = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(attention[:, None] * h, starts)
        logit = z @ p["c"] + p["b"][0]
        return {"starts": starts, "h": h, "t": t, "g": g, "attention": attention, "z": z, "y": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, rounds: int = 300, rate: float = 0.02, decay: float = 1e-4) -> None:
        sizes = np.array([len(b) for b in bags])
        x = np.concatenate(bags).astype(float)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.scale
        p = self.weights
        first = {k: np.zeros_like(v) for k, v in p.items()}
        second = {k: np.zeros_like(v) for k, v in p.items()}
        for step in range(1, rounds + 1):
            f = self._forward(x, sizes)
            error = (f["y"] - labels) / len(labels)
            dz = error[:, None] * p["c"]
            spread = np.repeat(dz, sizes, axis=0)
            da = (spread * f["h"]).sum(axis=1)
            inner = np.add.reduceat(f["attention"] * da, f["starts"])
            de = f["attention"] * (da - np.repeat(inner, sizes))
            dt = de[:, None] * f["g"] * p["a"] * (1 - f["t"] ** 2)
            dg = de[:, None] * f["t"] * p["a"] * f["g"] * (1 - f["g"])
            dh = f["attention"][:, None] * spread + dt @ p["v"].T + dg @ p["u"].T
            slope = {
                "c": f["z"].T @ error, "b": np.array([error.sum()]), "a": (f["t"] * f["g"]).T @ de,
                "v": f["h"].T @ dt, "u": f["h"].T @ dg, "w": x.T @ (dh * (1 - f["h"] ** 2)),
            }
            for k in p:
                d = slope[k] + decay * p[k]
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        x = (np.concatenate(bags) - self.mean) / self.scale
        return self._forward(x, np.array([len(b) for b in bags]))["y"]


def fit(labelled: DataFrame, rows: int = FIT_ROWS, size: int = FIT_BYTES) -> AttentionModel:
    """Fit on a bounded sample of the labelled rows (doc_id, text, label): in the order of the hashes of their ids, the
    first `rows` of them, as long as the texts before a row have less than `size` bytes together. Every passage of a
    chosen row is encoded."""

    def run(batch: pa.RecordBatch) -> dict:
        found = [bag(text).astype("<f4").tobytes() for text in text_bytes(batch.column("text"))]
        return {"label": batch.column("label"), "bag": found}

    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("label"), F.xxhash64("text")]
    first = labelled.where("label IS NOT NULL").orderBy(*order).limit(rows)
    length = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    before = F.sum(length).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - length
    chosen = first.withColumn("__before", before).where(F.col("__before") < size)
    spread = chosen.select("text", F.col("label").cast("int").alias("label")).repartition(32)
    sample = map_texts(spread, "text", run, "label int, bag binary").collect()
    model = AttentionModel()
    if sample:
        # any order of the partitions gives one model
        sample.sort(key=lambda row: (row.label, bytes(row.bag)))
        bags = [np.frombuffer(row.bag, "<f4").reshape(-1, _FEATURES) for row in sample]
        model.fit(bags, np.array([row.label for row in sample], float))
    return model


def scored(docs: DataFrame, model: AttentionModel, kept: list[str], text: str = "text") -> DataFrame:
    """(kept columns, `score`): the model's score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches, text):
            score = shared.value.score([bag(value) for value in text_bytes(batch.column(text))])
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in kept), pa.array(score)], names=[*kept, "score"])

    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("score", T.DoubleType())])
    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)


def training_rows(docs: DataFrame, labels: DataFrame, held_out_of: int = 5) -> DataFrame:
    """(doc_id, text, label) of rows with a label that are not held out; the smallest label of an id counts."""
    known = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("label"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(remainder("doc_id", held_out_of) != 0)
    first = known.where(remainder("doc_id", held_out_of) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    return own.join(F.broadcast(first), "doc_id")


def quality(docs: DataFrame, labels: DataFrame, held_out_of: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    Labels are read only of rows whose crc32(id as text) mod `held_out_of` is not 0, and of those the `FIT_ROWS`
    with the smallest hashes, up to `FIT_BYTES` of text. Scores read the text alone; null and empty texts score as one empty passage. Without
    labels the model is unfitted and its scores carry no meaning. Repeated rows come out as often as they occur; a
    null id has no label; an empty table gives an empty result; columns of other names are not read.
    """
    model = fit(training_rows(docs, labels, held_out_of))
    marked = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", held_out_of) == 0).alias("held_out"), "text"
    )
    found = scored(marked, model, ["doc_id", "held_out"])
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of the table that score at least `threshold`, with their own columns."""
    model = fit(training_rows(docs, labels))
    own = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("__row"), F.col("text").alias("__text"))
    found = scored(own, model, ["__row"], "__text")
    return found.where(F.col("score") >= threshold).select("__row.*")
