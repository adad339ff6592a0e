"""Language proportions of documents by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import map_texts, pieces, remainder

BUCKETS = 1 << 16
SMOOTHING = 0.5
ROUNDS = 30
LETTER = re.compile(r"[^\W\d_]")
MULTIPLIER = np.uint32(2654435761)
_OTHER = bytes(i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def profile(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of lower-cased words and how often each occurs."""
    words = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_OTHER).split()) + b" "
    data = np.frombuffer(words, np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    bucket = (key * MULTIPLIER) >> np.uint32(16)
    if len(bucket) > BUCKETS // 4:
        counts = np.bincount(bucket, minlength=BUCKETS)
        kept = np.flatnonzero(counts)
        return kept, counts[kept]
    return np.unique(bucket, return_counts=True)


def mixture(likelihood: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Languages of a text and their proportions. `likelihood`: n-grams x languages, `counts`: of the n-grams.

    Languages go one after the other, the smallest share first, as long as the likelihood penalised by half the
    logarithm of the n-grams for each language (BIC) does not fall.
    """
    scale = likelihood.max(axis=1, keepdims=True)
    likelihood = likelihood / scale
    kept = np.arange(likelihood.shape[1])
    total = counts.sum()
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    while True:
        part = likelihood[:, kept]
        share = np.full(len(kept), 1 / len(kept))
        for _ in range(ROUNDS if len(kept) > 1 else 0):
            weight = part * share
            after = (counts / weight.sum(axis=1)) @ weight / total
            moved = np.abs(after - share).max()
            share = after
            if moved < 1e-4:
                break
        worth = counts @ np.log(part @ share) - 0.5 * np.log(total) * (len(kept) - 1)
        if best is not None and worth < best[0]:
            break
        best = (worth, kept, share)
        if len(kept) == 1:
            break
        kept = np.delete(kept, np.argmin(share))
    return best[1], best[2]


def gather(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, bucket, n) over rows with a language."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in pieces(batches, "text"):
            for value, name in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                bucket, n = profile(value or "")
                totals.setdefault(name, np.zeros(BUCKETS, np.int64))[bucket] += n
        for name, counts in totals.items():
            kept = np.flatnonzero(counts)
            if not len(kept):
                kept = np.array([0])
            arrays = [pa.array([name] * len(kept)), pa.array(kept.astype(np.int32)), pa.array(counts[kept])]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    narrow = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL")
    return narrow.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages and n-gram likelihoods, buckets x languages: at most 2^16 numbers for each language that occurs."""
    found = gather(docs, lang, text).toPandas()
    names = sorted(found["lang"].unique())
    counts = np.full((BUCKETS, len(names)), SMOOTHING)
    for place, name in enumerate(names):
        own = found[found["lang"] == name]
        counts[own["bucket"].to_numpy(), place] += own["n"].to_numpy()
    return names, (counts / counts.sum(axis=0)).astype(np.float32)


def languages(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    held_out_of: int = 3,
    held_out: int = 1,
) -> DataFrame:
    """One row for each row: held_out, lang_pred, score (share of that language), and all languages and shares found.

    Learns from rows with a language whose crc32(id as text) mod `held_out_of` is not `held_out`; predictions read the
    text alone. Texts that are null or have no letter are `und` with score 0, as are all if nothing was learned. Equal
    shares go to the language whose name sorts first. Repeated rows count and come out as often as they occur; an
    empty table gives an empty result.
    """
    out = remainder(id_column, held_out_of) == held_out
    names, table = fit(docs.where(~out), lang, text)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batch: pa.RecordBatch) -> dict:
        found: dict[str, list] = {"lang_pred": [], "score": [], "langs": [], "shares": []}
        for value in batch.column("text").to_pylist():
            if not names or not value or not LETTER.search(value):
                row: tuple = ("und", 0.0, [], [])
            else:
                bucket, counts = profile(value)
                kept, share = mixture(shared.value[bucket].astype(float), counts.astype(float)) if len(bucket) else ([0], np.ones(1))
                top = int(np.argmax(share))
                row = (names[kept[top]], min(1.0, float(share[top])), [names[i] for i in kept], share.tolist())
            for column, part in zip(found.values(), row, strict=True):
                column.append(part)
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), **found}

    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), out.alias("held_out"), F.col(text).alias("text"))
    schema = "doc_id long, held_out boolean, lang_pred string, score double, langs array<string>, shares array<double>"
    return map_texts(narrow, "text", run, schema)
