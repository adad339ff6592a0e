import math
import random

import numpy as np
from pyspark.sql import functions as F

from recordloom.llm import quality


def plain_score(model, text: bytes) -> float:
    """The score of one text by loops over its passages: gated attention, weighted sum, logistic layer."""
    p = {k: v.tolist() for k, v in model.weights.items()}
    hidden, weights = [], []
    for passage in quality.passages(text):
        x = [(v - m) / s for v, m, s in zip(quality.encode(passage), model.mean, model.scale, strict=True)]
        h = [math.tanh(sum(x[i] * p["w"][i][j] for i in range(len(x)))) for j in range(quality.HIDDEN)]
        t = [math.tanh(sum(h[i] * p["v"][i][j] for i in range(len(h)))) for j in range(quality.HIDDEN)]
        g = [1 / (1 + math.exp(-sum(h[i] * p["u"][i][j] for i in range(len(h))))) for j in range(quality.HIDDEN)]
        hidden.append(h)
        weights.append(math.exp(sum(a * b * c for a, b, c in zip(t, g, p["a"], strict=True))))
    z = [sum(w * h[j] for w, h in zip(weights, hidden, strict=True)) / sum(weights) for j in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, p["c"], strict=True)) + p["b"][0])))


def words(draw, n, alphabet="abcdefg"):
    return " ".join("".join(draw.choices(alphabet, k=draw.randint(1, 8))) for _ in range(n))


def test_scores_equal_the_plain_forward_pass(spark):
    draw = random.Random(3)
    texts = [words(draw, n) + mark for n, mark in ((1, ""), (40, "."), (400, "! 7"), (3000, "é"), (700, "\n\n{}"))]
    labelled = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "doc_id long, text string, label int")
    model = quality.fit(labelled)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None])], "doc_id long, text string")
    for row in quality.scored(docs, model, ["doc_id", "text"]).collect():
        assert abs(row.score - plain_score(model, (row.text or "").encode())) < 1e-4


def test_every_passage_of_a_sampled_row_is_fitted(spark, monkeypatch):
    draw = random.Random(4)
    texts = [words(draw, 20000), words(draw, 30), None]
    labelled = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "doc_id long, text string, label int")
    seen = []
    monkeypatch.setattr(quality.AttentionModel, "fit", lambda self, bags, labels: seen.append(sorted(len(b) for b in bags)))
    quality.fit(labelled)
    assert seen == [sorted(len(quality.passages((t or "").encode())) for t in texts)] and seen[0][-1] > 48


def test_the_sample_is_bounded_by_whole_rows(spark, monkeypatch):
    labelled = spark.range(50).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 100).alias("text"), F.lit(1).alias("label"))
    seen = []
    monkeypatch.setattr(quality.AttentionModel, "fit", lambda self, bags, labels: seen.append(len(bags)))
    quality.fit(labelled, rows=20)
    quality.fit(labelled, size=3001)
    quality.fit(labelled.where("doc_id < 0"))
    assert seen == [20, 11]


def test_fitting_does_not_depend_on_partitions(spark):
    draw = random.Random(5)
    rows = [(i, words(draw, draw.randint(1, 300), "abc" if i % 2 else "xyz.!"), i % 2) for i in range(60)]
    one = spark.createDataFrame(rows, "doc_id long, text string, label int").coalesce(1)
    first, second = quality.fit(one), quality.fit(one.repartition(7))
    assert all(np.array_equal(first.weights[k], second.weights[k]) for k in first.weights)


def test_clashing_and_dotted_names(spark):
    docs = spark.createDataFrame([(1, "one text", 2, 3, 4)], "doc_id long, text string, __row int, __text int, `a.b` int")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.accepted(docs, labels, threshold=0.0).collect() == docs.collect()
