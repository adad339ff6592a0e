import collections
import itertools
import random
import re

import numpy as np
import pytest

from recordloom.llm import filters
from recordloom.llm.queries import op12_filters

SMALL = "/root/testdata/sf0.001"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failing(doc_id, text, rows):
    """Letters of the filters a document fails."""
    text = text or ""
    words = [word for word in re.split(r"[\x20\x09-\x0D]+", text) if word]
    return "".join(
        letter
        for letter, fails in (
            ("A", len(words) < 50),
            ("B", 100 * len(set(words)) < 65 * len(words)),
            ("C", 100 * sum("A" <= char <= "Z" for char in text) > 5 * len(text)),
            ("D", any(char in "#$%&*|" for char in text)),
            ("E", doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows)),
        )
        if fails
    )


def walk(rows, labels):
    """Every order applied document by document."""
    good = {i for i, quality, _ in labels if quality == 1}
    toxic = {i for i, _, bad in labels if bad == 1}
    docs = [(source or "", failing(i, t, rows), i in good, i in toxic) for i, t, source in rows]
    found, shapley = {}, collections.Counter()
    for part in {doc[0] for doc in docs}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [doc for doc in docs if doc[0] == part]
            gone = []
            for step, letter in enumerate(order, 1):
                out = [doc for doc in left if letter in doc[1]]
                left = [doc for doc in left if letter not in doc[1]]
                shapley[part, letter] += len(out)
                found[part, order, step] = [
                    len(left), len(out), sum(letter in doc[1] for doc in gone),
                    sum(doc[0] == part and doc[1] == letter for doc in docs), sum(doc[2] for doc in out), sum(doc[3] for doc in out),
                ]
                gone += out
    return {key: (*row, shapley[key[0], key[1][key[2] - 1]]) for key, row in found.items()}


def result(df):
    rows = df.collect()
    found = {(row.part, row.filter_order, row.step): tuple(row[name] for name in MEASURES) for row in rows}
    assert len(found) == len(rows)
    return found


def test_matches_a_walk_over_documents(spark):
    random.seed(5)
    long = " ".join(f"w{i}" for i in range(60))
    texts = ["", None, long, long.upper(), "a b " * 40, long + " #", long + " #", "SHORT", "x" * 50_000, "é " * 60]
    rows = [(random.choice([*range(30), None]), random.choice(texts), random.choice(["a", "b", "", None])) for _ in range(150)]
    labels = [(i, random.choice([0, 1, None]), random.choice([0, 1, None])) for i in [*range(0, 30, 2), 4, 6, None, 99]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS mask", "2 AS n", "'z' AS good")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'z' AS part", "1 AS digest")
    assert result(filters.filter_audit(docs, marks)) == walk(rows, [row for row in labels if row[0] is not None])


def test_whole_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert result(op12_filters(spark, SMALL)) == walk(rows, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filters.filter_audit(docs.limit(0), labels).collect() == []
    assert len(result(filters.filter_audit(docs, labels))) == 600


def test_other_numbers_of_filters(spark):
    counts = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 3, 1, 1), ("p", 3, 2, 2, 0)], "part string, mask int, n long, good long, toxic long")
    found = result(filters.interactions(counts, "XY"))
    assert found == {
        ("p", "XY", 1): (5, 5, 0, 3, 3, 1, 8), ("p", "XY", 2): (5, 0, 2, 0, 0, 0, 2),
        ("p", "YX", 1): (8, 2, 0, 0, 2, 0, 2), ("p", "YX", 2): (5, 3, 2, 3, 1, 1, 8),
    }
    for letters in ("", "AA", "ABCDEFGHI"):
        with pytest.raises(ValueError):
            filters.interactions(counts, letters)


def test_removal_ranks_are_least_positions():
    ranks = filters.RemovalRanks(4)
    for mask, (row, order) in itertools.product(range(16), enumerate(ranks.orders)):
        at = [step for step, one in enumerate(order, 1) if mask >> one & 1]
        assert ranks.steps[mask, row] == min(at, default=5)
    assert np.all(ranks.removed.sum(axis=2) == (ranks.steps <= 4))
