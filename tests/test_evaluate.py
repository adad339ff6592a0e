import json
import math
import re
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from recordloom.functions import similarity
from recordloom.functions.records import parse_record
from recordloom.operators import records as record_ops
from recordloom.operators import tfidf, vectors
from recordloom.plans import evaluate

PAIRS = [
    ({"a": {"b": 1, "c": [1, 2]}, "x": "big red dog", "k": True}, {"a": {"b": 1.0, "c": [1, 3]}, "y": "q", "k": 1}),
    ({"x": "big red dog", "n": None}, {"x": "Dog, red big!", "n": None}),
    ({"t": "one two three four five six", "l": [[1], [2]]}, {"t": "one two three four five seven", "l": [[1], [3]]}),
    ({}, {}),
    ({"a": "same"}, {}),
    ({"m": "ab" * 150}, {"m": "ba" * 150}),
]


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(PAIRS)]
    return evaluate.parse_pairs(spark.createDataFrame(rows, "id int, l string, r string"), "l", "r")


# The fields of PAIRS, written by hand.
FIELDS = [
    ({"a b": 1, "a c[0]": 1, "a c[1]": 2, "k": True, "x": "big red dog"}, {"a b": 1.0, "a c[0]": 1, "a c[1]": 3, "k": 1, "y": "q"}),
    ({"n": None, "x": "big red dog"}, {"n": None, "x": "Dog, red big!"}),
    (
        {"l[0]": [1], "l[1]": [2], "t": "one two three four five six"},
        {"l[0]": [1], "l[1]": [3], "t": "one two three four five seven"},
    ),
    ({}, {}),
    ({"a": "same"}, {}),
    ({"m": "ab" * 150}, {"m": "ba" * 150}),
]


def expected_basic(l, r):  # noqa: E741
    both, union = set(l) & set(r), set(l) | set(r)
    ratios = [SequenceMatcher(None, str(l[k]), str(r[k])).ratio() for k in both]
    return (
        len(both) / len(union) if union else 0,
        sum(l[k] == r[k] for k in both) / len(both) if both else 0,
        sum(ratios) / len(both) if both else 0,
    )


def test_basic_similarities(pairs):
    rows = evaluate.basic_similarities(pairs, "id", "l", "r").orderBy("id").collect()
    for row, (left, right) in zip(rows, FIELDS):
        assert tuple(row)[1:] == pytest.approx(expected_basic(left, right))


def test_field_rows_and_missing(pairs):
    rows = evaluate.field_rows(pairs, "id", "l", "r").collect()
    assert len(rows) == sum(len(set(a) | set(b)) for a, b in FIELDS)
    missing = {tuple(r) for r in evaluate.missing_fields(pairs, "id", "l", "r").collect()}
    assert missing == {(0, "x", "Dict 2"), (0, "y", "Dict 1"), (4, "a", "Dict 2")}


def bag(text):
    return Counter(re.findall(r"\w+", text.lower()))


def plain_cosine(a, b):
    dot = sum(a[w] * b[w] for w in a)
    scale = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    return dot / scale if scale else 0.0


def expected_decision(key, l, r, threshold):  # noqa: E741
    if key not in l:
        return "missing in Dict 1"
    if key not in r:
        return "missing in Dict 2"
    a, b = str(l[key]), str(r[key])
    score = 1.0 if a == b else plain_cosine(bag(f"{key}: {a}"), bag(f"{key}: {b}"))
    return "good" if score == 1 else "minor difference" if score >= threshold else "value mismatch"


def test_decisions(pairs):
    found = {(r.id, r.path): r.decision for r in evaluate.decision_details(pairs, "id", "l", "r").collect()}
    expected = {
        (i, key): expected_decision(key, a, b, 0.8)
        for i, (a, b) in enumerate(FIELDS)
        for key in set(a) | set(b)
    }
    assert found == expected
    assert set(found.values()) == {"good", "minor difference", "value mismatch", "missing in Dict 1", "missing in Dict 2"}
    scores = {r.id: r.similarity_score for r in evaluate.decision_scores(pairs, "id", "l", "r").collect()}
    for i in range(len(PAIRS)):
        own = [d for (pair, _), d in expected.items() if pair == i]
        good = sum(d in ("good", "minor difference") for d in own)
        assert scores[i] == (pytest.approx(good / len(own)) if own else None)


ODD_PAIRS = [
    # paths that meet although they come from other keys, in one record and in two
    ({"a b": 1, "a": {"b": 2}}, {"a": {"b": 2}}), ({"a": {"b": 1}}, {"a b": 1}), ({"": {"c": 1}, "c": 2}, {"c": 2}), ({"a": [5]}, {"a[0]": 5}),
    ({"x": {"p": {"q r": 1, "q": {"r": 2}}, "s": 3}}, {"x": {"p": {"q": {"r": 2}}, "s": 3}}),
    # other kinds of values on the two sides, empty ones, missing ones
    ({"a": {"b": 1}, "c": [1], "d": {}, "e": [], "f": 1}, {"a": [1, {"z": 2}], "c": {"k": 1}, "d": 5, "e": {}, "f": {"g": [True]}}),
    ({"a": {"b": {}, "c": [{}, 1]}}, {"a": {"b": [], "c": [[], 1]}}), ({"l": [{"k": 1}, {"k": 2}]}, {"l": [{"k": 1, "m": None}]}), ({"l": [1]}, {}),
    # lists in lists and what lies deeper
    ({"a": [[1, {"b": 2.0}], {"c": {"d": {"e": [1, {"f": "x"}]}}}]}, {"a": [[1, {"b": 2.5}], {"c": {"d": {"e": [1, {"f": "X"}]}}}]}),
    # texts of all kinds of numbers
    ({"n": [1, 1.0, 900.0, 1e20, 1e-7, 12345678.5, 10**30, 12345678901234567890, -0.5]}, {"n": ["1", 1, 900, 1e21, "1e-07", 12345678.5, 10.0**30, True, None]}),
    ([1], {"a": 1}), ({"a": 1}, "text"), (None, None),
]


def by_row(pairs, **options):
    """Details by decisions that are taken inside the row of a pair."""
    decided = evaluate.with_decisions(pairs, "id", "l", "r", **options)
    return decided.select("id", F.inline_outer("decisions")).where("path IS NOT NULL")


def test_details_of_odd_records_equal_those_by_row(spark, pairs):
    rows = [(i % 9 or None, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(ODD_PAIRS)]
    rows += [(1, None, rows[0][1]), (1, rows[0][1], "not json"), rows[3]]
    odd = evaluate.parse_pairs(spark.createDataFrame(rows, "id int, l string, r string"), "l", "r")
    for table, threshold in ((odd, 0.8), (pairs, 0.3)):
        found = evaluate.decision_details(table, "id", "l", "r", threshold=threshold)
        expected = by_row(table, threshold=threshold)
        assert found.dtypes == expected.dtypes
        assert Counter(found.collect()) == Counter(expected.collect())


def test_details_of_usual_records_are_not_taken_inside_the_row(spark, monkeypatch, plan_of):
    """Objects and lists of objects are opened and compared as rows, without flattening, sorting or aligning in a row."""
    monkeypatch.setattr(record_ops, "_REST", f"if(true, raise_error('inside the row'), {record_ops._REST})")
    left = {"id": 1, "o": {"p": "x", "q": 1.5}, "l": [{"k": 1, "t": "big dog"}, {"k": None}], "e": [], "only": {"here": [1, 2]}}
    right = {"id": 1, "o": {"p": "x", "q": 2.5}, "l": [{"k": 1, "t": "Dog, big!"}], "e": [], "there": {"a": True}}
    table = spark.createDataFrame([(1, json.dumps(left), json.dumps(right))], "id int, l string, r string")
    details = evaluate.decision_details(evaluate.parse_pairs(table, "l", "r"), "id", "l", "r")
    plan = plan_of(details)
    assert "Exchange" not in plan and "Python" not in plan and "Union" not in plan
    assert {r.path: (r.l_text, r.r_text, r.decision) for r in details.collect()} == {
        "id": ("1", "1", "good"), "o p": ("x", "x", "good"), "o q": ("1.5", "2.5", "value mismatch"), "l[0] k": ("1", "1", "good"),
        "l[0] t": ("big dog", "Dog, big!", "good"), "l[1] k": ("None", None, "missing in Dict 2"),
        "only here[0]": ("1", None, "missing in Dict 2"), "only here[1]": ("2", None, "missing in Dict 2"),
        "there a": (None, "True", "missing in Dict 1"),
    }


def words_of_length():
    def vectors_of(texts):
        return [[float(len(re.findall(rf"\b\w{{{n}}}\b", t))) for n in range(1, 8)] for t in texts]

    return vectors_of


def test_decisions_with_embedder(pairs):
    rows = evaluate.decision_details(pairs, "id", "l", "r", embedder=words_of_length).collect()
    assert len(rows) == len(evaluate.field_rows(pairs, "id", "l", "r").collect())
    model = words_of_length()
    for row in rows:
        if row.l_text is None or row.r_text is None:
            assert row.similarity is None
        elif row.l_text == row.r_text:
            assert row.similarity == 1.0
        else:
            a, b = (dict(enumerate(model([f"{row.path}: {t}"])[0])) for t in (row.l_text, row.r_text))
            assert row.similarity == pytest.approx(plain_cosine(a, b))


def test_compare(pairs):
    weights = {"jaccard_similarity": 0.4, "value_similarity": 0.2, "textual_similarity_seq": 0.1, "similarity_score": 0.3}
    rows = evaluate.compare(pairs, "id", "l", "r", weights=weights, threshold=0.8).collect()
    for row in rows:
        values = row.asDict()
        if row.similarity_score is None:
            assert row.weighted_mape is None
        else:
            assert row.weighted_mape == pytest.approx(sum(w * abs(1 - values[m]) for m, w in weights.items()))
    harsh = evaluate.compare(pairs, "id", "l", "r", score_div_100=True).where("similarity_score = 1").first()
    assert harsh.weighted_mape >= 0.48 * 0.99
    with pytest.raises(ValueError):
        evaluate.compare(pairs, "id", "l", "r", weights={**weights, "similarity_score": 0.5})
    with pytest.raises(ValueError):
        evaluate.compare(pairs, "id", "l", "r", weights={"jaccard_similarity": 1.0})
    summary = evaluate.corpus_summary(evaluate.compare(pairs, "id", "l", "r")).first()
    assert summary.pairs == len(PAIRS)


def test_identity_is_perfect(pairs):
    same = pairs.where("id not in (3)").select("id", "l", F.col("l").alias("r"))
    for row in evaluate.compare(same, "id", "l", "r", sequence=True).collect():
        assert tuple(row)[1:] == pytest.approx((1.0, 1.0, 1.0, 1.0, 0.0))


def test_plan_has_no_shuffle_and_no_python(pairs, plan_of):
    plan = plan_of(evaluate.compare(pairs, "id", "l", "r"))
    assert "Exchange" not in plan and "Python" not in plan and "Union" not in plan
    assert "Python" in plan_of(evaluate.compare(pairs, "id", "l", "r", sequence=True))


def test_record_similarities(pairs):
    for row, (left, right) in zip(
        evaluate.record_similarities(pairs, "id", "l", "r").orderBy("id").collect(), PAIRS
    ):
        if not left or not right:
            assert (row.key_similarity, row.raw_similarity) == (0, 0)
            continue
        keys = len(set(left) & set(right)) / len(set(left) | set(right))
        texts = [json.dumps(r, sort_keys=True) for r in (left, right)]
        assert (row.key_similarity, row.raw_similarity) == pytest.approx((keys, SequenceMatcher(None, *texts).ratio()))


# Written by hand: two values and their similarity.
VALUES = [
    ("abca", "ab", 1.0), ("ab", "abca", 2 / 3), ("", "", 0.0), ("é😀x", "x😀", 0.8), (1, 3, 1 / 3), (1.5, 1, 2 / 3), (True, 0, 0.5),
    ("1", 1, 0.0), (None, None, 0.0), ([1, 2, "ab"], [1, 4], 4 / 9), ([], [], 0.0), ([], [1], 0.0),
    ([[1], [2, 3]], [[1], [4, 3]], 5 / 6), ({"a": 1, "b": 2}, {"a": 1, "b": 3}, 0.5),
    ({"a": [1, 2], "b": {"c": 1}}, {"a": [1, 2], "b": {"c": 2}}, 0.5), ({}, {}, 0.0), ([{"a": 1}], [{"a": 1, "b": 2}], 1.0),
]


def test_lists_are_compared_to_any_depth(spark):
    rows = [
        ('[[["x"]]]', '[[["x"]]]', 1.0), ('[[[[1, 2]]]]', '[[[[1, 3]]]]', 0.75), ('[[[["a"]]], 1]', '[[[["a"]]], "b"]', 0.5),
        ('[[[[]]]]', '[[[[]]]]', 0.0), ("[" * 40 + "7" + "]" * 40, "[" * 40 + "7" + "]" * 40, 1.0), ("[1, 2]", "[1]", 0.5),
        ("[1]", "1", 0.0), ("[]", "[]", 0.0), ("[null]", "[null]", 0.0),
    ]
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "i int, a string, b string, s double")
    a, b = parse_record("a"), parse_record("b")
    found = df.select("s", similarity.value_similarity(a, b).alias("v"), similarity.list_similarity(a, b).alias("l"))
    for row in found.orderBy("i").collect():
        assert row.v == pytest.approx(row.s) and row.l == pytest.approx(row.s)


def test_value_similarity(spark):
    rows = [(i, json.dumps(a), json.dumps(b)) for i, (a, b, _) in enumerate(VALUES)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    scores = df.select("i", similarity.value_similarity(parse_record("a"), parse_record("b")).alias("s")).orderBy("i")
    assert [row.s for row in scores.collect()] == pytest.approx([score for *_, score in VALUES])


def test_string_measures(spark):
    cases = [("abcd", "bcde"), ("", ""), ("a", ""), ("kitten", "sitting"), (None, "x"), ("ab" * 150, "ab" * 150), ("ab" * 150, "ba" * 150)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, b string")
    rows = df.select(
        "i", similarity.sequence_ratio("a", "b").alias("seq"), similarity.sequence_ratio("a", "b", False).alias("all"),
        similarity.levenshtein_ratio("a", "b").alias("lev"), similarity.bag_cosine("a", "b").alias("bag"),
    ).orderBy("i").collect()
    for row, (a, b) in zip(rows, cases):
        if a is None:
            assert row.seq is None
            continue
        assert row.seq == pytest.approx(SequenceMatcher(None, a, b).ratio())
        assert row.all == pytest.approx(SequenceMatcher(None, a, b, False).ratio())
        assert row.bag == pytest.approx(plain_cosine(bag(a), bag(b)))
    assert rows[3].lev == pytest.approx(1 - 3 / 7)


def plain_tfidf(texts):
    docs = [Counter(re.findall(r"\b\w\w+\b", t.lower())) for t in texts]
    df = Counter(term for d in docs for term in d)
    out = []
    for d in docs:
        w = {t: c * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, c in d.items()}
        length = math.sqrt(sum(v * v for v in w.values()))
        out.append({t: v / length for t, v in w.items()})
    return out


def test_pair_tfidf(spark, plan_of):
    cases = [
        (["the big dog", "a cat", "x"], ["the dog", "a cat sat"]),
        (["x"], ["y"]),
        (["same text", "same text"], ["same text", "other words", "more"]),
        (["alpha"], []),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, l array<string>, r array<string>")
    result = tfidf.pair_tfidf(df, "i", "l", "r")
    found = {(r.i, r.pos): r.tfidf_cosine for r in result.collect()}
    expected = {}
    for i, (left, right) in enumerate(cases):
        weights = plain_tfidf(left + right)
        for pos in range(min(len(left), len(right))):
            a, b = weights[pos], weights[len(left) + pos]
            expected[i, pos] = sum(v * b.get(t, 0) for t, v in a.items())
    assert found == pytest.approx(expected)
    assert "Exchange" not in plan_of(result)
    means = {r.i: r.tfidf_mean for r in tfidf.mean_pair_tfidf(df, "i", "l", "r").collect()}
    assert means == pytest.approx({i: sum(c for (j, _), c in expected.items() if j == i) / n for i, n in ((0, 2), (1, 1), (2, 2))})


def test_tfidf_comes_out_of_the_row(pairs, spark, plan_of):
    texts = spark.createDataFrame([("{}", "[]")], "l string, r string").withColumn("id", F.monotonically_increasing_id())
    parsed = evaluate.parse_pairs(texts, "l", "r")
    plan = plan_of(evaluate.similarities_with_tfidf(parsed, "id", "l", "r", sequence=False))
    assert not any(word in plan for word in ("Exchange", "Join", "Python", "Union", "Aggregate"))
    assert plan.count("md5(") == plan_of(parsed).count("md5(") > 0
    for flat in (False, True):
        rows = evaluate.similarities_with_tfidf(pairs, "id", "l", "r", flat=flat, sequence=False)
        basics = evaluate.basic_similarities(pairs, "id", "l", "r", flat=flat, sequence=False)
        assert {tuple(r)[:3] for r in rows.collect()} == {tuple(r) for r in basics.collect()}
        empty = rows.where("id = 3").first()
        assert empty.textual_similarity_tfidf == 0.0


def test_corpus_tfidf_moves_texts_instead_of_terms(spark, plan_of):
    rows = [(1, "red red blue"), (1, "blue sky"), (None, "red sky"), (None, "sea"), (2, None)]
    weights = tfidf.corpus_tfidf(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    found = {(r.id, r.term): (r.tf, r.df) for r in weights.collect()}
    assert found == {
        (1, "red"): (2, 2), (1, "blue"): (2, 1), (1, "sky"): (1, 2), (None, "red"): (1, 2), (None, "sky"): (1, 2), (None, "sea"): (1, 1),
    }
    plan = plan_of(weights)
    assert "hashpartitioning(id" in plan and ", term#" not in "".join(p.split(")")[0] for p in plan.split("hashpartitioning(")[1:])


def test_corpus_tfidf(spark):
    texts = ["the the big dog", "the cat", "the dog sat", "", "the"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {(r.id, r.term): r.tfidf for r in tfidf.corpus_tfidf(df, "id", "text").collect()}
    expected = {(i, t): v for i, w in enumerate(plain_tfidf(texts)) for t, v in w.items()}
    assert found == pytest.approx(expected)


def test_matrix_block_and_points(pairs):
    small = pairs.where("id < 3")
    matrix = evaluate.similarity_matrix(small, "id", "l", "r").collect()
    sizes = [(len(a), len(b)) for a, b in FIELDS[:3]]
    assert len(matrix) == sum((a + b) ** 2 for a, b in sizes)
    assert all(row.cosine == pytest.approx(1.0) for row in matrix if row.left == row.right)
    cells = {(r.id, r.left, r.right): r.cosine for r in matrix}
    block = evaluate.similarity_block(small, "id", "l", "r").collect()
    assert len(block) == sum(a * b for a, b in sizes)
    assert all(cells[r.id, r.left, r.right] == pytest.approx(r.cosine) for r in block)
    points = evaluate.plot_points(small, "id", "l", "r").collect()
    assert len(points) == sum(a + b for a, b in sizes)
    for i in range(3):
        own = [p for p in points if p.id == i]
        assert sum(p.x for p in own) == pytest.approx(0, abs=1e-9)
        assert sum(p.x**2 for p in own) >= sum(p.y**2 for p in own) >= sum(p.z**2 for p in own)


def test_cosines_of_the_table_are_those_of_the_decisions(pairs):
    details = evaluate.decision_details(pairs, "id", "l", "r").where("l_text != r_text").collect()
    cells = {(r.id, r.left, r.right): r.cosine for r in evaluate.similarity_block(pairs, "id", "l", "r").collect()}
    assert details and all(cells[r.id, f"{r.path} (Dict 1)", f"{r.path} (Dict 2)"] == r.similarity for r in details)


def test_word_vectors_are_exact(spark):
    texts = ["", "a", "a a a b", "b c", "A, a! c é é é", "x " * 3_000 + " ".join(f"w{i}" for i in range(3_000)), "?!"]
    df = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "i int, t string")
    left = df.select(F.col("i").alias("i"), similarity.word_counts("t").alias("l"))
    right = df.select(F.col("i").alias("j"), similarity.word_counts("t").alias("r"))
    cells = left.crossJoin(right).select("i", "j", F.expr(similarity.sparse_cosine_sql("l", "r")).alias("c")).collect()
    for row in cells:
        assert row.c == pytest.approx(plain_cosine(bag(texts[row.i]), bag(texts[row.j])))


def test_table_with_an_embedder(pairs):
    model = words_of_length()
    cells = evaluate.similarity_matrix(pairs, "id", "l", "r", embedder=words_of_length).collect()
    assert len(cells) == sum((len(a) + len(b)) ** 2 for a, b in FIELDS)
    side = {" (Dict 1)": 0, " (Dict 2)": 1}

    def vector(i, label):
        path = label[:-9]
        return dict(enumerate(model([f"{path}: {FIELDS[i][side[label[-9:]]][path]}"])[0]))

    for row in cells:
        assert row.cosine == pytest.approx(plain_cosine(vector(row.id, row.left), vector(row.id, row.right)))
    block = {tuple(r) for r in evaluate.similarity_block(pairs, "id", "l", "r", embedder=words_of_length).collect()}
    assert block == {tuple(r) for r in cells if r.left.endswith("1)") and r.right.endswith("2)")}


def test_pca_and_pooling(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    data = rng.normal(size=(40, 5)) * [5, 3, 2, 1, 0.5] + 7
    df = spark.createDataFrame([(i, row.tolist(), i % 2) for i, row in enumerate(data)], "id int, v array<double>, g int")
    points = np.array([[r.pc1, r.pc2, r.pc3] for r in vectors.principal_components(df, "id", "v").orderBy("id").collect()])
    centred = data - data.mean(axis=0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs(points), np.abs((u * s)[:, :3]))
    pooled = {r.g: r.mean_vector for r in vectors.mean_pool(df, "g", "v").collect()}
    assert all(np.allclose(pooled[g], data[g::2].mean(axis=0)) for g in (0, 1))


def test_outputs_are_evaluated(spark):
    rows = [(1, '{"a":"x","b":2}', "Sure {'a': 'x', 'b': 2}"), (2, '{"a":"x"}', "no idea"), (3, '{"a":"x"}', '{"a":"y"}')]
    df = spark.createDataFrame(rows, "id int, expected string, generated_output string")
    scored = {r.id: r for r in evaluate.evaluate_outputs(df, "id", "expected").collect()}
    assert scored[1].weighted_mape == pytest.approx(0)
    assert (scored[2].jaccard_similarity, scored[2].similarity_score) == (0, 0)
    assert (scored[3].jaccard_similarity, scored[3].value_similarity) == (1, 0)
