import hashlib

import pytest

from recordloom.llm import fim

MARKS = (b"<P>", b"<S>", b"<M>")


def plainly(doc_id, text):
    """The contract by slices: (n, form, prefix_chars, middle_chars, output)."""
    text = text or ""
    n, digest = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(mark in text for mark in fim.SENTINELS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_matches_slicing_and_restores(spark):
    samples = ["", None, "x", "ab", "<P", "a<S", "été 中文 \U0001f600 é", "has <M> inside", "p" * 70_001 + "é" * 70_002, "<<S<P<M>>"[:5]]
    rows = [(i, samples[i % len(samples)]) for i in range(200)] + [(None, "null id"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS output", "1 AS n", "'y' AS form")
    found = fim.restored(fim.fill_in_middle(docs)).collect()
    key = lambda row: (row[0] is None, row[0] or 0, *map(str, row[1:]))
    expected = sorted(((i, *plainly(i, t), t or "") for i, t in rows), key=key)
    assert sorted((tuple(row) for row in found), key=key) == expected
    assert {row.form for row in found} == {"plain", "psm", "spm"}


def test_parameters_and_empty_table(spark):
    docs = spark.createDataFrame([(i, "text of some length") for i in range(50)], "doc_id long, text string")
    marks = ("[pre]", "[suf]", "[mid]")
    found = fim.restored(fim.fill_in_middle(docs, sentinels=marks, changed=100, suffix_first=100, seed="9"), sentinels=marks)
    assert all(row.form == "spm" and row.output.startswith("[suf]") and row.restored == "text of some length" for row in found.collect())
    assert fim.restored(fim.fill_in_middle(docs.limit(0))).collect() == []


def test_sentinels_that_overlap_are_refused(spark):
    docs = spark.range(1).selectExpr("id AS doc_id", "'' AS text")
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("ab", "bc", "x"), ("aa", "b", "c"), ("abc", "b", "d")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(docs, sentinels=marks)


def test_reverse_works_in_blocks(monkeypatch):
    monkeypatch.setattr(fim, "SWAP_BYTES", 3)
    for n in range(40):
        for middle in range(n + 1):
            text = bytearray(range(n))
            fim.rotate(text, 0, middle, n)
            assert text == bytes(range(middle, n)) + bytes(range(middle))


def test_no_shuffle(spark, plan_of):
    docs = spark.range(3).selectExpr("id AS doc_id", "'some text' AS text")
    assert "Exchange" not in plan_of(fim.digests(fim.restored(fim.fill_in_middle(docs))))
