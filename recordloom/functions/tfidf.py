"""TF-IDF inside one row: the values of a record pair are its corpus."""

from __future__ import annotations

from pyspark.sql import Column

from recordloom.functions.columns import let, literal, over
from recordloom.functions.text import TOKEN_PATTERN


def _starts_sql(rows: str, differs: str) -> str:
    """Places at which a run of an ordered array begins; `differs` compares its item `x` with the one before, `y`."""
    first = let(f"get({rows}, i - 1)", "y", f"if({differs}, i, NULL)")
    return f"filter(transform({rows}, (x, i) -> if(i = 0, 0, {first})), i -> i IS NOT NULL)"


def _runs_sql(rows: str, starts: str, body: str) -> str:
    """An item for each run; `body` may use `start`, where it begins, and `length`."""
    ending = let(f"coalesce(get({starts}, k + 1), size({rows})) - start", "length", body)
    return f"transform({starts}, (start, k) -> {ending})"


def pair_tfidf(left: Column | str, right: Column | str) -> Column:
    """ARRAY<STRUCT<pos, tfidf_cosine>>: cosine of the i-th text of one array and the i-th of the other.

    All texts of both sides make up the corpus; positions beyond the shorter side are not compared, a text without
    tokens has cosine 0, a null text counts as empty. Weights follow the usual smoothed form,
    idf = ln((1 + n) / (1 + df)) + 1. The tokens of all texts are ordered once by term, place and side: a run of equal
    ones is a frequency, the runs of a term give its document frequency, and neighbours at one place the products. The
    products are ordered by place and summed run by run, so the work grows with the tokens alone.
    """
    return over(lambda left, right: pair_tfidf_sql(left, right), left=left, right=right)


def pair_tfidf_sql(left: str, right: str) -> str:
    def tagged(texts: str, side: int) -> str:
        found = f"regexp_extract_all(lower(coalesce(t, '')), {literal(TOKEN_PATTERN)}, 0)"
        return f"flatten(transform({texts}, (t, i) -> transform({found}, w -> struct(w AS term, i AS pos, {side} AS side))))"

    tokens = f"sort_array(concat({tagged(left, 0)}, {tagged(right, 1)}))"
    cells = let(
        _starts_sql("tokens", "x.term != y.term OR x.pos != y.pos OR x.side != y.side"),
        "starts",
        _runs_sql("tokens", "starts", let(
            "get(tokens, start)", "x",
            "struct(x.term AS term, x.pos AS pos, x.side AS side, CAST(length AS DOUBLE) AS tf)")),
    )
    # Of one term: each cell's squared weight, and the product with the cell of the other side at the same place.
    product = """if(x.side = 0 AND get(held, j + 1).pos = x.pos, x.tf * get(held, j + 1).tf * idf * idf, 0D)"""
    weighed = f"""transform(held, (x, j) -> struct(x.pos AS pos, {product} AS lr,
        if(x.side = 0, x.tf * x.tf * idf * idf, 0D) AS ll, if(x.side = 1, x.tf * x.tf * idf * idf, 0D) AS rr))"""
    idf = "ln((1D + docs) / (1D + length)) + 1D"
    by_term = let(
        _starts_sql("cells", "x.term != y.term"),
        "starts",
        f"flatten({_runs_sql('cells', 'starts', let(idf, 'idf', let('slice(cells, start + 1, length)', 'held', weighed)))})",
    )
    places = "transform(sequence(0, compared - 1), p -> struct(p AS pos, 0D AS lr, 0D AS ll, 0D AS rr))"
    products = f"sort_array(concat(filter({by_term}, c -> c.pos < compared), {places}))"
    added = "struct(acc.lr + c.lr AS lr, acc.ll + c.ll AS ll, acc.rr + c.rr AS rr)"
    cosine = "if(acc.ll > 0 AND acc.rr > 0, acc.lr / sqrt(acc.ll * acc.rr), 0D)"
    total = f"""struct(get(products, start).pos AS pos, aggregate(slice(products, start + 1, length),
        struct(0D AS lr, 0D AS ll, 0D AS rr), (acc, c) -> {added}, acc -> {cosine}) AS tfidf_cosine)"""
    summed = let(_starts_sql("products", "x.pos != y.pos"), "starts", _runs_sql("products", "starts", total))
    found = let(tokens, "tokens", let(cells, "cells", let(products, "products", summed)))
    sized = let(f"size({left}) + size({right})", "docs", found)
    empty = "CAST(array() AS ARRAY<STRUCT<pos: INT, tfidf_cosine: DOUBLE>>)"
    return let(f"least(size({left}), size({right}))", "compared", f"if(compared > 0, {sized}, {empty})")


def mean_cosine(cosines: Column | str) -> Column:
    """Mean of the cosines of `pair_tfidf`; null when there is nothing to compare."""
    return over(
        lambda cosines: f"if(size({cosines}) > 0, aggregate({cosines}, 0D, (total, c) -> total + c.tfidf_cosine) / size({cosines}), NULL)",
        cosines=cosines,
    )
