"""Similarity of two values: strings, numbers, lists, records, vectors."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.columns import as_column, let, literal, over
from recordloom.functions.fields import align_sql, value_match_sql
from recordloom.functions.records import expand_sql, top_level_sql, type_name_sql
from recordloom.functions.text import WORD_PATTERN


def char_overlap(left: Column | str, right: Column | str) -> Column:
    """Twice the characters of `left` that occur in `right`, over both lengths.

    Repeats count and the measure is not symmetric. `translate` with nothing to translate to
    deletes the shared characters, so the cost is linear in the two lengths.
    """
    return over(lambda left, right: char_overlap_sql(left, right), left=left, right=right)


def levenshtein_ratio(left: Column | str, right: Column | str) -> Column:
    """Cheap in-JVM companion of the sequence ratio: 1 minus the edit distance over the longer length."""
    left, right = as_column(left), as_column(right)
    longest = F.greatest(F.length(left), F.length(right))
    return F.when(longest > 0, F.lit(1.0) - F.levenshtein(left, right) / longest).otherwise(F.lit(1.0))


def char_overlap_sql(left: str, right: str) -> str:
    shared = f"length({left}) - length(translate({left}, {right}, ''))"
    total = f"(length({left}) + length({right}))"
    return f"if({total} > 0, 2D * ({shared}) / {total}, 0D)"


def value_similarity(left: Column | str, right: Column | str) -> Column:
    """Similarity of two VARIANT values by their types; 0 for types that do not go together.

    Strings by character overlap, numbers and booleans by distance, records by the share of
    common keys with equal values, lists by the mean similarity of their elements over the
    longer length, to any depth of lists in lists.
    """
    return over(lambda left, right: value_similarity_sql(left, right), left=left, right=right)


# A pair of lists becomes the pairs of its elements, each with its share of the weight; all other pairs are done.
_ELEMENT_PAIRS = let(
    "struct(try_variant_get(n.l, '$', 'array<variant>') AS l, try_variant_get(n.r, '$', 'array<variant>') AS r)",
    "q",
    """if(q.l IS NULL OR q.r IS NULL, array(struct(n.l AS l, n.r AS r, n.w AS w, true AS done)),
        filter(zip_with(q.l, q.r, (a, b) ->
            struct(a AS l, b AS r, n.w / greatest(size(q.l), size(q.r)) AS w, false AS done)),
            c -> c.l IS NOT NULL AND c.r IS NOT NULL))""",
)


def value_similarity_sql(left: str, right: str) -> str:
    start = f"array(struct({left} AS l, {right} AS r, 1D AS w, false AS done))"
    pairs = expand_sql(start, f"if(n.done, array(n), {_ELEMENT_PAIRS})")
    return f"aggregate({pairs}, 0D, (total, n) -> total + n.w * coalesce({_plain_similarity_sql('n.l', 'n.r')}, 0D))"


def _plain_similarity_sql(left: str, right: str) -> str:
    """Similarity of two values that are not both lists."""

    def number(side: str) -> str:
        flag = f"CAST(try_variant_get(p.{side}, '$', 'boolean') AS DOUBLE)"
        return f"if(p.{side}t = 'bool', {flag}, try_variant_get(p.{side}, '$', 'double'))"

    strings = let(
        "struct(try_variant_get(p.l, '$', 'string') AS l, try_variant_get(p.r, '$', 'string') AS r)",
        "s",
        char_overlap_sql("s.l", "s.r"),
    )
    records = value_match_sql(align_sql(top_level_sql("p.l"), top_level_sql("p.r")))
    numbers = "('int', 'float', 'bool')"
    chosen = f"""CASE
        WHEN p.lt = 'str' AND p.rt = 'str' THEN {strings}
        WHEN p.lt IN {numbers} AND p.rt IN {numbers} THEN 1D / (1D + abs({number("l")} - {number("r")}))
        WHEN p.lt = 'dict' AND p.rt = 'dict' THEN {records}
        ELSE 0D END"""
    typed = f"struct({left} AS l, {right} AS r, {type_name_sql(left)} AS lt, {type_name_sql(right)} AS rt)"
    return let(typed, "p", chosen)


def list_similarity(left: Column | str, right: Column | str) -> Column:
    """Sum of the similarities of elements at equal places over the longer length; 0 if both are empty or one is no list."""
    return over(lambda left, right: list_similarity_sql(left, right), left=left, right=right)


def list_similarity_sql(left: str, right: str) -> str:
    lists = " AND ".join(f"startswith(schema_of_variant({side}), 'ARRAY')" for side in (left, right))
    return f"if({lists}, {value_similarity_sql(left, right)}, 0D)"


# --- vectors ----------------------------------------------------------------------


def dot_sql(left: str, right: str) -> str:
    products = f"zip_with({left}, {right}, (a, b) -> CAST(a AS DOUBLE) * CAST(b AS DOUBLE))"
    return f"aggregate({products}, 0D, (total, x) -> total + x)"


def dot(left: Column | str, right: Column | str) -> Column:
    return over(lambda left, right: dot_sql(left, right), left=left, right=right)


def norm(vector: Column | str) -> Column:
    return over(lambda vector: f"sqrt({dot_sql(vector, vector)})", vector=vector)


def dense_cosine(left: Column | str, right: Column | str, left_norm: Column, right_norm: Column) -> Column:
    """Cosine of two dense vectors with their norms computed beforehand; 0 for a zero vector."""
    return over(
        lambda left, right, scale: f"if({scale} > 0, {dot_sql(left, right)} / {scale}, 0D)",
        left=left,
        right=right,
        scale=left_norm * right_norm,
    )


def _words_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), {literal(WORD_PATTERN)}, 0)"


def word_counts(text: Column | str) -> Column:
    """Sparse vector of the words of a text: STRUCT<words, counts, squares>.

    `words` are the distinct words in order, `counts` the same words each with how often it occurs, `squares` the sum of
    the squared counts.
    """
    return over(lambda text: word_counts_sql(text), text=text)


def word_counts_sql(text: str) -> str:
    starts = "filter(transform(ws, (w, i) -> if(i > 0 AND get(ws, i - 1) = w, NULL, i)), i -> i IS NOT NULL)"
    counts = """transform(starts, (start, i) ->
        struct(get(ws, start) AS word, CAST(coalesce(get(starts, i + 1), size(ws)) - start AS BIGINT) AS n))"""
    vector = """struct(transform(counts, c -> c.word) AS words, counts AS counts,
        aggregate(counts, 0L, (total, c) -> total + c.n * c.n) AS squares)"""
    return let(f"sort_array({_words_sql(text)})", "ws", let(starts, "starts", let(counts, "counts", vector)))


def sparse_dot_sql(left: str, right: str) -> str:
    """Dot product of two vectors of `word_counts`, exact.

    The distinct words they share are found first. Without repeated words on either side their number is the product;
    otherwise the two ordered arrays are merged, so that equal words become neighbours, and folded once.
    """
    common = f"size(array_intersect({left}.words, {right}.words))"
    merged = f"sort_array(concat({left}.counts, {right}.counts))"
    step = """if(acc.word = x.word, struct(x.word AS word, 0L AS n, acc.total + acc.n * x.n AS total),
        struct(x.word AS word, x.n AS n, acc.total AS total))"""
    folded = f"aggregate({merged}, struct('' AS word, 0L AS n, 0L AS total), (acc, x) -> {step}, acc -> acc.total)"
    return f"""CASE WHEN {common} = 0 THEN 0L
        WHEN {left}.squares = size({left}.words) AND {right}.squares = size({right}.words) THEN CAST({common} AS BIGINT)
        ELSE {folded} END"""


def sparse_cosine_sql(left: str, right: str) -> str:
    """Cosine of two vectors of `word_counts`; 0 when either has no words."""
    scale = f"CAST({left}.squares AS DOUBLE) * CAST({right}.squares AS DOUBLE)"
    return f"if({left}.squares > 0 AND {right}.squares > 0, CAST({sparse_dot_sql(left, right)} AS DOUBLE) / sqrt({scale}), 0D)"


def bag_cosine(left: Column | str, right: Column | str) -> Column:
    """Cosine of the word counts of two texts; 0 when either has no words.

    The words of both texts are sorted together and folded once with a state of fixed
    size, so long texts cost one sort and no quadratic counting.
    """
    return over(lambda left, right: bag_cosine_sql(left, right), left=left, right=right)


def bag_cosine_sql(left: str, right: str) -> str:
    def tagged(text: str, side: int) -> str:
        return f"transform({_words_sql(text)}, w -> struct(w AS word, {side} AS side))"

    both = f"sort_array(concat({tagged(left, 0)}, {tagged(right, 1)}))"
    # l and r count the current word; lr, ll and rr sum the products of finished words.
    start = "struct('' AS word, 0L AS l, 0L AS r, 0L AS lr, 0L AS ll, 0L AS rr)"
    step = """if(acc.word = x.word,
        struct(x.word AS word, acc.l + 1L - x.side AS l, acc.r + x.side AS r,
               acc.lr AS lr, acc.ll AS ll, acc.rr AS rr),
        struct(x.word AS word, 1L - x.side AS l, 0L + x.side AS r,
               acc.lr + acc.l * acc.r AS lr, acc.ll + acc.l * acc.l AS ll, acc.rr + acc.r * acc.r AS rr))"""
    total = """struct(CAST(acc.lr + acc.l * acc.r AS DOUBLE) AS lr,
        CAST(acc.ll + acc.l * acc.l AS DOUBLE) * CAST(acc.rr + acc.r * acc.r AS DOUBLE) AS scale)"""
    cosine = let(total, "t", "if(t.scale > 0, t.lr / sqrt(t.scale), 0D)")
    return f"aggregate({both}, {start}, (acc, x) -> {step}, acc -> {cosine})"


# Word-count cosine of the two "key: value" texts of an aligned field `f`.
FIELD_BAG_COSINE = bag_cosine_sql("concat(f.path, ': ', f.l_text)", "concat(f.path, ': ', f.r_text)")


# --- sequence ratio ---------------------------------------------------------------


def sequence_ratio(left: Column | str, right: Column | str, autojunk: bool = True) -> Column:
    """Matching-blocks ratio of two texts (twice the matched characters over both lengths).

    Equal texts are answered without leaving the JVM; the others go to Python in Arrow
    batches.
    """
    left, right = as_column(left), as_column(right)

    @F.pandas_udf("double")
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([_ratio(x, y, autojunk) for x, y in zip(a, b)], dtype="float64")

    scored = ratio(F.when(left != right, left), F.when(left != right, right))
    return F.when(left == right, F.lit(1.0)).when(left.isNotNull() & right.isNotNull(), scored)


def sequence_ratios(left: Column | str, right: Column | str, autojunk: bool = True) -> Column:
    """`sequence_ratio` for two arrays of equal length: one call per pair instead of one row per field."""

    @F.pandas_udf("array<double>")
    def ratios(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([[_ratio(x, y, autojunk) for x, y in zip(xs, ys)] for xs, ys in zip(a, b)])

    return ratios(as_column(left), as_column(right))


def _ratio(a: str | None, b: str | None, autojunk: bool) -> float | None:
    if a is None or b is None:
        return None
    return SequenceMatcher(None, a, b, autojunk).ratio()
