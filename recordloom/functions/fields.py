"""Field alignment of two records inside one row, and the measures over it.

Both records of a pair sit in the same row, so their fields are matched there: the two
flattened arrays are concatenated, sorted once and neighbours with the same path are put
together. That is a full outer join on the path which needs no shuffle, however many
pairs the table has and however the pair keys are distributed.

An aligned field is STRUCT<path, l_type, l_text, r_type, r_text>; a side that lacks the
field has a null type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.columns import as_column, let, over

LEAVES_TYPE = "array<struct<path:string,type:string,text:string>>"

# SQL conditions on an aligned field `f`.
ON_BOTH_SIDES = "f.l_type IS NOT NULL AND f.r_type IS NOT NULL"
TO_COMPARE = f"{ON_BOTH_SIDES} AND f.l_text != f.r_text"


def _number_sql(side: str) -> str:
    return f"if(f.{side}_type = 'bool', CAST(f.{side}_text = 'True' AS DOUBLE), try_cast(f.{side}_text AS DOUBLE))"


_NUMBERS = "('int', 'float', 'bool')"
# Equality of two leaves; numbers and booleans compare as numbers.
VALUES_EQUAL = f"""(f.l_type = f.r_type AND f.l_text = f.r_text)
    OR coalesce(f.l_type != f.r_type AND f.l_type IN {_NUMBERS} AND f.r_type IN {_NUMBERS}
                AND {_number_sql("l")} = {_number_sql("r")}, false)"""


def last_wins(leaves: Column | str) -> Column:
    """One leaf per path: the place of the first, the value of the last. Needs one sort."""
    return over(lambda leaves: last_wins_sql(leaves), leaves=leaves)


def last_wins_sql(leaves: str) -> str:
    placed = f"sort_array(transform({leaves}, (x, i) -> struct(x.path AS path, i AS place, x.type AS type, x.text AS text)))"
    first = "if(i > 0 AND get(rows, i - 1).path = x.path, NULL, x.place)"
    last = "i = size(rows) - 1 OR get(rows, i + 1).path != x.path"
    kept = f"""zip_with(
        filter(transform(rows, (x, i) -> {first}), place -> place IS NOT NULL),
        filter(rows, (x, i) -> {last}),
        (place, x) -> struct(place AS place, x.path AS path, x.type AS type, x.text AS text))"""
    return (
        f"transform(sort_array({let(placed, 'rows', kept)}), "
        "x -> struct(x.path AS path, x.type AS type, x.text AS text))"
    )


def align_fields(left: Column | str, right: Column | str) -> Column:
    """Full outer match of two flattened records by path, sorted by path."""
    return over(lambda left, right: align_sql(left, right), left=left, right=right)


def align_sql(left: str, right: str) -> str:
    def tagged(leaves: str, side: int) -> str:
        return f"transform({leaves}, (x, i) -> struct(x.path AS path, {side} AS side, i AS place, x.type AS type, x.text AS text))"

    both = f"sort_array(concat({tagged(left, 0)}, {tagged(right, 1)}))"
    # Of several leaves of one side with the same path the last one stands.
    last_of_side = """filter(rows, (x, i) -> i = size(rows) - 1
        OR get(rows, i + 1).path != x.path OR get(rows, i + 1).side != x.side)"""
    matched = "get(rows, i + 1).path = x.path"
    taken = "i > 0 AND get(rows, i - 1).path = x.path"
    paired = f"""filter(transform(rows, (x, i) -> CASE
        WHEN x.side = 0 AND {matched} THEN struct(
            x.path AS path, x.type AS l_type, x.text AS l_text, get(rows, i + 1).type AS r_type, get(rows, i + 1).text AS r_text)
        WHEN x.side = 0 THEN struct(
            x.path AS path, x.type AS l_type, x.text AS l_text, CAST(NULL AS STRING) AS r_type, CAST(NULL AS STRING) AS r_text)
        WHEN {taken} THEN NULL
        ELSE struct(
            x.path AS path, CAST(NULL AS STRING) AS l_type, CAST(NULL AS STRING) AS l_text,
            x.type AS r_type, x.text AS r_text) END), f -> f IS NOT NULL)"""
    return let(let(both, "rows", last_of_side), "rows", paired)


def key_jaccard(fields: Column | str) -> Column:
    """Share of paths found on both sides; 0 when there are none."""
    return over(
        lambda fields: f"if(size({fields}) > 0, size(filter({fields}, f -> {ON_BOTH_SIDES})) / size({fields}), 0D)",
        fields=fields,
    )


def value_match(fields: Column | str) -> Column:
    """Share of common fields with equal values; 0 when there are none in common."""
    return over(lambda fields: value_match_sql(fields), fields=fields)


def value_match_sql(fields: str) -> str:
    share = f"if(size(common) > 0, size(filter(common, f -> {VALUES_EQUAL})) / size(common), 0D)"
    return let(f"filter({fields}, f -> {ON_BOTH_SIDES})", "common", share)


def key_overlap(left_keys: Column | str, right_keys: Column | str) -> Column:
    """Share of top-level keys found in both records; 0 when either has none."""
    return over(
        lambda left, right: f"""if(size({left}) > 0 AND size({right}) > 0,
            size(array_intersect({left}, {right})) / size(array_union({left}, {right})), 0D)""",
        left=left_keys,
        right=right_keys,
    )


# --- per-field decisions ----------------------------------------------------------

# The five decision labels, the two that count as correct, the thresholds.
MISSING_LEFT = "missing in Dict 1"
MISSING_RIGHT = "missing in Dict 2"
GOOD = "good"
MINOR = "minor difference"
MISMATCH = "value mismatch"
DECISION_THRESHOLD = 0.8
COMPARE_THRESHOLD = 0.9


def decision_sql(similarity: str, threshold: float) -> str:
    """Decision label of an aligned field `f` given the similarity of its two values."""
    return f"""CASE
        WHEN f.l_type IS NULL THEN '{MISSING_LEFT}'
        WHEN f.r_type IS NULL THEN '{MISSING_RIGHT}'
        WHEN f.l_text = f.r_text OR {similarity} = 1 THEN '{GOOD}'
        WHEN {similarity} >= {float(threshold)}D THEN '{MINOR}'
        ELSE '{MISMATCH}' END"""


def decision_score(decisions: Column | str) -> Column:
    """Share of decisions that count as correct; null for a pair without fields."""
    correct = f"d -> d.decision IN ('{GOOD}', '{MINOR}')"
    return over(
        lambda decisions: f"if(size({decisions}) > 0, size(filter({decisions}, {correct})) / size({decisions}), NULL)",
        decisions=decisions,
    )


def absolute_percentage_error(value: Column | str) -> Column:
    """Distance of a similarity from its expected value of 1."""
    return F.abs(F.lit(1.0) - as_column(value))


def weighted_error(metrics: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted sum of the absolute percentage errors of the metrics."""
    missing = [name for name in metrics if weights.get(name) is None]
    if missing:
        raise ValueError(f"no weight given for {missing}")
    if abs(sum(weights.values()) - 1.0) > 1e-9:
        raise ValueError("weights must sum to 1")
    total = F.lit(0.0)
    for name, value in metrics.items():
        total = total + F.lit(float(weights[name])) * absolute_percentage_error(value)
    return total
