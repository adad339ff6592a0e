"""Lookups and joins that hold when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FREQUENT_KEYS = 1024


def lookup(
    rows: DataFrame, table: DataFrame, key: str, default: dict[str, Column], spread_by: str | None = None, salt: int = 1
) -> DataFrame:
    """Left join to a table with unique keys; missing entries get `default` values.

    The planner broadcasts the table when its size allows it, else both sides shuffle and
    adaptive execution splits oversized partitions. With `salt` > 1 a hot key is spread over
    that many partitions up front: rows take a salt from `spread_by`, the table is repeated
    once per salt value.
    """
    keys = [key]
    if salt > 1:
        if spread_by is None:
            raise ValueError("salt needs spread_by, a column that differs between rows of one key")
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salt)).cast("int"))
        table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        keys.append("_salt")
    joined = rows.join(table, keys, "left")
    filled = {name: F.coalesce(F.col(name), value) for name, value in default.items()}
    return joined.withColumns(filled).drop("_salt")


def join_by_frequency(
    rows: DataFrame,
    stats: DataFrame,
    key: str,
    count: str,
    values: list[str],
    spread_by: list[str],
    hot_values: DataFrame | None = None,
    frequent: int = FREQUENT_KEYS,
    stay: bool = False,
) -> DataFrame:
    """Left join of `rows` to per-key `stats` where `count` says how often a key occurs.

    The `frequent` most common keys are broadcast, a fixed number of rows at any size.
    What is left for the shuffle join then has keys that each hold less than one row in
    `frequent`; rows that are already served are spread by `spread_by` instead of their key.
    `hot_values` may supply the frequent part when it is cheaper to compute separately.
    With `stay` rows that are already served are not shuffled at all; `rows` are then computed once for them and once
    for the others, so it suits rows that cost less to compute than to move.
    """
    if hot_values is None:
        hot_values = stats.orderBy(F.desc(count), key).limit(frequent)
    hot = F.broadcast(
        hot_values.select(F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    )
    served = F.col("_hot_key").isNotNull()
    if stay:
        met = rows.join(hot, F.col(key) == F.col("_hot_key"), "left")
        at_once = met.where(served).select(*rows.columns, *[F.col("_hot")[name].alias(name) for name in values])
        others = met.where(~served).select(*rows.columns)
        looked_up = stats.select(F.col(key).alias("_cold_key"), F.struct(*values).alias("_cold"))
        found = others.join(looked_up, F.col(key) == F.col("_cold_key"), "left")
        return at_once.unionByName(found.select(*rows.columns, *[F.col("_cold")[name].alias(name) for name in values]))
    tagged = rows.join(hot, F.col(key) == F.col("_hot_key"), "left").withColumns(
        {
            "_served": served,
            "_route": F.when(served, F.xxhash64(*spread_by).cast("string")).otherwise(F.col(key)),
        }
    )
    cold = stats.select(
        F.lit(False).alias("_served"), F.col(key).alias("_route"), F.struct(*values).alias("_cold")
    )
    joined = tagged.join(cold, ["_served", "_route"], "left")
    found = F.coalesce(F.col("_hot"), F.col("_cold"))
    return joined.select(*rows.columns, *[found[name].alias(name) for name in values])
