"""Connected components over a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import cut


def _nearest(links: DataFrame) -> DataFrame:
    """Each node with the smallest of itself and its neighbours."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    nearest = _nearest(down)
    moved = down.join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(nearest.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(u long, v long) links to (u, v): every linked node and the smallest node it can reach.

    Only nodes with a link come out; the smallest node of a component carries no row. Minima are pre-aggregated
    before the shuffle and a hub's rows are joined to one minimum, so adaptive splitting can divide the hub.
    Each round is written to the shared folder; rounds grow with the logarithm of the longest chain.
    """
    links = cut(links.where("u <> v").distinct(), "links")
    before = None
    while True:
        links = _small_star(_large_star(links)).where("u <> v").distinct()
        links = cut(links, "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return links
        before = state
