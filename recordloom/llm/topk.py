"""Exact top-k inner products by branch and bound over dimension blocks in vertical layout."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8
CANDIDATES = 16_384
QUERIES = 1024


def integer_vectors(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, vector array<long>): floor(scale * x) of every component; vectors that are null, empty of an id,
    or hold null or non-finite components are left out."""
    x = F.col("v").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad)
    return rows.select("vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("vector"))


def search(columns: np.ndarray, ids: np.ndarray, rest: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best candidates. `columns`: dimensions x candidates; `rest`: lengths of what is left
    of each candidate from each block on. A candidate goes as soon as even the product of the lengths left cannot
    lift it to the k-th best of what the others reach at least."""
    alive = np.flatnonzero(ids != own)
    score = np.zeros(len(alive), np.int64)
    dims = len(query)
    for block, low in enumerate(range(0, dims, BLOCK)):
        high = min(low + BLOCK, dims)
        part = columns[low:high] if len(alive) == columns.shape[1] else columns[low:high, alive]
        score = score + query[low:high] @ part
        left = np.sqrt(float((query[high:].astype(float) ** 2).sum())) * rest[block + 1][alive] + 1.0
        if len(alive) > k and high < dims:
            bound = np.partition(score - left, len(alive) - k)[len(alive) - k]
            keep = score + left >= bound
            alive, score = alive[keep], score[keep]
    if len(alive) > k:
        limit = np.partition(score, len(score) - k)[len(score) - k]
        keep = score >= limit
        alive, score = alive[keep], score[keep]
    order = np.lexsort((ids[alive], -score))[:k]
    return ids[alive[order]], score[order]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k largest inner products with all vectors but its own.

    Both tables have (vec_id, vector array<long>) as from `integer_vectors`. Vectors of other lengths than the query
    are no candidates. Ties go to the smaller id; repeated rows are candidates each; a repeated query is answered
    once; fewer candidates give fewer rows; empty tables give an empty result. Candidates lie in blocks of about
    `CANDIDATES` rows dealt by hash of id and row number, queries in blocks of about `QUERIES`, and each pair of
    blocks is one task's group; only k rows of each query and block leave it.
    """
    n_queries, n_vectors = queries.count(), vectors.count()
    query_blocks, blocks = n_queries // QUERIES + 1, n_vectors // CANDIDATES + 1
    asked = queries.dropDuplicates(["vec_id"]).select(
        "vec_id", "vector", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks).cast("long")).alias("q"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"),
    )
    held = vectors.select(
        "vec_id", "vector", F.explode(F.expr(f"sequence(0L, {query_blocks - 1}L)")).alias("q"),
        F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("b"),
    )
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def matrix(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Ids and rows by length of vector."""
        ids = table.column("vec_id").to_numpy()
        lists = table.column("vector").combine_chunks()
        lengths = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
        values, ends = lists.flatten().to_numpy(), np.cumsum(lengths)
        found = {}
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            found[int(length)] = ids[own], values[(ends[own] - length)[:, None] + np.arange(length)]
        return found

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            candidates = matrix(right)
            for length, (names, rows) in matrix(left).items():
                if length not in candidates:
                    continue
                ids, values = candidates[length]
                columns = np.ascontiguousarray(values.T)
                squares = (values.astype(float) ** 2).cumsum(axis=1)
                total = squares[:, -1] if length else np.zeros(len(ids))
                ends = [min(low + BLOCK, length) for low in range(0, length, BLOCK)]
                rest = [np.sqrt(total), *(np.sqrt(np.maximum(total - squares[:, end - 1], 0)) for end in ends)]
                for name, row in zip(names, rows, strict=True):
                    best, score = search(columns, ids, rest, row, name, k)
                    parts.append((np.full(len(best), name), best, score))
        if not parts:
            return schema.empty_table()
        return pa.table([np.concatenate(part) for part in zip(*parts, strict=True)], schema=schema)

    found = asked.groupBy("q", "b").cogroup(held.groupBy("q", "b")).applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
