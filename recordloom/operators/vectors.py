"""Vectors: pooling, principal components, similarity tables of the fields of a pair."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.columns import as_column, over
from recordloom.functions.similarity import word_counts_sql

LEFT = "Dict 1"
RIGHT = "Dict 2"
COMPONENTS = 3


def mean_pool(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector per key. Places are averaged one by one, so partial sums are taken before the shuffle."""
    places = df.select(key, F.posexplode(vector).alias("pos", "value"))
    means = places.groupBy(key, "pos").agg(F.avg(F.col("value").cast("double")).alias("mean"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "mean")))
    return means.groupBy(key).agg(F.transform(ordered, lambda place: place["mean"]).alias("mean_vector"))


def principal_components(df: DataFrame, key: str, vector: str, k: int = COMPONENTS) -> DataFrame:
    """Every vector projected on the first `k` principal components of the table.

    Only the covariance matrix, whose size is the vector length squared, is formed centrally.
    The sign of a component is arbitrary.
    """
    vectors = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_raw"))
    centre = StandardScaler(withMean=True, withStd=False, inputCol="_raw", outputCol="_centred").fit(vectors)
    centred = centre.transform(vectors)
    projected = PCA(k=k, inputCol="_centred", outputCol="_pc").fit(centred).transform(centred)
    points = vector_to_array("_pc")
    return projected.select(key, *[points[i].alias(f"pc{i + 1}") for i in range(k)])


def pair_points(products: Column | str, k: int = COMPONENTS) -> Column:
    """The fields of one pair placed on their own first `k` principal components.

    `products` holds the dot products of the vectors of all fields with each other; with their means taken off, their
    eigenvectors are the components' coordinates, however long the vectors are. One row holds one pair, so the work is
    spread as the rows are. Each component is turned so that its largest coordinate is positive.
    """

    @F.pandas_udf("array<array<double>>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        def points(rows):
            if rows is None or len(rows) == 0:
                return []
            gram = np.array([np.asarray(row, dtype="float64") for row in rows])
            means = gram.mean(axis=0)
            values, directions = np.linalg.eigh(gram - means - means[:, None] + means.mean())
            values, directions = values[::-1][:k], directions[:, ::-1][:, :k]
            found = directions * np.sqrt(np.where(values > 1e-12 * max(values[0], 1.0), values, 0.0))
            top = np.abs(found).argmax(axis=0)
            coordinates = np.zeros((len(gram), k))
            coordinates[:, : found.shape[1]] = found * np.where(found[top, range(found.shape[1])] < 0, -1.0, 1.0)
            return coordinates.tolist()

        for batch in batches:
            yield batch.map(points)

    return project(as_column(products))


def labelled_words(fields: Column | str, side: str) -> Column:
    """Fields of one side as ARRAY<STRUCT<label, vector>>, the vector being the exact word counts of "path: text"."""
    vector = word_counts_sql("concat(x.path, ': ', x.text)")
    entry = f"struct(concat(x.path, ' ({side})') AS label, {vector} AS vector)"
    return over(lambda fields: f"transform({fields}, x -> {entry})", fields=fields)


def cosine_table(df: DataFrame, key: str, left: str, right: str, cosine: str) -> DataFrame:
    """Cosines between two arrays of labelled vectors of the same row, one row per combination.

    `cosine` is the SQL text of the cosine of the vectors `l.vector` and `r.vector`. The table has as many rows per pair
    as its records have field combinations, because that matrix is the result asked for; fields of different pairs
    never meet.
    """
    rows = df.select(key, F.explode_outer(left).alias("l"), F.col(right).alias("_rights"))
    cells = rows.select(key, "l", F.explode_outer("_rights").alias("r")).where("l IS NOT NULL AND r IS NOT NULL")
    return cells.select(
        key, F.col("l.label").alias("left"), F.col("r.label").alias("right"), F.expr(cosine).alias("cosine")
    )
