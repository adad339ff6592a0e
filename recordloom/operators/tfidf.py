"""TF-IDF: corpus weights and similarity of the values of record pairs.

Weights follow the usual smoothed form, idf = ln((1 + n) / (1 + df)) + 1, with every
vector scaled to length 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.text import tokens
from recordloom.functions.tfidf import mean_cosine
from recordloom.functions.tfidf import pair_tfidf as row_tfidf
from recordloom.operators.lookup import join_by_frequency


def smoothed_idf(documents: Column, document_frequency: Column) -> Column:
    return F.log((F.lit(1.0) + documents) / (F.lit(1.0) + document_frequency)) + F.lit(1.0)


def term_frequencies(df: DataFrame, key: str, text: str) -> DataFrame:
    """How often each term occurs in each document.

    The texts are brought together by key before they are taken apart: a text is smaller than the rows of its terms,
    and counting them then moves nothing.
    """
    # the outer form: the optimizer would tokenise twice to filter out texts without tokens
    texts = df.select(F.col(key).alias(key), F.col(text).alias("_text")).repartition(key)
    exploded = texts.select(key, F.explode_outer(tokens("_text")).alias("term")).where("term IS NOT NULL")
    return exploded.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(frequencies: DataFrame) -> DataFrame:
    """In how many documents each term occurs.

    The count reads `tf` so that this branch needs the same columns as the table itself and
    both share the shuffle of the texts.
    """
    return frequencies.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))


def corpus_tfidf(df: DataFrame, key: str, text: str) -> DataFrame:
    """TF-IDF weight of every term of every document, fitted once over the table.

    Common words occur in most documents, so the join of terms to their frequency takes the
    frequent terms from a broadcast of fixed size, and only rows of other terms move for it.
    """
    frequencies = term_frequencies(df, key, text)
    documents = df.agg(F.count(F.lit(1)))
    weighted = join_by_frequency(
        frequencies, document_frequencies(frequencies), "term", "df", values=["df"], spread_by=[key, "term"], stay=True
    ).withColumn("raw", F.col("tf") * smoothed_idf(documents.scalar(), F.col("df")))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", "tf", "df", (F.col("raw") / length).alias("tfidf"))


def pair_tfidf(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """One row for each compared place of two arrays of texts, see `recordloom.functions.tfidf.pair_tfidf`.

    The whole corpus of a pair is in its row: nothing is shuffled or joined.
    """
    return pairs.select(key, F.inline_outer(row_tfidf(left, right))).where("pos IS NOT NULL")


def mean_pair_tfidf(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Mean of `pair_tfidf` per pair; a pair with nothing to compare has no row."""
    means = pairs.select(key, F.explode_outer(F.array(mean_cosine(row_tfidf(left, right)))).alias("tfidf_mean"))
    return means.where("tfidf_mean IS NOT NULL")
