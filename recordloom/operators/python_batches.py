"""Calls to user models: text embedding and text generation in Arrow batches.

A model is given as a factory. The factory is called once per Python worker process and
returns the function that is applied to each batch, so loading cost is paid per worker and
never per row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.columns import as_column
from recordloom.operators.lookup import FREQUENT_KEYS, join_by_frequency

# Default generation settings.
GENERATION_DEFAULTS = {
    "penalty_alpha": 0.6,
    "do_sample": True,
    "top_k": 5,
    "temperature": 0.1,
    "repetition_penalty": 10.2,
    "max_new_tokens": 200,
}

EmbedderFactory = Callable[[], Callable[[list[str]], list[list[float]]]]
GeneratorFactory = Callable[[dict], Callable[[list[str]], list[str]]]
TokenizerFactory = Callable[[], Callable[[str], int]]


def embed(text: Column | str, factory: EmbedderFactory) -> Column:
    """Vector of each text."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for batch in batches:
            yield pd.Series(list(model(batch.tolist())), index=batch.index)

    return vectors(as_column(text))


def embed_distinct(df: DataFrame, text: str, factory: EmbedderFactory, spread_by: list[str]) -> DataFrame:
    """Add `vector`, calling the model once per distinct text.

    The same field text may stand in a large part of the rows, so the vectors come back
    through a join that serves frequent texts by broadcast.
    """
    counts = df.where(F.col(text).isNotNull()).groupBy(text).agg(F.count(F.lit(1)).alias("_n"))
    frequent = counts.orderBy(F.desc("_n"), text).limit(FREQUENT_KEYS)
    return join_by_frequency(
        df,
        counts.select(text, "_n", embed(text, factory).alias("vector")),
        text,
        "_n",
        values=["vector"],
        spread_by=spread_by,
        hot_values=frequent.select(text, embed(text, factory).alias("vector")),
    )


def count_tokens(text: Column | str, factory: TokenizerFactory) -> Column:
    """Token count by a user tokenizer."""

    @F.pandas_udf("int")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = factory()
        for batch in batches:
            yield batch.map(lambda value: None if value is None else count(value)).astype("Int32")

    return counts(as_column(text))


def generate(
    df: DataFrame,
    factory: GeneratorFactory,
    prompt: str = "preprocessed_input",
    output: str = "generated_output",
    config: dict | None = None,
) -> DataFrame:
    """Add one generated text per row; `config` overrides the default generation settings.

    The time the model took for each batch, divided by its rows, is kept in
    `generation_seconds`, so that its sum over the table is the total model time.
    """
    settings = {**GENERATION_DEFAULTS, **(config or {})}

    @F.pandas_udf("text string, seconds double")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from time import perf_counter

        model = factory(settings)
        for batch in batches:
            start = perf_counter()
            made = list(model(batch.tolist()))
            share = (perf_counter() - start) / max(len(batch), 1)
            yield pd.DataFrame({"text": made, "seconds": share}, index=batch.index)

    called = df.withColumn("_generated", texts.asNondeterministic()(F.col(prompt)))
    return called.withColumns(
        {output: F.col("_generated.text"), "generation_seconds": F.col("_generated.seconds")}
    ).drop("_generated")
