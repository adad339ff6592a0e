"""Formatting of training tables and their preparation for a training run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.columns import let, over
from recordloom.functions.prompts import render_prompt, render_training_text
from recordloom.functions.records import map_json_text, map_sql, parse_sql, rename_sql, schema_map_sql
from recordloom.functions.text import buffered_budget, repair_record_text, token_count
from recordloom.operators.order import first_rows, row_at
from recordloom.operators.records import rejection_sql, table_signature
from recordloom.operators.split import SEED, TEST_SIZE, split_exact
from recordloom.sources.tables import export_splits, read_table, write_training_table

ON_ERROR = ("quarantine", "stop", "fail")
SCHEMA_SOURCES = ("record", "given")


def parse_outputs(
    df: DataFrame, mapping: dict[str, str] | None = None, repair: str = "parity", output: Column | str = "output"
) -> DataFrame:
    """Add the parsed and renamed record, its schema text and the reason why a row is unusable.

    The columns are `record` (MAP<STRING,VARIANT>), `schema_str` and `reason`. All three come out
    of one generator over a single row, so each text is repaired and parsed once: filters on
    them stay above the generator instead of repeating the parse below it.
    """

    def body(text: str) -> str:
        result = f"struct(renamed AS record, to_json({schema_map_sql('renamed')}) AS schema_str, reason AS reason)"
        renamed = f"if(reason IS NULL, {rename_sql('entries', mapping or {}, 'json_to_schema')}, NULL)"
        judged = let(rejection_sql("record", "entries"), "reason", let(renamed, "renamed", result))
        return let(parse_sql(text), "record", let(map_sql("record"), "entries", judged))

    parsed = over(body, text=repair_record_text(output, repair))
    return df.select("*", F.inline_outer(F.array(parsed)))


def quarantine(df: DataFrame, mapping: dict[str, str] | None = None, repair: str = "parity") -> DataFrame:
    """The rows that `format_training_data` sets aside, unchanged, with the reason."""
    return parse_outputs(df, mapping, repair).where(F.col("reason").isNotNull()).select(*df.columns, "reason")


def format_training_data(
    df: DataFrame,
    mapping: dict[str, str] | None = None,
    model_name: str = "",
    schema_str: str = "",
    key: str = "id",
    on_error: str = "quarantine",
    repair: str = "parity",
    schema_source: str = "record",
) -> DataFrame:
    """Prompt, record and training text for every row.

    Without an `output` column only `preprocessed_input` is added. With one, `output` becomes
    JSON, the prompt shows the schema of that record (or `schema_str` with
    ``schema_source="given"``) and `text` is added. `on_error` says what an unusable record
    does: ``quarantine`` leaves the row out (see `quarantine`), ``fail`` ends the query,
    ``stop`` formats the rows before the first unusable one by key, gives that one a prompt
    with the schema of the row before it, and leaves the rest unformatted.
    """
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {ON_ERROR}, not {on_error!r}")
    if schema_source not in SCHEMA_SOURCES:
        raise ValueError(f"schema_source must be one of {SCHEMA_SOURCES}, not {schema_source!r}")
    if "output" not in df.columns:
        return df.withColumn("preprocessed_input", render_prompt(F.lit(schema_str), "input", model_name))

    parsed = parse_outputs(df, mapping, repair)
    shown = F.col("schema_str") if schema_source == "record" else F.lit(schema_str)
    if on_error == "stop":
        return _format_until_first_bad(df, mapping, repair, shown, model_name, schema_str, key)
    if on_error == "fail":
        message = F.concat(F.lit("unusable record at "), F.col(key).cast("string"), F.lit(": "), F.col("reason"))
        guarded = F.when(F.col("reason").isNull(), F.col("reason")).otherwise(F.raise_error(message))
        usable = parsed.where(guarded.isNull())
    else:
        usable = parsed.where(F.col("reason").isNull())
    return _formatted(usable, shown, model_name).select(
        *df.columns, "preprocessed_input", "text", "schema_str"
    )


def _formatted(usable: DataFrame, shown: Column, model_name: str) -> DataFrame:
    prompted = usable.withColumns(
        {
            "preprocessed_input": render_prompt(shown, "input", model_name),
            "output": map_json_text(F.col("record")),
        }
    )
    return prompted.withColumn("text", render_training_text("preprocessed_input", "output"))


def first_bad_key(parsed: DataFrame, key: str) -> DataFrame:
    """Least key with an unusable record, one row; null when all are usable."""
    return parsed.agg(F.min(F.when(F.col("reason").isNotNull(), F.col(key))).alias("first_bad"))


def _format_until_first_bad(
    df: DataFrame, mapping: dict[str, str] | None, repair: str, shown: Column, model_name: str, schema_str: str, key: str
) -> DataFrame:
    """The rows up to the first unusable one are the only ones that are parsed to be formatted.

    The row before it is found by its key and alone parsed for the schema that is carried over.
    """
    stop = first_bad_key(parse_outputs(df, mapping, repair), key).scalar()
    last = df.where(F.col(key) < stop).agg(F.max_by("output", F.struct(key, "output")).alias("output"))
    before = parse_outputs(last, mapping, repair).select("schema_str").scalar()
    carried = F.coalesce(before, F.lit(schema_str))
    complete = stop.isNull() | (F.col(key) < stop)
    at_stop = F.col(key) == stop
    given = df.withColumn("_given", F.when(complete, F.col("output")))
    parsed = parse_outputs(given, mapping, repair, "_given")
    prompt = render_prompt(F.when(at_stop, carried).otherwise(shown), "input", model_name)
    marked = parsed.withColumns(
        {
            "_complete": complete,
            "preprocessed_input": F.when(complete | at_stop, prompt),
            "schema_str": F.when(complete, F.col("schema_str")).when(at_stop, carried),
        }
    )
    written = marked.withColumn(
        "output", F.when(F.col("_complete"), map_json_text(F.col("record"))).otherwise(F.col("output"))
    )
    text = F.when(F.col("_complete"), render_training_text("preprocessed_input", "output"))
    return written.withColumn("text", text).select(*df.columns, "preprocessed_input", "text", "schema_str")


def sequence_budget(df: DataFrame, text: str = "text", key: str | None = None, count: Column | None = None) -> DataFrame:
    """Buffered token budget of a table, one row.

    The largest count over all rows; with a `key`, the count of the row with the least key.
    `count` replaces the built-in token count.
    """
    count = token_count(text) if count is None else count
    if key is None:
        counts = df.agg(F.max(count).alias("tokens"))
    else:
        counts = row_at(df, key).select(count.alias("tokens"))
    return counts.select("tokens", buffered_budget("tokens").alias("budget"))


def sequence_budgets(
    df: DataFrame, text: str = "text", percentiles: tuple[float, ...] = (0.5, 0.95, 1.0), count: Column | None = None
) -> DataFrame:
    """Exact token counts that these shares of the rows do not exceed, with their budgets: (percentile, tokens, budget).

    Rows are first counted by their number of tokens; what is then put in order has one row per different number, so it
    grows with the longest text, not with the table. Null texts do not count; a table without texts gives nulls.
    """
    _check_percentiles(percentiles)
    counted = df.select((token_count(text) if count is None else count).alias("tokens")).where("tokens IS NOT NULL")
    histogram = counted.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.orderBy("tokens")
    reached = histogram.select(
        "tokens",
        F.sum("n").over(whole).alias("reached"),
        F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("rows"),
    )
    found = reached.agg(
        *[F.min(F.when(F.col("reached") >= F.lit(float(p)) * F.col("rows"), F.col("tokens"))).alias(f"_p{i}") for i, p in enumerate(percentiles)]
    )
    listed = [F.struct(F.lit(float(p)).alias("percentile"), F.col(f"_p{i}").alias("tokens")) for i, p in enumerate(percentiles)]
    return found.select(F.inline(F.array(*listed))).select("percentile", "tokens", buffered_budget("tokens").alias("budget"))


SKETCH_K = 400


def token_sketch(
    df: DataFrame, text: str = "text", by: tuple[str, ...] = (), k: int = SKETCH_K, count: Column | None = None
) -> DataFrame:
    """A quantile sketch of the token counts, one row or one per group of `by`, to be kept with the table.

    Sketches of parts are merged by `sketch_budgets`, so new rows never make old ones be counted again. With k = 400 the
    rank of an answer is within 1.1 per cent of the rows of the true one, at any size, with a probability of 0.99.
    """
    counted = df.select(*by, (token_count(text) if count is None else count).cast("long").alias("tokens")).where("tokens IS NOT NULL")
    return counted.groupBy(*by).agg(F.kll_sketch_agg_bigint("tokens", k).alias("sketch"))


def sketch_budgets(sketches: DataFrame, percentiles: tuple[float, ...] = (0.5, 0.95, 1.0), k: int = SKETCH_K) -> DataFrame:
    """(percentile, tokens, budget) of all sketches together."""
    _check_percentiles(percentiles)
    merged = sketches.agg(F.kll_merge_agg_bigint("sketch", k).alias("sketch"))
    ranks = F.array(*[F.lit(float(p)) for p in percentiles])
    tokens = F.kll_sketch_get_quantile_bigint("sketch", ranks)
    pairs = merged.select(F.inline(F.arrays_zip(ranks.alias("percentile"), tokens.alias("tokens"))))
    read = pairs.toDF("percentile", "tokens").withColumn("tokens", F.col("tokens").cast("int"))
    return read.select("percentile", "tokens", buffered_budget("tokens").alias("budget"))


def _check_percentiles(percentiles: tuple[float, ...]) -> None:
    if not percentiles or not all(0 < p <= 1 for p in percentiles):
        raise ValueError(f"percentiles must lie above 0 and up to 1, not {percentiles!r}")


def with_prompt(df: DataFrame, schema: str | dict = "", model_name: str = "") -> DataFrame:
    """The table with prompts: as it is when it has them, else with prompts that show the given schema.

    A schema given as a dict is shown as Python prints it. Every row gets a prompt, also where there is an `output`.
    """
    if "preprocessed_input" in df.columns:
        return df
    return df.withColumn("preprocessed_input", render_prompt(F.lit(str(schema)), "input", model_name))


@dataclass(frozen=True)
class PreparedTraining:
    """Results of `prepare_training`; every member is a table read back from what was written."""

    table: DataFrame
    signature: DataFrame
    example: DataFrame
    dataset: DataFrame
    train: DataFrame
    evaluation: DataFrame


def prepare_training(
    df: DataFrame,
    path: str,
    key: str = "id",
    fmt: str = "parquet",
    export_fmt: str = "parquet",
    test_size: float = TEST_SIZE,
    seed: int = SEED,
    **formatting,
) -> PreparedTraining:
    """Format a table, write it, describe it, split it and export the parts under `path`.

    Later steps read the written table, so formatting runs once.
    """
    spark = df.sparkSession
    formatted = format_training_data(df, key=key, **formatting)
    write_training_table(formatted, f"{path}/training", fmt, keep=[key])
    table = read_table(spark, f"{path}/training", fmt)
    export_splits(split_exact(table, key, test_size, seed), f"{path}/export", fmt=export_fmt)
    dataset = spark.read.format(export_fmt).schema(f"{_ddl(table)}, split string").load(f"{path}/export")
    return PreparedTraining(
        table=table,
        signature=table_signature(table.drop(key)),
        example=first_rows(table, key),
        dataset=dataset,
        train=dataset.where("split = 'train'"),
        evaluation=dataset.where("split = 'eval'"),
    )


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
