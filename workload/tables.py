"""The given tables and the tables derived from them for the checks.

The given texts hold no quotes, braces or backslashes and no nested records, so the
repair, parsing and comparison queries run on tables that Spark derives from the given
ones; `workload.oracle` derives the same tables in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.sources.tables import spread_few_splits

PART_FIELDS = ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")
LINE_FIELDS = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for row-wise work that costs much more than reading it."""
    return spread_few_splits(table(spark, sf_dir, name))


def _part_json(**changes: Column | None) -> Column:
    """JSON of a part; a change replaces a field, adds one, or drops it with None."""
    fields = {name: F.col(name) for name in PART_FIELDS}
    for name, value in changes.items():
        if value is None:
            fields.pop(name)
        else:
            fields[name] = value
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1: one flat record per part."""
    return wide_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), _part_json().alias("record_json"))


def _order_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the ordered list of their line items, empty for none."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.sort_array(F.collect_list(F.struct(*LINE_FIELDS))).alias("lines"))
    )
    orders = table(spark, sf_dir, "orders")
    joined = orders.join(lines.hint("merge"), orders.o_orderkey == lines.l_orderkey, "left")
    kind = "array<struct<{}>>".format(
        ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in lines.schema["lines"].dataType.elementType.fields)
    )
    return joined.withColumn("lines", F.coalesce("lines", F.array().cast(kind)))


def _order_json(status: str = "o_orderstatus", buyer: Column | None = None, lines: Column | None = None) -> Column:
    """JSON of an order; the changes give its status another key or replace a part."""
    if buyer is None:
        buyer = F.struct(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("priority"))
    parts = (
        F.col("o_orderstatus").alias(status), F.col("o_totalprice"), buyer.alias("buyer"),
        (F.col("lines") if lines is None else lines).alias("lines"),
    )
    return F.to_json(F.struct(*parts))


def nested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1n: one record per order with its buyer and the list of its line items."""
    return _order_parts(spark, sf_dir).select(F.col("o_orderkey").alias("id"), _order_json().alias("record_json"))


def nested_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5: every order record with a copy that is changed in one of six ways, at its top, in its buyer or in its lines."""
    kind = F.col("o_orderkey") % 6
    priority = F.col("o_orderpriority").alias("priority")
    more = F.transform("lines", lambda x, i: x.withField("l_quantity", x["l_quantity"] + F.when(i == 0, 1).otherwise(0)))
    predicted = (
        F.when(kind == 0, _order_json())
        .when(kind == 1, _order_json(buyer=F.struct(F.col("o_custkey").alias("key"))))
        .when(kind == 2, _order_json(lines=more))
        .when(kind == 3, _order_json(lines=F.slice("lines", 1, F.greatest(F.size("lines") - 1, F.lit(0)))))
        .when(kind == 4, _order_json(buyer=F.struct(F.col("o_custkey").cast("string").alias("key"), priority)))
        .otherwise(_order_json(status="status"))
    )
    return _order_parts(spark, sf_dir).select(
        F.col("o_orderkey").alias("pair_id"), _order_json().alias("expected_json"), predicted.alias("predicted_json")
    )


def dirty_records(spark: SparkSession, sf_dir: str, late: bool = False) -> DataFrame:
    """D2: printed Python dicts of parts with eleven kinds of trouble.

    With `late`, parts below the middle key only have two kinds that are mended, so the first unusable one is inside.
    """
    head = F.concat(
        F.lit("{'p_name': '"), F.col("p_name"), F.lit("', 'p_brand': '"), F.col("p_brand"), F.lit("'")
    )
    tail = F.concat(
        F.lit(", 'p_size': "), F.col("p_size").cast("string"),
        F.lit(", 'p_retailprice': "), F.col("p_retailprice").cast("string"),
    )

    def with_note(note: str) -> Column:
        return F.concat(head, F.lit(f", 'note': {note}"), tail, F.lit("}"))

    kind = F.col("p_partkey") % 11
    if late:
        middle = table(spark, sf_dir, "part").agg(F.max("p_partkey")).scalar() / 2
        kind = F.when(F.col("p_partkey") < middle, F.col("p_partkey") % 2 * 5).otherwise(kind)
    output = (
        F.when(kind == 0, with_note("nan"))
        .when(kind == 1, F.concat(head, tail, F.lit(", 'note': nan}")))
        .when(kind == 2, with_note("''"))
        .when(kind == 3, with_note("None"))
        .when(kind == 4, with_note("True"))
        .when(kind == 5, with_note("'1/2/2016'"))
        .when(kind == 6, with_note('"don\'t"'))
        .when(kind == 7, with_note('"l\'été"'))
        .when(kind == 8, with_note("'one\ntwo'"))
        .when(kind == 9, F.lit("{}"))
        .otherwise(F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit(", 'x']")))
    )
    text = F.concat(F.lit("The part's name is '"), F.col("p_name"), F.lit("' and it is "), F.col("p_type"))
    return wide_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), text.alias("input"), output.alias("output")
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: every part record with a copy that is changed in one of six ways."""
    kind = F.col("p_partkey") % 6
    predicted = (
        F.when(kind == 0, _part_json())
        .when(kind == 1, _part_json(p_brand=None))
        .when(kind == 2, _part_json(p_extra=F.lit("new")))
        .when(
            kind == 3,
            _part_json(p_name=F.concat(F.col("p_name"), F.lit(" deluxe")), p_size=F.col("p_size") + 1),
        )
        .when(kind == 4, _part_json(p_size=F.col("p_size").cast("string")))
        .otherwise(_part_json(p_type=None, kind=F.col("p_type")))
    )
    return wide_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pair_id"),
        _part_json().alias("expected_json"),
        predicted.alias("predicted_json"),
    )


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4: part records inside the kinds of text a model returns."""
    quoted = F.concat(
        F.lit("{'p_name': '"), F.col("p_name"), F.lit("', 'p_brand': '"), F.col("p_brand"),
        F.lit("', 'p_type': '"), F.col("p_type"), F.lit("', 'p_size': "), F.col("p_size").cast("string"),
        F.lit(", 'p_retailprice': "), F.col("p_retailprice").cast("string"), F.lit("}"),
    )
    kind = F.col("p_partkey") % 6
    output = (
        F.when(kind == 0, _part_json())
        .when(kind == 1, F.concat(F.lit("Here is the record: "), quoted, F.lit(" and {more} below.")))
        .when(kind == 2, F.concat(F.lit("Answer: "), F.replace(_part_json(), F.lit('"'), F.lit('\\"'))))
        .when(kind == 3, F.concat(F.lit("} "), _part_json()))
        .when(kind == 4, F.concat(F.lit("There is no record of "), F.col("p_name")))
        .otherwise(F.expr("substring({0}, 1, length({0}) - 1)".format("_json")))
    )
    return (
        wide_table(spark, sf_dir, "part")
        .withColumn("_json", _part_json())
        .select(
            F.col("p_partkey").alias("id"),
            F.col("_json").alias("expected_json"),
            output.alias("generated_output"),
        )
    )


def label_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata by document: the labels as a record."""
    labels = table(spark, sf_dir, "labels")
    return labels.select("doc_id", F.to_json(F.struct("quality", "toxic")).alias("structured"))
