"""Tables of records: packing, quarantine, field tables, profiles."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.columns import let
from recordloom.functions.fields import LEAVES_TYPE, align_sql
from recordloom.functions.records import (
    USUAL_DEPTH,
    as_map,
    expand_sql,
    leaves_below_sql,
    list_sql,
    map_sql,
    name_of_schema_sql,
    parse_record,
    schema_nodes,
    type_name,
    value_text_sql,
)

# Reasons for which a record is set aside.
NOT_JSON = "not_json"
NOT_OBJECT = "not_object"
EMPTY_RECORD = "empty_record"


def pack_record(df: DataFrame, text: str, null_as: str | None = None) -> Column:
    """Every column but the text column as one JSON record, nulls included.

    `null_as` writes a text in place of nulls; the columns are then packed as they are
    otherwise, so only null cells change type.
    """
    names = [name for name in df.columns if name != text]
    if null_as is None:
        return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})

    def entry(name: str) -> Column:
        value = F.col(f"`{name}`")
        written = F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")
        cell = F.when(value.isNull(), json.dumps(null_as, ensure_ascii=False)).otherwise(written)
        return F.concat(F.lit(json.dumps(name, ensure_ascii=False) + ":"), cell)

    return F.concat(F.lit("{"), F.concat_ws(",", *[entry(name) for name in names]), F.lit("}"))


def rejection_sql(record: str, entries: str) -> str:
    """Why a parsed record with these entries cannot be used; null when it can."""
    return f"""CASE
        WHEN {record} IS NULL THEN '{NOT_JSON}'
        WHEN {entries} IS NULL THEN '{NOT_OBJECT}'
        WHEN size({entries}) = 0 THEN '{EMPTY_RECORD}' END"""


# One level of taking nodes apart. Leaves pass through: exploding null gives one empty row.
# A list inside a list is a leaf, so it is not opened; only a list has an element 0.
_OPENED = """CASE WHEN n._done OR (n._in_list AND try_variant_get(n._value, '$[0]', 'variant') IS NOT NULL)
             THEN NULL ELSE n._value END"""
_LEVEL = f"""
    SELECT {{others}}
      CASE WHEN c.pos IS NULL THEN n._path
           WHEN c.key IS NULL THEN concat(n._path, '[', c.pos, ']')
           WHEN n._path IS NULL OR n._path = '' THEN c.key
           ELSE concat(n._path, ' ', c.key) END AS _path,
      coalesce(c.value, n._value) AS _value,
      if(c.pos IS NULL, n._in_list, c.key IS NULL) AS _in_list,
      c.pos IS NULL AS _done
    FROM {{nodes}} AS n, LATERAL variant_explode_outer({_OPENED}) AS c
    WHERE c.pos IS NOT NULL OR n._done
       OR NOT (to_json(n._value) = '{{{{}}}}' OR (NOT n._in_list AND to_json(n._value) = '[]'))"""
_NODE = "array(struct(_path AS path, _value AS value, _in_list AS in_list, _done AS done))"
# What is left after these levels, taken apart inside its row.
_DEEPER = f"explode_outer(CASE WHEN NOT _done THEN {expand_sql(_NODE)} END)"


def explode_fields(df: DataFrame, record: str, levels: int = USUAL_DEPTH) -> DataFrame:
    """One row per leaf field of each record (a VARIANT column), next to the other columns.

    The fields are those of `recordloom.functions.records.flatten_record`. Each of the first
    `levels` levels is one generator over the rows of the level before, so the table is
    scanned once and nothing is shuffled or collected. One more generator takes apart
    inside its row what lies deeper, so all of it comes out.
    """
    spark = df.sparkSession
    others = [name for name in df.columns if name != record]
    listed = "".join(f"n.`{name}`, " for name in others)
    nodes = df.select(
        *others,
        F.lit(None).cast("string").alias("_path"),
        F.when(as_map(record).isNotNull(), F.col(record)).alias("_value"),
        F.lit(False).alias("_in_list"),
        F.lit(False).alias("_done"),
    )
    for _ in range(levels):
        nodes = spark.sql(_LEVEL.replace("{others}", listed), nodes=nodes)
    opened = nodes.select(*others, "_path", "_value", "_done", F.expr(_DEEPER).alias("_deeper"))
    leaves = opened.where("_done OR _deeper IS NOT NULL").select(
        *others,
        F.coalesce("_deeper.path", "_path").alias("_path"),
        F.coalesce("_deeper.value", "_value").alias("_value"),
    )
    named = leaves.withColumn("_schema", F.schema_of_variant("_value"))
    typed = named.withColumn("type", F.expr(name_of_schema_sql("_schema")))
    return typed.select(
        *others, F.col("_path").alias("path"), "type", F.expr(value_text_sql("_value", "type")).alias("text")
    )


# Levels at which two records are opened together, one generator each: keys, lists below them, keys of objects in lists.
PAIR_LEVELS = 3

# Whether a key could make the path of one value that of another one: empty, with a blank or a bracket (or a comma, to be safe).
_ODD_KEYS = "contains(_keys, ',,') OR contains(_keys, ' ') OR contains(_keys, '[')"
# Both values are objects, or lists that are opened; a missing one does not matter.
_BOTH_OBJECTS = "(_lm IS NOT NULL OR _l IS NULL) AND (_rm IS NOT NULL OR _r IS NULL) AND NOT _odd"
_BOTH_LISTS = "(_ll IS NOT NULL OR _l IS NULL) AND (_rl IS NOT NULL OR _r IS NULL)"
_MEMBERS = """map_zip_with(
    coalesce(_lm, CAST(map() AS MAP<STRING, VARIANT>)), coalesce(_rm, CAST(map() AS MAP<STRING, VARIANT>)),
    (key, l, r) -> struct(l AS l, r AS r))"""
_LONGER = "greatest(size(_ll), size(_rl))"
_ITEMS = f"""map_from_arrays(
    transform(slice(sequence(0, {_LONGER}), 1, {_LONGER}), i -> concat('[', i, ']')),
    zip_with(coalesce(_ll, CAST(array() AS ARRAY<VARIANT>)), coalesce(_rl, CAST(array() AS ARRAY<VARIANT>)), (l, r) -> struct(l AS l, r AS r)))"""


def _opened_pairs(nodes: DataFrame, others: list[str], root: bool = False) -> DataFrame:
    """Rows of two values at a path, with one row per key or place where both can be opened; what is empty vanishes.

    An opened value is left out of the row before the generator, which would copy it for everything in it. A `root` that is no
    object counts as missing.
    """
    cast = nodes.selectExpr(
        *others, "_path", "_in_list", "_l", "_r", f"{map_sql('_l')} AS _lm", f"{map_sql('_r')} AS _rm",
        f"CASE WHEN NOT _in_list THEN {list_sql('_l')} END AS _ll", f"CASE WHEN NOT _in_list THEN {list_sql('_r')} END AS _rl",
    )
    if root:
        maps = ("_path", "_in_list", "_lm", "_rm", "_ll", "_rl")
        cast = cast.selectExpr(*others, *maps, "if(_lm IS NULL, NULL, _l) AS _l", "if(_rm IS NULL, NULL, _r) AS _r")
    keyed = cast.selectExpr("*", "concat_ws(',', '', map_keys(_lm), map_keys(_rm), '') AS _keys")
    judged = keyed.selectExpr("*", f"(_lm IS NOT NULL OR _rm IS NOT NULL) AND ({_ODD_KEYS}) AS _odd")
    kinds = f"CASE WHEN _l IS NULL AND _r IS NULL THEN 0 WHEN {_BOTH_OBJECTS} THEN 1 WHEN {_BOTH_LISTS} THEN 2 ELSE 0 END AS _kind"
    chosen = judged.selectExpr(*others, "_path", "_in_list", "_l", "_r", "_lm", "_rm", "_ll", "_rl", kinds)
    opened = chosen.selectExpr(
        *others, "_path", "_in_list", "CASE WHEN _kind = 0 THEN _l END AS _l", "CASE WHEN _kind = 0 THEN _r END AS _r",
        f"CASE _kind WHEN 1 THEN {_MEMBERS} WHEN 2 THEN {_ITEMS} END AS _below",
    )
    rows = opened.selectExpr(*others, "_path", "_in_list", "_l", "_r", "explode_outer(_below) AS (_step, _both)")
    path = """CASE WHEN _step IS NULL THEN _path WHEN _path = '' OR startswith(_step, '[') THEN concat(_path, _step)
        ELSE concat(_path, ' ', _step) END AS _path"""
    return rows.where("_step IS NOT NULL OR _l IS NOT NULL OR _r IS NOT NULL").selectExpr(
        *others, path, "if(_step IS NULL, _in_list, startswith(_step, '[')) AS _in_list",
        "if(_step IS NULL, _l, _both.l) AS _l", "if(_step IS NULL, _r, _both.r) AS _r",
    )


# What is left of two values, as aligned fields.
_REST = let(
    f"""transform(array(_l, _r), v -> CASE WHEN v IS NULL THEN CAST(array() AS {LEAVES_TYPE})
        ELSE {leaves_below_sql("v", "_path", "_in_list")} END)""",
    "both",
    align_sql("both[0]", "both[1]"),
)


def explode_pairs(df: DataFrame, left: str, right: str, levels: int = PAIR_LEVELS) -> DataFrame:
    """One row per field of two records (VARIANT columns), next to the other columns: path, l_type, l_text, r_type, r_text.

    The fields are those of `align_fields` over `flatten_record`; a null record counts as empty. Both records are opened together, one
    generator for each of the first `levels` levels, so equal paths meet without being sorted and types and texts are taken
    of rows, in compiled code. What cannot be opened so is flattened and aligned inside its row: what lies deeper, lists in
    lists, a value that is an object or a list on one side only, and an object with keys that could make two paths equal.
    """
    others = [f"`{name}`" for name in df.columns if name not in (left, right)]
    nodes = df.selectExpr(*others, "'' AS _path", "true AS _in_list", f"`{left}` AS _l", f"`{right}` AS _r")
    for level in range(levels):
        nodes = _opened_pairs(nodes, others, root=level == 0)
    kept = [*others, "_path", "_l", "_r"]
    named = nodes.selectExpr(*kept, "_in_list", "schema_of_variant(_l) AS _ls", "schema_of_variant(_r) AS _rs").selectExpr(
        *kept, "_in_list", "_ls", "_rs", f"{name_of_schema_sql('_ls')} AS _lt", f"{name_of_schema_sql('_rs')} AS _rt"
    )
    whole = "coalesce(_lt IN ('list', 'dict'), false) OR coalesce(_rt IN ('list', 'dict'), false) AS _whole"
    usual = [
        f"""CASE WHEN _{side}t = 'str' THEN try_variant_get(_{side}, '$', 'string')
            WHEN _{side}s = 'BIGINT' THEN CAST(try_variant_get(_{side}, '$', 'bigint') AS STRING)
            WHEN _{side}t = 'float' THEN CAST(try_variant_get(_{side}, '$', 'double') AS STRING) END AS _{side}x"""
        for side in "lr"
    ]
    texts = named.selectExpr(*kept, "_in_list", "_lt", "_rt", whole, *usual)
    # the cast prints floats without an exponent as string formatting does; a value whose text is found is needed no more
    judged = texts.selectExpr(
        *others, "_path", "_in_list", "_lt", "_rt", "_lx", "_rx", "_whole",
        *[f"if(_whole OR _{s}x IS NULL OR (_{s}t = 'float' AND contains(_{s}x, 'E')), _{s}, NULL) AS _{s}" for s in "lr"],
    )

    def text(side: str) -> str:
        other = value_text_sql(f"_{side}", f"_{side}t", scalar=True)
        return f"CASE WHEN _whole THEN NULL WHEN _{side} IS NULL THEN _{side}x ELSE {other} END AS _{side}x"

    written = judged.selectExpr(*others, "_path", "_whole", "_lt", text("l"), "_rt", text("r"), f"CASE WHEN _whole THEN {_REST} END AS _rest")
    rows = written.selectExpr(*others, "_path", "_whole", "_lt", "_lx", "_rt", "_rx", "inline_outer(_rest)").where("NOT _whole OR path IS NOT NULL")
    values = (("path", "_path"), ("l_type", "_lt"), ("l_text", "_lx"), ("r_type", "_rt"), ("r_text", "_rx"))
    return rows.selectExpr(*others, *[f"if(_whole, {name}, {own}) AS {name}" for name, own in values])


def schema_profile(df: DataFrame, record_text: str) -> DataFrame:
    """How often each top-level key occurs with each type, over all records."""
    entries = F.explode_outer(F.map_entries(as_map(parse_record(record_text))))
    typed = df.select(entries.alias("e")).where("e IS NOT NULL").select(
        F.col("e.key").alias("key"), type_name(F.col("e.value")).alias("type")
    )
    return typed.groupBy("key", "type").agg(F.count(F.lit(1)).alias("records"))


# The type of values that have no common one.
ANY = "any"


def merged_type(types: Column) -> Column:
    """Least type that holds values of all these types; nulls fit every type, and an int is also a float."""
    held = F.array_sort(F.array_except(types, F.array(F.lit("NoneType"))))
    numbers = F.array(F.lit("float"), F.lit("int"))
    return (
        F.when(F.size(held) == 0, "NoneType")
        .when(F.size(held) == 1, F.get(held, F.lit(0)))
        .when(held == numbers, "float")
        .otherwise(ANY)
    )


def merged_schema(df: DataFrame, record_text: str) -> DataFrame:
    """One schema for all records: (parent, path, type, types, occurrences, nulls, optional), one row per path.

    Values are counted by path and type inside the scan stage first, so a shuffle moves one row per path, type and task,
    however many records or list items there are, and each record is parsed once. `type` is the least type that holds
    all values of the path (`merged_type`), `types` lists what occurred, `optional` says that some object at the parent
    path lacks the key. Texts that are not JSON are left out; the path of a record is ``''``, of list items ``name[]``.
    """
    nodes = df.select(F.explode(schema_nodes(parse_record(record_text))).alias("n")).select("n.*")
    counts = nodes.groupBy("parent", "path", "in_list", "type").agg(F.count(F.lit(1)).alias("n"))
    # an object is counted at its own path and once more for the keys below it
    own = F.struct(F.col("parent"), F.col("path"), F.col("in_list"), F.col("type"), F.col("n"), F.lit(0).cast("long").alias("objects"))
    below = F.struct(
        F.col("path").alias("parent"),
        F.lit(None).cast("string").alias("path"),
        F.lit(False).alias("in_list"),
        F.col("type"),
        F.lit(0).cast("long").alias("n"),
        F.col("n").alias("objects"),
    )
    rows = F.when(F.col("type") == "dict", F.array(own, below)).otherwise(F.array(own))
    spread = counts.select(F.inline(rows)).withColumn("objects", F.sum("objects").over(Window.partitionBy("parent")))
    paths = spread.where("path IS NOT NULL").groupBy("parent", "path", "in_list").agg(
        F.array_sort(F.collect_set("type")).alias("types"),
        F.sum("n").alias("occurrences"),
        F.sum(F.when(F.col("type") == "NoneType", F.col("n")).otherwise(0)).alias("nulls"),
        F.max("objects").alias("objects"),
    )
    return paths.select(
        "parent",
        "path",
        merged_type(F.col("types")).alias("type"),
        "types",
        "occurrences",
        "nulls",
        (~F.col("in_list") & F.col("parent").isNotNull() & (F.col("occurrences") < F.col("objects"))).alias("optional"),
    )


def table_signature(df: DataFrame) -> DataFrame:
    """Name, type and nullability of each column, with its count of nulls, in one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(F.col(f"`{f.name}`")).alias(f"_n{i}") for i, f in enumerate(df.schema.fields)],
    )
    described = F.array(
        *[
            F.struct(
                F.lit(i).alias("pos"),
                F.lit(f.name).alias("name"),
                F.lit(f.dataType.simpleString()).alias("type"),
                (F.col("_rows") - F.col(f"_n{i}")).alias("nulls"),
                (F.col("_rows") == F.col(f"_n{i}")).alias("required"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    return counts.select(F.inline(described))
