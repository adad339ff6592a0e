import json

import pytest
from pyspark.sql import functions as F

from recordloom.functions import records
from recordloom.functions.columns import let
from recordloom.functions.fields import last_wins
from recordloom.operators import records as record_ops


def test_strict_parse(apply):
    rejected = ['{"a":1} x', '{"a":1}]', '{"a":1}}', '{"a":1},{"b":2}', '1,"x":2', "", " ", '{"a":1}] junk {}', "x", '{"a":nan}', None]
    accepted = {'{"a":1,"a":2}': '{"a":2}', "[1]": "[1]", "null": "null", ' {"b":1, "a":2} ': '{"a":2,"b":1}', '"x"': '"x"'}
    shown = lambda c: F.to_json(records.parse_record(c))
    assert apply(rejected, shown) == [None] * len(rejected)
    assert apply(list(accepted), shown) == list(accepted.values())


def test_parse_output(apply):
    cases = {
        '{"a":1}': '{"a":1}',
        "Sure: {'a': 'x', 'b': {'c': 2}} done {x}": '{"a":"x","b":{"c":2}}',
        'A: {\\"a\\": \\"x\\"}': '{"a":"x"}',
        '} {"a":1}': None,
        "nothing": None,
        '{"a":1': None,
    }
    assert apply(list(cases), lambda c: F.to_json(records.parse_output(c))) == list(cases.values())


def test_parse_output_with_mapping(apply):
    values = ["Sure: {'p': 'x', 'q': 1.0}", "{}", "[1]", "no"]
    out = apply(values, lambda c: records.json_text(records.parse_output(c, {"name": "p"})))
    assert out == ['{"name":"x","q":1.0}', None, None, None]


def test_type_names(apply):
    values = ["1", "1.0", "1.5", "1e3", "12345678901234567890", '"x"', "true", "null", "[]", '[1,"a"]', "{}", '{"a":1}']
    expected = [type(json.loads(v)).__name__ for v in values]
    assert apply(values, lambda c: records.type_name(records.parse_record(c))) == expected
    assert set(expected) == set(records.TYPE_NAMES)


NESTED = [
    {"a": {"b": 1, "c": [1, {"d": 2}, [3], [], {}]}, "e": "x", "z": {}, "n": None, "t": True, "f": 1.0, "l": []},
    {"a b": 1, "a": {"b": 2}, "k": [{"x": [{"y": [1, 2]}]}]},
    {"": {"b": 2, "": 3, "c": [{"": 1}]}},
    {},
]


# The leaves of NESTED, written by hand: row, path, type, text.
LEAVES = [
    (0, "a b", "int", "1"), (0, "a c[0]", "int", "1"), (0, "a c[1] d", "int", "2"), (0, "a c[2]", "list", "[3]"),
    (0, "a c[3]", "list", "[]"), (0, "e", "str", "x"), (0, "f", "float", "1.0"), (0, "n", "NoneType", "None"),
    (0, "t", "bool", "True"),
    (1, "a b", "int", "1"), (1, "a b", "int", "2"), (1, "k[0] x[0] y[0]", "int", "1"), (1, "k[0] x[0] y[1]", "int", "2"),
    (2, "", "int", "3"), (2, "b", "int", "2"), (2, "c[0] ", "int", "1"),
]


def test_flatten_both_forms(spark):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(NESTED)], "i int, s string")
    parsed = df.select("i", records.parse_record("s").alias("v"))
    in_row = parsed.select("i", F.inline(records.flatten_record("v")))
    assert sorted(map(tuple, in_row.collect())) == sorted(LEAVES)
    assert sorted(map(tuple, record_ops.explode_fields(parsed, "v").collect())) == sorted(LEAVES)


def test_floats_print_as_string_formatting_prints_them(spark):
    values = [1e7, 12345678.5, -12345678.5, 1e-5, 1.25e-4, 1e15, 1e16, 1.5e16, 1e20, 1e100, -2.5e-300, -2.5e-7, 0.001, 900.0, 0.1, 100200300.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double")
    texts = df.select("i", F.expr(records.float_text_sql("x")).alias("t")).orderBy("i").collect()
    assert [row.t for row in texts] == [str(x) for x in values]


def test_flatten_has_no_depth_limit(spark):
    deep = {"v": 1, "l": [[2]]}
    for i in range(60):
        deep = {f"k{i}": deep, "side": i}
    df = spark.createDataFrame([(0, json.dumps(deep)), (1, '{"a":{"b":{}}}')], "i int, s string")
    parsed = df.select("i", records.parse_record("s").alias("v"))
    above = [" ".join(f"k{j}" for j in range(59, i, -1)) for i in range(-1, 60)]
    expected = sorted(
        [(0, f"{above[0]} v", "int", "1"), (0, f"{above[0]} l[0]", "list", "[2]")]
        + [(0, f"{above[i + 1]} side".strip(), "int", str(i)) for i in range(60)]
    )
    assert sorted(map(tuple, parsed.select("i", F.inline(records.flatten_record("v"))).collect())) == expected
    named = parsed.select("i", F.lit("kept").alias("value"), F.lit(1).alias("done"), "v")
    assert {(r.value, r.done) for r in record_ops.explode_fields(named, "v").collect()} == {("kept", 1)}
    for levels in (1, 2, 5):
        assert sorted(map(tuple, record_ops.explode_fields(parsed, "v", levels).collect())) == expected


def test_generator_flatten_plan(spark, plan_of):
    df = spark.range(5).withColumn("v", F.parse_json(F.lit('{"a":{"b":1}}')))
    plan = plan_of(record_ops.explode_fields(df, "v"))
    assert "Exchange" not in plan and "Union" not in plan and plan.count("Range (") == 1


def test_last_wins(apply):
    rows = apply(
        ['{"a b":1,"a":{"b":2,"c":3}}', '{"a":{"b":1,"c":3},"a b":9}'],
        lambda c: last_wins(records.flatten_record(records.parse_record(c))),
    )
    # keys are visited in alphabetical order, so "a b" comes after everything below "a"
    assert [[tuple(leaf) for leaf in row] for row in rows] == [
        [("a b", "int", "1"), ("a c", "int", "3")],
        [("a b", "int", "9"), ("a c", "int", "3")],
    ]


TO_JSON, TO_SCHEMA = records.DIRECTIONS
PLAIN = {"a": 1, "b": "two", "c": {"d": 3.0}}
# Written by hand: direction, mapping, record, record with its keys renamed.
RENAMED = [
    (TO_JSON, {"a": "x"}, PLAIN, {"b": "two", "c": {"d": 3.0}, "x": 1}),
    (TO_JSON, {"a": "x"}, {"c": None}, {"c": None}),
    (TO_JSON, {"a": "b", "b": "c"}, PLAIN, {"c": 1}),
    (TO_JSON, {"a": "b", "b": "a"}, PLAIN, {"a": 1, "c": {"d": 3.0}}),
    (TO_JSON, {"x": "a", "y": "b", "z": "a"}, {"c": None, "x": [1]}, {"a": [1], "c": None}),
    (TO_JSON, {"a": "a", "q": "w"}, PLAIN, PLAIN),
    (TO_JSON, {"it's": "a\\b"}, {"it's": 1, "a\\b": 2}, {"a\\b": 1}),
    (TO_JSON, {}, PLAIN, PLAIN),
    (TO_JSON, {"a": "x"}, {}, None),
    (TO_SCHEMA, {"a": "x"}, PLAIN, PLAIN),
    (TO_SCHEMA, {"a": "x"}, {"c": None, "x": [1]}, {"a": [1], "c": None}),
    (TO_SCHEMA, {"a": "b", "b": "c"}, PLAIN, {"a": "two", "b": {"d": 3.0}}),
    (TO_SCHEMA, {"x": "a", "y": "b", "z": "a"}, PLAIN, {"c": {"d": 3.0}, "x": 1, "y": "two"}),
    (TO_SCHEMA, {"it's": "a\\b"}, {"it's": 1, "a\\b": 2}, {"it's": 2}),
    (TO_SCHEMA, {}, {}, None),
]


@pytest.mark.parametrize("direction, mapping, record, renamed", RENAMED)
def test_rename(apply, direction, mapping, record, renamed):
    texts = apply(
        [json.dumps(record)],
        lambda c: records.map_json_text(records.rename_keys(records.as_map(records.parse_record(c)), mapping, direction)),
    )
    # keys come out in alphabetical order, as they are written in the table
    assert texts == [renamed and json.dumps(renamed, separators=(",", ":"))]


def test_json_text_of_any_depth(apply):
    text = '{"f":{"e":[{"d":{"c":[[900.0,{"b":[1e+300,1e-05,"\\"",null,true,{},[]],"a":-2.50}]]}}]},"a":7.0}'
    ordered = '{"a":7.0,"f":{"e":[{"d":{"c":[[900.0,{"a":-2.5,"b":[1e+300,1e-05,"\\"",null,true,{},[]]}]]}}]}}'
    deep = "[" * 300 + "1.0" + "]" * 300
    cases = {text: ordered, deep: deep, "{}": "{}", "[]": "[]", '""': '""', "nothing": None, None: None}
    assert apply(list(cases), lambda c: records.json_text(records.parse_record(c))) == list(cases.values())
    assert apply([text, "[1]"], lambda c: records.map_json_text(records.as_map(records.parse_record(c)))) == [ordered, None]
    spaced = apply([text], lambda c: records.json_text(records.parse_record(c), ", ", ": "))
    assert spaced == [ordered.replace(",", ", ").replace(":", ": ")]


def test_json_text(apply):
    values = [{"b": 900.0, "a": [1.0, 2, {"d": "x\"y", "c": 3.50}], "é": None}, [], {}, "s", 1.0]
    texts = apply([json.dumps(v) for v in values], lambda c: records.json_text(records.parse_record(c)))
    assert [json.loads(t) for t in texts] == values
    assert texts[0] == '{"a":[1.0,2,{"c":3.5,"d":"x\\"y"}],"b":900.0,"é":null}'
    spaced = apply([json.dumps(values[0])], lambda c: records.json_text(records.parse_record(c), ", ", ": "))
    assert spaced == [json.dumps({"a": [1.0, 2, {"c": 3.5, "d": 'x"y'}], "b": 900.0, "é": None}, ensure_ascii=False)]


def test_schema_text(apply):
    text = apply(['{"b":1,"a":"x","c":1.0,"d":null}'], lambda c: records.schema_text(records.as_map(records.parse_record(c))))
    assert text == ['{"a":"str","b":"int","c":"float","d":"NoneType"}']


def test_pack_record(spark):
    df = spark.createDataFrame([("t", 1, None, 'say "hi"'), ("u", None, 2.5, "x")], "raw string, n int, d double, `a \"q` string")
    out = df.select(record_ops.pack_record(df, "raw").alias("p"), record_ops.pack_record(df, "raw", "None").alias("q")).collect()
    assert json.loads(out[0].p) == {"n": 1, "d": None, 'a "q': 'say "hi"'}
    assert json.loads(out[0].q) == {"n": 1, "d": "None", 'a "q': 'say "hi"'}
    assert json.loads(out[1].q) == {"n": "None", "d": 2.5, 'a "q': "x"}


def test_profile_and_signature(spark):
    df = spark.createDataFrame([(1, '{"a":1,"b":"x"}'), (2, '{"a":2.5}'), (3, None)], "id int, r string")
    profile = {tuple(r) for r in record_ops.schema_profile(df, "r").collect()}
    assert profile == {("a", "int", 1), ("a", "float", 1), ("b", "str", 1)}
    rows = [tuple(r) for r in record_ops.table_signature(df).orderBy("pos").collect()]
    assert rows == [(0, "id", "int", 0, True), (1, "r", "string", 1, False)]


def test_merged_schema_of_mixed_records(spark, plan_of):
    texts = [
        '{"a":1,"b":{"x":null,"y":[1,2.5]},"c":"s"}',
        '{"a":2.5,"b":{"y":[]},"c":null}',
        '{"a":3,"c":{"d":true},"e":[{"f":1},{"f":"t"},[7]]}',
        "no json",
        None,
        '["list"]',
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, r string")
    merged = record_ops.merged_schema(df, "r")
    found = {r.path: (r.parent, r.type, r.types, r.occurrences, r.nulls, r.optional) for r in merged.collect()}
    assert found == {
        "": (None, "any", ["dict", "list"], 4, 0, False),
        "[]": ("", "str", ["str"], 1, 0, False),
        "a": ("", "float", ["float", "int"], 3, 0, False),
        "b": ("", "dict", ["dict"], 2, 0, True),
        "b x": ("b", "NoneType", ["NoneType"], 1, 1, True),
        "b y": ("b", "list", ["list"], 2, 0, False),
        "b y[]": ("b y", "float", ["float", "int"], 2, 0, False),
        "c": ("", "any", ["NoneType", "dict", "str"], 3, 1, False),
        "c d": ("c", "bool", ["bool"], 1, 0, False),
        "e": ("", "list", ["list"], 1, 0, True),
        "e[]": ("e", "any", ["dict", "list"], 3, 0, False),
        "e[] f": ("e[]", "any", ["int", "str"], 2, 0, False),
        "e[][]": ("e[]", "int", ["int"], 1, 0, False),
    }
    assert plan_of(merged).lower().count("parsejson") == 1
    assert record_ops.merged_schema(df.where("id > 2 AND id < 5"), "r").count() == 0


def test_merged_schema_agrees_with_the_variant_schema(spark):
    orders = ['{"o":1,"lines":[{"q":2,"p":1.5},{"q":3,"p":2.25}]}', '{"o":2,"lines":[{"q":1,"p":9.75}],"note":"n"}']
    df = spark.createDataFrame([(t,) for t in orders], "r string")
    paths = {r.path: r.type for r in record_ops.merged_schema(df, "r").collect()}
    assert paths == {"": "dict", "o": "int", "lines": "list", "lines[]": "dict", "lines[] q": "int", "lines[] p": "float", "note": "str"}
    whole = df.select(F.schema_of_variant_agg(F.parse_json("r"))).first()[0]
    assert whole == "OBJECT<lines: ARRAY<OBJECT<p: DECIMAL(3,2), q: BIGINT>>, note: STRING, o: BIGINT>"


def test_merged_schema_opens_any_depth(spark):
    text = '{"a":' * 12 + "[[1]]" + "}" * 12
    deep = record_ops.merged_schema(spark.createDataFrame([(text,)], "r string"), "r").collect()
    assert {r.path for r in deep} >= {" ".join("a" * 12), " ".join("a" * 12) + "[][]"} and len(deep) == 15


ODD_RECORDS = [
    '{"a": 1, "b": {"c": 2.50, "d": [1, {"e": [true, null]}, [3, [4]]]}, "": {"": "x", "y": {}}, "l": []}',
    '{"a": {"b": {"c": {"d": {"e": {"f": {"g": [1, {"h": 1e300}]}}}}}}, "z": [[], [1.0], {}]}',
    '{"k\\u0000": "v\\u0000", "[q]": {"\\"": "]", "\\n": 900.0, "x\\n": "é", "plain key_1": -0.0001}}',
    '[1, {"a": {"b": [[{"c": 1}]]}}]', "3.0", '"text"', "{}", "not json",
]


def test_nested_expressions_equal_level_by_level(spark, monkeypatch):
    """What is opened by nested expressions and what is left to the levels gives the same leaves, texts and schemas."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(ODD_RECORDS)], "i int, s string")

    def found(depth):
        monkeypatch.setattr(records, "NESTED_DEPTH", depth)
        v = records.parse_record("s")
        made = rows.select("i", records.flatten_record(v), records.json_text(v, ", ", ": "), records.schema_nodes(v))
        return [(i, leaves, text, nodes and sorted(nodes, key=str)) for i, leaves, text, nodes in made.orderBy("i").collect()]

    whole = found(4)
    assert whole == found(0) == found(3)
    assert [x.path for x in whole[1][1]][0] == "a b c d e f g[0]" and whole[1][2].startswith('{"a": {"b": {"c"')
    assert '{"[q]": {"\\n": 900.0, "\\"": "]"' in whole[2][2] and "\\u0000" in whole[2][2]


def test_bindings_and_usual_records_take_no_copies_by_level(spark, monkeypatch):
    """Binding copies nothing, and a record of usual depth never reaches the fold over levels."""
    assert "transform" not in let("a", "b", "b")
    monkeypatch.setattr(records, "expand_sql", lambda nodes, expanded=None: f"if(true, raise_error('level by level'), {nodes})")
    rows = spark.createDataFrame([('{"b": 1, "l": [{"k": 1.5, "t": "x"}, {"k": null}], "o": {"p": {"q": true}}}',)], "s string")
    leaves = rows.select(records.flatten_record(records.parse_record("s"))).first()[0]
    assert [x.path for x in leaves] == ["b", "l[0] k", "l[0] t", "l[1] k", "o p q"]
