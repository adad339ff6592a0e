import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.functions import prompts, text


@pytest.mark.parametrize(
    "given_text, expected",
    [
        ("{'a': 'x', 'b': nan, 'c': 1.5}", '{"a": "x", "b":"None", "c": 1.5}'),
        ("{'a': nan}", '{"a": nan}'),
        ("{'a': ''}", '{"a": "}'),
        ("{'a': True}", '{"a": True}'),
        ("{'a': None}", '{"a": None}'),
        ("{'d': '1/2/2016'}", '{"d": "1 or 2 or 2016"}'),
        ("{'a': \"l'été\"}", '{"a": "l\'été"}'),
        ("{'a': \"don't\"}", '{"a": "don\'t"}'),
        ("{'a': 'one\ntwo'}", '{"a": "one two"}'),
        ("{'a': 'the men 'S'}", '{"a": "the men\'S"}'),
        ("", ""),
    ],
)
def test_repair_golden(apply, given_text, expected):
    assert apply([given_text], text.repair_record_text) == [expected]


TRICKY = st.text(alphabet="ab'\"/ {}:,_éß1\n", max_size=30)


@settings(max_examples=8, deadline=None)
@given(st.lists(TRICKY, min_size=20, max_size=60))
def test_repair_leaves_nothing_to_repair(apply, values):
    for made in apply(values, text.repair_record_text):
        assert "\n" not in made and "/" not in made and " 'S" not in made


def test_safe_repair_keeps_valid_json(apply):
    values = ['{"a":"the \'best\' one"}', '{"a":"rock \'n\' roll"}', '{"a":"None, True","b":{"c":"C:\\\\"}}']
    assert apply(values, lambda c: text.repair_record_text(c, "safe")) == values


def test_safe_repair(apply):
    values = ["{'a': None, 'b': 'None, x', 'c': True, 'd': nan, 'e': '1/2', 'f': '', 'g': False}"]
    out = apply(values, lambda c: text.repair_record_text(c, "safe"))
    assert json.loads(out[0]) == {"a": None, "b": "None, x", "c": True, "d": None, "e": "1/2", "f": "", "g": False}
    with pytest.raises(ValueError):
        text.repair_record_text(F.lit("x"), "other")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="{}a\"' é", max_size=20), min_size=20, max_size=60))
def test_first_object_is_balanced(apply, values):
    for value, found in zip(values, apply(values, text.first_json_object)):
        if found is None:
            continue
        assert found in value and found[0] == "{" and found[-1] == "}"
        assert found.count("{") == found.count("}")


def test_first_object_golden(apply):
    cases = {
        'x {"a":{"b":1}} y {"c":2}': '{"a":{"b":1}}',
        '} {"a":1}': None,
        '} {{"a":1}}': '{"a":1}',
        '{"a":"}"}': '{"a":"}',
        "no braces": None,
        "": None,
    }
    assert apply(list(cases), text.first_json_object) == list(cases.values())
    long_text = "{" * 20_000 + "x" * 50_000 + "}" * 20_000
    assert apply([long_text], text.first_json_object) == [long_text]


def test_quotes_golden(apply):
    cases = {
        "{'a': 'b'}": '{"a": "b"}',
        '{"a": \'b\'}': '{"a": \'b\'}',
        "{'a': 'it\\'s'}": '{"a": "it\\\'s"}',
        "x": "x",
        "": "",
    }
    assert apply(list(cases), text.single_to_double_quotes) == list(cases.values())


def test_cleaning(apply):
    assert apply(["it's 'x'", "", None], text.strip_apostrophes) == ["its x", "", None]
    assert apply(["a\\nb\\\\", None], text.strip_backslashes) == ["anb", None]
    assert apply([" \t a b \x1c\n"], text.strip_whitespace) == ["a b"]


def test_tokens_like_python(apply):
    values = ["Été à la plage, 3 x 42_b!", "a b c", "", "naïve-Ünï 你好 x²y"]
    expected = [re.findall(r"\b\w\w+\b", v.lower()) for v in values]
    assert apply(values, text.tokens) == expected
    assert apply(values, text.token_count) == [len(e) for e in expected]


def test_budget(spark):
    rows = spark.createDataFrame([(10,), (50,), (0,)], "n int")
    assert [r[0] for r in rows.select(text.buffered_budget("n")).collect()] == [int(1.1 * n) for n in (10, 50, 0)]


@pytest.mark.parametrize("size, overlap", [(4, 1), (4, 0), (3, 2), (100, 10)])
def test_chunks_cover_the_text(apply, size, overlap):
    values = ["abcdefghij", "", "abc", "abcd", "é" * 9]
    for value, pieces in zip(values, apply(values, lambda c: text.chunks(c, size, overlap))):
        assert all(len(p) <= size for p in pieces)
        assert pieces[0] + "".join(p[overlap:] for p in pieces[1:]) == value
    with pytest.raises(ValueError):
        text.chunks(F.lit("x"), 2, 2)


def test_prompts(apply):
    plain = apply(["T"], lambda c: prompts.render_prompt(F.lit("S"), c))[0]
    assert plain == (
        "\n            Populate a JSON in the JSON_SCHEMA format from the provided TEXT_DATA.\n            ---"
        "\n            JSON_SCHEMA: S\n            ---\n            TEXT_DATA: T\n            ---"
        "\n            OUTPUT:\n        "
    )
    instruct = apply(["T"], lambda c: prompts.render_prompt(F.lit("S"), c, "My-Instruct-7b"))[0]
    assert instruct == apply(["T"], lambda c: prompts.render_prompt(F.lit("S"), c, F.lit("x INSTRUCT")))[0]
    assert instruct.startswith("\n            [INST]\n") and instruct.endswith("\n            [\\INST]\n        ")
    assert apply([None], lambda c: prompts.render_prompt(F.lit("{input}"), c))[0].count("{input}") == 1
    text_ = apply(["P"], lambda c: prompts.render_training_text(c, F.lit("O")))[0]
    assert text_ == "\n            P\n            O\n            "


def test_run_id(spark):
    row = spark.sql("SELECT timestamp'2024-01-31 22:10:06' AS ts").select(
        text.run_id("ts").alias("id"), text.run_path("runs", F.lit("m"), "ts").alias("path")
    )
    assert tuple(row.first()) == ("2024-01-31 22:10:06", "runs/m/2024-01-31 22:10:06")
