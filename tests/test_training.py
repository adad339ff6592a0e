import json
import math
import os

import pytest
from pyspark.sql import functions as F

from recordloom.operators import kept, lookup, order, python_batches, split
from recordloom.plans import build, evaluate, training
from recordloom.sources import csv, documents, tables
from recordloom.sources.scratch import scratch_path

ROWS = [
    (1, "first text", "{'b': 'x', 'a': 1}"),
    (2, "second text", "{'c': 2.0}"),
    (3, "third text", "{'a': nan}"),
    (4, "fourth text", "{'a': 'y'}"),
    (5, "fifth text", "{}"),
    (6, "sixth text", "['a']"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id int, input string, output string")


def test_quarantine_and_good_rows_make_up_the_input(rows):
    good = training.format_training_data(rows)
    bad = training.quarantine(rows)
    assert {r.id: r.reason for r in bad.collect()} == {3: "not_json", 5: "empty_record", 6: "not_object"}
    assert {r.id for r in good.collect()} == {1, 2, 4}
    row = good.where("id = 1").first()
    assert row.output == '{"a":1,"b":"x"}' and row.schema_str == '{"a":"int","b":"str"}'
    assert f"JSON_SCHEMA: {row.schema_str}\n" in row.preprocessed_input and "TEXT_DATA: first text\n" in row.preprocessed_input
    assert row.text == f"\n            {row.preprocessed_input}\n            {row.output}\n            "


def test_given_schema_and_mapping(rows):
    out = training.format_training_data(rows, mapping={"alpha": "a"}, schema_str="S", schema_source="given").where("id = 1").first()
    assert out.output == '{"alpha":1,"b":"x"}' and "JSON_SCHEMA: S\n" in out.preprocessed_input


def test_inference_formatting(rows):
    out = training.format_training_data(rows.drop("output"), schema_str="S", model_name="an-Instruct")
    assert out.columns == ["id", "input", "preprocessed_input"]
    assert all("[INST]" in r.preprocessed_input for r in out.collect())


def test_stop_mode(rows):
    out = {r.id: r for r in training.format_training_data(rows, on_error="stop").collect()}
    assert [out[i].text is not None for i in range(1, 7)] == [True, True, False, False, False, False]
    assert "JSON_SCHEMA: {\"c\":\"float\"}\n" in out[3].preprocessed_input  # carried over from row 2
    assert out[3].output == "{'a': nan}" and out[4].preprocessed_input is None and out[4].output == "{'a': 'y'}"
    all_good = training.format_training_data(rows.where("id < 3"), on_error="stop")
    assert all(r.text is not None for r in all_good.collect())
    first_bad = training.format_training_data(rows.where("id >= 3"), on_error="stop", schema_str="G").where("id = 3").first()
    assert "JSON_SCHEMA: G\n" in first_bad.preprocessed_input


def test_fail_mode(rows):
    with pytest.raises(Exception, match=r"unusable record at [356]: (not_json|empty_record|not_object)"):
        training.format_training_data(rows, on_error="fail").collect()
    assert training.format_training_data(rows.where("id < 3"), on_error="fail").count() == 2
    for bad in ({"on_error": "x"}, {"schema_source": "x"}):
        with pytest.raises(ValueError):
            training.format_training_data(rows, **bad)


def test_each_text_is_parsed_once(rows, plan_of):
    assert plan_of(training.format_training_data(rows)).count("parseJson") == 1


def test_split_exact(spark, plan_of):
    for n in (1, 10, 333):
        df = spark.range(n).withColumnRenamed("id", "key")
        parts = split.split_exact(df, "key")
        counts = {r.split: r["count"] for r in parts.groupBy("split").count().collect()}
        assert counts.get("eval", 0) == math.ceil(0.3 * n) and sum(counts.values()) == n
    parts = split.split_exact(spark.range(50), "id", test_size=0.5, seed=1)
    assert {r.id for r in parts.where("split='eval'").collect()} == {
        r.id for r in split.split_exact(spark.range(50).repartition(7), "id", 0.5, 1).where("split='eval'").collect()
    }
    top = plan_of(parts).split("Subquery")[0]
    assert "Exchange" not in top and "Sort" not in top
    assert split.split_exact(spark.range(9), "id", test_size=1.0).where("split='eval'").count() == 9
    assert split.split_exact(spark.range(9), "id", test_size=0.0).where("split='eval'").count() == 0


def test_split_by_hash(spark):
    share = spark.range(20_000).select((split.split_by_hash("id") == "eval").cast("int").alias("e")).agg(F.avg("e")).first()[0]
    assert 0.28 < share < 0.32


def test_row_index(spark):
    df = spark.range(0, 3000, 3).select(((F.col("id") * 7919) % 100_003).alias("key")).distinct()
    keys = [r.key for r in order.row_index(df, "key").orderBy("row").collect()]
    assert keys == sorted(keys) and len(keys) == 1000
    assert [r.row for r in order.row_index(spark.range(1), "id").collect()] == [0]
    assert order.row_at(df, "key").first().key == keys[0] and order.row_at(df, "key", keys[5]).count() == 1


def test_budget(spark):
    df = spark.createDataFrame([(2, "aa bb cc"), (1, "aa " * 10)], "id int, text string")
    assert tuple(training.sequence_budget(df).first()) == (10, 11)
    assert tuple(training.sequence_budget(df, key="id").first()) == (10, 11)

    def characters():
        return len

    counted = training.sequence_budget(df, count=python_batches.count_tokens("text", characters))
    assert tuple(counted.first()) == (30, 33)


def test_prepare(spark, rows):
    many = rows.select(F.explode(F.sequence(F.lit(0), F.lit(9))).alias("n"), "*").select(
        (F.col("id") * 100 + F.col("n")).alias("id"), "input", "output"
    )
    for fmt in ("parquet", "json"):
        prepared = training.prepare_training(many, scratch_path(spark, "prepared"), export_fmt=fmt)
        assert prepared.table.columns == ["id", "input", "preprocessed_input", "output", "text"]
        assert (prepared.dataset.count(), prepared.train.count(), prepared.evaluation.count()) == (30, 21, 9)
        assert {r.name for r in prepared.signature.collect()} == set(tables.TRAINING_COLUMNS)
        assert [r.id for r in prepared.example.collect()] == [100, 101, 102, 103, 104]


def test_csv_round_trip(spark, tmp_path):
    raw = ['plain', 'two\nlines, "quoted"', " kept blanks ", "it's \\ back", "é", "", "a\r\nb"]
    df = spark.createDataFrame([(i, r, {"k": r}) for i, r in enumerate(raw)], "id int, raw string, record map<string,string>")
    csv.write_csv(df, str(tmp_path / "a"), index_by="id")
    back = csv.read_csv(spark, str(tmp_path / "a"))
    assert back.columns == ["id", "raw", "record"]
    got = {r.id: (r.raw, json.loads(r.record)) for r in back.collect()}
    assert got == {i: (r or None, {"k": r}) for i, r in enumerate(raw)}
    typed = csv.read_csv(spark, str(tmp_path / "a"), "`_c0` int, id long, raw string, record string")
    assert typed.columns == ["id", "raw", "record"] and typed.schema["id"].dataType.simpleString() == "bigint"


def test_documents_to_pairs(spark, tmp_path):
    for name, content in {"a.pdf": "it's\fpage two", "b.pdf": "other", "c.PDF": "no", "d.txt": "no"}.items():
        (tmp_path / name).write_text(content)
    os.mkdir(tmp_path / "sub.pdf.d")
    assert {r.file_name for r in documents.scan_documents(spark, str(tmp_path)).collect()} == {"a.pdf", "b.pdf"}

    def decoder():
        return lambda content: bytes(content).decode().split("\f")

    pages = documents.scan_documents(spark, str(tmp_path), decoder_factory=decoder)
    assert pages.count() == 3
    meta = tables.table_from_rows(spark, [("a.pdf", '{"x":1}')], "file_name string, record string")
    pairs = build.pairs_from_documents(pages, meta, "file_name", "pos", "text", "record")
    assert {tuple(r) for r in pairs.collect()} == {("a.pdf", "its page two", '{"x":1}'), ("b.pdf", "other", "{}")}
    assert build.rename_pair_columns(pairs).columns == ["file_name", "input", "output"]
    wide = build.pairs_from_table(spark.createDataFrame([("t", 1, None)], "text string, a int, b string"), "text")
    assert tuple(wide.first()) == ("t", '{"a":1,"b":null}')


def test_lookup_salted_and_plain(spark):
    docs = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("f"), F.col("id") % 50)).alias("name"))
    meta = spark.createDataFrame([("hot", "H"), ("f1", "one"), ("f2", "two")], "name string, value string")
    plain = lookup.lookup(docs, meta, "name", {"value": F.lit("none")})
    salted = lookup.lookup(docs, meta, "name", {"value": F.lit("none")}, spread_by="id", salt=4)
    assert sorted(map(tuple, plain.select("id", "name", "value").collect())) == sorted(
        map(tuple, salted.select("id", "name", "value").collect())
    )
    assert plain.where("value = 'H'").count() == 100
    with pytest.raises(ValueError):
        lookup.lookup(docs, meta, "name", {}, salt=2)


@pytest.mark.parametrize("frequent", [1, 3, 1000])
def test_join_by_frequency(spark, frequent):
    rows = spark.range(500).select("id", F.when(F.col("id") < 200, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("key"))
    stats = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("key != 'k7'")
    joined = lookup.join_by_frequency(rows, stats, "key", "n", ["top"], ["id"], frequent=frequent)
    plain = rows.join(stats, "key", "left").select("id", "key", "top")
    assert sorted(map(str, joined.collect())) == sorted(map(str, plain.collect()))


def test_join_by_frequency_leaves_served_rows_where_they_are(spark):
    rows = spark.range(500).select("id", F.when(F.col("id") >= 200, F.concat(F.lit("k"), F.col("id") % 40)).alias("key"))
    stats = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("key != 'k7'")
    for frequent in (1, 3, 1000):
        joined = lookup.join_by_frequency(rows, stats, "key", "n", ["top"], ["id"], frequent=frequent, stay=True)
        plain = rows.join(stats, "key", "left").select("id", "key", "top")
        assert sorted(map(str, joined.collect())) == sorted(map(str, plain.collect()))


def test_embed_distinct_calls_each_text_once(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def factory():
        def embed(texts):
            with open(calls, "a") as log:
                log.writelines(f"{t}\n" for t in texts)
            return [[float(len(t))] for t in texts]

        return embed

    rows = spark.range(200).select("id", F.concat(F.lit("text"), F.col("id") % 5).alias("text"))
    rows = rows.union(spark.createDataFrame([(999, None)], "id long, text string"))
    out = python_batches.embed_distinct(rows, "text", factory, ["id"]).collect()
    assert len(out) == 201 and all(r.vector == [5.0] for r in out if r.text) and [r.vector for r in out if not r.text] == [None]
    # once for the frequent texts, once for the table of all distinct texts
    assert len(open(calls).read().split()) <= 10


def test_generate(spark):
    def factory(config):
        assert config["top_k"] == 5
        return lambda prompts: [p[: config["max_new_tokens"]] for p in prompts]

    df = spark.createDataFrame([(1, "abcdef"), (2, "xy")], "id int, preprocessed_input string")
    out = python_batches.generate(df, factory, config={"max_new_tokens": 3}).orderBy("id").collect()
    assert [r.generated_output for r in out] == ["abc", "xy"] and all(r.generation_seconds >= 0 for r in out)
    assert python_batches.GENERATION_DEFAULTS["max_new_tokens"] == 200


def test_scratch_is_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(shared) and scratch_path(spark, "x") != scratch_path(spark, "x")


def test_delta_is_named_through(spark, rows, tmp_path):
    formatted = training.format_training_data(rows)
    with pytest.raises(Exception, match="(?i)delta"):
        tables.write_training_table(formatted, str(tmp_path / "t"), fmt="delta")
    tables.write_training_table(formatted, str(tmp_path / "t"), fmt="orc")
    assert tables.read_table(spark, str(tmp_path / "t"), "orc").columns == list(tables.TRAINING_COLUMNS)


def test_small_scans_are_spread_and_large_ones_are_not(spark):
    assert tables.spread_few_splits(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == 4
    wide = spark.range(0, 10, 1, 9)
    assert tables.spread_few_splits(wide) is wide


def test_stop_inside_a_table(spark, plan_of):
    texts = {1: "{'a': 1}", 2: "{'b': 'x'}", 3: "broken", 4: "{'a': 1}", 5: "broken"}
    df = spark.createDataFrame([(i, f"t{i}", o) for i, o in texts.items()], "id int, input string, output string").repartition(3)
    stopped = training.format_training_data(df, on_error="stop")
    out = {r.id: r for r in stopped.collect()}
    assert [out[i].schema_str for i in range(1, 6)] == ['{"a":"int"}', '{"b":"str"}', '{"b":"str"}', None, None]
    assert [out[i].output for i in range(1, 6)] == ['{"a":1}', '{"b":"x"}', "broken", "{'a': 1}", "broken"]
    assert [out[i].text is None for i in range(1, 6)] == [False, False, True, True, True]
    assert "Window" not in plan_of(stopped)
    # equal keys, null outputs and an empty table
    ties = spark.createDataFrame([(1, "t", None), (1, "t", "{'a': 1}")], "id int, input string, output string")
    assert all(r.schema_str == "" for r in training.format_training_data(ties, on_error="stop").collect())
    assert training.format_training_data(df.where("id > 9"), on_error="stop").collect() == []


def test_percentile_budgets(spark):
    words = [(i, " ".join(["word"] * n)) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 100])]
    df = spark.createDataFrame([*words, (99, None)], "id int, text string")
    budgets = training.sequence_budgets(df, percentiles=(0.1, 0.5, 0.91, 1.0)).orderBy("percentile").collect()
    assert [tuple(r) for r in budgets] == [(0.1, 1, 1), (0.5, 5, 5), (0.91, 100, 110), (1.0, 100, 110)]
    assert [r.tokens for r in training.sequence_budgets(df.where("text IS NULL")).collect()] == [None] * 3
    top = training.sequence_budget(df).first()
    assert (top.tokens, top.budget) == (100, 110)
    for bad in ((), (0.0,), (1.5,)):
        with pytest.raises(ValueError):
            training.sequence_budgets(df, percentiles=bad)


def test_sketches_of_parts_answer_for_the_whole(spark):
    counts = spark.range(20000).select((F.col("id") * 7919 % 20000).alias("n"), (F.col("id") % 7).alias("part"), F.lit("").alias("text"))
    parts = training.token_sketch(counts, by=("part",), count=F.col("n"))
    assert parts.count() == 7
    ranks = (0.01, 0.25, 0.5, 0.95, 1.0)
    for row in training.sketch_budgets(parts, ranks).collect():
        assert abs((row.tokens + 1) / 20000 - row.percentile) <= 0.03


def test_prompts_are_added_where_there_are_none(spark, rows):
    shown = training.with_prompt(rows, {"a": "int"}).orderBy("id").collect()
    assert len(shown) == 6 and all("JSON_SCHEMA: {'a': 'int'}\n" in r.preprocessed_input for r in shown)
    own = rows.withColumn("preprocessed_input", F.lit("mine"))
    assert {r.preprocessed_input for r in training.with_prompt(own, "S").collect()} == {"mine"}

    def factory(config):
        return lambda asked: [str(len(p)) for p in asked]

    made = evaluate.generate_texts(rows, factory, "S", "an-Instruct").collect()
    assert all(r.generated_output == str(len(r.preprocessed_input)) and "[INST]" in r.preprocessed_input for r in made)


def test_kept_vectors_are_not_made_again(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def factory():
        def vectors_of(texts):
            with open(calls, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return [[float(len(t))] for t in texts]

        return vectors_of

    def asked():
        return open(calls).read().split() if os.path.exists(calls) else []

    df = spark.range(300).select("id", F.concat(F.lit("text"), F.col("id") % 5).alias("text"))
    df = df.union(spark.createDataFrame([(999, None), (1000, "")], "id long, text string"))
    path = str(tmp_path / "vectors")
    first = kept.embed_kept(df, "text", factory, path, "m1", ["id"], slices=3)
    expected = {r.id: None if r.text is None else [float(len(r.text))] for r in df.collect()}
    assert {r.id: r.vector for r in first.collect()} == expected and first.columns == ["id", "text", "vector"]
    # the empty text is asked for too, but shows as no word in the list
    assert sorted(asked()) == [f"text{i}" for i in range(5)]
    again = kept.embed_kept(df, "text", factory, path, "m1", ["id"], slices=3)
    assert {r.id: r.vector for r in again.collect()} == expected and len(asked()) == 5
    more = df.union(spark.createDataFrame([(2000, "other")], "id long, text string"))
    assert kept.embed_kept(more, "text", factory, path, "m1", ["id"]).where("id = 2000").first().vector == [5.0]
    assert sorted(asked()) == ["other", *[f"text{i}" for i in range(5)]]
    kept.embed_kept(df, "text", factory, path, "m2", ["id"])
    assert len(asked()) == 11  # another version is another model
    assert kept.embed_kept(df.limit(0), "text", factory, path, "m1", ["id"]).collect() == []
    with pytest.raises(ValueError):
        kept.embed_kept(df, "text", factory, path, "m1", ["id"], slices=0)


def test_plan_of_kept_vectors(spark, tmp_path, plan_of):
    df = spark.range(20).select("id", F.col("id").cast("string").alias("text"))
    made = kept.embed_kept(df, "text", lambda: lambda texts: [[1.0]] * len(texts), str(tmp_path / "v"), "m", ["id"])
    assert plan_of(made).count("Exchange") <= 5 and "ArrowEvalPython" not in plan_of(made)


def test_generation_goes_on_after_a_break(spark, tmp_path):
    """A model that breaks once has its finished slices kept; the next run asks only for the others."""
    calls, broken = str(tmp_path / "calls"), str(tmp_path / "broken")
    open(broken, "w").close()

    def factory(config):
        def answer(asked):
            if os.path.exists(broken) and any(p.endswith("7") for p in asked):
                raise RuntimeError("model is gone")
            with open(calls, "a") as f:
                f.writelines(f"{p}\n" for p in asked)
            return [p.upper() for p in asked]

        return answer

    df = spark.range(40).select("id", F.concat(F.lit("p"), F.col("id")).alias("preprocessed_input"))
    path = str(tmp_path / "texts")
    with pytest.raises(Exception, match="model is gone"):
        kept.generate_kept(df, factory, path, "m", ["id"], slices=40)
    done = {r.generated_output.lower() for r in spark.read.parquet(path).collect()}
    assert len(done) < 40
    os.remove(broken)
    before = len(open(calls).read().split())
    out = {r.id: r.generated_output for r in kept.generate_kept(df, factory, path, "m", ["id"], slices=40).collect()}
    assert out == {i: f"P{i}" for i in range(40)}
    later = open(calls).read().split()[before:]
    assert sorted(later) == sorted({f"p{i}" for i in range(40)} - done)
    # other settings are other texts
    assert kept.digest("x", "m 1") is not None
    kept.generate_kept(df.limit(1), factory, path, "m", ["id"], config={"top_k": 1})
    assert spark.read.parquet(path).count() == 41
