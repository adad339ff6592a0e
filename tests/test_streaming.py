from recordloom.functions.records import parse_record
from recordloom.plans import evaluate, training


def test_row_wise_plans_run_on_a_stream(spark, tmp_path):
    rows = [(1, "text", "{'a': 1}", '{"a":1}'), (2, "more", "oops", '{"a":2}')]
    spark.createDataFrame(rows, "id int, input string, output string, expected string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, input string, output string, expected string").json(str(tmp_path / "in"))
    formatted = training.format_training_data(stream)
    pairs = formatted.select("id", parse_record("expected").alias("l"), parse_record("output").alias("r"))
    scored = evaluate.compare(pairs, "id", "l", "r")
    for name, df in (("formatted", formatted), ("scored", scored)):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    assert [r.id for r in spark.sql("SELECT * FROM formatted").collect()] == [1]
    assert [(r.id, r.weighted_mape) for r in spark.sql("SELECT * FROM scored").collect()] == [(1, 0.0)]
