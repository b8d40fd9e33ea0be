import json

import numpy as np
from pyspark.sql import functions as F

from millrace.plans import pipeline
from millrace.sources import mock, parsers, readers, sinks
from millrace.streaming import hooks


def test_jsonl(spark, tmp_path):
    good = {"id": "1", "source": "news", "text": "hello", "metadata": {"k": "v"}}
    (tmp_path / "a.jsonl").write_text(json.dumps(good) + "\n\nnot json\n" + json.dumps(good | {"id": "2"}) + "\n")
    assert readers.jsonl(spark, str(tmp_path)).where("id is not null").count() == 2
    records, bad = readers.jsonl_with_errors(spark, str(tmp_path))
    assert records.count() == 2 and bad.first().value == "not json"


def test_metrics_and_logs(spark, tmp_path):
    (tmp_path / "m.csv").write_text("step,loss,val_loss,lr,tokens,tokens_per_sec,timestamp\n1.0,2.5,,0.1,10,5,2024-01-01 00:00:00\n2,bad,3.0,0.1,20,5,\n")
    rows = readers.metrics_csv(spark, str(tmp_path / "m.csv")).orderBy("step").collect()
    assert rows[0].step == 1 and rows[0].val_loss is None and rows[1].loss is None and rows[1].timestamp is None
    (tmp_path / "x.log").write_text("a GradNorm: 1.25 b\nnothing\n")
    assert readers.log_values(spark, str(tmp_path / "x.log")).first().value == 1.25


def test_token_store_and_listing(spark, tmp_path):
    np.arange(10, dtype=np.uint16).tofile(tmp_path / "tokens_00010.bin")
    rows = readers.token_store(spark, str(tmp_path / "*.bin")).orderBy("pos").collect()
    assert [r.token_id for r in rows] == list(range(10))
    assert readers.file_listing(spark, str(tmp_path)).first().step == 10


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, "news", "t", "pt", [i, i + 1]) for i in range(25)], "doc_id int, source string, topic string, language string, ids array<int>")
    sinks.write_jsonl(df.drop("ids"), str(tmp_path / "a"), compress=True)
    assert spark.read.json(str(tmp_path / "a")).count() == 25
    manifest = sinks.write_shards(df.drop("ids").coalesce(1), str(tmp_path / "s"), 10)
    assert sorted(r.records for r in manifest.collect()) == [5, 10, 10]
    assert sinks.write_tokens(df, str(tmp_path / "t")).agg(F.sum("tokens")).first()[0] == 75
    sinks.write_splits(df.select("doc_id"), str(tmp_path / "p"), "doc_id")
    assert spark.read.json(str(tmp_path / "p")).count() == 25
    sinks.write_report(df.agg(F.count("*").alias("n")), str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first().value) == {"n": 25}
    assert sinks.remaining(df, df.limit(5), "doc_id").count() == 20


def test_parsers(spark):
    body = "x" * 120
    rss = f"<rss><channel><item><title>T</title><link>L</link><pubDate>Tue, 05 Mar 2024 10:00:00 +0000</pubDate><description>{body}</description></item><item><title>S</title><link>M</link><pubDate>x</pubDate><description>short</description></item></channel></rss>"
    rows = parsers.feed_items(spark.createDataFrame([(rss,)], "xml string")).collect()
    assert len(rows) == 1 and rows[0].title == "T"
    listing = json.dumps({"data": {"children": [{"data": {"id": "a", "title": "T", "selftext": "y" * 60, "score": 12, "created_utc": 0.0, "author": "u"}}, {"data": {"id": "b", "title": "T", "selftext": "[removed]", "score": 99}}]}})
    assert [r.id for r in parsers.posts(spark.createDataFrame([(listing,)], "json string")).collect()] == ["a"]
    law = "LEI\nArt. 1º " + "a" * 60 + "\nArt. 2º " + "b" * 60
    got = parsers.law_articles(spark.createDataFrame([(1, law), (2, "no articles")], "id int, text string")).orderBy("id", "number").collect()
    assert [(r.id, r.number) for r in got] == [(1, 1), (1, 2), (2, 1)]
    book = "junk\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\nbody\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\nmore"
    assert spark.createDataFrame([(book,)], "t string").select(parsers.book_text(F.col("t")).alias("x")).first().x.strip() == "body"


def test_mock(spark):
    mock.register(spark)
    df = spark.read.format("millrace_mock").option("years", "2020,2021").option("rows", "10").load()
    assert df.count() == 20 and df.where("date like '2020%'").count() == 10


def test_pipeline(spark):
    text = "O relatório que não muda para cada região está com uma descrição. São dados que valem para todos, com isso fica claro o que se mede em cada cidade do país e também quando."
    rows = [(1, text + " Um fim."), (2, text + " Um fim."), (3, ""), (4, None), (5, "zzz " * 80)]
    got = {r.doc_id: r.drop_reason for r in pipeline.process(spark.createDataFrame(rows, "doc_id int, text string"), min_score=0.1).collect()}
    assert got[2] in ("duplicate", got[1]) and got[3] == "language" and got[4] == "language"
    counted = pipeline.counters(pipeline.process(spark.createDataFrame(rows, "doc_id int, text string")))
    assert counted.agg(F.sum("documents")).first()[0] == 5
    items = spark.createDataFrame([("a", "T", "Solar panels are " + "x" * 60 + ". They work. Often."), ("b", "T", "kill " * 20)], "id string, title string, text string")
    built = pipeline.build_instructions(items)
    assert [r.id for r in built.collect()] == ["a"]
    assert pipeline.augment(built.drop("topics", "entities"), 3).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    rows = [("r1", i, 5.0 / (i + 1), 2.0 if 3 <= i <= 9 else 0.5, 2.0, 0.1) for i in range(12)] + [("r2", i, 1.0, 0.1, 2.0, 0.2) for i in range(5)]
    schema = "run_id string, step long, loss double, grad_norm double, clip double, lr double"
    steps = spark.createDataFrame(rows, schema)
    for part in range(3):
        steps.where(f"step % 12 >= {part * 4} and step % 12 < {part * 4 + 4}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running = hooks.on_step(stream).writeStream.format("memory").queryName("steps_out").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("steps_out").select("run_id", "step").collect())
    want = sorted(tuple(r) for r in hooks.on_step_batch(steps).select("run_id", "step").collect())
    assert got == want
    assert any(r.clipping_dominant for r in hooks.on_step_batch(steps).collect())


def test_eval_hook(spark):
    losses = [3.0, 2.0, 2.0, 2.0, 2.0, 2.5, 2.6, 2.7]
    rows = spark.createDataFrame([("r", i, v) for i, v in enumerate(losses)], "run_id string, step long, val_loss double")
    actions = [r.action for r in hooks.on_eval_batch(rows).orderBy("step").collect()]
    assert "reduce_on_plateau" in actions
