"""Queries on pipelines, Python text steps, sources and stateful hooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import bpe, dates, udfs
from millrace.operators import guardrails, tokens
from millrace.plans import pipeline
from millrace.plans.registry import query
from millrace.session import table
from millrace.sources import mock, parsers
from millrace.streaming import hooks


def _documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *columns)


@query()
def p13_process(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.process(_documents(spark, d, "text")).select("doc_id", "drop_reason", F.round("quality_score", 4).alias("quality_score"), F.length("clean_text").alias("clean_length"), "pii_removed")


@query()
def a01_pipeline_counters(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.counters(pipeline.process(_documents(spark, d, "text")))


@query()
def p14_build_instructions(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.build_instructions(table(spark, d, "dataset_entries").select("id", "title", "text"))


@query()
def f23_augment(spark: SparkSession, d: str) -> DataFrame:
    rows = pipeline.build_instructions(table(spark, d, "dataset_entries").select("id", "title", "text")).drop("topics", "entities")
    return pipeline.augment(rows, 2 * rows.count())


@query()
def f01_repair_mojibake(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d, udfs.repair(F.col("text")).alias("out"))


@query()
def f02_nfkc(spark: SparkSession, d: str) -> DataFrame:
    """Every row of documents; DuckDB has no NFKC, so tests compare with unicodedata."""
    return _documents(spark, d, udfs.nfkc(F.col("text")).alias("out"))


@query()
def f04_unescape(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d, udfs.unescape(F.col("text")).alias("out"))


@query()
def f11_full_clean(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d, udfs.full_clean(F.col("text")).alias("out"))


@query()
def f13_html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d, udfs.html_to_text(F.col("text")).alias("out"))


@query()
def f19_sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d, "text").where("text is not null").select("doc_id", F.posexplode(udfs.chunk_sentences(F.col("text"), 128, 16)).alias("chunk_no", "chunk"))


@query()
def g04_mask_pii(spark: SparkSession, d: str) -> DataFrame:
    masked = udfs.mask_pii(F.col("text"), guardrails.pii_patterns(), labels=guardrails.PII_LABELS)
    return table(spark, d, "dataset_entries").select("id", masked.alias("out"))


@query()
def s20_mock_source(spark: SparkSession, d: str) -> DataFrame:
    mock.register(spark)
    return spark.read.format("millrace_mock").option("years", "2023,2024").option("rows", "500").load()


@query()
def s26_law_articles(spark: SparkSession, d: str) -> DataFrame:
    return parsers.law_articles(_documents(spark, d, "text").where("text is not null"))


@query()
def t03_portuguese_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "instruction_rows").select("row_id", dates.portuguese_to_english(F.col("meta.date")).alias("out"))


@query("SELECT event_id, CAST(TIMESTAMP '2020-01-01' + to_days((('0x' || substr(md5('5|' || event_id), 1, 8))::BIGINT % 366)::INTEGER) AS DATE)::VARCHAR AS day FROM events")
def t19_dates_in_year(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators import sampling

    offset = (F.conv(F.substring(sampling.hash_order(F.col("event_id"), 5), 1, 8), 16, 10).cast("long") % 366).cast("int")
    return table(spark, d, "events").select("event_id", F.date_add(F.lit("2020-01-01").cast("date"), offset).cast("string").alias("day"))


@query(
    """WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings ORDER BY md5('0|' || vec_id), vec_id LIMIT 100)
SELECT round(avg(abs(list_dot_product(a.e, b.e) / greatest(sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)), 1e-12))), 6) AS mean_cosine, count(*) AS pairs FROM x a, x b WHERE a.vec_id <> b.vec_id"""
)
def a30_pairwise_cosine(spark: SparkSession, d: str) -> DataFrame:
    """A report over 100 sampled vectors: the sample is the feature, and its pairs are made inside one row."""
    from millrace.operators import sampling, vectors

    picked = table(spark, d, "embeddings").orderBy(sampling.hash_order(F.col("vec_id")), "vec_id").limit(100).agg(F.collect_list(F.struct("vec_id", F.col("embedding").cast("array<double>").alias("e"))).alias("rows"))
    pairs = picked.select(F.explode("rows").alias("a"), "rows").select("a", F.explode("rows").alias("b")).where("a.vec_id <> b.vec_id")
    return pairs.agg(F.round(F.avg(F.abs(vectors.cosine(F.col("a.e"), F.col("b.e")))), 6).alias("mean_cosine"), F.count("*").alias("pairs"))


def _steps(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").select(F.col("event_type").alias("run_id"), F.col("event_id").alias("step"), v.alias("loss"), (v / 100).alias("grad_norm"), F.lit(2.0).alias("clip"), (v / 1e6).alias("lr"))


@query()
def x01_step_hook(spark: SparkSession, d: str) -> DataFrame:
    return hooks.on_step_batch(_steps(spark, d))


@query()
def x02_x05_x07_eval_hook(spark: SparkSession, d: str) -> DataFrame:
    return hooks.on_eval_batch(_steps(spark, d).select("run_id", "step", F.col("loss").alias("val_loss")))


@query()
def x08_resumed_evals(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation hook over the events in two calls, the second from the state that the first has left."""
    evals = _steps(spark, d).select("run_id", "step", F.col("loss").alias("val_loss")).where("val_loss is not null")
    middle = evals.agg(F.max("step").alias("m")).first()["m"] or 0
    none = spark.createDataFrame([], "run_id string, " + hooks.EVAL_STATE)
    first, state = hooks.resume_evals(evals.where(F.col("step") <= middle // 2), none)
    second, _ = hooks.resume_evals(evals.where(F.col("step") > middle // 2), state)
    return first.unionByName(second)


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    return tokens.concatenated(_documents(spark, d, "text"), bpe.token_ids(F.col("text")), end=0)


@query()
def m16_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """One window of every document decoded and encoded again; the stream ends each document with token 0."""
    return tokens.round_trip(_encoded(spark, d)).drop("text")


@query()
def m16_round_trip_report(spark: SparkSession, d: str) -> DataFrame:
    return tokens.round_trip_report(tokens.round_trip(_encoded(spark, d)))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS begin, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def x11_event_windows(spark: SparkSession, d: str) -> DataFrame:
    return hooks.windowed(table(spark, d, "events"), "ts", "value", "event_type").select(F.col("span.start").alias("begin"), "event_type", "n", F.round("mean", 6).alias("mean"))
