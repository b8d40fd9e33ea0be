"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import encode, languages, mixing, neardup, packing, pairs, pii, spam, textstats
from millrace.session import materialize, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def _mixing_tables(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("shard_records", "source_configs", "stage_configs")]


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.unreachable_shares(*_mixing_tables(spark, d))


@query
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    report = mixing.mix(*_mixing_tables(spark, d))["report"]
    return report.select("stage", "name", "needed_tokens", "planned_tokens", "actual_tokens", "repeats", "target_share", "actual_share")


@query
def p1_selected(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(*_mixing_tables(spark, d))["selected"]


_P1_LINES = """
WITH sizes AS (
  SELECT regexp_replace(lower(source), '[\\s_-]', '', 'g') AS k, record_id, max(token_count) AS n
  FROM shard_records WHERE token_count > 0 AND source IS NOT NULL AND record_id IS NOT NULL GROUP BY ALL),
totals AS (SELECT k, sum(n) AS total FROM sizes GROUP BY k),
lines AS (
  SELECT s.stage, s.name, greatest(coalesce(TRY_CAST(s.weight AS DECIMAL(38,12)), 0), 0) AS exact_weight, CAST(exact_weight AS DOUBLE) AS w,
         CASE WHEN s.repeat IS NULL THEN 1.0 ELSE greatest(s.repeat, 0.0) END AS r, g.target_tokens AS target,
         greatest(0, least(coalesce(t.total, 0), coalesce(s.max_tokens, t.total, 0))) AS once
  FROM source_configs s LEFT JOIN stage_configs g USING (stage)
  LEFT JOIN totals t ON t.k = regexp_replace(lower(s.name), '[\\s_-]', '', 'g')),
summed AS (SELECT *, nullif(CAST(sum(exact_weight) OVER (PARTITION BY stage) AS DOUBLE), 0) AS ws FROM lines),
needs AS (SELECT *, coalesce(target * w / ws, 0.0) AS needed, once * r AS available FROM summed)
"""
SQL["p1_found"] = _P1_LINES + "SELECT DISTINCT stage, name FROM needs WHERE available < needed"
SQL["p1_report"] = (
    _P1_LINES
    + """, plan AS (SELECT DISTINCT stage, name, w, once, needed, CAST(floor(least(needed, available)) AS BIGINT) AS planned,
  w / ws AS share FROM needs)
SELECT stage, name, CAST(floor(needed) AS BIGINT) AS needed_tokens, planned AS planned_tokens, planned AS actual_tokens,
  round(planned / nullif(CAST(once AS DOUBLE), 0), 6) AS repeats, round(share, 6) AS target_share,
  round(planned / nullif(CAST(sum(planned) OVER (PARTITION BY stage) AS DOUBLE), 0), 6) AS actual_share
FROM plan"""
)


@query
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_texts(table(spark, d, "documents").select("doc_id", "text"))


def _texts_with_personal_data(spark: SparkSession, d: str) -> DataFrame:
    """Both tables as (table_name, record_key, text), repeats of a record once."""
    entries = table(spark, d, "dataset_entries").select(F.lit("dataset_entries").alias("table_name"), F.col("id").alias("record_key"), "text")
    alpaca = table(spark, d, "alpaca_records").select(F.lit("alpaca_records").alias("table_name"), F.col("record_id").cast("string").alias("record_key"), F.col("output").alias("text"))
    return entries.unionByName(alpaca).where("text is not null")


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    spans = materialize(pii.proposed_spans(_texts_with_personal_data(spark, d)))
    places = pii.found_places(spans, pii.fit(spans))
    return places.select("table_name", "record_key", "pii_type", "start_pos").distinct()


@query
def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts_with_personal_data(spark, d)
    weights = pii.fit(materialize(pii.proposed_spans(texts)))
    return pii.redact(texts, weights).select("table_name", "record_key", "redacted").distinct()


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "dataset_entries").select("id", F.col("word_count").alias("stored"), "text")
    measured = materialize(textstats.statistics(entries, table(spark, d, "common_words")))
    judged = textstats.judge(measured, textstats.prose_model(measured))
    kinds = F.when(F.col("kind").isin("list", "table", "junk"), F.col("kind"))
    counts = F.when(textstats.count_is_wrong(F.col("stored"), F.col("word_count")), F.lit("word_count"))
    return judged.select("id", F.explode(F.array_compact(F.array(kinds, counts))).alias("finding")).distinct()


@query
def p6_statistics(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "dataset_entries").select("id", "text", "quality_score")
    measured = materialize(textstats.statistics(entries, table(spark, d, "common_words")))
    judged = textstats.judge(measured, textstats.prose_model(measured))
    named = [F.round(F.col("stats")[i], 6).alias(n) for i, n in enumerate(textstats.STATISTICS)]
    parts = F.map_from_arrays(F.array(*map(F.lit, textstats.STATISTICS)), F.col("contributions"))
    return judged.select("id", "quality_score", "word_count", "lang", "kind", "distance", *named, F.to_json(parts).alias("contributions")).distinct()


@query
def p6_word_counts(spark: SparkSession, d: str) -> DataFrame:
    words = F.size(F.filter(F.split("text", "[ \t\r\n]+", -1), lambda w: w != ""))
    entries = table(spark, d, "dataset_entries").where("text is not null").withColumn("counted", words)
    return entries.where(textstats.count_is_wrong(F.col("word_count"), F.col("counted"))).select("id", "word_count", "counted").distinct()


SQL["p6_word_counts"] = r"""
WITH e AS (SELECT id, word_count, len(list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: w <> '')) AS counted FROM dataset_entries WHERE text IS NOT NULL)
SELECT DISTINCT id, word_count, CAST(counted AS INTEGER) AS counted FROM e WHERE counted >= 20 AND abs(word_count - counted) * 10 > counted"""


def _language_model(spark: SparkSession, d: str) -> languages.LanguageModel:
    return languages.fit_model(languages.training_sentences(table(spark, d, "dataset_entries"), table(spark, d, "common_words")))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "dataset_entries").select("id", "language", "text")
    found = languages.mislabelled_segments(entries, _language_model(spark, d), table(spark, d, "common_words"))
    return found.select("id", "segment_no", "lang").distinct()


@query
def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "dataset_entries").select("id", "text")
    labelled = languages.label_segments(entries, _language_model(spark, d))
    return labelled.select("id", F.explode("segments").alias("s")).select("id", "s.segment_no", "s.lang", "s.confidence", "s.words").distinct()


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    columns = ["instruction", "input", "output"]
    alpaca = table(spark, d, "alpaca_records").select(F.lit("alpaca_records").alias("table_name"), "record_id", *columns)
    rows = table(spark, d, "instruction_rows").select(F.lit("instruction_rows").alias("table_name"), F.col("row_id").alias("record_id"), *columns)
    return alpaca.unionByName(rows)


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = _pairs(spark, d)
    examples = languages.training_sentences(found.select("output"), table(spark, d, "common_words"), "output", None)
    return pairs.pair_defects(found, languages.fit_model(examples), table(spark, d, "common_words")).where("defect is not null").select("table_name", "record_id", "defect").distinct()


def _pages(spark: SparkSession, d: str) -> DataFrame:
    measured = materialize(spam.features(table(spark, d, "documents").select("doc_id", "site", "text"), table(spark, d, "common_words")))
    return spam.spam_probabilities(measured, spam.fit(measured))


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).where("probability > 0.5").select("doc_id").distinct()


@query
def p9_probabilities(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("doc_id", "site", F.round("own", 6).alias("own"), F.round("host_rate", 6).alias("host_rate"), F.round("probability", 6).alias("probability")).distinct()


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    links, members = neardup.similar_pairs(table(spark, d, "dataset_entries").select("id", "title", "text"))
    return neardup.expand_pairs(materialize(links), members)


@query
def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    links, members = neardup.similar_pairs(table(spark, d, "dataset_entries").select("id", "title", "text"))
    return neardup.link_counts(links, members)


def _sized(spark: SparkSession, d: str) -> DataFrame:
    sized = table(spark, d, "documents").select("doc_id", encode.token_counts(F.col("text")).alias("tokens"), "source", packing.near_copy_cluster(F.col("text")).alias("cluster"))
    return materialize(sized)


@query
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sized(spark, d), table(spark, d, "pack_plans"), packing.SOURCE_CONFLICTS)


@query
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    plans = table(spark, d, "pack_plans")
    return packing.fill_rate(packing.pack(_sized(spark, d), plans, packing.SOURCE_CONFLICTS), plans)


@query
def p8_violations(spark: SparkSession, d: str) -> DataFrame:
    sized, plans = _sized(spark, d), table(spark, d, "pack_plans")
    return packing.violations(packing.pack(sized, plans, packing.SOURCE_CONFLICTS), sized, plans, packing.SOURCE_CONFLICTS)


# What a packing must keep: every document placed, nothing over the capacity, in conflict, doubled, split or lost.
SQL["p8_violations"] = """
SELECT plan_id, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0 AS over_capacity, 0 AS conflicts, 0 AS twins, 0 AS split, 0 AS incomplete
FROM (SELECT DISTINCT plan_id FROM pack_plans WHERE seq_len >= 1)"""
