"""Queries on guardrails, de-duplication, formats, predicates, joins, set operations and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import dedup, formats, guardrails, telemetry, tokens
from millrace.plans.queries_text import _instruction_sql
from millrace.plans.registry import query
from millrace.session import table

_q = lambda s: s.replace("'", "''")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """dataset_entries with one row an id (repeats are equal but for the later collected_date)."""
    e = table(spark, d, "dataset_entries")
    return e.groupBy("id").agg(*[F.min_by(c, "collected_date").alias(c) for c in e.columns if c not in ("id", "collected_date")], F.min("collected_date").alias("collected_date"))


E = "e AS (SELECT * FROM dataset_entries QUALIFY row_number() OVER (PARTITION BY id ORDER BY collected_date) = 1)"


def _sql_content(text: str = "text") -> tuple[str, str]:
    """SQL lists of the reasons and of the flags `category: pattern` of the content filter."""
    edge = r"(?:^|$|[^\p{L}\p{N}_])"
    met = lambda ps: f"regexp_matches(coalesce({text}, ''), '(?i)(?:{_q('|'.join(ps).replace(chr(92) + 'b', edge))})')"
    named = lambda rows: "list_filter([" + ", ".join(f"CASE WHEN {met(ps)} THEN '{_q(label)}' END" for ps, label in rows) + "], lambda x: x IS NOT NULL)"
    every = guardrails.CONTENT_PATTERNS.items()
    return named([(ps, guardrails.CONTENT_REASON[c]) for c, ps in every]), named([([p], f"{c}: {p[:50]}") for c, ps in every for p in ps])


_REASONS, _FLAGS = _sql_content()


@query(f"SELECT doc_id, array_to_string({_REASONS}, ',') AS reasons, array_to_string({_FLAGS}, ' | ') AS flags, greatest(0.0::DOUBLE, 1 - 0.2::DOUBLE * len({_FLAGS})) AS confidence FROM documents")
def g01_content_filter(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.array_join(guardrails.content_reasons(t), ",").alias("reasons"), F.array_join(guardrails.content_flags(t), " | ").alias("flags"), guardrails.content_confidence(t).alias("confidence"))


@query(
    f"""WITH r AS (SELECT {_REASONS} AS l FROM documents) SELECT 'content' AS kind, unnest(['total', 'passed', 'failed']) AS label, unnest([count(*), count(*) FILTER (len(l) = 0), count(*) FILTER (len(l) > 0)]) AS n FROM r
UNION ALL SELECT 'content_reason', label, count(*) FROM (SELECT unnest(l) AS label FROM r) GROUP BY label"""
)
def a08_content_statistics(spark: SparkSession, d: str) -> DataFrame:
    return guardrails.content_statistics(table(spark, d, "documents").select("text"))


def _sql_bias(text: str) -> str:
    parts = [f"CASE WHEN regexp_matches({text}, '(?i){_q(p)}') THEN '{label}:{s}' END" for p, label, s in guardrails.BIAS_PATTERNS]
    return "list_sort(list_distinct(list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)))"


@query(f"SELECT doc_id, array_to_string({_sql_bias('text')}, ',') AS labels FROM documents WHERE text IS NOT NULL")
def g02_bias(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(guardrails.bias_labels(F.col("text")), ",").alias("labels"))


@query(
    f"""WITH r AS (SELECT {_sql_bias("coalesce(text, '')")} AS l FROM documents), t AS (SELECT list_distinct(list_transform(l, lambda x: split_part(x, ':', 1))) AS types, list_max(list_transform(l, lambda x: list_position(['low', 'medium', 'high'], split_part(x, ':', 2)))) AS worst, l FROM r)
SELECT 'bias' AS kind, unnest(['total', 'with_bias', 'without_bias']) AS label, unnest([count(*), count(*) FILTER (len(l) > 0), count(*) FILTER (len(l) = 0)]) AS n FROM t
UNION ALL SELECT 'bias_type', label, count(*) FROM (SELECT unnest(types) AS label FROM t) GROUP BY label UNION ALL SELECT 'bias_severity', list_extract(['low', 'medium', 'high'], worst), count(*) FROM t WHERE len(l) > 0 GROUP BY 2"""
)
def a08_bias_statistics(spark: SparkSession, d: str) -> DataFrame:
    return guardrails.bias_statistics(table(spark, d, "documents").select("text"))


_PII = ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '{_q(p)}')) AS {k}" for k, p in guardrails.PII_PATTERNS.items())


@query(f"SELECT id, {_PII} FROM dataset_entries")
def g03_pii_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dataset_entries").select("id", *[c.alias(k) for k, c in guardrails.pii_counts(F.col("text")).items()])


@query()
def g03_pii_counts_all(spark: SparkSession, d: str) -> DataFrame:
    """g03_pii_counts with addresses, whose patterns DuckDB's expressions can't follow beyond ASCII."""
    return table(spark, d, "dataset_entries").select("id", *[c.alias(k) for k, c in guardrails.all_pii_counts(F.col("text")).items()])


_MARK = {k: " + ".join(f"contains(p, ' {w} ')::INT" for w in ws) for k, ws in guardrails.LANGUAGE_MARKERS.items()}
_LANG = f"""WITH p AS (SELECT doc_id, lang, coalesce(text, '') AS t, ' ' || lower(coalesce(text, '')) || ' ' AS p FROM documents),
c AS (SELECT *, {", ".join(f"({v}) AS {k}" for k, v in _MARK.items())} FROM p), b AS (SELECT *, greatest(pt, en, es) AS best, pt + en + es + 1 AS total FROM c),
l AS (SELECT doc_id, lang, CASE WHEN length(trim(t)) < 10 THEN 'unknown' WHEN best = 0 OR pt = best THEN 'pt' WHEN en = best THEN 'en' ELSE 'es' END AS detected_lang,
  CASE WHEN length(trim(t)) < 10 THEN 0.0 WHEN best > 0 THEN best / total ELSE 0.5 END AS confidence FROM b)
"""


@query(_LANG + "SELECT doc_id, detected_lang, round(confidence, 6) AS confidence, detected_lang = 'pt' AND confidence >= 0.3 AS is_target FROM l")
def g05_language(spark: SparkSession, d: str) -> DataFrame:
    return guardrails.detect_language(table(spark, d, "documents")).select("doc_id", "detected_lang", F.round("confidence", 6).alias("confidence"), "is_target")


@query(_LANG + "SELECT detected_lang = 'pt' AND confidence >= 0.3 AS is_target, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM l GROUP BY 1")
def g06_language_partition(spark: SparkSession, d: str) -> DataFrame:
    return guardrails.detect_language(table(spark, d, "documents")).groupBy("is_target").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


@query(
    _LANG
    + """SELECT 'language' AS kind, unnest(['total', 'target', 'non_target', 'low_confidence']) AS label, unnest([count(*), count(*) FILTER (detected_lang = 'pt' AND confidence >= 0.3), count(*) FILTER (NOT (detected_lang = 'pt' AND confidence >= 0.3)), count(*) FILTER (confidence < 0.3)]) AS n FROM l
UNION ALL SELECT 'language_of', detected_lang, count(*) FROM l GROUP BY detected_lang"""
)
def a08_language_statistics(spark: SparkSession, d: str) -> DataFrame:
    return guardrails.language_statistics(table(spark, d, "documents").select("text"))


@query(
    _LANG
    + """SELECT doc_id, CASE WHEN best = 0 THEN 'pt' ELSE array_to_string(list_transform(list_reverse_sort(list_filter([{'n': pt, 't': 0, 'l': 'pt'}, {'n': en, 't': -1, 'l': 'en'}, {'n': es, 't': -2, 'l': 'es'}], lambda x: x.n > 0)), lambda x: x.l), ',') END AS candidates,
round(CASE WHEN best = 0 THEN 0.5 ELSE best / total END, 6) AS share FROM b"""
)
def o07_language_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select("doc_id", guardrails.language_candidates(F.col("text")).alias("c"))
    return found.select("doc_id", F.array_join(F.transform("c", lambda x: x["lang"]), ",").alias("candidates"), F.round(F.element_at("c", 1)["share"], 6).alias("share"))


_EXPECTED = "CASE WHEN lower(lang) LIKE 'pt%' OR lower(lang) LIKE 'por%' THEN 'pt' WHEN lower(lang) LIKE 'en%' THEN 'en' WHEN lower(lang) LIKE 'es%' OR lower(lang) LIKE 'spa%' THEN 'es' END"


@query(_LANG + f"SELECT e AS expected, count(*) AS detected, round(100 * count(*) FILTER (detected_lang <> e) / count(*), 4) AS contamination_pct FROM (SELECT {_EXPECTED} AS e, detected_lang FROM l) WHERE e IS NOT NULL AND detected_lang <> 'unknown' GROUP BY e")
def a17_contamination(spark: SparkSession, d: str) -> DataFrame:
    judged = guardrails.detect_language(table(spark, d, "documents").select("lang", "text")).withColumn("e", F.expr(_EXPECTED))
    return tokens.contamination(judged, "e", "detected_lang")


def _sql_words(terms: list[str]) -> str:
    return r"(?:^|[^\p{L}\p{N}_])(?:" + "|".join(_q(t.lower()) for t in terms) + r")(?:$|[^\p{L}\p{N}_])"


_BLACK = [t for ts in guardrails.BLACKLIST.values() for t in ts]


@query(rf"SELECT doc_id, NOT (regexp_matches(lower(coalesce(text, '')), '{_sql_words(_BLACK)}') OR regexp_matches(lower(coalesce(text, '')), 'price target of \$\d+')) AS passes FROM documents")
def g07_blacklist(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", guardrails.blacklist_passes(F.col("text")).alias("passes"))


_TOPIC = ", ".join(f"CASE WHEN regexp_matches(lower(coalesce(text, '')), '{_sql_words(ks)}') THEN '{t}' END" for t, ks in sorted(guardrails.TOPIC_KEYWORDS.items()))


@query(f"SELECT doc_id, array_to_string(list_filter([{_TOPIC}], lambda x: x IS NOT NULL), ',') AS topics FROM documents")
def g08_topics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(guardrails.topics(F.col("text")), ",").alias("topics"))


@query()
def g09_entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(guardrails.entities(F.col("text")), "|").alias("entities"))


@query(
    """SELECT event_id, array_to_string(list_filter([CASE WHEN value IS NULL THEN 'loss_not_finite' END, CASE WHEN value > 15 THEN 'loss_too_high' END, CASE WHEN value * 0.5 > 100 THEN 'gradient_explosion' END,
CASE WHEN value * 0.5 < 1e-7 THEN 'gradient_vanished' END, CASE WHEN value * 0.25 > 50 THEN 'ssm_gradient_high' END], lambda x: x IS NOT NULL), ',') AS alerts FROM events"""
)
def g10_health(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.array_join(guardrails.health_alerts(F.col("value"), F.col("value") * 0.5, F.col("value") * 0.25), ",").alias("alerts"))


@query(f"SELECT {', '.join(f'CAST(count(*) FILTER ({k} > 0) AS BIGINT) AS {k}' for k in guardrails.PII_PATTERNS)}, count(*) AS total FROM (SELECT {_PII} FROM dataset_entries)")
def a08_pii_documents(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "dataset_entries").select(*[c.alias(k) for k, c in guardrails.pii_counts(F.col("text")).items()])
    return counts.agg(*[F.count_if(F.col(k) > 0).alias(k) for k in guardrails.PII_PATTERNS], F.count("*").alias("total"))


@query()
def a08_pii_documents_all(spark: SparkSession, d: str) -> DataFrame:
    every = guardrails.all_pii_counts(F.col("text"))
    counts = table(spark, d, "dataset_entries").select(*[c.alias(k) for k, c in every.items()])
    return counts.agg(*[F.count_if(F.col(k) > 0).alias(k) for k in every], F.count("*").alias("total"))


_COLLAPSE = r"trim(regexp_replace(lower(coalesce(text, '')), '[ \t\r\n\f\v]+', ' ', 'g'))"


def _dup_sql(key: str, extra: str = "") -> str:
    return f"SELECT doc_id, row_number() OVER (PARTITION BY {key} ORDER BY doc_id) > 1 {extra} AS is_duplicate FROM documents"


@query(_dup_sql(f"md5({_COLLAPSE})", "AND length(coalesce(text, '')) >= 50"))
def d01_exact(spark: SparkSession, d: str) -> DataFrame:
    return dedup.mark_exact(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "is_duplicate")


@query(_dup_sql(f"sha256({_COLLAPSE})"))
def d02_exact_sha(spark: SparkSession, d: str) -> DataFrame:
    return dedup.mark_first(table(spark, d, "documents").select("doc_id", "text"), dedup.strict_key(F.col("text")), "doc_id").select("doc_id", "is_duplicate")


@query("SELECT doc_id, coalesce(text, '') = '' OR row_number() OVER (PARTITION BY md5(replace(coalesce(text, ''), ' ', '')) ORDER BY doc_id) > 1 AS is_duplicate FROM documents")
def d03_spaceless(spark: SparkSession, d: str) -> DataFrame:
    marked = dedup.mark_first(table(spark, d, "documents").select("doc_id", "text"), dedup.spaceless_key(F.col("text")), "doc_id")
    return marked.select("doc_id", ((F.coalesce("text", F.lit("")) == "") | F.col("is_duplicate")).alias("is_duplicate"))


@query(
    r"""WITH t AS (SELECT record_id, regexp_replace(lower(instruction), '[ \t\r\n\f\v]+', ' ', 'g') AS t FROM alpaca_records WHERE instruction IS NOT NULL)
SELECT record_id, len(list_distinct(list_transform(range(1, greatest(1, length(t) - 3)), lambda i: substring(t, i, 5)))) AS shingles FROM t"""
)
def d04_shingles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "alpaca_records").where("instruction is not null").select("record_id", F.size(dedup.char_shingles(F.col("instruction"))).cast("long").alias("shingles"))


@query()
def d05_j04_similar(spark: SparkSession, d: str) -> DataFrame:
    return dedup.similar_texts(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").select("id_a", "id_b", F.round("similarity", 6).alias("similarity"))


@query()
def d05_marks(spark: SparkSession, d: str) -> DataFrame:
    return dedup.mark_similar(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query(
    r"""WITH t AS (SELECT row_id, instruction, output FROM instruction_rows WHERE instruction IS NOT NULL AND output IS NOT NULL),
s AS (SELECT row_id, list_distinct(regexp_extract_all(lower(instruction), '[\p{L}\p{N}_]+')) AS a, list_distinct(regexp_extract_all(lower(output), '[\p{L}\p{N}_]+')) AS b FROM t)
SELECT DISTINCT row_id, round(CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0.0 END, 6) AS similarity FROM s"""
)
def d06_pair_similarity(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.array_distinct(tx.words(F.col("instruction"))), F.array_distinct(tx.words(F.col("output")))
    return table(spark, d, "instruction_rows").where("instruction is not null and output is not null").select("row_id", F.round(dedup.jaccard(a, b), 6).alias("similarity")).distinct()


@query(
    "SELECT record_id, md5(coalesce(instruction, '') || '|' || coalesce(input, '') || '|' || coalesce(output, '')) AS content_hash FROM alpaca_records QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY record_id) = 1"
)
def d07_record_hash(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "alpaca_records")
    return records.select("record_id", dedup.record_hash(records).alias("content_hash")).groupBy("content_hash").agg(F.min("record_id").alias("record_id"))


@query("SELECT id, left(md5(source || ':' || id), 16) AS short_id FROM dataset_entries")
def d08_short_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dataset_entries").select("id", dedup.short_id(F.col("source"), F.col("id")).alias("short_id"))


_MSG = f"[{{'role': 'system', 'content': '{formats.DEFAULT_SYSTEM}'}}, {{'role': 'user', 'content': coalesce(instruction, '') || CASE WHEN coalesce(input, '') <> '' THEN chr(10) || chr(10) || 'Contexto: ' || input ELSE '' END}}, {{'role': 'assistant', 'content': coalesce(output, '')}}]"


@query(f"SELECT record_id, to_json({_MSG})::VARCHAR AS messages FROM alpaca_records")
def t12_alpaca_to_chat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "alpaca_records").select("record_id", F.to_json(formats.alpaca_messages(F.col("instruction"), F.col("input"), F.col("output"))).alias("messages"))


@query(
    f"SELECT record_id, array_to_string(list_transform({_MSG}, lambda m: '<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>' || chr(10)), '') AS rendered, length(output) // 4 AS output_tokens FROM alpaca_records"
)
def t16_render_chat(spark: SparkSession, d: str) -> DataFrame:
    messages = formats.alpaca_messages(F.col("instruction"), F.col("input"), F.col("output"))
    return table(spark, d, "alpaca_records").select("record_id", formats.render_chat(messages).alias("rendered"), tx.approx_tokens(F.col("output")).alias("output_tokens"))


_TOPIC_CASE = " ".join(f"WHEN '{k}' THEN '{_q(v)}'" for k, v in formats.TOPIC_SYSTEM.items())


@query(f"SELECT record_id, CASE metadata.topic {_TOPIC_CASE} ELSE '{formats.DEFAULT_SYSTEM}' END AS system FROM alpaca_records")
def t13_j01_topic_prompt(spark: SparkSession, d: str) -> DataFrame:
    messages = formats.with_topic_prompt(formats.alpaca_messages(F.col("instruction"), F.col("input"), F.col("output")), F.col("metadata.topic"))
    return table(spark, d, "alpaca_records").select("record_id", messages[0]["content"].alias("system"))


@query("SELECT record_id, coalesce(output, '') AS last_content, CASE WHEN instruction IS NOT NULL AND output IS NOT NULL THEN 'alpaca' ELSE 'unknown' END AS format FROM alpaca_records")
def p15_t15_format_and_last(spark: SparkSession, d: str) -> DataFrame:
    messages = formats.alpaca_messages(F.col("instruction"), F.col("input"), F.col("output"))
    found = formats.detect_format({"instruction": F.col("instruction"), "output": F.col("output")})
    return table(spark, d, "alpaca_records").select("record_id", F.element_at(messages, -1)["content"].alias("last_content"), found.alias("format"))


_META = "{'id': id, 'source': coalesce(source, 'unknown'), 'topic': coalesce(topic, ''), 'quality_score': coalesce(quality_score, 0.7::DOUBLE)}"
_ENTRY_SYSTEM = "CASE topic " + " ".join(f"WHEN '{k}' THEN '{_q(v)}'" for k, v in formats.ENTRY_SYSTEM.items() if k != "default") + f" ELSE '{_q(formats.ENTRY_SYSTEM['default'])}' END"


@query(
    f"""WITH i AS (SELECT DISTINCT ON (id) id, {_instruction_sql("topic")} AS instruction, coalesce(text, '') AS t, topic FROM dataset_entries)
SELECT id, to_json({{'instruction': instruction, 'input': '', 'output': t}})::VARCHAR AS alpaca, to_json({{'conversations': [{{'from': 'human', 'value': instruction}}, {{'from': 'gpt', 'value': t}}]}})::VARCHAR AS sharegpt,
to_json({{'messages': [{{'role': 'system', 'content': {_ENTRY_SYSTEM}}}, {{'role': 'user', 'content': instruction}}, {{'role': 'assistant', 'content': t}}]}})::VARCHAR AS chatml FROM i"""
)
def t14_entry_formats(spark: SparkSession, d: str) -> DataFrame:
    return formats.entry_formats(table(spark, d, "dataset_entries").drop("collected_date").dropDuplicates(["id"]))


@query(f"SELECT DISTINCT id, {_META}.source AS source, {_META}.topic AS topic, round({_META}.quality_score, 6) AS quality_score FROM dataset_entries")
def t14_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The metadata of the alpaca form, read back from its JSON."""
    made = formats.entry_formats(table(spark, d, "dataset_entries"), metadata=True)
    meta = F.from_json(F.get_json_object("alpaca", "$.metadata"), "id string, source string, topic string, quality_score double").alias("m")
    return made.select(meta).select("m.id", "m.source", "m.topic", F.round("m.quality_score", 6).alias("quality_score")).distinct()


@query("SELECT coalesce(metadata.topic, 'unknown') AS topic, coalesce(metadata.source, 'unknown') AS source, count(*) AS records, CAST(sum(length(coalesce(output, '')) // 4) AS BIGINT) AS tokens FROM alpaca_records GROUP BY GROUPING SETS ((metadata.topic), (metadata.source), ())")
def a02_a03_dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "alpaca_records").createOrReplaceTempView("millrace_alpaca")
    return spark.sql(
        """SELECT coalesce(topic, 'unknown') AS topic, coalesce(source, 'unknown') AS source, count(*) AS records, sum(floor(length(coalesce(output, '')) / 4)) AS tokens
        FROM (SELECT metadata.topic AS topic, metadata.source AS source, output FROM millrace_alpaca) GROUP BY GROUPING SETS ((topic), (source), ())"""
    )


@query("SELECT doc_id, coalesce(nullif(trim(text), ''), nullif(trim(topic), ''), url) AS content FROM documents")
def p01_first_text(spark: SparkSession, d: str) -> DataFrame:
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.coalesce(blank(F.col("text")), blank(F.col("topic")), F.col("url")).alias("content"))


@query(
    r"""SELECT id, coalesce(source, 'unknown') AS source, coalesce(topic, 'geral') AS topic, coalesce(language, 'pt_br') AS language, coalesce(quality_score, 0.7) AS quality_score, coalesce(token_count, length(text) // 4, 0)::BIGINT AS token_count,
coalesce(len(list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: w <> '')), 0)::BIGINT AS word_count FROM dataset_entries"""
)
def p02_p03_entry_defaults(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "dataset_entries").select(
        "id",
        F.coalesce("source", F.lit("unknown")).alias("source"),
        F.coalesce("topic", F.lit("geral")).alias("topic"),
        F.coalesce("language", F.lit("pt_br")).alias("language"),
        F.coalesce("quality_score", F.lit(0.7)).alias("quality_score"),
        F.coalesce(F.col("token_count").cast("long"), tx.approx_tokens(t), F.lit(0)).alias("token_count"),
        F.coalesce(F.when(t.isNotNull(), tx.whitespace_words(t)), F.lit(0)).cast("long").alias("word_count"),
    )


@query("SELECT doc_id, CASE WHEN length(trim(text)) < 10 THEN 0 WHEN length(text) < 50 THEN 1 WHEN length(text) < 200 THEN 2 WHEN length(text) < 1000 THEN 3 ELSE 4 END AS length_class FROM documents WHERE text IS NOT NULL")
def p04_length_classes(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.when(F.length(F.trim("text")) < 10, 0).when(n < 50, 1).when(n < 200, 2).when(n < 1000, 3).otherwise(4).alias("length_class"))


@query("SELECT record_id, coalesce(edu_int_score >= 3, false) AS educational, CASE WHEN coalesce(edu_int_score >= 3, false) THEN 'edu' ELSE 'non_edu' END AS route, subset FROM shard_records")
def p05_p06_score_routes(spark: SparkSession, d: str) -> DataFrame:
    good = F.coalesce(F.col("edu_int_score") >= 3, F.lit(False))
    return table(spark, d, "shard_records").select("record_id", good.alias("educational"), F.when(good, "edu").otherwise("non_edu").alias("route"), "subset")


@query("SELECT id, strftime(published_date, '%Y-%m-%d %H:%M:%S') AS published FROM dataset_entries WHERE year(published_date) BETWEEN 2020 AND 2023")
def p07_year_range(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dataset_entries").where("published_date >= timestamp'2020-01-01' and published_date < timestamp'2024-01-01'").select("id", F.date_format("published_date", "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("SELECT doc_id FROM documents WHERE source = 'social_media' AND length(text) >= 50 AND text NOT IN ('[removed]', '[deleted]') AND coalesce(n_chars, 0) >= 10")
def p08_posts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("source = 'social_media' and length(text) >= 50 and text not in ('[removed]', '[deleted]') and coalesce(n_chars, 0) >= 10").select("doc_id")


@query("SELECT name, stage FROM source_configs WHERE coalesce(weight > 0, true)")
def p09_enabled(spark: SparkSession, d: str) -> DataFrame:
    """Sources that are not switched off; without a switch (here: without a weight) a source is on."""
    return table(spark, d, "source_configs").withColumn("enabled", F.col("weight") > 0).where(F.coalesce("enabled", F.lit(True))).select("name", "stage")


@query(
    "SELECT event_id AS step, event_type AS policy, CASE WHEN event_id % 3 = 1 THEN upper(event_type) || '_LR' WHEN event_id % 3 = 2 THEN 'REDUCE' END AS action FROM events WHERE event_id BETWEEN 100 AND 50000 AND (event_type = 'click' OR event_id % 3 = 1 AND contains(lower(event_type) || '_lr', 'click'))"
)
def p10_p18_policy_filter(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a decision log by policy or type of action and by steps; the action of every third entry is null."""
    kind = F.when(F.col("event_id") % 3 == 1, F.concat(F.upper("event_type"), F.lit("_LR"))).when(F.col("event_id") % 3 == 2, "REDUCE")
    log = table(spark, d, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("policy"), F.when(kind.isNotNull(), F.struct(kind.alias("type"))).alias("action"))
    return telemetry.filter_decisions(log, "click", 100, 50000).select("step", "policy", F.col("action.type").alias("action"))


@query(
    "SELECT doc_id, CASE WHEN length(coalesce(text, '')) // 4 < 50 THEN 'too_few_tokens' WHEN length(coalesce(text, '')) // 4 > 4096 THEN 'too_many_tokens' ELSE 'ok' END AS verdict FROM documents"
)
def p12_token_range(spark: SparkSession, d: str) -> DataFrame:
    n = tx.approx_tokens(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.when(n < 50, "too_few_tokens").when(n > 4096, "too_many_tokens").otherwise("ok").alias("verdict"))


@query(
    """WITH steps AS (SELECT unnest(range(0, 120000, 250)) AS step), m AS (SELECT step, max_by(stage, start_step) AS stage FROM steps JOIN stage_configs ON start_step <= step AND (end_step IS NULL OR step < end_step) GROUP BY step)
SELECT steps.step, coalesce(m.stage, (SELECT min_by(stage, start_step) FROM stage_configs)) AS stage FROM steps LEFT JOIN m USING (step)"""
)
def p16_j05_stage_of_step(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators import sampling

    return sampling.resolve_stage(spark.range(0, 120000, 250).select(F.col("id").alias("step")), table(spark, d, "stage_configs"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, TRY_CAST('[Not Supported]' AS DOUBLE) AS missing FROM events")
def p17_safe_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"), F.lit("[Not Supported]").try_cast("double").alias("missing"))


@query("SELECT s.stage, n.name FROM (SELECT DISTINCT stage FROM stage_configs) s CROSS JOIN (SELECT DISTINCT name FROM source_configs) n EXCEPT SELECT stage, name FROM source_configs WHERE weight > 0")
def j02_u02_pending_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of two small configuration tables without those already planned."""
    sources = table(spark, d, "source_configs")
    every = table(spark, d, "stage_configs").select("stage").distinct().crossJoin(sources.select("name").distinct())
    return every.join(sources.where("weight > 0").select("stage", "name").distinct(), ["stage", "name"], "left_anti")


@query("SELECT DISTINCT e.id FROM dataset_entries e WHERE NOT EXISTS (SELECT 1 FROM alpaca_records a WHERE a.metadata.id = e.id)")
def j03_not_collected(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "alpaca_records").select(F.col("metadata.id").alias("id")).where("id is not null").distinct()
    return table(spark, d, "dataset_entries").select("id").distinct().join(used, "id", "left_anti")


@query("SELECT DISTINCT e.id FROM dataset_entries e WHERE EXISTS (SELECT 1 FROM alpaca_records a WHERE a.metadata.id = e.id)")
def j06_existing(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "alpaca_records").select(F.col("metadata.id").alias("id")).where("id is not null").distinct()
    return table(spark, d, "dataset_entries").select("id").distinct().join(used, "id", "left_semi")


@query("SELECT l_suppkey, coalesce(s_name, 'source_' || l_suppkey) AS name, count(*) AS n FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey + 3 GROUP BY ALL")
def j07_names(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    named = counts.join(table(spark, d, "supplier").select("s_suppkey", "s_name"), F.col("s_suppkey") == F.col("l_suppkey") + 3, "left")
    return named.select("l_suppkey", F.coalesce("s_name", F.concat(F.lit("source_"), F.col("l_suppkey"))).alias("name"), "n")


@query("SELECT table_name, count(*) AS n FROM (SELECT 'alpaca' AS table_name, instruction FROM alpaca_records UNION ALL SELECT 'rows', instruction FROM instruction_rows) GROUP BY table_name")
def u01_union_all(spark: SparkSession, d: str) -> DataFrame:
    a, b = (table(spark, d, t).select(F.lit(n).alias("table_name"), "instruction") for t, n in (("alpaca_records", "alpaca"), ("instruction_rows", "rows")))
    return a.unionByName(b, allowMissingColumns=True).groupBy("table_name").agg(F.count("*").alias("n"))


@query("SELECT row_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(meta.topics, []), ['extra', 'tech']))), ',') AS topics FROM instruction_rows")
def u03_topic_union(spark: SparkSession, d: str) -> DataFrame:
    found = F.array_union(F.coalesce("meta.topics", F.array().cast("array<string>")), F.array(F.lit("extra"), F.lit("tech")))
    return table(spark, d, "instruction_rows").select("row_id", F.array_join(F.array_sort(F.array_compact(found)), ",").alias("topics"))


@query("SELECT DISTINCT path FROM source_configs")
def u04_distinct_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_configs").select("path").distinct()


@query(
    """WITH s AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn, dense_rank() OVER (ORDER BY source) AS prio FROM documents WHERE source IS NOT NULL)
SELECT doc_id, source, turn FROM s WHERE length(trim(coalesce(text, ''))) > 10"""
)
def u05_round_robin(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators import sampling

    taken = sampling.round_robin(table(spark, d, "documents").where("source is not null"), "source", "doc_id")
    return taken.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 10).select("doc_id", "source", "turn")


@query("SELECT topic, count(*) AS n FROM documents WHERE topic IS NOT NULL GROUP BY topic ORDER BY n DESC, topic LIMIT 10")
def o02_top_topics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("topic is not null").groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(10)


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def o03_last_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(200)


@query("SELECT doc_id, source FROM documents WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20")
def o04_limit_per_source(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators import sampling

    return sampling.first_per_group(table(spark, d, "documents").where("source is not null").select("doc_id", "source"), "source", ["doc_id"], 20)


@query("SELECT user_id, max_by(event_id, ts) AS latest, min_by(event_id, {'v': value, 'e': event_id}) AS best, max(ts) AS latest_ts FROM events GROUP BY user_id")
def o05_o06_latest_and_best(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", "ts").alias("latest"), F.min_by("event_id", F.struct("value", "event_id")).alias("best"), F.max("ts").alias("latest_ts"))


@query("SELECT row_id, array_to_string(coalesce(meta.topics, [])[1:2], ',') AS first_topics, left(output, 100) AS head FROM instruction_rows")
def o08_nested_limits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "instruction_rows").select("row_id", F.array_join(F.slice(F.coalesce("meta.topics", F.array().cast("array<string>")), 1, 2), ",").alias("first_topics"), F.left("output", F.lit(100)).alias("head"))


@query()
def t01_parse_dates(spark: SparkSession, d: str) -> DataFrame:
    from millrace.functions import dates

    return table(spark, d, "instruction_rows").select("row_id", F.col("meta.date").alias("raw"), dates.parse_date(F.col("meta.date")).alias("parsed"))


@query("SELECT event_id, strftime(make_timestamp(epoch_us(ts) // 1000000 * 1000000), '%Y-%m-%d %H:%M:%S') AS from_epoch, strftime(ts, '%Y-%m-%d') AS day, year(ts)::INTEGER AS year FROM events")
def t04_t05_epoch_and_day(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.date_format(F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp"))), "yyyy-MM-dd HH:mm:ss").alias("from_epoch"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.year("ts").alias("year"))


@query(
    r"""WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'PT' || event_id % 50 || 'H' || event_id % 60 || 'M' || event_id % 59 || 'S' WHEN 1 THEN 'PT' || event_id % 60 || 'M' WHEN 2 THEN 'PT' || event_id % 60 || 'S' ELSE 'none' END AS iso FROM events)
SELECT event_id, coalesce(TRY_CAST(regexp_extract(iso, '(\d+)H', 1) AS BIGINT), 0) * 3600 + coalesce(TRY_CAST(regexp_extract(iso, '(\d+)M', 1) AS BIGINT), 0) * 60 + coalesce(TRY_CAST(regexp_extract(iso, '(\d+)S', 1) AS BIGINT), 0) AS seconds FROM x"""
)
def t06_durations(spark: SparkSession, d: str) -> DataFrame:
    from millrace.functions import dates

    e, k = F.col("event_id"), F.col("event_id") % 4
    iso = F.when(k == 0, F.concat(F.lit("PT"), e % 50, F.lit("H"), e % 60, F.lit("M"), e % 59, F.lit("S"))).when(k == 1, F.concat(F.lit("PT"), e % 60, F.lit("M"))).when(k == 2, F.concat(F.lit("PT"), e % 60, F.lit("S"))).otherwise("none")
    return table(spark, d, "events").select("event_id", dates.iso_duration_seconds(iso).alias("seconds"))


@query("SELECT id, to_json({'id': id, 'source': source, 'title': title})::VARCHAR AS json FROM dataset_entries")
def t18_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dataset_entries").select("id", F.to_json(F.struct("id", "source", "title"), {"ignoreNullFields": "false"}).alias("json"))


@query(
    """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents WHERE lang ILIKE 'en%'), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents WHERE lang ILIKE 'p%'),
s AS (SELECT slot, (('0x' || substr(md5('0|' || slot), 1, 8))::BIGINT / 4294967296.0::DOUBLE) < 0.3 AS f FROM range((SELECT count(*) FROM a) + (SELECT count(*) FROM b)) t(slot)),
c AS (SELECT slot, f, CASE WHEN f THEN sum(f::INT) OVER w - 1 ELSE slot - sum(f::INT) OVER w END AS i FROM s WINDOW w AS (ORDER BY slot)),
e AS (SELECT coalesce(min(slot), 1000000000) AS e FROM c WHERE (f AND i >= (SELECT count(*) FROM a)) OR (NOT f AND i >= (SELECT count(*) FROM b)))
SELECT slot, doc_id FROM c JOIN a ON c.f AND c.i = a.i WHERE slot < (SELECT e FROM e) UNION ALL SELECT slot, doc_id FROM c JOIN b ON NOT c.f AND c.i = b.i WHERE slot < (SELECT e FROM e)"""
)
def m02_interleave(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators import sampling

    docs = table(spark, d, "documents").select("doc_id", "lang")
    english, portuguese = docs.where(F.col("lang").ilike("en%")).select("doc_id"), docs.where(F.col("lang").ilike("p%")).select("doc_id")
    return sampling.interleave(english, portuguese, "doc_id", 0.3).select("slot", "doc_id")


@query("SELECT DISTINCT c.path FROM source_configs c WHERE NOT EXISTS (SELECT 1 FROM shard_records r WHERE lower(regexp_replace(r.source, '[ _-]', '', 'g')) = lower(regexp_replace(c.name, '[ _-]', '', 'g')))")
def m15_missing_artifacts(spark: SparkSession, d: str) -> DataFrame:
    bare = lambda c: F.lower(F.regexp_replace(c, "[ _-]", ""))
    have = table(spark, d, "shard_records").select(bare(F.col("source")).alias("k")).distinct()
    return table(spark, d, "source_configs").select("path", bare(F.col("name")).alias("k")).join(have, "k", "left_anti").select("path").distinct()


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed FROM events")
def t02_iso_dates(spark: SparkSession, d: str) -> DataFrame:
    from millrace.functions import dates

    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, d, "events").select("event_id", iso.alias("iso"), F.date_format(dates.parse_date(iso), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("SELECT row_id, len(list_filter(coalesce(meta.entities, []), lambda e: length(e) > 5)) AS long_entities, list_contains(coalesce(meta.topics, []), 'tech') AS has_tech, array_to_string(list_transform(coalesce(meta.topics, []), lambda t: upper(t)), ',') AS shouted FROM instruction_rows")
def t11_arrays(spark: SparkSession, d: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    names, tags = F.coalesce("meta.entities", empty), F.coalesce("meta.topics", empty)
    return table(spark, d, "instruction_rows").select("row_id", F.size(F.filter(names, lambda e: F.length(e) > 5)).cast("long").alias("long_entities"), F.array_contains(tags, "tech").alias("has_tech"), F.array_join(F.transform(tags, lambda t: F.upper(t)), ",").alias("shouted"))
