"""Queries on cleaning, text functions and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import bpe
from millrace.functions import text as tx
from millrace.operators import formats, quality
from millrace.sources import parsers
from millrace.plans.registry import query
from millrace.session import spread, table

W = r"[\p{L}\p{N}_]+"
_SCORED = rf"""
WITH base AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '{W}') AS words,
    list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda s: regexp_replace(s, '[ \t\r\n]+', '', 'g') <> ''), lambda s: len(regexp_extract_all(lower(s), '{W}'))) AS sizes
  FROM documents),
rep AS (SELECT doc_id, count(*) AS r FROM (SELECT doc_id, word FROM (SELECT doc_id, unnest(words) AS word FROM base) GROUP BY doc_id, word HAVING count(*) > 1) GROUP BY doc_id),
m AS (SELECT doc_id, lang, t, words, length(t) // 4 AS tokens,
    len(regexp_extract_all(t, '[^\p{{L}}\p{{N}}\s.,!?;:''"-]')) / greatest(1, length(t)) AS special,
    len(list_distinct(words)) AS d,
    coalesce(rep.r, 0) AS r,
    coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS letters,
    CASE WHEN len(sizes) > 0 THEN list_sum(sizes) / len(sizes) ELSE 0.0 END AS mean FROM base LEFT JOIN rep USING (doc_id)),
n AS (SELECT *, CASE WHEN d > 0 THEN r / d ELSE 0.0 END AS repetition, CASE WHEN len(words) > 0 THEN letters / len(words) ELSE 0.0 END AS average FROM m),
s AS (SELECT *, CASE WHEN tokens < 50 THEN tokens / 50 WHEN tokens > 4096 THEN greatest(0.0, 1 - (tokens - 4096) / 4096) ELSE 1.0 END AS length_score,
    greatest(0.0, 1 - special / 0.1::DOUBLE) AS special_char_score,
    greatest(0.0, 1 - repetition / 0.3::DOUBLE) * CASE WHEN average < 2 OR average > 15 THEN 0.8::DOUBLE ELSE 1.0 END AS repetition_score,
    CASE WHEN mean < 3 THEN mean / 3 WHEN mean > 50 THEN greatest(0.5, 1 - (mean - 50) / 100) ELSE 1.0 END AS sentence_score FROM n),
q AS (SELECT *, CASE WHEN t = '' THEN 0.0 ELSE 0.3::DOUBLE * length_score + 0.2::DOUBLE * special_char_score + 0.25 * repetition_score + 0.25 * sentence_score END AS quality_score,
    CASE WHEN t = '' THEN ['empty_text'] ELSE list_filter([CASE WHEN tokens < 50 THEN 'too_short' END, CASE WHEN tokens > 4096 THEN 'too_long' END,
      CASE WHEN special > 0.1 THEN 'too_many_special_chars' END, CASE WHEN repetition > 0.3 THEN 'high_word_repetition' END,
      CASE WHEN average < 2 AND len(words) > 0 THEN 'words_too_short' END, CASE WHEN average > 15 THEN 'words_too_long' END,
      CASE WHEN sentence_score < 0.5 THEN 'poor_sentence_structure' END], lambda x: x IS NOT NULL) END AS reasons FROM s),
scored AS (SELECT *, quality_score >= 0.6 AND len(reasons) = 0 AS passed FROM q)
"""


def _documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *columns)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return quality.with_quality(spread(_documents(spark, d, "lang", "text")))


@query(
    _SCORED
    + r""", k AS (SELECT *, md5(trim(regexp_replace(lower(t), '[ \t\r\n\f\v]+', ' ', 'g'))) AS h FROM scored),
r AS (SELECT *, length(t) >= 50 AND row_number() OVER (PARTITION BY h ORDER BY doc_id) > 1 AS dup FROM k)
SELECT lang, count(*) AS documents, CAST(count(*) FILTER (passed) AS BIGINT) AS passed, CAST(count(*) FILTER (dup) AS BIGINT) AS duplicates, round(avg(quality_score), 6) AS avg_score FROM r GROUP BY lang"""
)
def slice0_quality_by_language(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators import dedup

    marked = dedup.mark_exact(_scored(spark, d), "text", "doc_id")
    return marked.groupBy("lang").agg(F.count("*").alias("documents"), F.count_if("passed").alias("passed"), F.count_if("is_duplicate").alias("duplicates"), F.round(F.avg("quality_score"), 6).alias("avg_score"))


@query(_SCORED + "SELECT doc_id, round(length_score, 6) AS length_score, round(special_char_score, 6) AS special_char_score, round(repetition_score, 6) AS repetition_score, round(sentence_score, 6) AS sentence_score FROM scored")
def q01_q04_part_scores(spark: SparkSession, d: str) -> DataFrame:
    parts = ("length_score", "special_char_score", "repetition_score", "sentence_score")
    return _scored(spark, d).select("doc_id", *[F.round(p, 6).alias(p) for p in parts])


@query(_SCORED + "SELECT doc_id, round(quality_score, 6) AS quality_score, passed, array_to_string(reasons, ',') AS reasons FROM scored")
def q05_quality_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", F.round("quality_score", 6).alias("quality_score"), "passed", F.array_join("reasons", ",").alias("reasons"))


@query(
    _SCORED
    + "SELECT count(*) AS total, CAST(count(*) FILTER (passed) AS BIGINT) AS passed, round(avg(passed::INT::DOUBLE), 6) AS pass_rate, round(avg(quality_score), 6) AS avg_score, round(min(quality_score), 6) AS min_score, round(max(quality_score), 6) AS max_score FROM scored"
)
def a07_quality_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_summary(_scored(spark, d))


@query(_SCORED + "SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM scored) GROUP BY reason")
def a07_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.reason_counts(_scored(spark, d))


@query(r"SELECT doc_id, regexp_replace(text, '<[^>]+>', '', 'g') AS out FROM documents")
def f03_strip_html(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d, tx.strip_html(F.col("text")).alias("out"))


@query(r"SELECT doc_id, regexp_replace(text, '(?i)https?://[A-Za-z0-9_.%-]+[^\s]*', '', 'g') AS out FROM documents")
def f05_remove_urls(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d, tx.remove_urls(F.col("text")).alias("out"))


@query(r"SELECT id, regexp_replace(text, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}', '[EMAIL]', 'g') AS out FROM dataset_entries")
def f06_mask_emails(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dataset_entries").select("id", tx.mask_emails(F.col("text")).alias("out"))


@query(f"SELECT doc_id, regexp_replace(text, '{tx.EMOJI}', '', 'g') AS out FROM documents")
def f07_remove_emojis(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d, tx.remove_emojis(F.col("text")).alias("out"))


_BOILER = r"(?im)^[ \t]*(?:" + "|".join(tx.BOILERPLATE_LINES) + r").*$"


@query(f"SELECT doc_id, regexp_replace(text, '{_BOILER}', '', 'g') AS out FROM documents")
def f08_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d, tx.remove_boilerplate(F.col("text")).alias("out"))


_WS = r"regexp_replace(regexp_replace(regexp_replace({0}, '(?m)^[ \t]+|[ \t]+$', '', 'g'), ' {{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
_PUNCT = "translate(regexp_replace(regexp_replace(regexp_replace({0}, '\\.{{4,}}', '...', 'g'), '!{{2,}}', '!', 'g'), '\\?{{2,}}', '?', 'g'), '„‚—–', '\"''--')"


@query(f"SELECT doc_id, {_WS.format('text')} AS out FROM documents")
def f09_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d, tx.normalize_whitespace(F.col("text")).alias("out"))


@query(f"SELECT doc_id, {_PUNCT.format('text')} AS out FROM documents")
def f10_punctuation(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d, tx.normalize_punctuation(F.col("text")).alias("out"))


_NATIVE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', '', 'g'), '(?i)https?://[A-Za-z0-9_.%-]+[^\s]*', '', 'g'), '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}', '[EMAIL]', 'g'), '" + _BOILER + "', '', 'g')"
_CLEAN = f"trim(regexp_replace({_PUNCT.format(_WS.format(_NATIVE))}, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g'))"


@query(f"SELECT doc_id, {_CLEAN} AS out FROM documents")
def f11_clean_native(spark: SparkSession, d: str) -> DataFrame:
    return spread(_documents(spark, d, "text")).select("doc_id", tx.clean(F.col("text")).alias("out"))


@query(
    f"""WITH c AS (SELECT doc_id, coalesce(text, '') AS o, {_CLEAN} AS c FROM documents)
SELECT doc_id, length(o) AS original_length, length(c) AS cleaned_length, round(1 - length(c) / greatest(1, length(o)), 6) AS reduction, len(regexp_extract_all(o, '\\n')) + 1 AS original_lines, len(regexp_extract_all(c, '\\n')) + 1 AS cleaned_lines FROM c"""
)
def f12_clean_stats(spark: SparkSession, d: str) -> DataFrame:
    both = _documents(spark, d, F.coalesce("text", F.lit("")).alias("o")).withColumn("c", tx.clean(F.col("o")))
    lines = lambda c: (F.regexp_count(c, F.lit("\n")) + 1).cast("long")
    return both.select(
        "doc_id",
        F.length("o").cast("long").alias("original_length"),
        F.length("c").cast("long").alias("cleaned_length"),
        F.round(1 - F.length("c") / F.greatest(F.lit(1), F.length("o")), 6).alias("reduction"),
        lines("o").alias("original_lines"),
        lines("c").alias("cleaned_lines"),
    )


@query(
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '={2,}[^=\n]+={2,}', '', 'g'), '\[\d+\]', '', 'g'), '\$[^$\n]+\$', '', 'g') AS out FROM documents"""
)
def f14_source_cleaners(spark: SparkSession, d: str) -> DataFrame:
    """Section headers and reference marks of encyclopedia pages, formulas of papers."""
    out = F.col("text")
    for pattern in (r"={2,}[^=\n]+={2,}", r"\[\d+\]", r"\$[^$\n]+\$"):
        out = F.regexp_replace(out, pattern, "")
    return _documents(spark, d, out.alias("out"))


@query(
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '={2,}[^=]+={2,}', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '\[\d+\]', '', 'g'), '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g') AS page,
CASE WHEN length(b) > 50000 THEN left(b, 50000) || '...' ELSE b END AS book FROM (SELECT doc_id, text,
  trim(regexp_replace(regexp_replace('x *** START OF THE PROJECT GUTENBERG EBOOK A' || chr(10) || text || chr(10) || '*** END OF THE PROJECT GUTENBERG EBOOK A', '(?s)^.*?\*\*\* ?START OF (?:THE|THIS) PROJECT GUTENBERG EBOOK[^\n]*\n', ''), '(?s)\*\*\* ?END OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*$', '')) AS b FROM documents)"""
)
def f14_pages_and_books(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned encyclopedia pages, and books inside the licence that stands around them."""
    framed = F.concat(F.lit("x *** START OF THE PROJECT GUTENBERG EBOOK A\n"), F.col("text"), F.lit("\n*** END OF THE PROJECT GUTENBERG EBOOK A"))
    return _documents(spark, d, parsers.wiki_text(F.col("text")).alias("page"), parsers.book_text(framed).alias("book"))


@query(
    rf"""SELECT doc_id, len(regexp_extract_all(lower(text), '{W}')) AS words, len(list_distinct(regexp_extract_all(lower(text), '{W}'))) AS distinct_words,
len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_replace(s, '[ \t\r\n]+', '', 'g') <> '')) AS sentences FROM documents WHERE text IS NOT NULL"""
)
def f15_words_and_sentences(spark: SparkSession, d: str) -> DataFrame:
    w = tx.words(F.col("text"))
    return _documents(spark, d, "text").where("text is not null").select("doc_id", F.size(w).cast("long").alias("words"), F.size(F.array_distinct(w)).cast("long").alias("distinct_words"), F.size(tx.sentences(F.col("text"))).cast("long").alias("sentences"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: w <> '')) AS words, length(text) // 4 AS tokens FROM documents WHERE text IS NOT NULL")
def f16_f17_counts(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d, "text").where("text is not null").select("doc_id", tx.whitespace_words(F.col("text")).cast("long").alias("words"), tx.approx_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, CASE WHEN length(text) > 400 THEN left(text, 397) || '...' ELSE text END AS out FROM documents")
def f18_truncate(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d, tx.truncate_tokens(F.col("text"), 100).alias("out"))


@query(
    """WITH c AS (SELECT doc_id, text, unnest(range(0, 1 + CAST(greatest(0, ceil((length(text) - 512) / 448)) AS BIGINT))) AS i FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, substring(text, i * 448 + 1, 512) AS chunk FROM c"""
)
def f19_fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks = F.posexplode(tx.fixed_chunks(F.col("text"), 128, 16)).alias("chunk_no", "chunk")
    return _documents(spark, d, "text").where("text is not null").select("doc_id", chunks)


def _template_sql(topic: str, key: str) -> str:
    """SQL of the template that formats.pick_template chooses."""
    quoted = lambda ts: "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in ts) + "]"
    cases = " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in formats.TOPIC_TEMPLATES.items())
    choice = f"(CASE {topic} {cases} ELSE {quoted(formats.DEFAULT_TEMPLATES)} END)"
    return f"list_extract({choice}, ((('0x' || substr(md5('0|' || {key}), 1, 8))::BIGINT % len({choice})) + 1)::INTEGER)"


def _instruction_sql(topic: str) -> str:
    return f"replace(replace({_template_sql(topic, 'id')}, '{{title}}', coalesce(title, {topic}, '')), '{{topic}}', coalesce({topic}, ''))"


@query(f"SELECT id, {_instruction_sql('topic')} AS instruction FROM dataset_entries")
def f20_j01_templates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dataset_entries").select("id", formats.fill_template(formats.pick_template(F.col("topic"), F.col("id"))).alias("instruction"))


@query()
def f17_exact_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each document by a public vocabulary; tests compare with the public library."""
    return _documents(spark, d, bpe.token_count(F.col("text")).alias("tokens"))


@query()
def f18_exact_truncate(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d, bpe.truncate(F.col("text"), 100).alias("out"))


@query(
    """WITH b AS (SELECT doc_id, CAST(length(text) AS BIGINT) * 977 AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.2f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.2f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.2f MB', n / 1048576.0) ELSE printf('%.2f GB', n / 1073741824.0) END AS size,
CASE WHEN n >= 86400 THEN concat(n // 86400, 'd ', n % 86400 // 3600, 'h ', n % 3600 // 60, 'm ', n % 60, 's') WHEN n >= 3600 THEN concat(n // 3600, 'h ', n % 3600 // 60, 'm ', n % 60, 's') WHEN n >= 60 THEN concat(n // 60, 'm ', n % 60, 's') ELSE concat(n, 's') END AS lasted FROM b"""
)
def f21_number_formats(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text").cast("long") * 977
    return _documents(spark, d, "text").where("text is not null").select("doc_id", tx.human_bytes(n).alias("size"), tx.elapsed(n).alias("lasted"))


@query(
    r"""SELECT doc_id, array_to_string(list_filter([
CASE WHEN regexp_matches(text, '(?i)</?(?:html|body|div|p|span|a|script|table|br)\b[^>]*>') THEN 'html' END,
CASE WHEN regexp_matches(text, '[^\p{L}\p{N}_\s]{4,}') THEN 'punctuation_run' END,
CASE WHEN len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]')) / greatest(1, length(text)) > 0.01 THEN 'control_chars' END,
CASE WHEN starts_with(text, chr(65533)) OR ends_with(text, chr(65533)) THEN 'replacement_edge' END,
CASE WHEN contains(regexp_replace(text, '(?s)^.|.$', '', 'g'), chr(65533)) THEN 'replacement_mid' END], lambda x: x IS NOT NULL), ',') AS flags FROM documents WHERE text IS NOT NULL"""
)
def f22_text_flags(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d, "text").where("text is not null").select("doc_id", F.array_join(tx.text_flags(F.col("text")), ",").alias("flags"))


@query("SELECT doc_id, 'https://wiki.example/' || replace(topic, ' ', '_') AS page, concat_ws(chr(10) || chr(10), topic, text) AS body FROM documents WHERE topic IS NOT NULL")
def f24_titles_and_bodies(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d, "topic", "text").where("topic is not null").select("doc_id", F.concat(F.lit("https://wiki.example/"), F.replace("topic", F.lit(" "), F.lit("_"))).alias("page"), F.concat_ws("\n\n", "topic", "text").alias("body"))
