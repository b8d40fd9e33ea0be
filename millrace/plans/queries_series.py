"""Queries on token streams, sampling, telemetry series and numeric vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import dates
from millrace.functions import text as tx
from millrace.operators import sampling, telemetry, tokens, vectors
from millrace.plans.registry import query
from millrace.session import table
from millrace.sources import acquire

_TOK = r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM w),
tok AS (SELECT doc_id, pos, (('0x' || substr(md5(word), 1, 4))::INT % 50257)::INT AS token_id FROM x)
"""


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.hashed_tokens(table(spark, d, "documents").select("doc_id", "text"))


@query(_TOK + "SELECT token_id, count(*) AS n FROM tok GROUP BY token_id")
def a10_token_histogram(spark: SparkSession, d: str) -> DataFrame:
    return tokens.histogram(_tokens(spark, d))


_AUDIT = (
    _TOK
    + """, h AS (SELECT token_id, count(*) AS n FROM tok GROUP BY token_id), l AS (SELECT *, lag(token_id) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM tok),
m AS (SELECT count(*) AS total, min(token_id) AS least, max(token_id) AS most, round(avg(token_id), 6) AS mean, round(stddev_pop(token_id), 4) AS std, CAST(count(*) FILTER (token_id < 0) AS BIGINT) AS negative, CAST(count(*) FILTER (token_id >= 50257) AS BIGINT) AS beyond, CAST(count(*) FILTER (token_id = p) AS BIGINT) AS repeated FROM l),
s AS (SELECT count(*) AS distinct_tokens, sum(n) AS t, max(n) AS top, sum(n * log2(n)) AS nlogn FROM h),
a AS (SELECT total, least, most, mean, std, negative, beyond, repeated, distinct_tokens, round(log2(t) - nlogn / t, 6) AS entropy_bits, round(distinct_tokens / total, 6) AS diversity, round(top / total, 6) AS dominant_ratio, round(repeated / (total - 1), 8) AS repetition_ratio FROM m, s)
"""
)


@query(_AUDIT + "SELECT * FROM a")
def a11_a13_w10_p11_token_audit(spark: SparkSession, d: str) -> DataFrame:
    return tokens.audit(_tokens(spark, d))


@query(_AUDIT + "SELECT total, CASE WHEN negative > 0 OR beyond > 0 OR total = 0 THEN 'FAIL' WHEN dominant_ratio > 0.1 OR repetition_ratio > 0.01 OR entropy_bits < 6 THEN 'PASS WITH MINOR WARNINGS' ELSE 'PASS' END AS verdict FROM a")
def a18_audit_verdict(spark: SparkSession, d: str) -> DataFrame:
    return tokens.verdict(tokens.audit(_tokens(spark, d))).select("total", "verdict")


@query(_TOK + ", h AS (SELECT token_id, count(*) AS n FROM tok GROUP BY token_id HAVING count(*) < 10) SELECT n AS occurrences, count(*) AS rare_tokens FROM h GROUP BY n")
def a14_rare_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.histogram(_tokens(spark, d)).where("n < 10").groupBy(F.col("n").alias("occurrences")).agg(F.count("*").alias("rare_tokens"))


@query(_TOK + ", h AS (SELECT token_id, count(*) AS n FROM tok GROUP BY token_id), t AS (SELECT * FROM h ORDER BY n DESC, token_id LIMIT 50) SELECT token_id, n FROM t WHERE n / (SELECT sum(n) FROM h) >= 0.01")
def a15_o01_suspicious_tokens(spark: SparkSession, d: str) -> DataFrame:
    counts = tokens.histogram(_tokens(spark, d))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.orderBy(F.desc("n"), "token_id").limit(50).crossJoin(F.broadcast(total)).where(F.col("n") / F.col("total") >= 0.01).select("token_id", "n")


@query(_TOK + "SELECT count(DISTINCT token_id) AS distinct_tokens FROM tok")
def a16_distinct_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).agg(F.count_distinct("token_id").alias("distinct_tokens"))


@query(
    _TOK
    + """, b AS (SELECT *, CASE WHEN token_id = lag(token_id) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS s FROM tok), r AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM b)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS start_pos, any_value(token_id) AS token_id, count(*) AS length FROM r GROUP BY doc_id, run HAVING count(*) >= 3"""
)
def w09_token_runs(spark: SparkSession, d: str) -> DataFrame:
    return tokens.runs(_tokens(spark, d), least=3)


_OFFSETS = r"WITH n AS (SELECT doc_id, length(coalesce(text, '')) // 4 AS n FROM documents), o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM n) "


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.approx_tokens(F.coalesce("text", F.lit(""))).alias("n"))


@query(_OFFSETS + "SELECT doc_id, n, off AS \"offset\" FROM o")
def w15_k09_running_offsets(spark: SparkSession, d: str) -> DataFrame:
    return sampling.running_offsets(_lengths(spark, d), "doc_id", "n").select("doc_id", "n", F.col("offset").cast("long").alias("offset"))


@query(
    _OFFSETS
    + ", b AS (SELECT doc_id, n, off, unnest(range(off // 2048, (off + n - 1) // 2048 + 1)) AS block FROM o WHERE n > 0) SELECT doc_id, block, greatest(off, block * 2048) AS from_pos, least(off + n, (block + 1) * 2048) AS to_pos FROM b"
)
def m10_m11_stream_blocks(spark: SparkSession, d: str) -> DataFrame:
    return tokens.blocks(_lengths(spark, d), 2048)


@query("WITH n AS (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, unnest(range(0, 1 + greatest(0, ceil((n - 512) / 256))::BIGINT)) * 256 AS begin FROM n")
def w16_strided_windows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(sampling.windows_of(F.length("text").cast("long"), 512, 256).cast("array<bigint>")).alias("begin"))


@query("WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS p, count(*) OVER () AS n FROM lineitem) SELECT CASE WHEN p >= n - floor(n * 0.005) THEN 'validation' ELSE 'train' END AS split, count(*) AS rows FROM r GROUP BY 1")
def m07_contiguous_split(spark: SparkSession, d: str) -> DataFrame:
    """Only the positions matter: rows are counted by order key, so no task holds the whole stream."""
    per_key = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    placed = sampling.running_offsets(per_key, "l_orderkey", "n")
    total = per_key.agg(F.sum("n").alias("total"))
    cut = F.col("total") - F.floor(F.col("total") * 0.005)
    validation = F.greatest(F.lit(0), F.least(F.col("n"), F.col("offset") + F.col("n") - cut))
    both = placed.crossJoin(F.broadcast(total)).agg(F.sum(validation).alias("v"), F.max("total").alias("t"))
    return both.select(F.explode(F.array(F.struct(F.lit("train").alias("split"), (F.col("t") - F.col("v")).cast("long").alias("rows")), F.struct(F.lit("validation").alias("split"), F.col("v").cast("long").alias("rows")))).alias("s")).select("s.*")


_U = "(('0x' || substr(md5('0|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query(f"SELECT doc_id, CASE WHEN {_U} < 0.9 THEN 'train' WHEN {_U} < 0.9::DOUBLE + 0.05::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM documents")
def m05_m06_hash_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.split_by_hash(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("SELECT doc_id FROM documents ORDER BY md5('0|' || doc_id), doc_id LIMIT 100")
def m01_m13_sample(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").orderBy(sampling.hash_order(F.col("doc_id")), "doc_id").limit(100)


@query(
    f"""WITH s AS (SELECT name, greatest(coalesce(weight, 0), 0) * greatest(coalesce(repeat, 1), 0) AS w FROM source_configs WHERE stage = 'final'),
c AS (SELECT name, w, coalesce(sum(w) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(w) OVER () AS lo FROM s WHERE w > 0), d AS (SELECT doc_id, {_U} AS u FROM documents)
SELECT doc_id, max_by(name, lo) AS name FROM d JOIN c ON u >= lo GROUP BY doc_id"""
)
def m03_m04_weighted_choice(spark: SparkSession, d: str) -> DataFrame:
    draws = table(spark, d, "documents").select("doc_id", sampling.hash_unit(F.col("doc_id")).alias("u"))
    return sampling.weighted_choice(draws, table(spark, d, "source_configs").where("stage = 'final'")).select("doc_id", "name")


@query("SELECT stage, name, coalesce(max_tokens, 1000000000)::BIGINT AS capped, coalesce(max_tokens, 1000000000) > 2049 AS usable FROM source_configs")
def m08_source_caps(spark: SparkSession, d: str) -> DataFrame:
    capped = F.least(F.coalesce("max_tokens", F.lit(10**9)), F.lit(10**9)).cast("long")
    return table(spark, d, "source_configs").select("stage", "name", capped.alias("capped"), (capped > 2049).alias("usable"))


@query(
    """WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: round(x * 100)::INT) AS v FROM embeddings),
s AS (SELECT vec_id, v[11:31] AS w FROM t WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id, v[51:71] FROM t WHERE vec_id % 2 = 1)
SELECT vec_id, array_to_string(list_concat(w[1:20], list_transform(range(20 - len(w[1:20])), lambda i: 0)), ',') AS input_ids, array_to_string(list_concat(w[2:], list_transform(range(20 - len(w[2:])), lambda i: -100)), ',') AS labels FROM s"""
)
def m09_shifted_samples(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform("embedding", lambda x: F.round(x.cast("double") * 100).cast("int"))
    start = F.when(F.col("vec_id") % 2 == 0, 10).otherwise(50)
    inputs, labels = sampling.shifted_sample(v, start, 20)
    return table(spark, d, "embeddings").select("vec_id", F.array_join(inputs.cast("array<string>"), ",").alias("input_ids"), F.array_join(labels.cast("array<string>"), ",").alias("labels"))


@query("SELECT stage, greatest(1, target_tokens // 2048) AS epoch_length FROM stage_configs")
def m12_epoch_lengths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stage_configs").select("stage", F.greatest(F.lit(1), F.expr("target_tokens div 2048")).alias("epoch_length"))


@query("WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, source FROM documents WHERE source IS NOT NULL) SELECT source, (rn - 1) // 8 AS batch, min(doc_id) AS first_doc, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS documents FROM r WHERE rn <= 40 GROUP BY ALL HAVING count(*) = 8")
def m14_fixed_batches(spark: SparkSession, d: str) -> DataFrame:
    numbered = sampling.round_robin(table(spark, d, "documents").where("source is not null").select("doc_id", "source"), "source", "doc_id").where("turn <= 40")
    return numbered.groupBy("source", F.floor((F.col("turn") - 1) / 8).alias("batch")).agg(F.min("doc_id").alias("first_doc"), F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("documents"), F.count("*").alias("n")).where("n = 8").drop("n")


@query("SELECT stage, name, round(100 * w / sum(w) OVER (PARTITION BY stage), 4) AS percent FROM (SELECT stage, name, greatest(coalesce(weight, 0), 0) * greatest(coalesce(repeat, 1), 0) AS w FROM source_configs) WHERE w > 0")
def a26_effective_mix(spark: SparkSession, d: str) -> DataFrame:
    w = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)) * F.greatest(F.coalesce("repeat", F.lit(1.0)), F.lit(0.0))
    positive = table(spark, d, "source_configs").select("stage", "name", w.alias("w")).where("w > 0")
    return positive.select("stage", "name", F.round(100 * F.col("w") / F.sum("w").over(Window.partitionBy("stage")), 4).alias("percent"))


@query("SELECT source_dataset, CAST(sum(token_count) FILTER (token_count > 0) AS BIGINT) AS tokens, count(DISTINCT record_id) AS records FROM shard_records GROUP BY ROLLUP (source_dataset)")
def a25_token_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "shard_records").rollup("source_dataset").agg(F.sum(F.when(F.col("token_count") > 0, F.col("token_count"))).alias("tokens"), F.count_distinct("record_id").alias("records"))


@query("SELECT source_dataset, round(sum(edu_int_score * token_count) / greatest(1, sum(token_count)), 6) AS weighted, coalesce(array_to_string(list_sort(list(DISTINCT subset) FILTER (subset IS NOT NULL)), ','), '') AS subsets FROM shard_records WHERE token_count > 0 AND edu_int_score IS NOT NULL GROUP BY source_dataset")
def a04_a05_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "shard_records").where("token_count > 0 and edu_int_score is not null")
    return rows.groupBy("source_dataset").agg(F.round(F.sum(F.col("edu_int_score") * F.col("token_count")) / F.greatest(F.lit(1), F.sum("token_count")), 6).alias("weighted"), F.array_join(F.array_sort(F.collect_set("subset")), ",").alias("subsets"))


@query("WITH k AS (SELECT unnest(coalesce(meta.topics, [])) AS topic FROM instruction_rows) SELECT topic, count(*) AS n FROM k GROUP BY topic")
def a06_t17_map_sum(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "instruction_rows").select(F.explode("meta.topics").alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT length(coalesce(text, '')) // 4 AS n FROM documents) SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS tokens, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most, CAST(count(*) FILTER (n BETWEEN 50 AND 4096) AS BIGINT) AS valid FROM t")
def a09_token_stats(spark: SparkSession, d: str) -> DataFrame:
    return _lengths(spark, d).agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), F.count_if(F.col("n").between(50, 4096)).alias("valid"))


@query(
    """WITH t AS (SELECT coalesce(text, '') AS t, lang FROM documents) SELECT count(*) AS sample, CAST(count(*) FILTER (t = '') AS BIGINT) AS empty, CAST(count(*) FILTER (length(t) < 50) AS BIGINT) AS short, CAST(count(*) FILTER (lang IS NULL) AS BIGINT) AS unlabelled,
CASE WHEN 100.0 * (count(*) FILTER (length(t) < 50) + count(*) FILTER (lang IS NULL)) / count(*) < 5 THEN 'EXCELLENT' WHEN 100.0 * (count(*) FILTER (length(t) < 50) + count(*) FILTER (lang IS NULL)) / count(*) < 15 THEN 'GOOD' WHEN 100.0 * (count(*) FILTER (length(t) < 50) + count(*) FILTER (lang IS NULL)) / count(*) < 30 THEN 'FAIR' ELSE 'POOR' END AS grade FROM t"""
)
def a28_validation_grade(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    sums = table(spark, d, "documents").agg(F.count("*").alias("sample"), F.count_if(t == "").alias("empty"), F.count_if(F.length(t) < 50).alias("short"), F.count_if(F.col("lang").isNull()).alias("unlabelled"))
    rate = 100 * (F.col("short") + F.col("unlabelled")) / F.col("sample")
    return sums.withColumn("grade", F.when(rate < 5, "EXCELLENT").when(rate < 15, "GOOD").when(rate < 30, "FAIR").otherwise("POOR"))


# Series: events by type, in order of time; the value stands for a loss.
_O = "PARTITION BY event_type ORDER BY ts, event_id"
_SER = f"WITH s AS (SELECT event_id, event_type, ts, value, row_number() OVER ({_O}) AS pos FROM events) "
RUN, ORDER = "event_type", ["ts", "event_id"]


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "event_type", "ts", "value")


@query(
    _SER
    + f"""SELECT event_id, n, round(coalesce(mean, 0), 8) AS mean, round(CASE WHEN n >= 2 THEN std ELSE 0 END, 4) AS std, round(CASE WHEN n >= 2 THEN hi - lo ELSE 0 END, 4) AS variation, round(CASE WHEN n >= 3 THEN slope ELSE 0 END, 4) AS trend
FROM (SELECT event_id, count(value) OVER f AS n, avg(value) OVER f AS mean, stddev_samp(value) OVER f AS std, max(value) OVER f AS hi, min(value) OVER f AS lo, regr_slope(value, pos) OVER f AS slope FROM s WINDOW f AS ({_O} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"""
)
def w01_w03_rolling(spark: SparkSession, d: str) -> DataFrame:
    r = telemetry.rolling(_events(spark, d), "value", RUN, ORDER, 50)
    return r.select("event_id", "n", F.round("mean", 8).alias("mean"), *[F.round(c, 4).alias(c) for c in ("std", "variation", "trend")])


@query(f"SELECT event_id, round(avg((value >= 0.95 * 200)::INT::DOUBLE) OVER ({_O} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS clip_frequency FROM events")
def w04_clip_frequency(spark: SparkSession, d: str) -> DataFrame:
    clipped = (F.col("value") >= 0.95 * 200).cast("double")
    return _events(spark, d).select("event_id", F.round(F.avg(clipped).over(telemetry.frame(RUN, ORDER, 100)), 6).alias("clip_frequency"))


@query(
    f"WITH b AS (SELECT *, sum((value < 100)::INT) OVER ({_O}) AS breaks FROM events) SELECT event_id, CAST(sum((value >= 100)::INT) OVER (PARTITION BY event_type, breaks ORDER BY ts, event_id) AS BIGINT) AS run_length FROM b"
)
def w05_consecutive(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.consecutive(_events(spark, d), F.col("value") >= 100, RUN, ORDER, "run_length").select("event_id", "run_length")


@query()
def w05_stagnation(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.stagnation(_events(spark, d), "value", RUN, "event_id")


@query(
    f"""WITH b AS (SELECT *, min(value) OVER ({_O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM events), g AS (SELECT *, sum((NOT value > best + 0.001)::INT) OVER ({_O}) AS breaks FROM b)
SELECT event_id, best, value > best + 0.001 AS diverged, CAST(sum((value > best + 0.001)::INT) OVER (PARTITION BY event_type, breaks ORDER BY ts, event_id) AS BIGINT) AS diverged_for FROM g"""
)
def w06_divergence(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.divergence(_events(spark, d), "value", RUN, ORDER).select("event_id", "best", "diverged", "diverged_for")


@query(f"SELECT event_id, round(value / lag(value) OVER ({_O}) - 1, 6) AS change FROM events QUALIFY value / lag(value) OVER ({_O}) - 1 > 0.5")
def w07_spikes(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("value").over(Window.partitionBy(RUN).orderBy(*ORDER))
    change = telemetry.ratio(F.col("value"), F.col("before")) - 1
    return _events(spark, d).withColumn("before", before).withColumn("change", change).where("change > 0.5").select("event_id", F.round("change", 6).alias("change"))


@query(f"SELECT event_id FROM (SELECT event_id, max(value) OVER f - min(value) OVER f AS r, count(*) OVER f AS n FROM events WINDOW f AS ({_O} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) WHERE n = 10 AND r < 60")
def w08_plateau(spark: SparkSession, d: str) -> DataFrame:
    over = telemetry.frame(RUN, ORDER, 10)
    return _events(spark, d).withColumn("r", F.max("value").over(over) - F.min("value").over(over)).withColumn("n", F.count("*").over(over)).where("n = 10 and r < 60").select("event_id")


@query("WITH s AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), c AS (SELECT * FROM s WHERE b IS NULL OR b <> event_type) SELECT event_id, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM c")
def w11_timeline(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.timeline(table(spark, d, "events"), "event_type", "user_id", ["ts", "event_id"]).select("event_id", "event_type", "until")


@query(f"SELECT event_id, lag(value) OVER ({_O}) AS previous, first_value(value) OVER ({_O}) AS first FROM events")
def w13_previous(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy(RUN).orderBy(*ORDER)
    return _events(spark, d).select("event_id", F.lag("value").over(w).alias("previous"), F.first("value").over(w).alias("first"))


@query(
    f"""SELECT event_id, coalesce(b > 3 * greatest(a, 0.01), false) AS oscillating, coalesce(value > 5 * med, false) AS spike FROM (SELECT event_id, value, stddev_samp(value) OVER ({_O} ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING) AS a, stddev_samp(value) OVER ({_O} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS b, median(value) OVER ({_O} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS med FROM events)"""
)
def w14_a27_oscillation(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy(RUN).orderBy(*ORDER)
    measured = _events(spark, d).withColumns({"a": F.stddev_samp("value").over(w.rowsBetween(-19, -10)), "b": F.stddev_samp("value").over(w.rowsBetween(-9, 0)), "v": F.array_sort(F.collect_list("value").over(w.rowsBetween(-19, 0)))})
    n = F.size("v")
    median = (F.get("v", F.floor((n - 1) / 2).cast("int")) + F.get("v", F.floor(n / 2).cast("int"))) / 2
    return measured.select("event_id", F.coalesce(F.col("b") > 3 * F.greatest("a", F.lit(0.01)), F.lit(False)).alias("oscillating"), F.coalesce(F.col("value") > 5 * median, F.lit(False)).alias("spike"))


@query("WITH v AS (SELECT event_type, list(value ORDER BY event_id) AS v FROM events GROUP BY event_type) SELECT event_type, round(list_reduce(v, lambda a, x: a * 0.9 + x * 0.1), 6) AS average FROM v")
def w17_exponential_average(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.exponential_average(_events(spark, d), "value", RUN, "event_id").select(RUN, F.round("average", 6).alias("average"))


_PHASE = "CASE WHEN pos < 500 THEN 'a' WHEN pos < 1000 THEN 'b' WHEN pos < 1500 THEN 'c' ELSE 'd' END"


@query(_SER + f"SELECT event_type, {_PHASE} AS phase, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(stddev_samp(value), 6) AS std FROM s GROUP BY ALL")
def a20_phases(spark: SparkSession, d: str) -> DataFrame:
    s = _events(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy(RUN).orderBy(*ORDER)))
    phase = F.when(F.col("pos") < 500, "a").when(F.col("pos") < 1000, "b").when(F.col("pos") < 1500, "c").otherwise("d")
    return s.groupBy(RUN, phase.alias("phase")).agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.stddev_samp("value"), 6).alias("std"))


@query(
    _SER
    + """, n AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n FROM s) SELECT event_type, round(avg(value) FILTER (pos <= 10), 6) AS head, round(avg(value) FILTER (pos > n - 100), 6) AS tail, min(value) AS least, max(value) AS most, min_by(event_id, {'v': value, 'e': event_id}) AS best_step,
CASE WHEN abs(avg(value) FILTER (pos > n - 100) / avg(value) FILTER (pos <= 100) - 1) < 0.01 THEN 'STAGNANT' WHEN avg(value) FILTER (pos > n - 100) < avg(value) FILTER (pos <= 100) THEN 'IMPROVING' ELSE 'DEGRADING' END AS verdict FROM n GROUP BY event_type"""
)
def a19_a21_loss_summary(spark: SparkSession, d: str) -> DataFrame:
    s = _events(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy(RUN).orderBy(*ORDER))).withColumn("n", F.count("*").over(Window.partitionBy(RUN)))
    part = lambda c: F.avg(F.when(c, F.col("value")))
    first, last = part(F.col("pos") <= 100), part(F.col("pos") > F.col("n") - 100)
    verdict = F.when(F.abs(last / first - 1) < 0.01, "STAGNANT").when(last < first, "IMPROVING").otherwise("DEGRADING")
    return s.groupBy(RUN).agg(F.round(part(F.col("pos") <= 10), 6).alias("head"), F.round(last, 6).alias("tail"), F.min("value").alias("least"), F.max("value").alias("most"), F.min_by("event_id", F.struct("value", "event_id")).alias("best_step"), verdict.alias("verdict"))


@query(
    _SER
    + "SELECT event_type, round(avg(value) FILTER (pos < 500), 6) AS before, round(avg(value) FILTER (pos BETWEEN 901 AND 1000), 6) AS at_1000, round(avg(value) FILTER (pos BETWEEN 1401 AND 1500), 6) AS at_1500, round(100 * (1 - avg(value) FILTER (pos BETWEEN 901 AND 1000) / avg(value) FILTER (pos < 500)), 4) AS improvement FROM s GROUP BY event_type"
)
def a22_recovery(spark: SparkSession, d: str) -> DataFrame:
    s = _events(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy(RUN).orderBy(*ORDER)))
    part = lambda a, b: F.avg(F.when(F.col("pos").between(a, b), F.col("value")))
    return s.groupBy(RUN).agg(F.round(part(1, 499), 6).alias("before"), F.round(part(901, 1000), 6).alias("at_1000"), F.round(part(1401, 1500), 6).alias("at_1500"), F.round(100 * (1 - part(901, 1000) / part(1, 499)), 4).alias("improvement"))


@query("SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted_loss, round(avg(l_tax), 6) AS aux FROM lineitem GROUP BY l_suppkey")
def a23_weighted_loss(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("weighted_loss"), F.round(F.avg("l_tax"), 6).alias("aux"))


@query("SELECT event_type, max_by(value, {'t': ts, 'e': event_id}) AS last_value, min_by(value, {'t': ts, 'e': event_id}) AS first_value, min(value) AS best, round(epoch(max(ts)) - epoch(min(ts)), 3) AS elapsed, count(*) AS steps FROM events GROUP BY event_type")
def a24_t08_status(spark: SparkSession, d: str) -> DataFrame:
    when = F.struct("ts", "event_id")
    seconds = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return _events(spark, d).groupBy(RUN).agg(F.max_by("value", when).alias("last_value"), F.min_by("value", when).alias("first_value"), F.min("value").alias("best"), F.round(seconds, 3).alias("elapsed"), F.count("*").alias("steps"))


@query("SELECT (event_id // 100)::BIGINT AS bucket, round(avg(value), 6) AS mean, round(sum(value), 4) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def a31_t10_buckets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.expr("event_id div 100").alias("bucket")).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value"), 4).alias("total"), F.count_distinct("user_id").alias("users"))


# Runs by user, of different loss, noise, gradients and learning rates, with an evaluation at every seventh event.
_STEPS = """WITH e AS (SELECT event_id, ts, value, user_id % 20 AS run, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS pos FROM events WHERE value IS NOT NULL),
s AS (SELECT event_id, ts, run, pos, 2::DOUBLE + value * (run % 4) / 2000 - CASE WHEN run % 3 = 0 THEN pos / 10000 ELSE 0 END AS loss, 0.2::DOUBLE + (run % 5) * 0.2::DOUBLE + value / 1000 AS grad,
  0.0003::DOUBLE + CASE WHEN run % 2 = 0 THEN 0 ELSE value / 1000000 END AS lr, CASE WHEN event_id % 7 = 0 THEN 2::DOUBLE + value * (run % 6) / 20000 END AS val_loss FROM e)
"""


def _regime_sql(scaled: bool) -> str:
    clip = "WHEN clipped_run >= 5 THEN 'PLATEAU_RUIDOSO_COM_CLIPPING' WHEN pos >= 25 AND clip_share >= 0.8 THEN 'PLATEAU_RUIDOSO_COM_CLIPPING'" if scaled else ""
    persistent = "WHEN persistent AND NOT falling THEN 'PLATEAU_RUIDOSO_COM_CLIPPING'" if scaled else ""
    last = "WHEN persistent THEN 'PLATEAU_RUIDOSO_COM_CLIPPING'" if scaled else ""
    frame = lambda n: f"(PARTITION BY run ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return (
        _STEPS
        + f""", c AS (SELECT *, (grad >= 0.95 * 1.0)::INT AS clipped, val_loss IS NOT NULL AS ev FROM s),
b AS (SELECT *, sum(1 - clipped) OVER (PARTITION BY run ORDER BY ts, event_id) AS breaks,
  CASE WHEN ev AND loss < lag(loss) OVER (PARTITION BY run, ev ORDER BY ts, event_id) AND val_loss > lag(val_loss) OVER (PARTITION BY run, ev ORDER BY ts, event_id) THEN 1 ELSE 0 END AS parted FROM c),
v AS (SELECT *, sum(clipped) OVER (PARTITION BY run, breaks ORDER BY ts, event_id) AS clipped_run,
  CASE WHEN ev THEN row_number() OVER w END AS n0, CASE WHEN ev THEN max(val_loss) OVER p - min(val_loss) OVER p END AS r0, CASE WHEN ev THEN coalesce(stddev_samp(val_loss) OVER p, 0) END AS s0, CASE WHEN ev THEN sum(parted) OVER o >= 4 END AS o0
  FROM b WINDOW w AS (PARTITION BY run, ev ORDER BY ts, event_id), p AS (PARTITION BY run, ev ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), o AS (PARTITION BY run, ev ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
m AS (SELECT *, last_value(n0 IGNORE NULLS) OVER u AS evals, last_value(r0 IGNORE NULLS) OVER u AS val_range, last_value(s0 IGNORE NULLS) OVER u AS val_std, last_value(o0 IGNORE NULLS) OVER u AS over,
  coalesce(stddev_samp(loss) OVER f50, 0) / greatest(avg(loss) OVER f50, 1e-6) AS cv, coalesce(stddev_samp(grad) OVER f50, 0) AS gstd, avg(clipped) OVER f50 AS clip_share, avg(clipped) OVER f100 AS wide,
  CASE WHEN count(*) OVER f30 >= 3 THEN regr_slope(loss, pos) OVER f30 ELSE 0 END AS trend, avg(loss) OVER f30 AS tmean, coalesce(stddev_samp(loss) OVER f30, 0) AS tstd,
  max(lr) OVER f10 - min(lr) OVER f10 AS lr_range, max(loss) OVER f20 - min(loss) OVER f20 AS loss_range
  FROM v WINDOW u AS (PARTITION BY run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f10 AS {frame(10)}, f20 AS {frame(20)}, f30 AS {frame(30)}, f50 AS {frame(50)}, f100 AS {frame(100)}),
x AS (SELECT *, trend < 0 AND (tmean <= 1e-6 OR -trend / tmean >= 0.1 * greatest(tstd / tmean, 1e-6)) AS falling, pos >= 50 AND wide >= 0.7 AS persistent FROM m)
SELECT event_id, CASE WHEN pos < 10 THEN 'HEALTHY_LEARNING' {clip} WHEN cv > 0.3 OR gstd > {3.0 if scaled else 2.0} THEN 'UNSTABLE_EXPLORATION' {persistent}
  WHEN evals >= 5 AND over {"AND NOT persistent" if scaled else ""} THEN 'LATE_OVERFITTING' WHEN evals >= 3 AND val_range < 0.02 AND val_std < 0.01 THEN 'REAL_PLATEAU' WHEN evals >= 3 AND val_range < 0.02 THEN 'NOISY_PLATEAU'
  WHEN lr_range < 1e-6 AND loss_range < 0.05 THEN 'CONVERGENCE' {last} ELSE 'HEALTHY_LEARNING' END AS regime FROM x"""
    )


def _regimes(spark: SparkSession, d: str, scaled: bool) -> DataFrame:
    run, v = F.col("user_id") % 20, F.col("value")
    placed = table(spark, d, "events").where("value is not null").select("event_id", "ts", "value", run.alias("run")).withColumn("place", F.row_number().over(Window.partitionBy("run").orderBy(*ORDER)))
    run = F.col("run")
    steps = placed.select(
        "event_id",
        "ts",
        "run",
        (F.lit(2.0) + v * (run % 4) / 2000 - F.when(run % 3 == 0, F.col("place") / 10000).otherwise(F.lit(0.0))).alias("loss"),
        (F.lit(0.2) + (run % 5) * 0.2 + v / 1000).alias("grad"),
        (F.lit(0.0003) + F.when(run % 2 == 0, F.lit(0.0)).otherwise(v / 1000000)).alias("lr"),
        F.when(F.col("event_id") % 7 == 0, F.lit(2.0) + v * (run % 6) / 20000).alias("val_loss"),
    )
    return telemetry.classify(steps, "run", ORDER, "loss", "grad", 1.0, scaled=scaled).select("event_id", "regime")


@query(_regime_sql(False))
def x03_regimes(spark: SparkSession, d: str) -> DataFrame:
    return _regimes(spark, d, False)


@query(_regime_sql(True))
def x04_regimes(spark: SparkSession, d: str) -> DataFrame:
    return _regimes(spark, d, True)


@query(
    """SELECT event_id, CASE WHEN length(event_type || ' ' || coalesce(props, '')) < 10 THEN 'justification_too_short' WHEN event_type = 'click' AND abs(value * 0.9 - value) / greatest(abs(value), 1e-12) > 0.2 THEN 'change_too_large' WHEN event_type = 'click' AND (value * 0.9 < 1 OR value * 0.9 > 100) THEN 'out_of_bounds'
WHEN event_type = 'view' AND value * 0.9 > 2 THEN 'clip_too_high' WHEN event_type = 'error' AND (value * 0.9 < 0 OR value * 0.9 > 0.1) THEN 'dropout_out_of_bounds' ELSE 'valid' END AS verdict FROM events"""
)
def x06_validate_decisions(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "lr").when(F.col("event_type") == "view", "grad_clip").when(F.col("event_type") == "error", "dropout").otherwise("none")
    why = F.concat_ws(" ", "event_type", F.coalesce("props", F.lit("")))
    return table(spark, d, "events").select("event_id", telemetry.validate_decision(kind, F.col("value"), F.col("value") * 0.9, why, F.lit(False), 1.0, 100.0).alias("verdict"))


@query(
    """WITH s AS (SELECT unnest(range(0, 20000, 50)) AS step) SELECT step, round(CASE WHEN step < 1000 THEN 0.0003::DOUBLE * step / 1000 ELSE 0.00003::DOUBLE + 0.5 * 0.00027::DOUBLE * (1 + cos(pi() * least(1.0, (step - 1000) / 14000.0::DOUBLE))) END, 12) AS cosine,
round(CASE WHEN step < 1000 THEN 0.0003::DOUBLE * step / 1000 WHEN step < 10800 THEN 0.0003::DOUBLE ELSE 0.00003::DOUBLE + 0.5 * 0.00027::DOUBLE * (1 + cos(pi() * least(1.0, (step - 10800) / 4200.0::DOUBLE))) END, 12) AS wsd FROM s"""
)
def t09_schedules(spark: SparkSession, d: str) -> DataFrame:
    step = F.col("id")
    return spark.range(0, 20000, 50).select(step.alias("step"), F.round(dates.cosine_schedule(step, 1000, 15000, 3e-4, 3e-5), 12).alias("cosine"), F.round(dates.wsd_schedule(step, 1000, 15000, 3e-4, 3e-5), 12).alias("wsd"))


@query("WITH l AS (SELECT event_type, max(ts) AS last, max(event_id) AS step FROM events GROUP BY event_type) SELECT event_type, CASE WHEN step >= 1000000 THEN 'completed' WHEN epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(last) < 300 THEN 'running' WHEN epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(last) < 1800 THEN 'paused' ELSE 'stopped' END AS state FROM l")
def t07_training_state(spark: SparkSession, d: str) -> DataFrame:
    last = _events(spark, d).groupBy(RUN).agg(F.max("ts").alias("last"), F.max("event_id").alias("step"))
    age = (F.unix_micros(F.lit("2024-01-31 00:00:00").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 1e6
    return last.select(RUN, F.when(F.col("step") >= 1_000_000, "completed").when(age < 300, "running").when(age < 1800, "paused").otherwise("stopped").alias("state"))


# Vectors: embeddings stand for logits and weights.
_V = "WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings), r AS (SELECT vec_id, unnest(e) AS v, generate_subscripts(e, 1) - 1 AS i FROM x), s AS (SELECT *, exp(v - max(v) OVER (PARTITION BY vec_id)) AS z FROM r), p AS (SELECT vec_id, i, v, z / sum(z) OVER (PARTITION BY vec_id) AS p FROM s) "


def _probabilities(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators import vectors

    return vectors.softmax(table(spark, d, "embeddings"), "vec_id", "embedding")


@query(_V + "SELECT vec_id, round(max(p), 8) AS top_p, arg_max(i, p)::INTEGER AS top_i, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY vec_id")
def n01_softmax(spark: SparkSession, d: str) -> DataFrame:
    return _probabilities(spark, d).groupBy("vec_id").agg(F.round(F.max("p"), 8).alias("top_p"), F.max_by("i", "p").alias("top_i"), F.round(-F.sum(F.col("p") * F.log("p")), 6).alias("entropy"))


@query(_V + ", k AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY p DESC) AS r FROM p) SELECT vec_id, count(*) AS kept, round(sum(p), 6) AS mass FROM k WHERE r <= 5 GROUP BY vec_id")
def n02_top_k(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators import vectors

    return vectors.top_k(_probabilities(spark, d), "vec_id", 5).groupBy("vec_id").agg(F.count("*").alias("kept"), F.round(F.sum("p"), 6).alias("mass"))


@query(_V + ", k AS (SELECT *, max(p) OVER (PARTITION BY vec_id) AS m FROM p) SELECT vec_id, count(*) AS kept FROM k WHERE p >= 0.9 * m GROUP BY vec_id")
def n03_min_p(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators import vectors

    return vectors.min_p(_probabilities(spark, d), "vec_id", 0.9).groupBy("vec_id").agg(F.count("*").alias("kept"))


@query(_V + ", k AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, i) - p AS before FROM p) SELECT vec_id, count(*) AS kept, round(max(p) / sum(p), 6) AS top FROM k WHERE before <= 0.5 GROUP BY vec_id")
def n04_w12_top_p(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators import vectors

    return vectors.top_p(_probabilities(spark, d), "vec_id", 0.5).groupBy("vec_id").agg(F.count("*").alias("kept"), F.round(F.max("p") / F.sum("p"), 6).alias("top"))


@query(_V + "SELECT vec_id, i::INTEGER AS i, round(CASE WHEN i % 7 = 0 THEN CASE WHEN v > 0 THEN v / 1.2 ELSE v * 1.2 END - 0.1 * (i % 3 + 1) - 0.05 ELSE v END, 6) AS penalised FROM p")
def n05_penalties(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators import vectors

    count = F.when(F.col("i") % 7 == 0, F.col("i") % 3 + 1).otherwise(0)
    return _probabilities(spark, d).select("vec_id", "i", F.round(vectors.penalise(F.col("v"), count, 1.2, 0.1, 0.05), 6).alias("penalised"))


@query("SELECT doc_id, CASE WHEN strpos(text, '. ') > 0 THEN left(text, strpos(text, '. ') - 1) ELSE text END AS out FROM documents")
def n06_stop_string(spark: SparkSession, d: str) -> DataFrame:
    at = F.locate(". ", F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.when(at > 0, F.left("text", at - 1)).otherwise(F.col("text")).alias("out"))


@query("WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings), s AS (SELECT vec_id, e, greatest(list_avg(list_transform(e, lambda v: abs(v))), 1e-5) AS scale FROM x) SELECT vec_id, round(scale, 8) AS scale, array_to_string(list_transform(e, lambda v: round_even(greatest(-1.0, least(1.0, v / scale)), 0)::INT), ',') AS ternary FROM s")
def n07_ternary(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators import vectors

    e = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, d, "embeddings").withColumn("e", e).select("vec_id", F.round(vectors.ternary_scale(F.col("e")), 8).alias("scale"), F.array_join(vectors.ternary(F.col("e")).cast("array<string>"), ",").alias("ternary"))


@query(_V + ", k AS (SELECT *, i % 8 AS expert, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS r FROM p) SELECT expert::INTEGER AS expert, CAST(count(*) FILTER (r <= 2) AS BIGINT) AS routed, round(avg(p), 8) AS mean_p FROM k GROUP BY expert")
def n08_router_load(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators import vectors

    return vectors.router_load(_probabilities(spark, d), "vec_id", 8, 2)


@query("WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings) SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda v: v * v)) / len(e) + 1e-6), 6) AS rms, round(list_sum(list_transform(e, lambda v: v * v)), 6) AS squares FROM x")
def n09_rms_norm(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators import vectors

    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.rms(F.col("embedding")), 6).alias("rms"), F.round(vectors.squares(F.col("embedding")), 6).alias("squares"))


@query(
    """WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT label, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS least, round(max(v), 6) AS most, round(avg((abs(v) < 0.05)::INT::DOUBLE), 6) AS near_zero, round(sqrt(sum(v * v)), 4) AS norm FROM x GROUP BY label"""
)
def a29_a32_n10_weight_stats(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    return table(spark, d, "embeddings").select("label", F.explode(F.col("embedding").cast("array<double>")).alias("v")).groupBy("label").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("std"), F.round(F.min(v), 6).alias("least"), F.round(F.max(v), 6).alias("most"), F.round(F.avg((F.abs(v) < 0.05).cast("double")), 6).alias("near_zero"), F.round(F.sqrt(F.sum(v * v)), 4).alias("norm"))


@query(
    "SELECT user_id, round(CASE WHEN sum(value) / sum(n) < 100 THEN exp(sum(value) / sum(n)) ELSE 'inf'::DOUBLE END, 6) AS perplexity FROM (SELECT user_id, value, 1 + event_id % 97 AS n FROM events) GROUP BY user_id"
)
def n11_perplexity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.round(telemetry.perplexity(F.col("value"), 1 + F.col("event_id") % 97), 6).alias("perplexity"))


@query(_SER + "SELECT event_type, round(avg(value), 6) AS mean_time, round(1000 / avg(value), 6) AS per_second, count(*) AS rounds FROM s WHERE pos > 3 GROUP BY event_type")
def n12_benchmark(spark: SparkSession, d: str) -> DataFrame:
    s = _events(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy(RUN).orderBy(*ORDER))).where("pos > 3")
    return s.groupBy(RUN).agg(F.round(F.avg("value"), 6).alias("mean_time"), F.round(1000 / F.avg("value"), 6).alias("per_second"), F.count("*").alias("rounds"))


_CONFIGS = "SELECT stage, start_step::BIGINT AS step, target_tokens::DOUBLE / 20 AS params, 12 AS layers, 768 AS width, 2 AS batch, 2048 AS len, CASE WHEN end_step IS NULL THEN 0 WHEN start_step % 5000 = 0 THEN target_tokens END AS stored FROM stage_configs"


@query(
    f"""SELECT stage, CASE WHEN coalesce(stored, 0) <> 0 THEN stored ELSE step * batch * 8 * len END AS tokens_trained, round(params * 4 / 1e9, 2) AS params_gb, round(params * 8 / 1e9, 2) AS optim_gb, round(layers * batch * len * width * 2 / 1e9, 2) AS activations_gb,
round((params * 16 + layers * batch * len * width * 2) / 1e9, 2) AS total_gb FROM ({_CONFIGS})"""
)
def n13_memory(spark: SparkSession, d: str) -> DataFrame:
    """Training memory and trained tokens of model configurations, here one a stage."""
    stored = F.when(F.col("end_step").isNull(), F.lit(0).cast("long")).when(F.col("start_step") % 5000 == 0, F.col("target_tokens"))
    memory = telemetry.memory_gigabytes(F.col("target_tokens").cast("double") / 20, F.lit(12), F.lit(768), F.lit(2), F.lit(2048))
    rows = table(spark, d, "stage_configs").select("stage", telemetry.trained_tokens(stored, F.col("start_step"), F.lit(2), F.lit(8), F.lit(2048)).alias("tokens_trained"), memory.alias("m"))
    return rows.select("stage", "tokens_trained", "m.params_gb", "m.optim_gb", "m.activations_gb", "m.total_gb")


@query("WITH c AS (SELECT source_dataset, count(*) AS n FROM shard_records GROUP BY source_dataset), s AS (SELECT *, unnest(range(0, (n + 999) // 1000)) AS shard FROM c) SELECT source_dataset, shard, least(1000, n - shard * 1000) AS records FROM s")
def k06_shard_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of shards of at most 1000 records a source: every full one and the rest."""
    counts = table(spark, d, "shard_records").groupBy("source_dataset").agg(F.count("*").alias("n"))
    return sampling.shard_manifest(counts, "source_dataset", "n", 1000)


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 >= count(*) OVER () - floor(count(*) OVER () * 0.005) THEN 'validation' ELSE 'train' END AS split FROM lineitem"
)
def m07_split_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every row with its part: positions of order keys by ranges, then of the few rows inside a key."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    per_key = rows.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    placed = sampling.running_offsets(per_key, "l_orderkey", "n").crossJoin(F.broadcast(per_key.agg(F.sum("n").alias("total"))))
    inside = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    numbered = rows.withColumn("place", inside).join(placed.select("l_orderkey", "offset", "total"), "l_orderkey")
    return numbered.select("l_orderkey", "l_linenumber", tokens.split_position(F.col("offset") + F.col("place") - 1, F.col("total")).alias("split"))


@query(f"SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) > 3 AND row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) > 1")
def k14_retention(spark: SparkSession, d: str) -> DataFrame:
    """What to delete: all but the last three and the best of each run."""
    latest = F.row_number().over(Window.partitionBy(RUN).orderBy(F.desc("ts"), F.desc("event_id")))
    best = F.row_number().over(Window.partitionBy(RUN).orderBy("value", "event_id"))
    return _events(spark, d).withColumn("a", latest).withColumn("b", best).where("a > 3 and b > 1").select("event_id", "event_type")


@query("SELECT doc_id FROM documents WHERE source = 'books' AND text IS NOT NULL")
def s07_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The first source of a chain that opens and has text: one that is missing, one that is empty, one without text, books."""
    documents = table(spark, d, "documents")
    chain = [
        (3, "no_text", lambda: documents.where("text is null").select("doc_id", "text")),
        (1, "missing", lambda: table(spark, d, "no_such_table")),
        (2, "empty", lambda: documents.where("source = 'no such source'")),
        (4, "books", lambda: documents.where("source = 'books' and text is not null").orderBy(F.desc(F.length("text")))),
        (5, "news", lambda: documents.where("source = 'news'")),
    ]
    return acquire.first_usable(chain)[1].select("doc_id")


@query("SELECT 'pt' AS lang, 'books' AS source, count(*) AS documents FROM documents WHERE source = 'books' AND text IS NOT NULL UNION ALL SELECT 'en', 'news', count(*) FROM documents WHERE source = 'news' AND text IS NOT NULL")
def s08_bilingual(spark: SparkSession, d: str) -> DataFrame:
    of = lambda source: lambda: table(spark, d, "documents").where(F.col("source") == source).where("text is not null").orderBy(F.desc(F.length("text")))
    both = acquire.bilingual({"pt": [(1, "missing", lambda: table(spark, d, "no_such_table")), (2, "books", of("books"))], "en": [(1, "news", of("news"))]})
    return both.groupBy("lang", "source").agg(F.count("*").alias("documents"))


@query("SELECT arg_min(o_orderkey, {'v': o_totalprice, 'k': o_orderkey}) AS best_key, min(o_totalprice) AS best_value FROM orders WHERE o_totalprice IS NOT NULL AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def s16_best_existing(spark: SparkSession, d: str) -> DataFrame:
    """The least value among entries that have a file; orders and their large items stand for sidecars and files."""
    files = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return acquire.best_existing(table(spark, d, "orders"), files, "o_orderkey", "o_totalprice")


@query("SELECT y AS year, t AS topic, t || ' ' || y AS query, p * 50 AS offset FROM range(2020, 2024) a(y), (VALUES ('juros'), ('saude')) b(t), range(20) c(p)")
def s19_search_plan(spark: SparkSession, d: str) -> DataFrame:
    return acquire.search_plan(spark, [2020, 2021, 2022, 2023], ["juros", "saude"])


@query("SELECT id FROM dataset_entries WHERE year(published_date) BETWEEN 2021 AND 2022")
def s18_year_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dataset_entries").where(acquire.in_years(F.col("published_date"), 2021, 2022)).select("id")


_CAT = "CASE WHEN label % 3 = 0 THEN 'embedding' WHEN label % 3 = 1 THEN 'linear' ELSE 'other' END"


@query(
    f"""WITH t AS (SELECT {_CAT} AS category, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), e AS (SELECT category, list_avg(list_transform(v, lambda x: abs(x))) AS magnitude, list_stddev_samp(v) AS std, list_min(v) AS least, list_max(v) AS most, list_dot_product(v, v) AS squares FROM t)
SELECT category, count(*) AS tensors, round(avg(magnitude), 6) AS magnitude, round(avg(std), 6) AS std, round(avg(least), 6) AS least, round(avg(most), 6) AS most, round(sqrt(sum(squares)), 4) AS norm, 0 AS nan_tensors, 0 AS inf_tensors FROM e GROUP BY category"""
)
def a32_n10_tensor_categories(spark: SparkSession, d: str) -> DataFrame:
    """Each vector stands for a tensor, its label for the layer in the tensor's name."""
    name = F.element_at(F.array(F.lit("model.embedding.weight"), F.lit("layers.0.in_proj.weight"), F.lit("head.bias")), (F.col("label") % 3 + 1).cast("int"))
    tensors = table(spark, d, "embeddings").select(name.alias("name"), F.col("embedding").cast("array<double>").alias("values"))
    found = vectors.tensor_categories(tensors, "name", "values", {"embedding": r"embedding|lm_head", "linear": r"in_proj|out_proj"})
    return found.select("category", "tensors", *[F.round(c, 6).alias(c) for c in ("magnitude", "std", "least", "most")], F.round("norm", 4).alias("norm"), "nan_tensors", "inf_tensors")


@query(
    """WITH t AS (SELECT doc_id, 1 + len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS n FROM documents WHERE length(regexp_replace(text, '^[ \\t\\n\\v\\f\\r]+|[ \\t\\n\\v\\f\\r]+$', '', 'g')) >= 10),
o AS (SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id) - n AS off FROM t) SELECT doc_id, n, CAST(off AS BIGINT) AS "offset" FROM o"""
)
def m11_end_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Places of documents in a stream with an end token after each; texts under ten characters are left out."""
    words = F.transform(tx.words(F.col("text")), lambda w: F.lit(1))
    stream = tokens.concatenated(table(spark, d, "documents"), words)
    return sampling.running_offsets(stream.select("doc_id", "n"), "doc_id", "n").select("doc_id", "n", F.col("offset").cast("long").alias("offset"))


@query(_TOK + "SELECT count(*) AS n, CAST(sum(token_id) AS BIGINT) AS checksum FROM tok WHERE pos < 50")
def s10_capped_scan(spark: SparkSession, d: str) -> DataFrame:
    """The quick mode of the audit reads a fixed number of positions: here the limit is the feature."""
    return _tokens(spark, d).where("pos < 50").agg(F.count("*").alias("n"), F.sum("token_id").alias("checksum"))


@query("SELECT event_id, round(coalesce(value, 0), 6) AS norm, round(value - 1.0, 6) AS delta, CASE WHEN value <= 1 THEN value * 100 ELSE value END AS percent FROM events")
def p19_p21_gradient_series(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").where("value is not null").select("event_id", F.round(F.coalesce(v, F.lit(0.0)), 6).alias("norm"), F.round(v - 1.0, 6).alias("delta"), F.when(v <= 1, v * 100).otherwise(v).alias("percent"))


@query("SELECT user_id, coalesce(max_by(value, {'t': ts, 'e': event_id}) FILTER (event_type = 'click'), 1.0) AS parameter FROM events GROUP BY user_id")
def p20_latest_parameter(spark: SparkSession, d: str) -> DataFrame:
    latest = F.max_by(F.when(F.col("event_type") == "click", F.col("value")), F.when(F.col("event_type") == "click", F.struct("ts", "event_id")))
    return table(spark, d, "events").groupBy("user_id").agg(F.coalesce(latest, F.lit(1.0)).alias("parameter"))
