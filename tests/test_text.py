import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import dates, udfs
from millrace.functions import text as tx
from millrace.operators import dedup, formats, guardrails, quality, sampling, telemetry, tokens, vectors


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string' if isinstance(v, str) or v is None else 'long'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()[0]


def test_cleaning(spark):
    t = F.col("t")
    assert "Hello world" in one(spark, tx.clean(t), t="<p>Hello <b>world</b></p>")
    out = one(spark, tx.clean(t), t="Hello    world\n\n\n\ntest")
    assert "    " not in out and "\n\n\n" not in out
    assert "[EMAIL]" in one(spark, tx.clean(t), t="Contact test@example.com for info")
    assert "Leia" not in one(spark, tx.clean(t), t="Main content here.\nLeia também: outro artigo\nMore content.")
    assert one(spark, tx.clean(t), t=None) == ""
    assert one(spark, tx.clean(t), t="") == ""


def test_python_steps(spark):
    assert udfs.repair_mojibake("crÃ©dito") == "crédito"
    assert udfs.repair_mojibake("São Paulo") == "São Paulo"
    assert one(spark, udfs.nfkc(F.col("t")), t="ﬁm ①") == "fim 1"
    assert one(spark, udfs.unescape(F.col("t")), t="a &amp; b") == "a & b"
    assert one(spark, udfs.html_to_text(F.col("t")), t="<div>Hi<br>there</div><script>x()</script>") == "Hi there"
    assert udfs.mask_matches("Email: teste@teste.com e CPF: 111.222.333-44", guardrails.PII_PATTERNS).count("[") == 2
    chunks = udfs.sentence_chunks("One two three. " * 40, 20, 5)
    assert "".join(c[:1] for c in chunks) and chunks[-1].endswith(". ")
    with pytest.raises(ValueError):
        udfs.sentence_chunks("x" * 100, 5, 5)


def test_numbers(spark):
    assert one(spark, tx.human_bytes(F.col("n")), n=1536) == "1.50 KB"
    assert one(spark, tx.elapsed(F.col("n")), n=90061) == "1d 1h 1m 1s"
    assert one(spark, tx.elapsed(F.col("n")), n=5) == "5s"


def test_quality(spark):
    rows = [(1, ""), (2, "Short text."), (3, "word " * 100), (4, None), (5, "a b\n\n" * 5000)]
    got = {r.id: r for r in quality.with_quality(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert got[1].reasons == ["empty_text"] and got[4].reasons == ["empty_text"]
    assert "too_short" in got[2].reasons
    assert not got[3].passed
    small = quality.with_quality(spark.createDataFrame(rows, "id int, text string"), max_tokens=10).where("id = 3").first()
    assert "too_long" in small.reasons
    assert quality.with_quality(spark.createDataFrame([], "id int, text string")).count() == 0


def test_guardrails(spark):
    t = F.col("t")
    assert one(spark, guardrails.content_reasons(t), t="Ganhe dinheiro rápido! Clique aqui para http://spam.com") == ["contains_spam"]
    assert one(spark, guardrails.content_reasons(t), t=None) == []
    assert one(spark, guardrails.content_confidence(t), t="") == 1.0
    counts = guardrails.pii_counts(t)
    assert one(spark, counts["cpf"], t="123.456.789-00") == 1
    assert one(spark, counts["cnpj"], t="12.345.678/0001-90") == 1
    assert one(spark, counts["cep"], t="01310-100") == 1
    for bad in ("This is a strong buy now", "Pump it up", "Price target of $500", "I hate everyone"):
        assert not one(spark, guardrails.blacklist_passes(t), t=bad)
    assert one(spark, guardrails.blacklist_passes(t), t="A pumpkin")
    assert one(spark, guardrails.topics(t), t="Bitcoin is a blockchain technology.") == ["crypto_assets"]
    assert one(spark, guardrails.entities(t), t="The United States and Apple Inc are huge.") == ["Apple Inc", "United States"]
    df = guardrails.detect_language(spark.createDataFrame([("Este texto é em português e não está em inglês, que isso",), ("short",), (None,)], "text string"))
    assert [r.detected_lang for r in df.collect()] == ["pt", "unknown", "unknown"]


def test_exact_duplicates(spark):
    long = "The same sentence with more than fifty characters in it."
    rows = [(1, long), (2, long.upper().replace(" ", "   ")), (3, "tiny"), (4, "tiny"), (5, None), (6, "")]
    got = {r.id: r.is_duplicate for r in dedup.mark_exact(spark.createDataFrame(rows, "id int, text string"), "text", "id").collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: False, 6: False}
    strict = dedup.mark_first(spark.createDataFrame(rows, "id int, text string"), dedup.strict_key(F.col("text")), "id")
    assert {r.id for r in strict.where("is_duplicate").collect()} == {2, 4, 6}


def test_similar_texts(spark):
    base = "A long enough sentence about the reading of meters in a rural town, with many words to compare."
    rows = [(1, base), (2, base + "!"), (3, "Something else entirely that shares no run of five characters, or nearly none of them."), (4, None)]
    got = dedup.similar_texts(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect()
    assert [(r.id_a, r.id_b) for r in got] == [(1, 2)]


def test_formats(spark):
    m = formats.alpaca_messages(F.col("i"), F.col("g"), F.col("o"))
    got = one(spark, m, i="Ask", g="Data", o="Say")
    assert [r.role for r in got] == ["system", "user", "assistant"] and got[1].content == "Ask\n\nContexto: Data"
    assert one(spark, m, i="Ask", g="", o="Say")[1].content == "Ask"
    df = spark.sql("SELECT array(named_struct('from', 'human', 'value', 'a'), named_struct('from', 'tool', 'value', 'b'), named_struct('from', 'gpt', 'value', 'c')) AS c")
    assert [r.role for r in df.select(formats.sharegpt_messages(F.col("c"))).first()[0]] == ["system", "user", "assistant"]
    swapped = formats.with_topic_prompt(m, F.lit("saude"))
    assert one(spark, swapped, i="Ask", g="", o="Say")[0].content == formats.TOPIC_SYSTEM["saude"]
    assert "<|im_start|>user\nAsk<|im_end|>" in one(spark, formats.render_chat(m), i="Ask", g="", o="Say")


def test_dates(spark):
    for raw, day in [("2024-03-05T10:00:00Z", "2024-03-05"), ("Sex, 23 Jan 2026 19:57:23 -0300", "2026-01-23"), ("05/03/2024", "2024-03-05"), ("10 de março de 2023", "2023-03-10"), ("rubbish", None), (None, None), ("", None)]:
        got = one(spark, F.date_format(dates.parse_date(F.col("t")), "yyyy-MM-dd"), t=raw)
        assert got == day, raw
    assert one(spark, dates.iso_duration_seconds(F.col("t")), t="PT1H2M3S") == 3723
    assert one(spark, dates.iso_duration_seconds(F.col("t")), t="none") == 0


def test_sampling(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    parts = sampling.split_by_hash(df, "doc_id").groupBy("split").count().collect()
    assert sum(r["count"] for r in parts) == 1000 and {r["split"] for r in parts} == {"train", "validation", "test"}
    sized = df.withColumn("n", F.col("doc_id") % 7)
    got = [r.offset for r in sampling.running_offsets(sized, "doc_id", "n").orderBy("doc_id").collect()]
    want, at = [], 0
    for i in range(1000):
        want.append(at)
        at += i % 7
    assert got == want
    blocks = tokens.blocks(sized, 100).collect()
    assert sum(b.to_pos - b.from_pos for b in blocks) == at
    stages = spark.createDataFrame([("a", 0, 10), ("b", 10, None)], "stage string, start_step int, end_step int")
    steps = sampling.resolve_stage(spark.createDataFrame([(0,), (9,), (10,), (99,)], "step int"), stages)
    assert [r.stage for r in steps.collect()] == ["a", "a", "b", "b"]
    x, y = sampling.shifted_sample(F.array(*map(F.lit, range(5))), F.lit(2), 4)
    row = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert row.x == [2, 3, 4, 0] and row.y == [3, 4, -100, -100]


def test_tokens(spark):
    df = spark.createDataFrame([(1, "a a a b"), (2, None), (3, "")], "doc_id int, text string")
    stream = tokens.hashed_tokens(df)
    assert stream.count() == 4
    audited = tokens.verdict(tokens.audit(stream)).first()
    assert audited.total == 4 and audited.distinct_tokens == 2 and audited.repeated == 2
    run = tokens.runs(stream, least=3).collect()
    assert len(run) == 1 and run[0].length == 3 and run[0].start_pos == 0


def test_telemetry(spark):
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate([1.0, 0.5, 0.49, 0.48, 0.3])], "run string, step int, v double")
    assert [r.counter for r in telemetry.stagnation(df, "v", "run", "step").orderBy("step").collect()] == [0, 0, 1, 2, 0]
    assert [r.n for r in telemetry.consecutive(df, F.col("v") < 0.5, "run", ["step"], "n").orderBy("step").collect()] == [0, 0, 1, 2, 3]
    rolled = telemetry.rolling(df, "v", "run", ["step"], 2).orderBy("step").collect()
    assert rolled[0]["std"] == 0.0 and abs(rolled[1]["mean"] - 0.75) < 1e-9
    average = telemetry.exponential_average(df, "v", "run", "step").first().average
    want = 1.0
    for v in [0.5, 0.49, 0.48, 0.3]:
        want = 0.9 * want + 0.1 * v
    assert abs(average - want) < 1e-12


def test_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0, 2.0, 2.0])], "k int, e array<double>")
    p = vectors.softmax(df, "k", "e")
    assert abs(p.agg(F.sum("p")).first()[0] - 1) < 1e-12
    assert vectors.top_k(p, "k", 1).count() == 2
    assert vectors.top_p(p, "k", 0.5).count() == 2
    assert df.select(vectors.ternary(F.col("e")).alias("t")).first().t == [0, 1, 1, 1]
    assert isinstance(pd.DataFrame(p.collect()), pd.DataFrame)
