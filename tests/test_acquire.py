"""Acquisition, parsers of landed answers, stores, resumed hooks, regimes and exact tokens on small cases."""

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import bpe
from millrace.operators import formats, guardrails, telemetry, tokens, vectors
from millrace.sources import acquire, parsers, readers, sinks
from millrace.streaming import hooks


def test_first_usable(spark):
    good = spark.createDataFrame([("long enough text",)], "content string")
    chain = [(1, "broken", lambda: spark.read.parquet("/no/such/place")), (2, "short", lambda: spark.createDataFrame([("short",)], "text string")), (3, "good", lambda: good), (4, "later", lambda: good)]
    name, df, refused = acquire.first_usable(chain)
    assert name == "good" and df.first().text == "long enough text" and [r[0] for r in refused] == ["broken", "short"]
    assert acquire.first_usable(chain[:2])[:2] == (None, None)
    assert acquire.bilingual({"pt": chain, "en": chain[:1]}).collect() == [("pt", "good", "long enough text")]


def test_retries_and_bucket():
    calls, pauses = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise OSError("not yet")
        return "done"

    assert acquire.with_retries(call, 5, 0.5, pauses.append) == "done" and pauses == [0.5, 1.0, 2.0]
    with pytest.raises(OSError):
        acquire.with_retries(lambda: (_ for _ in ()).throw(OSError()), 2, 0.0, pauses.append)
    assert acquire.refill(1.0, 3.0, 2.0, 5.0) == 5.0 and acquire.refill(1.0, 1.0, 2.0, 5.0) == 3.0


def test_pages(spark, tmp_path):
    for p in range(5):
        (tmp_path / f"page-{p:05d}.json").write_text(json.dumps([{"id": f"{p}-{i}", "text": f"t{i}"} for i in range(p)]))
    acquire.register(spark)
    rows = spark.read.format("millrace_pages").option("path", str(tmp_path)).option("pages", 5).option("pagesPerTask", 2).load().collect()
    assert sorted(r.id for r in rows) == sorted(f"{p}-{i}" for p in range(5) for i in range(p))


def test_catalogs(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"sources": {"news": {"enabled": True, "feeds": ["x"]}, "books": {"enabled": False}}}))
    rows = {r.name: r.attributes for r in acquire.catalog(spark, str(tmp_path / "a.json"), "sources").collect()}
    assert rows == {"news": {"enabled": "true", "feeds": '["x"]'}, "books": {"enabled": "false"}}
    pytest.importorskip("yaml")
    (tmp_path / "b.yaml").write_text("stages:\n- name: one\n  weight: 0.5\n- name: two\n")
    assert {r.name for r in acquire.catalog(spark, str(tmp_path / "b.yaml"), "stages").collect()} == {"one", "two"}
    assert acquire.catalog(spark, str(tmp_path / "b.yaml"), "none").count() == 0


def test_best_checkpoint(spark, tmp_path):
    for step, loss, there in ((1, 2.0, True), (2, 1.0, False), (3, 1.5, True), (4, None, True)):
        (tmp_path / f"step_{step}.json").write_text(json.dumps({"val_ce_loss": loss}))
        if there:
            (tmp_path / f"step_{step}.pt").write_bytes(b"x")
    (tmp_path / "step_5.json").write_text("not json")
    (tmp_path / "step_5.pt").write_bytes(b"x")
    assert acquire.best_checkpoint(spark, str(tmp_path)).collect() == [("step_3", 1.5)]


def test_landed_answers(spark):
    news = json.dumps({"articles": [{"title": "a", "url": "u", "content": "c", "description": "d"}, {"title": "b", "url": "v", "content": "", "description": "d"}, {"title": "n", "url": "w", "content": None, "description": None}]})
    assert sorted((r.title, r.text) for r in parsers.news_articles(spark.createDataFrame([(news,), (None,), ("{",)], "json string")).collect()) == [("a", "c"), ("b", "d")]
    body = "== Head ==\nText[1] " + "words of a page " * 20 + "\n\n\n\nend"
    wiki = json.dumps({"query": {"pages": {"1": {"pageid": 1, "title": "P", "extract": body}, "2": {"pageid": 2, "title": "S", "extract": "short"}}}})
    rows = parsers.wiki_pages(spark.createDataFrame([(wiki,), (wiki,)], "json string")).collect()
    assert len(rows) == 1 and "[1]" not in rows[0].text and "Head" not in rows[0].text and "\n\n\n" not in rows[0].text


def test_token_chunks_and_ranges(spark, tmp_path):
    df = spark.createDataFrame([(i, list(range(i, i + 7))) for i in range(10)], "doc_id int, ids array<int>")
    manifest = sinks.write_tokens(df, str(tmp_path / "t"), chunk=10)
    assert manifest.agg(F.sum("tokens")).first()[0] == 80 and manifest.agg(F.max("tokens")).first()[0] <= 10
    cells = spark.read.parquet(str(tmp_path / "t")).orderBy("part", "chunk").collect()
    flat = np.concatenate([np.frombuffer(c.content, np.uint32) for c in cells])
    assert flat.tolist() == [t for i in range(10) for t in [*range(i, i + 7), 50256]]
    (tmp_path / "raw").mkdir()
    np.arange(1000, dtype=np.uint16).tofile(tmp_path / "raw" / "tokens.bin")
    (tmp_path / "raw" / "empty.bin").write_bytes(b"")
    rows = readers.token_store(spark, str(tmp_path / "raw"), most_bytes=64).collect()
    assert sorted((r.pos, r.token_id) for r in rows) == [(i, i) for i in range(1000)]


def test_reports_and_state(spark, tmp_path):
    df = spark.range(10).withColumn("text", F.lit("x"))
    assert sinks.write_with_report(df, str(tmp_path / "out"), str(tmp_path / "report"), even=F.col("id") % 2 == 0) == {"rows": 10, "even": 5}
    assert spark.read.json(str(tmp_path / "report")).first().even == 5 and spark.read.json(str(tmp_path / "out")).count() == 10
    at = lambda page, day: spark.createDataFrame([("news", "t", page, None, None, pd.Timestamp(day).to_pydatetime(), None)], sinks.STATE)
    sinks.save_state(at(1, "2024-01-01"), str(tmp_path / "state"))
    sinks.save_state(at(2, "2024-01-02"), str(tmp_path / "state"))
    assert [r.last_page for r in sinks.load_state(spark, str(tmp_path / "state")).collect()] == [2]


def test_resumed_evals_equal_the_whole(spark):
    rng = np.random.default_rng(1)
    rows = [(f"r{r}", i, float(3 - 0.02 * i + rng.normal(0, 0.05))) for r in range(3) for i in range(30)]
    schema = "run_id string, step long, val_loss double"
    whole = hooks.on_eval_batch(spark.createDataFrame(rows, schema))
    state = spark.createDataFrame([], "run_id string, " + hooks.EVAL_STATE)
    got = []
    for low, high in ((0, 4), (4, 5), (5, 5), (5, 30)):
        part = spark.createDataFrame([r for r in rows if low <= r[1] < high and not (r[0] == "r2" and r[1] < 5)], schema)
        out, state = hooks.resume_evals(part, state)
        got += [tuple(r) for r in out.collect()]
    expected = [tuple(r) for r in whole.where("run_id <> 'r2'").collect()]
    assert sorted(r for r in got if r[0] != "r2") == sorted(expected)
    assert {r.run_id for r in state.collect()} == {"r0", "r1", "r2"}


def _regime(rows, clip, scaled):
    """The regime after the last of rows (loss, grad, lr, val_loss or None), from plain lists."""
    losses, grads, lrs = ([r[i] for r in rows] for i in range(3))
    evals = [(r[0], r[3]) for r in rows if r[3] is not None]
    flags = [g >= 0.95 * clip for g in grads]
    sd = lambda v: float(np.std(v, ddof=1)) if len(v) > 1 else 0.0
    if len(rows) < 10:
        return "HEALTHY_LEARNING"
    tail = losses[-30:]
    slope = float(np.polyfit(range(len(tail)), tail, 1)[0])
    falling = slope < 0 and abs(slope) / np.mean(tail) >= 0.1 * max(sd(tail) / np.mean(tail), 1e-6)
    persistent = len(rows) >= 50 and np.mean(flags[-100:]) >= 0.7
    noisy = "PLATEAU_RUIDOSO_COM_CLIPPING"
    if scaled and (all(flags[-5:]) or len(rows) >= 25 and np.mean(flags[-50:]) >= 0.8):
        return noisy
    if sd(losses[-50:]) / np.mean(losses[-50:]) > 0.3 or sd(grads[-50:]) > (3.0 if scaled else 2.0):
        return "UNSTABLE_EXPLORATION"
    if scaled and persistent and not falling:
        return noisy
    last = evals[-5:]
    if len(last) == 5 and all(b[0] < a[0] and b[1] > a[1] for a, b in zip(last, last[1:])) and not (scaled and persistent):
        return "LATE_OVERFITTING"
    if len(evals) >= 3 and max(v for _, v in evals[-3:]) - min(v for _, v in evals[-3:]) < 0.02:
        return "REAL_PLATEAU" if sd([v for _, v in evals[-3:]]) < 0.01 else "NOISY_PLATEAU"
    if max(lrs[-10:]) - min(lrs[-10:]) < 1e-6 and max(losses[-20:]) - min(losses[-20:]) < 0.05:
        return "CONVERGENCE"
    return noisy if scaled and persistent else "HEALTHY_LEARNING"


@pytest.mark.parametrize("scaled", [False, True])
def test_regimes_equal_plain_lists(spark, scaled):
    rng = np.random.default_rng(8)
    series = {}
    for run in range(10):
        rows = []
        for i in range(130):
            fall, noise = (0.0, 0.004, 0.01)[run % 3], (0.001, 0.2, 2.5)[run // 4]
            evaluated = i % 4 == 0
            val = 2.0 + (0.02 * i if run % 5 == 0 else 0.001 * rng.random() if run % 5 == 1 else rng.random() * 0.02 if run % 5 == 2 else -0.03 * i)
            rows.append((3.0 - fall * i + abs(rng.normal(0, noise)), (0.5, 1.0, 0.93)[run % 3] + rng.random() * 0.1 * (1 + 60 * (run == 7)), 1e-3 if run % 2 else 1e-3 + rng.random() * 1e-3, float(val) if evaluated else None))
        series[run] = rows
    flat = [(run, i, *r) for run, rows in series.items() for i, r in enumerate(rows)]
    df = spark.createDataFrame(flat, "run int, step int, loss double, grad double, lr double, val_loss double")
    got = {(r.run, r.step): r.regime for r in telemetry.classify(df, "run", ["step"], "loss", "grad", 1.0, scaled=scaled).collect()}
    want = {(run, i): _regime(rows[: i + 1], 1.0, scaled) for run, rows in series.items() for i in range(len(rows))}
    assert got == want
    assert len(set(want.values())) >= 5 and "LATE_OVERFITTING" in set(want.values()) and "UNSTABLE_EXPLORATION" in set(want.values())


def test_decision_filter(spark):
    log = spark.createDataFrame([(1, "plateau", None), (2, None, ("LR_cut",)), (3, None, None), (9, "plateau", ("x",))], "step int, policy string, action struct<type:string>")
    assert [r.step for r in telemetry.filter_decisions(log, "plateau", 1, 5).collect()] == [1]
    assert [r.step for r in telemetry.filter_decisions(log, "Lr_Cut").collect()] == [2]
    assert telemetry.filter_decisions(log, "all").count() == 4


def test_perplexity_edges(spark):
    df = spark.createDataFrame([("a", 2.0, 2), ("b", 1e6, 1), ("c", 0.0, 0)], "k string, nll double, n int")
    got = {r.k: r.p for r in df.groupBy("k").agg(telemetry.perplexity(F.col("nll"), F.col("n")).alias("p")).collect()}
    assert abs(got["a"] - np.e) < 1e-12 and got["b"] == float("inf") and got["c"] != got["c"]


def test_templates(spark):
    rows = [(f"k{i}", "financeiro" if i % 2 else "nothing known", f"title {i}", None, None, None) for i in range(200)] + [("n", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, topic string, title string, text string, source string, quality_score double")
    picked = {r.id: r.t for r in df.select("id", formats.pick_template(F.col("topic"), F.col("id")).alias("t")).collect()}
    assert {t for k, t in picked.items() if k[1:].isdigit() and int(k[1:]) % 2} == set(formats.TOPIC_TEMPLATES["financeiro"])
    assert picked["n"] in formats.DEFAULT_TEMPLATES
    made = formats.entry_formats(df, metadata=True).where("id = 'k1'").first()
    assert json.loads(made.alpaca)["metadata"] == {"id": "k1", "source": "unknown", "topic": "financeiro", "quality_score": 0.7}
    assert json.loads(made.chatml)["messages"][0]["content"] == formats.ENTRY_SYSTEM["financeiro"]


def test_guardrail_statistics(spark):
    texts = ["mulher não sabe dirigir", "sexo frágil e homem não chora", "Ganhe dinheiro rápido, curso gratuito", None, "", "isso não é para uma pessoa"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    bias = {(r.kind, r.label): r.n for r in guardrails.bias_statistics(df).collect()}
    assert bias == {("bias", "total"): 6, ("bias", "with_bias"): 2, ("bias", "without_bias"): 4, ("bias_type", "gender"): 2, ("bias_severity", "high"): 2}
    content = {(r.kind, r.label): r.n for r in guardrails.content_statistics(df).collect()}
    assert content == {("content", "total"): 6, ("content", "passed"): 5, ("content", "failed"): 1, ("content_reason", "contains_spam"): 1}
    language = {(r.kind, r.label): r.n for r in guardrails.language_statistics(df).collect()}
    assert language[("language", "total")] == 6 and language[("language_of", "unknown")] == 2
    first = df.select(guardrails.language_candidates(F.col("text")).alias("c")).collect()
    assert first[5].c[0].lang == "pt" and [x.lang for x in first[3].c] == ["pt"]
    assert guardrails.bias_statistics(df.limit(0)).where("label = 'total'").first().n == 0


def test_tensor_categories(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("embedding.w", [1.0, -1.0, nan]), ("embedding.v", [2.0, 2.0]), ("layer.in_proj", [inf, 3.0]), ("bias", [0.0])]
    df = spark.createDataFrame(rows, "name string, v array<double>")
    got = {r.category: r for r in vectors.tensor_categories(df, "name", "v", {"embedding": "embedding", "linear": "in_proj"}).collect()}
    assert got["embedding"].tensors == 2 and got["embedding"].magnitude == 1.5 and got["embedding"].nan_tensors == 1 and abs(got["embedding"].norm - 10**0.5) < 1e-12
    assert got["linear"].inf_tensors == 1 and got["linear"].most == 3.0 and got["other"].tensors == 1


needs_vocabulary = pytest.mark.skipif(not os.path.isdir(bpe.FOLDER), reason="no tokenizers here")


@needs_vocabulary
def test_exact_tokens(spark):
    pytest.importorskip("tiktoken")
    coder = bpe.encoding()
    texts = [None, "", "hello world, a few words", "ação 😀 " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = df.select("i", "text", bpe.token_count(F.col("text")).alias("n"), bpe.token_ids(F.col("text")).alias("ids"), bpe.truncate(F.col("text"), 5).alias("short")).orderBy("i").collect()
    for r in rows:
        ids = coder.encode_ordinary(r.text or "")
        assert r.n == len(ids) and list(r.ids) == ids
    assert rows[0].short is None and rows[1].short == "" and rows[2].short.endswith("...") and rows[3].text.startswith(rows[3].short[:-3])


@needs_vocabulary
def test_round_trip(spark):
    pytest.importorskip("tiktoken")
    coder = bpe.encoding()
    good = coder.encode_ordinary("The committee met in the town hall and agreed on the plan. " * 20)
    odd = coder.encode_ordinary("😀" * 100)
    assert tokens.sample_check(good, 0, 64, coder, coder.n_vocab)[0]
    assert tokens.sample_check([*good[:10], 10**6], 0, 64, coder, coder.n_vocab)[0] is False
    invalid = {tokens.sample_check(odd, s, 3, coder, coder.n_vocab)[2] for s in range(20, 30)}
    assert invalid <= {None, "edge"}
    df = spark.createDataFrame([(1, good), (2, odd), (3, [])], "doc_id long, ids array<int>")
    windows = tokens.round_trip(df)
    assert sorted(r.doc_id for r in windows.collect()) == [1, 2]
    report = tokens.round_trip_report(windows).first()
    assert report.samples == 2 and 0 <= report.mismatch_pct <= 100
    assert tokens.round_trip_report(tokens.round_trip(df.limit(0))).first().samples == 0


def test_feeds(spark):
    body = "<p>" + "word " * 30 + "</p>"
    text = body.replace("<", "&lt;").replace(">", "&gt;")
    rss = f"<rss version='2.0'><channel><title>F</title><item><link>L1</link><description>{text}</description></item><item><title>T2</title><link>L2</link><pubDate>Tue, 05 Mar 2024 10:00:00 +0000</pubDate><description><![CDATA[{body}]]></description></item></channel></rss>"
    atom = f"<feed xmlns='http://www.w3.org/2005/Atom'><title>F</title><entry><title>A</title><link href='U1'/><link href='U2'/><updated>2024-03-05T10:00:00Z</updated><summary>short</summary><content type='html'>{text}</content></entry></feed>"
    rows = parsers.feed_items(spark.createDataFrame([(1, rss), (2, atom), (3, None), (4, "no xml")], "id int, xml string")).orderBy("id", "link").collect()
    assert [(r.id, r.title, r.link) for r in rows] == [(1, None, "L1"), (1, "T2", "L2"), (2, "A", "U1")]
    assert rows[1].published is not None and rows[2].published is not None and all("<" not in r.text for r in rows)


def test_decision_log_and_listing(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"step": 3, "policy": "p", "action": {"type": "lr", "before": 1.0, "after": 0.5}}\nbroken\n{"step": 4, "policy": null, "action": null}\n')
    rows = readers.decision_log(spark, str(tmp_path / "log.jsonl")).orderBy("step").collect()
    assert [(r.step, r.action and r.action.after) for r in rows] == [(3, 0.5), (4, None)]
    (tmp_path / "f").mkdir()
    for name in ("step_00010.pt", "best_00011.pt", "interrupt.pt", "manager_00012.pt"):
        (tmp_path / "f" / name).write_bytes(b"x")
    assert {r.name: r.reason for r in readers.file_listing(spark, str(tmp_path / "f")).collect()} == {"step_00010.pt": "scheduled", "best_00011.pt": "best_val_loss", "interrupt.pt": "interrupt", "manager_00012.pt": "manager_decision"}
