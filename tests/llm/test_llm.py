"""Operators of the llm subpackage against brute force, round trips, held-out accuracy and odd input."""

import itertools
import os

import numpy as np
import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

from millrace.llm import encode, languages, mixing, neardup, packing, pairs, pii, queries, spam, textstats
from millrace.session import table

COMMON = {"pt": frozenset("a o de que e do da em um para com não uma os no se na por mais as".split()), "en": frozenset("the of and to in a is that for it was on are as with his they at be this".split())}
TEXT = "The committee met in the town hall and agreed that the new plan for the river is sound. It was the third meeting of the year, and many people came to listen to the members."


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(k, w, 1) for k, ws in COMMON.items() for w in sorted(ws)], "lang string, word string, word_rank int")


# Mixing


def _mix(spark, records, sources, stages):
    return mixing.mix(
        spark.createDataFrame(records, "record_id long, source string, token_count long, name string"),
        spark.createDataFrame(sources, "stage string, name string, weight double, repeat double, max_tokens long, source string"),
        spark.createDataFrame(stages, "stage string, target_tokens long"),
    )


def test_mix_cuts_exactly(spark):
    records = [(i, "A_b" if i % 2 else "a-B ", 7, "x") for i in range(200)] + [(1, "a b", 7, "x")] + [(500 + i, "small", 10, "y") for i in range(5)]
    records += [(900, "small", 0, ""), (901, "small", -5, ""), (902, "small", None, ""), (None, "small", 9, ""), (903, None, 9, "")]
    sources = [("s", "AB", 3.0, None, None, ""), ("s", "Small", 1.0, 2.0, None, ""), ("s", "none", None, 1.0, 5, ""), ("s", "gone", -1.0, -2.0, None, "")]
    out = _mix(spark, records, sources, [("s", 800), ("other", 5)])
    report = {r.name: r for r in out["report"].collect()}
    assert report["AB"].actual_tokens == report["AB"].planned_tokens == 600
    assert report["Small"].planned_tokens == report["Small"].actual_tokens == 100 and report["Small"].most_uses == 2
    assert report["none"].actual_tokens == 0 and report["gone"].actual_tokens == 0
    assert {r.name for r in out["budgets"].where("short").collect()} == {"Small"}
    picked = out["selected"].where("name = 'AB'").collect()
    assert len({r.record_id for r in picked}) == len(picked) and sum(r.tokens_taken for r in picked) == 600


def test_needs_do_not_depend_on_the_order_of_lines(spark):
    weights = [0.44, 0.1, 0.2, 0.05, 0.07, 0.3, 0.02, 0.16, 0.1]
    seen = set()
    for seed in range(10):
        order = np.random.default_rng(seed).permutation(len(weights))
        sources = [("s", f"n{i}", weights[i], None, None, "") for i in order] + [("s", "bad", w, None, None, "") for w in (float("nan"), float("inf"), -1.0, None)]
        report = _mix(spark, [(i, f"n{i}", 10**9, "") for i in range(len(weights))], sources, [("s", 1_440_000)])["report"]
        seen.add(tuple(sorted((r.name, r.needed_tokens, r.planned_tokens, r.target_share) for r in report.collect())))
    assert len(seen) == 1 and sum(n for _, n, *_ in seen.pop()) == 1_440_000


def test_selection_keeps_plan_and_repeats(spark, data):
    records, sources, stages = queries._mixing_tables(spark, data)
    out = mixing.mix(records, sources, stages)
    plan = {(r.stage, r.name): r for r in out["budgets"].collect()}
    taken, uses = {}, {}
    for r in out["selected"].collect():
        key = (r.stage, r.name)
        taken[key] = taken.get(key, 0) + r.tokens_taken
        uses[key] = max(uses.get(key, 0), r.times)
    assert {k: r.planned for k, r in plan.items() if r.planned} == taken
    assert all(n <= np.ceil(plan[k]["repeat"]) for k, n in uses.items())


def test_mix_empty(spark):
    out = _mix(spark, [], [("s", "a", 1.0, 1.0, None, "")], [("s", 10)])
    assert out["selected"].count() == 0 and out["report"].first().actual_tokens == 0
    assert _mix(spark, [(1, "a", 5, "")], [], [])["report"].count() == 0


# Encoding


@pytest.fixture(scope="module")
def encoder():
    if not os.path.isdir(encode.TOKENIZERS):
        pytest.skip("no tokenizers here")
    return encode.TextEncoder(encode.BytePairEncoder.load(os.path.join(encode.TOKENIZERS, "byte_bpe_50k.tiktoken"), encode.split_pattern()))


def test_encoding_equals_public_library(encoder, spark, data):
    tiktoken = pytest.importorskip("tiktoken")
    public = tiktoken.Encoding("own", pat_str=encode.split_pattern(), mergeable_ranks=encoder.encoder.ranks, special_tokens={})
    texts = [r.text for r in table(spark, data, "documents").select("text").collect()]
    texts += [None, "", " ", "a" * 5000, "ab" * 900 + "!" * 700, "\n\n  \t x", "😀é漢字 ​", "x" * 400, "<|endoftext|>", " 's 're don't 12345"]
    ids, offsets = encoder.encode(texts)
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == public.encode_ordinary(text or ""), repr(text)[:60]


def test_encoding_frame(spark, encoder):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "hello hello", "k"), (3, "hello hello", "k"), (None, "x", None)], "doc_id int, text string, ids string")
    rows = encode.encode_texts(df).collect()
    assert sorted(len(r.ids) for r in rows) == [0, 0, 1, 2, 2]
    assert encode.encode_texts(df.limit(0)).count() == 0
    counts = df.select(encode.token_counts(F.col("text")).alias("n")).collect()
    assert sorted(r.n for r in counts) == [0, 0, 1, 2, 2]


# Personal data


def test_pii_finds_and_masks(spark):
    lines = [
        ("Fale com Irene dos Lumiares pelo telefone (52) 99478-2639.", {("name", 9), ("phone", 42)}),
        ("Escreva para ana.dias@mail.example até sexta.", {("email", 13)}),
        ("Mail me: joan21 (at) corp dot penedral dot example now.", {("email", 9)}),
        ("O formulário foi assinado por Mauro Ribeiral, CPF ou registro 291.088.549-86, morador da Rua das Paineiras, n. 379.", {("name", 30), ("id_number", 62), ("address", 89)}),
        ("The box is with Oscar Tarrowby at 1894 Quarry Bend Road, thanks.", {("name", 16), ("address", 34)}),
        ("O Colégio Otávio Lumiares ficou em 2 lugar.", set()),
        ("A versão 10.2.544.41 corrigiu a falha.", set()),
        ("O perfil @mesa_de_cambio publicou a nota.", set()),
    ]
    rows = [(i, text) for i, (text, _) in enumerate(lines)] * 1
    many = rows + [(100 + i, text) for i in range(30) for text in [lines[i % len(lines)][0]]]
    df = spark.createDataFrame(many, "id int, text string")
    spans = pii.proposed_spans(df)
    weights = pii.fit(spans)
    found = {}
    for r in pii.found_places(spans, weights).collect():
        found.setdefault(r.id, set()).add((r.pii_type, r.start_pos))
    for i, (_, want) in enumerate(lines):
        assert found.get(i, set()) == want, lines[i]
    redacted = {r.id: r.redacted for r in pii.redact(df, weights).collect()}
    assert redacted[1] == "Escreva para [EMAIL] até sexta."
    assert redacted[5] == lines[5][0]


def test_pii_adds_labelled_names_beyond_the_gazetteer(spark, data):
    texts = queries._texts_with_personal_data(spark, data)
    weights = pii.fit(pii.proposed_spans(texts))
    rows = [(1, "Falei com a Sra. Zuleide Tamarindo sobre isso."), (2, "Nome: Fundação Tamarindo do Vale"), (3, "Zuleide Tamarindo falou sobre isso.")]
    redacted = {r.id: r.redacted for r in pii.redact(spark.createDataFrame(rows, "id int, text string"), weights).collect()}
    assert redacted == {1: "Falei com a Sra. [NAME] sobre isso.", 2: rows[1][1], 3: rows[2][1]}


def test_pii_odd_input(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 30000), (3, "x " * 30000)], "id int, text string")
    spans = pii.proposed_spans(df)
    weights = pii.fit(spans)
    assert pii.found_places(spans, weights).count() == 0
    assert [r.redacted for r in pii.redact(df, weights).orderBy("id").collect()][:2] == [None, ""]
    assert pii.proposed_spans(df.limit(0)).count() == 0


def test_label_reliability_separates():
    belief = pii.label_reliability([("email", "+0+", 90), ("email", "--0", 60), ("email", "-0-", 20)])
    assert belief[("email", "+0+")] > 0.9 and belief[("email", "--0")] < 0.1


# Near duplicates


def brute_pairs(rows, share=0.6, least=20):
    word = regex.compile(r"[\p{L}\p{N}]+")
    sets = {}
    for key, title, text in rows:
        w = word.findall(((title or "") + " " + (text or "")).lower())
        if key is not None and len(w) >= least:
            sets[key] = set(zip(w, w[1:], w[2:]))
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common >= share * len(sets[a] | sets[b]) - 1e-9:
            out.add((a, b))
    return out


def test_neardup_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        base = list(rng.choice(vocabulary, int(rng.integers(15, 160))))
        rows.append((f"k{i:03d}a", "t", " ".join(base)))
        for j in range(3):
            edited = list(base)
            for _ in range(int(rng.integers(0, max(1, len(base) // 6)))):
                edited[int(rng.integers(len(edited)))] = str(rng.choice(vocabulary))
            if j == 2:
                cut = int(rng.integers(1, len(edited)))
                edited = edited[cut:] + edited[:cut]
            rows.append((f"k{i:03d}{'bcd'[j]}", None if j else "t", " ".join(edited)))
    rows += [("same1", "x", rows[0][2]), ("same2", "x", rows[0][2]), ("same2", "x", rows[0][2]), ("none", None, None), (None, "t", rows[0][2]), ("e", "", ""), ("rep", None, "a b " * 40)]
    links, members = neardup.similar_pairs(spark.createDataFrame(rows, "id string, title string, text string"))
    got = {(r.id_a, r.id_b) for r in neardup.expand_pairs(links, members).collect()}
    assert got == brute_pairs(rows)
    counts = {r.id: r for r in neardup.link_counts(links, members).collect()}
    assert counts["same1"]["class"] == counts["same2"]["class"] and "none" not in counts


def test_neardup_on_tables(spark, data):
    rows = [tuple(r) for r in table(spark, data, "dataset_entries").select("id", "title", "text").distinct().collect()]
    got = {(r.id_a, r.id_b) for r in queries.QUERIES["p3_found"](spark, data).collect()}
    assert got == brute_pairs(rows)


def test_large_groups_of_copies_keep_links_of_different_texts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "EXPAND", 3)
    base = [f"w{i}" for i in range(60)]
    rows = [(f"c{i}", "t", " ".join(base)) for i in range(6)] + [("u", "T", " ".join(base)), ("v", "t", " ".join(base[:-4]))]
    links, members = neardup.similar_pairs(spark.createDataFrame(rows, "id string, title string, text string"))
    got = {(r.id_a, r.id_b) for r in neardup.expand_pairs(links, members).collect()}
    assert got == {("c0", f"c{i}") for i in range(1, 6)} | {("c0", "u"), ("c0", "v"), ("u", "v")}


def test_neardup_splits_regions_and_is_empty(spark, monkeypatch, data):
    df = table(spark, data, "dataset_entries").select("id", "title", "text")
    whole = {tuple(r) for r in neardup.similar_pairs(df)[0].select("class_a", "class_b").collect()}
    monkeypatch.setattr(neardup, "REGION_POSTINGS", 300)
    assert {tuple(r) for r in neardup.similar_pairs(df)[0].select("class_a", "class_b").collect()} == whole
    links, members = neardup.similar_pairs(df.limit(0))
    assert links.count() == 0 and members.count() == 0


def shuffled_bytes(spark, run):
    """Bytes that the stages of run write for shuffles."""
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()
    listed = lambda: store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    stages = lambda: {s.stageId(): s.shuffleWriteBytes() for s in (found.apply(i) for found in [listed()] for i in range(found.size()))}
    before = max(stages(), default=-1)
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(n for k, n in stages().items() if k > before)


def test_neardup_writes_no_posting_once_more_for_every_region(spark, monkeypatch, data):
    run = lambda: neardup.similar_pairs(table(spark, data, "dataset_entries").select("id", "title", "text"))
    few = shuffled_bytes(spark, run)
    monkeypatch.setattr(neardup, "REGION_POSTINGS", 100)
    assert few < shuffled_bytes(spark, run) < 2.5 * few


# Pairs


def test_pair_rules():
    assert all(pairs.is_empty(x) for x in (None, "", "  \n", "-", "...", "N/A", "[resposta]", "(vazio)", "<p></p>", "&nbsp;", "null"))
    assert not any(pairs.is_empty(x) for x in ("Yes", "1108", "XAD", "No."))
    ask = "Explique de forma simples como funciona o câmbio hoje em dia."
    assert pairs.is_copy(ask, None, ask.upper()) and pairs.is_copy(ask, None, f'Você perguntou: "{ask}"') and pairs.is_copy(ask, "Um dado.", f"{ask}\nUm dado.")
    assert not pairs.is_copy(ask, None, ask + " O câmbio é a troca de uma moeda por outra, feita por bancos e corretoras autorizadas.")
    assert not pairs.is_copy("Repeat the text below exactly as it is.", "A b c d.", "Repeat the text below exactly as it is.")
    assert pairs.is_refusal(ask, "Desculpe, mas não posso ajudar com isso.") and pairs.is_refusal(ask, "I can't answer that.")
    assert not pairs.is_refusal("Escreva uma recusa educada para um convite.", "Infelizmente não posso aceitar o convite.")
    assert pairs.ending("It was said that the observatory negotiated the") == "cut"
    assert pairs.ending("A list:\n1. One thing\n2.") == "cut" and pairs.ending("A list:\n1. One thing\n2. Another thing") == "open"
    assert pairs.ending("Text.\n```\nselect a from b where (") == "cut" and pairs.ending("Text.\n```\nselect a\n```") == "complete"
    long = "Sinto muito, mas não posso ajudar com esse assunto delicado neste momento. " * 8
    assert pairs.is_refusal(ask, long) and not pairs.is_refusal(ask, "Desculpe. " + "O câmbio é a troca de uma moeda por outra, feita todo dia por bancos. " * 8)
    assert pairs.is_copy("Define inflation", None, "Define inflation.") and not pairs.is_copy("Define inflation", None, "To define inflation: prices rise.")
    assert pairs.is_copy(ask, None, " ".join([ask] * 5))
    assert pairs.ending("Some items of the list:\n- the first thing here\n- the second thing") == "open"
    assert pairs.ending("1108") == "complete" and pairs.ending("Done at last.") == "complete" and pairs.ending("| a | b |\n| c |") == "complete"


def test_shortened_and_limits(spark):
    texts = [("abc",), ("abcd",), ("abd",), ("abcd",), (None,), ("",), ("zz",)]
    got = {r.output for r in pairs.shortened_responses(spark.createDataFrame(texts, "output string")).collect()}
    assert got == {"abc"}
    lengths = [("x" * 120,)] * 40 + [("y" * n,) for n in range(100, 140)]
    assert [r.size for r in pairs.length_limits(spark.createDataFrame(lengths, "output string")).collect()] == [120]


def test_pair_query_odd_input(spark, words, data):
    model = languages.fit_model(languages.training_sentences(table(spark, data, "alpaca_records").select("output"), table(spark, data, "common_words"), "output", None))
    rows = [(1, None, None, None, "d"), (2, "", "", "", "d"), (3, "Ask", None, "word " * 20000 + "end.", "d"), (3, "Ask", None, "word " * 20000 + "end.", "d")]
    got = pairs.pair_defects(spark.createDataFrame(rows, "record_id int, instruction string, input string, output string, defect string"), model, words).collect()
    assert sorted((r.record_id, r.defect) for r in got if r.defect) == [(1, "empty"), (2, "empty")] and len(got) == 4
    assert pairs.pair_defects(spark.createDataFrame([], "record_id int, instruction string, input string, output string"), model, words).count() == 0


# Languages


def test_language_codes():
    for raw, code in [("pt_BR", "pt"), ("Português", "pt"), ("pt ", "pt"), ("en-US", "en"), ("es_419", "es"), ("fra", "fr"), (None, None), (" ", None), ("unknown", None), ("und", None), ("de", "de")]:
        assert languages.language_code(raw) == code, raw


def test_language_held_out(spark, data):
    examples = languages.training_sentences(table(spark, data, "dataset_entries"), table(spark, data, "common_words"))
    held = examples[::4]
    model = languages.fit_model([e for i, e in enumerate(examples) if i % 4])
    logp = model.log_probabilities([w for w, _ in held])
    assert (logp.argmax(1) == np.array([y for _, y in held])).mean() > 0.97
    full = languages.fit_model(examples)
    assert full.segments(None) == [] and full.segments("  ") == [] and full.segments("123 456") == []
    mixed = full.segments(TEXT + " " + TEXT + " O relatório mais recente diz que o conselho escolar não avaliou as notas do bimestre. A escola rural ampliou o calendário letivo e a biblioteca pública recebeu um projeto de leitura.")
    assert [g for g, _, _ in mixed] == ["en", "pt"]


# Statistics


def test_kinds(spark, data):
    prose = [(f"p{i}", f"{TEXT} Number {i} of the series is about the {w}.", 5) for i, w in enumerate(["river", "hall", "plan", "year", "town"] * 30)]
    odd = [
        ("list", "- the river bank\n- the town hall\n- a new plan\n- the third year\n- some old roads\n- the market square\n- the school", 1),
        ("table", "river;12;3,50\nhall;9;1,20\nplan;4;7,10\nyear;8;2,00\ntown;1;9,90\nroad;5;5,00\nbank;7;1,00\nfarm;2;2,20\n" * 3, 1),
        ("junk", "xkq zzvb qwrtp lkjh mnbv " * 12, 60),
        ("stub", "Not here.", None),
        ("blank", " \n ", 0),
        ("null", None, 3),
        ("count", TEXT, 500),
        ("count", TEXT, 500),
    ]
    df = spark.createDataFrame(prose + odd, "id string, text string, stored int")
    words = spark.createDataFrame([(k, w) for k, ws in COMMON.items() for w in ws], "lang string, word string")
    measured = textstats.statistics(df, words)
    judged = {r.id: r for r in textstats.judge(measured, textstats.prose_model(measured)).collect()}
    assert [judged[k].kind for k in ("list", "table", "junk", "stub", "blank", "null", "p3")] == ["list", "table", "junk", "stub", "blank", "blank", "prose"]
    assert abs(sum(judged["p3"].contributions) - judged["p3"].distance) < 1e-3
    wrong = textstats.judge(measured, textstats.prose_model(measured)).where(textstats.count_is_wrong(F.col("stored"), F.col("word_count"))).select("id").distinct().collect()
    assert {r.id for r in wrong} >= {"count"} and "null" not in {r.id for r in wrong}
    empty = textstats.statistics(df.limit(0), words)
    assert textstats.judge(empty, textstats.prose_model(empty)).count() == 0


def test_distance_is_a_sum_of_contributions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, textstats.K))
    moments = (500, x.sum(0), x.T @ x)
    model = textstats._model({"en": moments}, {"en": textstats._spread(*moments)})
    d, parts = textstats.distances(x, model, "en")
    assert np.allclose(d, parts.sum(1)) and abs(d.mean() - textstats.K) < 1.0


# Packing


def test_best_fit():
    sizes = np.array([6, 5, 4, 3, 2])
    bins, place, room = packing.pack_items(sizes, np.full(5, -1), np.arange(5), 10)
    assert len(set(bins)) == 2 and all(sizes[bins == b].sum() == 10 for b in set(bins))
    bins, _, _ = packing.pack_items(np.array([2, 2, 2]), np.full(3, -1), np.array([7, 7, 7]), 10)
    assert len(set(bins)) == 3
    bins, _, _ = packing.pack_items(np.array([2, 2]), np.array([0, 1]), np.array([1, 2]), 10, {0: 2, 1: 1})
    assert len(set(bins)) == 2


def test_packing_keeps_everything(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(n), "s", None) for i, n in enumerate(rng.integers(0, 60, 300))] + [(1000, 777, "s", 5), (1001, 30, None, 6), (1002, 30, None, 6), (1003, None, "s", None), (None, 12, "s", None)]
    sized = spark.createDataFrame(rows, "doc_id int, tokens long, source string, cluster long")
    plans = spark.createDataFrame([(1, "a", 64), (2, "b", 100), (3, "c", None), (4, "d", 0)], "plan_id int, plan_name string, seq_len int")
    out = packing.pack(sized, plans).toPandas()
    assert set(out.plan_id) == {1, 2}
    for plan, capacity in ((1, 64), (2, 100)):
        x = out[out.plan_id == plan]
        assert x.tokens.sum() == sum(r[1] or 0 for r in rows)
        assert x[x.container.notna()].groupby("container").tokens.sum().max() <= capacity
        twins = x[x.doc_id.isin([1001, 1002])]
        assert twins.container.nunique() == 2
        assert (x[x.doc_id == 1000].tokens > 0).all() and len(x[x.doc_id == 1000]) == -(-777 // capacity)
        assert len(x[(x.tokens == 0)]) == sum(not r[1] for r in rows)
    assert packing.pack(sized.limit(0), plans).count() == 0


def test_packing_keeps_conflicts_apart(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(1, 90)), str(rng.choice(["legal", "forums", "news", "academic"])), int(rng.integers(0, 150))) for i in range(600)]
    sized = spark.createDataFrame(rows, "doc_id int, tokens long, source string, cluster long")
    plans = spark.createDataFrame([(1, "a", 64), (2, "b", 200)], "plan_id int, plan_name string, seq_len int")
    packed = packing.pack(sized, plans, packing.SOURCE_CONFLICTS)
    for r in packing.violations(packed, sized, plans, packing.SOURCE_CONFLICTS).collect():
        assert r.documents == 600 and r.over_capacity + r.conflicts + r.twins + r.split + r.incomplete == 0
    loose = packing.violations(packing.pack(sized.withColumn("cluster", F.lit(None).cast("long")), plans), sized, plans, packing.SOURCE_CONFLICTS)
    assert sum(r.conflicts for r in loose.collect()) > 0 and sum(r.twins for r in loose.collect()) > 0


# Spam


def test_spam(spark, words):
    links = "\n".join(f"[Best rates {i}](https://www.site{i}.example/a/b)" for i in range(12))
    stuffed = "cheap loans near me cheap loans online cheap loans 2024 " * 12
    rows = [(i, f"h{i % 5}", f"{TEXT} Part {i} is about the town and the river.") for i in range(120)]
    rows += [(200 + i, "bad", links.replace("rates", f"rates{i}")) for i in range(20)] + [(300 + i, "bad", stuffed + str(i)) for i in range(20)]
    rows += [(400, None, None), (401, "h1", ""), (402, None, stuffed), (403, "h1", TEXT + " See https://one.example/x for more.")]
    measured = spam.features(spark.createDataFrame(rows, "doc_id int, site string, text string"), words)
    found = {r.doc_id for r in spam.spam_probabilities(measured, spam.fit(measured)).where("probability > 0.5").collect()}
    assert found == {*range(200, 220), *range(300, 320), 402}
    empty = measured.limit(0)
    assert spam.spam_probabilities(empty, spam.fit(empty)).count() == 0


def test_weak_labels_abstain_and_trees_decide(spark, words):
    stuffed = "cheap loans near me cheap loans online cheap loans 2024 " * 12
    half = stuffed[: len(stuffed) // 2]
    pages = [f"{TEXT} Part {i} of it." for i in range(40)] + [stuffed + str(i) for i in range(20)] + [f"{TEXT}\n{half}\n{half}{i}" for i in range(20)]
    x = np.array([spam.page_features(p, COMMON) for p in pages])
    label = spam.weak_label(x)
    assert (label[:40] == 0).all() and (label[40:60] == 1).all()
    conflict = np.array([[0.0] * len(spam.FEATURES)])
    conflict[0, [spam.FEATURES.index(n) for n in ("marks_per_word", "common_ratio", "links_per_word")]] = 0.05, 0.4, 1.0
    assert spam.weak_label(conflict).tolist() == [-1] and spam.weak_label(conflict * 0).tolist() == [-1]
    said = label >= 0
    p = spam.Forest.grow(x[said], label[said]).probability(x)
    assert ((p > 0.5) == np.repeat([False, True, True], [40, 20, 20])).all()


def test_forest_learns():
    rng = np.random.default_rng(2)
    x = rng.random((600, 5))
    y = (x[:, 2] > 0.6).astype(int)
    p = spam.Forest.grow(x, y).probability(x)
    assert ((p > 0.5) == y).mean() > 0.97


# Queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    if name.startswith(("p7", "p8")) and not os.path.isdir(encode.TOKENIZERS):
        pytest.skip("no tokenizers here")
    rows = queries.QUERIES[name](spark, data).toPandas()
    assert isinstance(rows, pd.DataFrame)
    if name in queries.SQL:
        con = duckdb.connect()
        for table_name in os.listdir(data):
            con.execute(f"create view {table_name.split('.')[0]} as select * from read_parquet('{data}/{table_name}')")
        result = con.execute(queries.SQL[name])
        names = [c[0] for c in result.description]
        show = lambda v: None if v is None or v != v else "%.6g" % v if isinstance(v, float) else str(v)
        want = sorted(str([show(r[names.index(c)]) for c in sorted(names)]) for r in result.fetchall())
        assert sorted(str([show(v) for v in r]) for r in rows[sorted(rows.columns)].itertuples(index=False)) == want
