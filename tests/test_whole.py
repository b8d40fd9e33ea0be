"""Queries over small tables of their own, on rows that a shortened form of the query would leave out or leave as they are."""

import random
import re
import unicodedata
from datetime import datetime

import pytest

from millrace.functions import udfs
from millrace.operators import dedup, guardrails
from millrace.plans import pipeline
from millrace.plans.queries import QUERIES, SQL


def run(spark, folder, name, table, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return QUERIES[name](spark, str(folder)).collect()


def test_nfkc_of_all_documents(spark, tmp_path):
    texts = ["plain", "S\u00e3o Paulo", "Sa\u0303o Paulo", "\ufb01m \u2460", "\uff21\uff22\uff11", "a\u00a0b", "", None]
    got = run(spark, tmp_path, "f02_nfkc", "documents", list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.out for r in got} == {i: unicodedata.normalize("NFKC", t) if t else t for i, t in enumerate(texts)}


def test_all_personal_data(spark, tmp_path):
    rows = [
        ("a", "Ligue (11) 98765-4321 ou escreva a ana@x.com.br."),
        ("b", "RG 12.345.678-9, IP 192.168.10.1, cartão 1234-5678-9012-3456."),
        ("c", "Mora na Rua São João, 120, perto da praça."),
        ("d", "Rua das Flores cep 01310-100, CPF 123.456.789-00."),
        ("e", None),
        ("f", "Nada aqui."),
    ]
    schema = "id string, text string"
    got = {r.id: r.out for r in run(spark, tmp_path, "g04_mask_pii", "dataset_entries", rows, schema)}
    assert got["a"] == "Ligue ([TELEFONE] ou escreva a [EMAIL]."
    assert got["b"] == "RG [RG], IP [IP], cartão [CARTAO]."
    assert got["c"] == "Mora na [ENDERECO], perto da praça."
    assert got["d"] == "[ENDERECO], CPF [CPF]."
    assert got["e"] is None and got["f"] == "Nada aqui."
    counts = {r.id: r for r in run(spark, tmp_path, "g03_pii_counts_all", "dataset_entries", rows, schema)}
    assert [counts[i].address for i in "abcdef"] == [0, 0, 1, 2, 0, 0] and counts["b"].credit_card == counts["b"].ip == 1
    total = run(spark, tmp_path, "a08_pii_documents_all", "dataset_entries", rows, schema)[0]
    assert (total.address, total.cpf, total.total) == (2, 1, 6)
    assert udfs.mask_matches("Sou Maria da Silva.", guardrails.pii_patterns(names=True), labels=guardrails.PII_LABELS) == "Sou [NOME]."


def _shingles(text):
    text = re.sub(r"[ \t\r\n\f\x0b]+", " ", text.lower())
    return {text[i : i + 5] for i in range(len(text) - 4)}


def _edited(seed=5):
    """Texts of 60 to 2000 characters, each with copies that differ by ever more words, equal copies and short texts."""
    pick, rows = random.Random(seed), []
    words = ["".join(pick.choices("abcdefghijlmnoprstuvã", k=pick.randint(2, 9))) for _ in range(400)]
    for n in (12, 20, 35, 60, 110, 200, 300):
        for _ in range(4):
            base = pick.choices(words, k=n)
            for changes in (0, 0, 1, 2, 3, n // 20, n // 12, n // 9):
                copy = list(base)
                for at in pick.sample(range(n), min(changes, n)):
                    copy[at] = pick.choice(words)
                rows.append(" ".join(copy))
    rows += ["short", "short", None, rows[0].upper() + "  ", "aaaa " * 20]
    pick.shuffle(rows)
    return list(enumerate(rows))


def test_similar_texts_are_all_found(spark, tmp_path):
    rows = _edited()
    sets = {i: _shingles(t) for i, t in rows if t and len(t) >= 50}
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    normal = {i: re.sub(r"\s+", " ", t.lower()) for i, t in rows if i in sets}
    first = {i: min(j for j in normal if normal[j] == normal[i]) for i in normal}
    want = {p: s for p, s in share.items() if s >= 0.85 and first[p[0]] == p[0] and (first[p[1]] == p[1] or first[p[1]] == p[0])}
    got = {(r.id_a, r.id_b): r.similarity for r in run(spark, tmp_path, "d05_j04_similar", "documents", rows, "doc_id long, text string")}
    assert len(want) > 60 and got == {p: round(s, 6) for p, s in want.items()}

    kept, dropped = [], set()
    for i in sorted(sets):
        if any(share[k, i] >= 0.85 or normal[k].strip() == normal[i].strip() for k in kept):
            dropped.add(i)
        else:
            kept.append(i)
    marks = {r.id: r for r in run(spark, tmp_path, "d05_marks", "documents", rows, "doc_id long, text string")}
    assert set(marks) == set(sets) and {i for i, r in marks.items() if r.is_duplicate} == dropped
    assert all(r.class_id == first[i] and (not r.is_duplicate or r.similar_to in kept) for i, r in marks.items())


def test_blocks_of_similar_texts(spark):
    df = spark.createDataFrame(_edited(7), "id long, text string")
    classes = dedup.text_classes(df, "id", "text")
    few, one = ({tuple(r) for r in dedup.similar_classes(classes, chunk=n).collect()} for n in (7, 3000))
    assert few == one and few


def test_pipeline_has_near_copies_and_personal_data(spark):
    text = (
        "O relatório que não muda para cada região está com uma descrição. São dados que valem para todos, com isso fica claro o que se mede em cada cidade do país e também quando. "
        "A equipe registrou os resultados das medições do interior, que serão publicados para consulta com uma nota técnica e isso ajuda. "
    )
    other = "Uma carta que não chegou para os moradores com isso está parada. São muitos pedidos, que seguem para uma fila com nomes e números. Escreva para ana@x.com.br ou ligue 98765-4321. Quem mora longe recebe uma resposta por correio, com isso o atendimento fica para depois. São regras que valem para cada bairro e também para quem aluga."
    swindle = "Este curso gratuito que não existe para todos está com uma oferta. São vagas, que isso seja claro, para uma turma com poucos alunos e nada mais do que isso na cidade. A escola fica perto da praça central, com salas que recebem gente de cada bairro. São horários da noite, para quem trabalha durante o dia e estuda depois."
    rows = [(1, text + "Fim."), (2, text.replace("claro", "certo") + "Fim."), (3, other), (4, text + "Fim."), (5, swindle), (6, swindle.replace("nada", "pouco")), (7, None)]
    got = {r.doc_id: r for r in pipeline.process(spark.createDataFrame(rows, "doc_id int, text string"), min_score=0.1).collect()}
    assert [got[i].drop_reason for i in range(1, 8)] == [None, "duplicate", None, "duplicate", "content", "duplicate", "language"]
    assert [i for i, r in got.items() if r.pii_removed] == [3]
    assert "[EMAIL]" in got[3].clean_text and "[TELEFONE]" in got[3].clean_text and "98765" not in got[3].clean_text
    counted = {r.reason: r for r in pipeline.counters(pipeline.process(spark.createDataFrame(rows, "doc_id int, text string"), min_score=0.1)).collect()}
    assert counted["kept"].documents == 2 and counted["kept"].pii_removed == 1 and counted["duplicate"].documents == 3


def test_first_wins_equals_one_by_one(spark):
    rng = random.Random(3)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(70)} | {(100 + i, 101 + i) for i in range(9)})
    kept, want = set(), {}
    for i in sorted({x for p in pairs for x in p}):
        like = min((a for a, b in pairs if b == i and a in kept), default=None)
        if like is None:
            kept.add(i)
        else:
            want[i] = like
    df = spark.createDataFrame(pairs, "id_a long, id_b long")
    assert {r.id: r.like for r in dedup.first_wins(df).collect()} == want
    assert dedup.first_wins(df.limit(0)).count() == 0


def test_spikes_after_zero(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    values = [1.0, 2.0, 0.0, 3.0, 0.0, 0.0, -1.0, -0.0, 5.0, -0.0, -5.0, None, 4.0, 5.0, float("nan"), 0.0]
    rows = [(i, datetime(2024, 1, 1, 0, 0, i), 1, "a", v) for i, v in enumerate(values)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    got = run(spark, tmp_path, "w07_spikes", "events", rows, schema)
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert sorted((r.event_id, str(r.change)) for r in got) == sorted((i, str(c)) for i, c in con.execute(SQL["w07_spikes"]).fetchall())
    assert {(r.event_id, str(r.change)) for r in got} >= {(1, "1.0"), (3, "inf"), (5, "nan"), (10, "inf")}
