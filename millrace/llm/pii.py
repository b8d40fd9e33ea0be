"""Personal data in free text: e-mail addresses, phone numbers, identity numbers, street addresses, names of persons.

1. Patterns and a gazetteer of given names propose spans of one type each.
2. Labelers (shape, gazetteer, words around, structure) vote +, - or 0 on every proposed span.
3. The counts of vote patterns over all documents are a small table; expectation-maximisation on it estimates how
   reliable each labeler is and how probable each vote pattern makes a span personal data.
4. A logistic span classifier (votes, shape and hashed context words) is fitted to these probabilities, on at most
   `TRAIN_SPANS` spans of each type, chosen by hash; it decides all spans.
5. Of overlapping accepted spans the most probable one holds; accepted spans become `[EMAIL]`, `[PHONE]`, `[ID]`,
   `[ADDRESS]` or `[NAME]`.

Defined cases: null text has no spans and stays null; empty text stays empty; positions count code points; repeated
rows give equal results; texts are searched whole; without any span the classifier is not needed and nothing is found.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.samples import bounded_sample

TRAIN_SPANS = 20_000
WIDTH = 1 << 12
TYPES = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
SPANS = "array<struct<pii_type:string,start:int,end:int,votes:string,features:array<int>>>"

# Common given names of Portuguese, Spanish, English and French, without accents.
GIVEN = frozenset(
    """
    ana antonia antonio alberto alexandre alice aline amanda andre andrea angela arthur augusto beatriz benedito bernardo bianca
    bruna bruno caio camila carla carlos carolina cecilia celia celso cesar claudia claudio clara cristina daniel daniela davi
    debora denise diego diogo eduardo elena elias elisa elisabete emanuel emilia enzo erica eva fabio fabiana felipe fernanda
    fernando flavia flavio francisca francisco gabriel gabriela geraldo gilberto gloria guilherme gustavo heitor helena heloisa
    henrique hugo igor ines irene isabel isabela ivan ivone jair joana joao joaquim jonas jorge jose julia juliana julio laura
    leandro leonardo leticia ligia livia lourdes lucas lucia luciana luis luiz luisa marcelo marcia marcos margarida maria
    mariana marina mario marlene marta mateus mauricio mauro miguel milton monica murilo nadia natalia nelson nilza noemia
    olivia orlando otavio patricia paula paulo pedro priscila rafael raimundo raquel raul regina renata renato ricardo rita
    roberto rodrigo rogerio rosa rui samuel sandra sara sebastiao sergio silvia simone sofia sonia susana tadeu tatiana teresa
    tereza tiago thiago ursula valter vanessa vera vicente victoria vinicius vitor viviane wagner yara zelia
    carmen concepcion diego dolores enrique esteban guadalupe ignacio javier jesus juan juana manuel mercedes pablo pilar ramon
    rosario salvador santiago ximena
    alan albert alfred andrew ann anne arthur barbara benjamin brian catherine charles christopher clara david deborah dorothy
    edith edward eleanor elizabeth emily emma ethan eric frank fred george grace graham hannah harold harriet harry hazel
    helen henry howard hugh ian jack jacob james jane janet jason jean jennifer joan john jonathan joseph joshua joyce judith
    karen kenneth kevin laura leon lewis linda lucy margaret mark martha martin mary matthew michael miles nancy nicholas nora
    olive oliver oscar pamela patrick paul peter philip rachel ralph raymond rebecca richard robert roger ronald rose ruth
    samuel sarah sean sharon simon stella stephen steven stuart susan teresa theodore thomas timothy victor vincent violet
    virginia walter wendy william
    adele alain antoine camille chantal claire claude denis didier elodie etienne fabrice francois francoise genevieve gilles
    guillaume henri herve isabelle jacqueline jacques jeanne julien laurent louis louise luc madeleine marc marcel marie
    mathieu michel monique nathalie nicolas olivier pascal philippe pierre rene sebastien sophie suzanne sylvie thierry
    valerie veronique xavier yves
    """.split()
)

# Words that name what a number, a capitalised phrase or an address belongs to, without accents.
PHONE_WORDS = frozenset("telefone telefono telephone tel fone celular movil mobile phone cell call ring ligue liga ligar ligacao llame llamar llamada appelez numero number mensagem mensaje message whatsapp falta failing contato contact portable".split())
ID_WORDS = frozenset("cpf cnpj rg cpf/cnpj nif dni nie nit ssn id documento document doc registro record cedula identidade identidad identity identite inscricao cadastro passaporte passport social security tax fiscal anotou wrote anoto chave pagamento pago clave key payment".split())
NUMBER_OTHER = frozenset("processo proceso expediente norma versao version release ticket protocolo atendimento codigo barras barcode isbn edicao livro libro book emissao intervalo range lote serie serial maquina machine bilhete chamado case file pontos puntos points rede network servidor server ip pedido order volume artigo lei decreto placa patente standard model modelo".split())
NAME_BEFORE = frozenset("sr sra srta senhor senhora dr dra dom dona don mr mrs ms miss mme mlle monsieur madame senor senora nome name nombre nom por by com con with para to de from segundo according segun selon fiscal clerk professor profesor professora profesora teacher responsavel responsable contact contato assina signed firmado assinado abraco atenciosamente regards atentamente cliente client paciente patient filho filha son daughter hijo hija fale cita cites e and y et contrato titular autor autora requerente cadastro person".split())
ORGANISATION = frozenset("premio prize award colegio escola escuela ecole school college instituto institute institut construtora constructora construtor fundacao fundacion fundacao foundation fondation lei ley law loi act biblioteca library bibliotheque hospital clinica clinic museu museo museum universidade universidad university empresa company cia holdings group grupo banco bank editora editorial teatro theatre theater estadio stadium aeroporto aeropuerto airport ponte bridge puente parque park praca plaza square rua avenida avenue travessa alameda estrada largo rodovia calle street road lane cidade ciudad city porto serra vila ltda sa inc ltd corp llc associados associates industria industrias loja store hotel catedral igreja church barragem usina projeto plano plan operacao campeonato taca copa cup torneio trofeu medalha livraria padaria farmacia mercado cooperativa laboratorio editora jornal revista centro center centre".split())
CONNECTORS = frozenset("de da do dos das del di du la las los von van e y".split())
OPENERS = frozenset("ontem hoje amanha agora depois antes assim entao ainda segundo conforme porem contudo entretanto mas logo tambem aqui ali yesterday today tomorrow then now later however also still meanwhile so ayer hoy manana ahora despues luego pero hier demain ensuite sim nao yes no".split())

_SPACES = "\u00a0\u2002\u2003\u2009\u200a\u200b\u200c\u200d\u202f\u2060\u3000\ufeff"
_AT = r"(?:[ \t]?@[ \t]?|[ \t]*[\[({<][ \t]*(?:at|arroba|@)[ \t]*[\])}>][ \t]*|[ \t]+(?:arroba|at)[ \t]+)"
_DOT = r"(?:\.|[ \t]*[\[({][ \t]*(?:\.|dot|ponto|punto|point)[ \t]*[\])}][ \t]*|[ \t]+(?:dot|ponto|punto|point)[ \t]+)"
EMAIL = regex.compile(rf"(?i)(?<![\w.+%@\-])(?P<local>\w[\w.+%\-]*)(?P<at>{_AT})(?P<domain>[\p{{L}}\d\-]+(?:{_DOT}[\p{{L}}\d\-]+)+)")
NUMBER = regex.compile(
    r"(?<![\w.,/\-+$€£#])(?P<number>(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)|0?xx\d{2}|0xx\d{2}|\d+|[A-Z]{1,3}\d)(?:(?:[ ]{1,3}|[.\-/]?)(?:\(\d{1,4}\)[ ]*)?\d+)*(?:-[\dXx])?)(?![\w]|[.,/\-]\d|%)"
)
DIGITS = re.compile(r"\d[\d .\-/()x]{5,}\d|\d{7}")
STREET = r"rua|r\.|avenida|av\.|travessa|tv\.|alameda|al\.|estrada|largo|praça|praca|rodovia|rod\.|viela|ladeira|beco|calle|c/|carrera|paseo|camino|rue|boulevard|bd\.|chemin|impasse"
STREET_STARTS = ("rua ", "r. ", "avenida ", "av. ", "travessa ", "tv. ", "alameda ", "al. ", "estrada ", "largo ", "praça ", "praca ", "rodovia ", "rod. ", "viela ", "ladeira ", "beco ", "calle ", "c/ ", "carrera ", "paseo ", "camino ", "rue ", "boulevard ", "bd. ", "chemin ", "impasse ")
STREET_ENDS = (" street", " st.", " road", " rd.", " ave", " lane", " ln.", " drive", " dr.", " boulevard", " blvd", " court", " square", " terrace", " way", " close", " crescent", " place")
ADDRESS = regex.compile(
    rf"(?i)(?<![\w.])(?P<kind>{STREET})[ ]+(?P<name>(?:[^\W\d_][\w'’.\-]*[ ]+){{0,5}}?[^\W\d_][\w'’\-]*)(?:[ ]*,)?[ ]*(?P<number>s/n\b|(?:n\.?[ºo°]?|nº|núm\.?|número|numero|no\.|#)?[ ]*\d{{1,5}}\b)"
)
ADDRESS_EN = regex.compile(
    r"(?<![\w.,/\-])(?P<number>\d{1,5}[A-Za-z]?)[ ]+(?P<name>(?:[A-Z][\w'’\-]+[ ]+){1,4})(?P<kind>(?i:street|st\.|road|rd\.|avenue|ave\.?|lane|ln\.|drive|dr\.|boulevard|blvd\.|court|square|terrace|way|close|crescent|place))(?!\w)"
)
FIELD_AFTER_STREET = regex.compile(rf"(?i)[;|][ ]*(?:{STREET})[ ][^;|]{{3,60}}[;|][ ]*$")
FIELD_BEFORE_STREET = regex.compile(rf"(?i)[ ]*[;|][ ]*(?:{STREET})[ ]")
WORD = regex.compile(r"[^\W\d_][\w'’\-]*")
CAPITAL = regex.compile(r"(?<![\w@.+\-])\p{Lu}[\p{L}\p{M}'’\-]*")
FOLLOWS = regex.compile(r"[ \n]+(?:(?:de|da|do|dos|das|del|di|du|la|von|van|DE|DA|DO|DOS|DAS|DEL|LA|Da|De|Do|Dos|Das)[ \n]+)?(?:\p{Lu}\.[ ]+)?(?P<next>\p{Lu}[\p{L}\p{M}'’\-]+)")


@functools.lru_cache(100_000)
def fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def _around(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    before = [fold(w) for w in WORD.findall(text[max(0, start - 48) : start])][-4:]
    after = [fold(w) for w in WORD.findall(text[end : end + 40])][:3]
    return before, after


def _vote(positive: bool, negative: bool = False) -> str:
    return "+" if positive and not negative else "-" if negative and not positive else "0"


def _hash(kind: str, *parts: str) -> int:
    return zlib.crc32("\x1f".join((kind, *parts)).encode()) % WIDTH


def _features(kind: str, votes: str, before: list[str], after: list[str], shape: str) -> list[int]:
    found = [_hash(kind, "bias"), _hash(kind, "shape", shape)]
    found += [_hash(kind, "vote", str(i), v) for i, v in enumerate(votes)]
    found += [_hash(kind, "before", w) for w in before[-3:]] + [_hash(kind, "just before", w) for w in before[-1:]]
    found += [_hash(kind, "after", w) for w in after[:2]]
    return sorted(set(found))


def _shape(value: str) -> str:
    return regex.sub(r"[A-Za-z]", "A", regex.sub(r"\d", "9", value))


# Shapes of phone numbers and of tax, identity and social security numbers: country code, area code, number; punctuation optional.
PHONE_SHAPE = regex.compile(
    r"\+\d{1,3}[ .\-]?\(?\d{2,4}\)?[ .\-]?\d{3,5}[ .\-]?\d{3,6}|\+\d{1,3}[ .\-]?\d{4}[ .\-]?\d{6}|\(0?\d{2,3}\)[ ]?9?[ ]?\d{3,5}[ .\-]?\d{4}|0?xx\d{2}[ .\-]?\d{4,5}[ .\-]?\d{4}|0?\d{2}[ .\-]9?[ ]?\d{4,5}[ .\-]?\d{4}|\d{3}[ .\-]\d{3}[ .\-]\d{4}|0\d{4}[ ]\d{6}|0?\d{10,11}|\+\d{1,3}[ .\-]?\d{9,11}|\+\d{1,3}[ .\-]?\d{1,3}(?:[ .\-]\d{2,4}){2,4}|\+\d{1,3}[ .\-]?\(\d{2,3}\)[ ]?\d{8,9}"
)
ID_SHAPE = regex.compile(
    r"\d{3}\.\d{3}\.\d{3}[\-/.]\d{2}|\d{3} \d{3} \d{3} \d{2}|\d{9}[\-/]\d{2}|\d{11}|\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}|\d{2} \d{3} \d{3} \d{4} \d{2}|\d{8}/\d{4}-\d{2}|\d{14}|\d{1,2}\.\d{3}\.\d{3}-[\dXx]|\d{7,8}-[\dXx]|\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{9}|[A-Z]{2}\d{6,7}|\d{1,2} \d{3} \d{3} [\dXx]"
)


def _emails(text: str) -> Iterator[tuple]:
    for m in EMAIL.finditer(text):
        at, domain, local = m["at"].strip().lower(), m["domain"], m["local"]
        if at == "at" and not regex.search(r"(?i)dot|ponto|punto|\[", domain):
            continue
        if at == "at" and not (any(c in local for c in "._+0123456789") or regex.search(r"(?i)(?: dot | ponto | punto )", domain)):
            continue
        last = regex.split(_DOT, domain, flags=regex.I)[-1]
        before, after = _around(text, m.start(), m.end())
        plain = at == "@" and regex.fullmatch(r"[\p{L}\d.\-]+", domain) is not None
        votes = _vote(plain) + _vote(not plain) + _vote(last.isalpha() and 2 <= len(last) <= 12, not last.isalpha())
        votes += _vote(bool({"mail", "email", "e-mail", "correo", "enviadas", "enviar", "sent", "write", "escreva", "escriba", "procure", "para", "to", "from", "de", "a", "por"} & set(before)))
        yield "email", m.start(), m.end(), votes, before, after, "plain" if plain else at


def _number_matches(text: str) -> Iterator[regex.Match]:
    """Matches of NUMBER around runs of digits that are long enough for it."""
    done = 0
    for run in DIGITS.finditer(text):
        if run.end() <= done:
            continue
        for m in NUMBER.finditer(text, max(done, run.start() - 4), min(len(text), run.end() + 4)):
            done = m.end()
            yield m


def _numbers(text: str) -> Iterator[tuple]:
    for m in _number_matches(text):
        value = regex.sub(r" +", " ", m["number"])
        digits = sum(c.isdigit() for c in value)
        if digits < 7 or digits > 15:
            continue
        phone, identity = PHONE_SHAPE.fullmatch(value) is not None, ID_SHAPE.fullmatch(value) is not None
        if not phone and not identity:
            continue
        before, after = _around(text, m.start(), m.end())
        near = set(before)
        words_phone, words_id = bool(near & PHONE_WORDS), bool(near & ID_WORDS)
        words_other = bool(near & NUMBER_OTHER) or bool({"pontos", "puntos", "points", "fixed", "corrigiu", "corrigio"} & set(after[:1]))
        if FIELD_AFTER_STREET.search(text[max(0, m.start() - 90) : m.start()]):
            words_phone, words_id = True, False
        elif FIELD_BEFORE_STREET.match(text[m.end() : m.end() + 16]):
            words_phone, words_id = False, True
        bare, shape = value.isdigit(), _shape(value)
        hex_like = bool(regex.search(r"(?<![A-Za-z])[0-9a-f]{2} $", text[max(0, m.start() - 3) : m.start()])) or bool(regex.match(r" ?[0-9a-f]{1,2}(?: [0-9a-f]{2})", text[m.end() : m.end() + 6]))
        cell = bool(regex.search(r"[|;\t]\s*$|\s{3}$", text[max(0, m.start() - 4) : m.start()])) and bool(regex.match(r"\s*[|;\t]|\s{3}", text[m.end() : m.end() + 4]))
        common = _vote(False, words_other) + _vote(False, hex_like or (cell and not (phone or identity)))
        if phone:
            strong = value[0] in "+(" or "xx" in value or shape in ("999-999-9999", "999.999.9999")
            yield "phone", m.start(), m.end(), _vote(strong, bare and not words_phone) + _vote(words_phone, words_id and not words_phone) + common + _vote(not identity, identity and words_id), before, after, shape
        if identity:
            strong = not bare and not phone
            yield "id_number", m.start(), m.end(), _vote(strong, bare and not words_id) + _vote(words_id, words_phone and not words_id) + common + _vote(not phone, phone and words_phone), before, after, shape


def _addresses(text: str, low: str) -> Iterator[tuple]:
    lower_text = text.islower()
    for m in ADDRESS.finditer(text) if any(s in low for s in STREET_STARTS) else ():
        words = [w for w in regex.split(r"[ ]+", m["name"]) if fold(w.strip(".")) not in CONNECTORS]
        if not words or not (lower_text or words[0][:1].isupper()):
            continue
        before, after = _around(text, m.start(), m.end())
        number = m["number"].lower()
        votes = _vote(True) + _vote(all(w[:1].isupper() for w in words), not lower_text and not all(w[:1].isupper() for w in words)) + _vote(number == "s/n" or "," in text[m.end("name") : m.start("number") + 1] or not number[0].isdigit())
        votes += _vote(bool({"endereco", "na", "no", "em", "moro", "morador", "para", "marcada", "address", "at", "direccion", "e", "en"} & set(before[-2:])), bool({"meses", "anos", "dias", "semanas", "months"} & set(after[:1])))
        yield "address", m.start(), m.end(), votes, before, after, fold(m["kind"])
    for m in ADDRESS_EN.finditer(text) if any(s in low for s in STREET_ENDS) else ():
        before, after = _around(text, m.start(), m.end())
        votes = _vote(True) + _vote(True) + _vote(bool(regex.match(r"[ ]*,[ ]*(?:apt|flat|suite|unit)", text[m.end() : m.end() + 9].lower()))) + _vote(bool({"at", "to", "address", "living", "and", "in", "live", "went", "booked"} & set(before[-1:])))
        yield "address", m.start(), m.end(), votes, before, after, fold(m["kind"])


def _names(text: str) -> Iterator[tuple]:
    done = -1
    for m in CAPITAL.finditer(text):
        if m.start() < done or fold(m.group()) not in GIVEN:
            continue
        start, end, more = m.start(), m.end(), 0
        while (n := FOLLOWS.match(text, end)) and more < 5 and "\n\n" not in n.group():
            if "\n" in n.group() and (more or text[n.end() : n.end() + 1] == ":"):
                break
            if n["next"].isupper() and len(n["next"]) > 1 and not text[start:end].isupper():
                break
            end, more = n.end(), more + 1
        turned = regex.search(r"(?<![\w@])(\p{Lu}[\p{L}\p{M}'’\-]+),[ ]+$", text[max(0, start - 40) : start])
        reverse = False
        if turned and fold(turned[1]) not in GIVEN | OPENERS and start - len(turned[0]) >= done:
            reverse = True
            start -= len(turned[0])
        if not more and not reverse:
            continue
        done = end
        before, after = _around(text, start, end)
        prior = regex.search(r"([\p{L}\p{M}'’\-]+)(\.?)[ ]+$", text[max(0, start - 30) : start])
        prior = fold(prior[1]) if prior and not (prior[2] and len(prior[1]) > 4) else ""
        inside = [fold(w) for w in WORD.findall(text[start:end])]
        organisation = prior in ORGANISATION or bool(set(after[:1]) & ORGANISATION and text[end : end + 2].strip()[:1].isupper()) or bool(set(inside[1:]) & ORGANISATION)
        two_given = sum(w in GIVEN for w in inside) > 1
        cased = text[m.start() : m.end()].isupper() and text[end : end + 12].isupper()
        votes = _vote(True) + _vote(more > 0 and not cased, cased) + _vote(False, organisation) + _vote(prior in NAME_BEFORE or not prior) + _vote(two_given or reverse) + _vote(any(c in inside for c in ("de", "dos", "da", "das", "do")))
        yield "name", start, end, votes, before, after, "reverse" if reverse else f"given{min(more, 3)}"


LABELLED = regex.compile(
    r"(?<![\p{L}\d])(?:(?:[Ss]ra?|[Ss]rta|[Dd]ra?|[Mm]rs?|[Mm]s|[Mm]me|[Mm]lle|NOME|[Nn]ome|NAME|[Nn]ame|[Nn]ombre|[Nn]om)[.:]|[Dd]ona|[Ss]eñora?|[Ss]enhora?)[ ]+(?P<name>\p{Lu}[\p{L}\p{M}'’\-]+(?:[ ]+(?:(?:de|da|do|dos|das|del|la|von|van)[ ]+)?\p{Lu}[\p{L}\p{M}'’\-]+){1,4})"
)


def _labelled_names(text: str, known: set[int]) -> Iterator[tuple]:
    """Names after a title or a label whose given name the gazetteer does not have: it says nothing about these."""
    for m in LABELLED.finditer(text):
        if m.start("name") in known:
            continue
        start, end = m.span("name")
        before, after = _around(text, start, end)
        inside = [fold(w) for w in WORD.findall(m["name"])]
        if set(inside) & ORGANISATION or inside[0] in OPENERS:
            continue
        votes = "0" + _vote(True) + "0" + _vote(True) + "0" + _vote(any(c in inside for c in ("de", "dos", "da", "das", "do")))
        yield "name", start, end, votes, before, after, "labelled"


def propose(text: str | None) -> list[tuple]:
    """Proposed spans of a text: (type, start, end, votes, features)."""
    if not text:
        return []
    if not text.isascii():
        for space in _SPACES:
            text = text.replace(space, " ")
    low, found = text.lower(), []
    if "@" in text or "arroba" in low or regex.search(r"(?i)[\[({ ]at[\])} ]", text):
        found += _emails(text)
    found += _numbers(text)
    found += _addresses(text, low)
    names = list(_names(text))
    found += names
    if "." in text or ":" in text or "don" in low or "se" in low:
        found += _labelled_names(text, {n[1] for n in names})
    return [(kind, start, end, votes, _features(kind, votes, before, after, shape)) for kind, start, end, votes, before, after, shape in found]


def _propose_column(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"pii_type": k, "start": s, "end": e, "votes": v, "features": f} for k, s, e, v, f in propose(t if isinstance(t, str) else None)] for t in texts], dtype=object)


def proposed_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """df without the text, with `spans`: the proposed spans of each row that has any."""
    propose_udf = F.pandas_udf(_propose_column, SPANS)
    kept = [c for c in df.columns if c not in (text, "spans")]
    return df.select(*kept, propose_udf(F.col(text)).alias("spans")).where("size(spans) > 0")


def label_reliability(counts: list[tuple[str, str, int]], rounds: int = 60) -> dict[tuple[str, str], float]:
    """Expectation-maximisation on vote patterns (type, votes, count): probability that a span with these votes is a true one."""
    result = {}
    for kind in sorted({k for k, _, _ in counts}):
        rows = [(v, n) for k, v, n in counts if k == kind]
        votes = np.array([["-0+".index(c) for c in v] for v, _ in rows])
        n = np.array([c for _, c in rows], float)
        belief = np.clip(0.55 + 0.18 * (votes - 1).sum(1) - 0.9 * (votes == 0).any(1), 0.02, 0.98)
        for _ in range(rounds):
            weight = np.stack([(1 - belief) * n, belief * n])
            prior = (weight.sum(1) + 1) / (weight.sum() + 2)
            score = np.log(prior)[:, None] + np.zeros((2, len(n)))
            for j in range(votes.shape[1]):
                table = np.stack([[weight[c][votes[:, j] == v].sum() for v in range(3)] for c in range(2)])
                prior_votes = np.array([[0.6, 0.3, 0.1], [0.1, 0.4, 0.5]]) * (2 + 0.02 * n.sum())
                table = table + prior_votes
                table /= table.sum(1, keepdims=True)
                score += np.log(table[:, votes[:, j]])
            belief = 1 / (1 + np.exp(np.clip(score[0] - score[1], -30, 30)))
        result |= {(kind, v): float(b) for (v, _), b in zip(rows, belief)}
    return result


def fit_span_classifier(features: list[list[int]], target: np.ndarray, steps: int = 150) -> np.ndarray:
    """Weights of a logistic classifier on hashed features, by full-batch gradient steps with per-weight scaling."""
    weights, scale = np.zeros(WIDTH), np.full(WIDTH, 1e-6)
    if not features:
        return weights
    sizes = np.fromiter(map(len, features), np.int64, len(features))
    row, column = np.repeat(np.arange(len(features)), sizes), np.concatenate([np.asarray(f, np.int64) for f in features])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[column], len(features)), -30, 30)))
        gradient = np.bincount(column, (p - target)[row], WIDTH) / len(features) + 1e-5 * weights
        scale += gradient**2
        weights -= 0.25 * gradient / np.sqrt(scale)
    return weights


def fit(spans: DataFrame) -> np.ndarray:
    """Weights of the span classifier from the proposed spans of all rows; spans is read twice (counts and training sample)."""
    each = spans.select(F.explode("spans").alias("s")).select("s.*")
    counts = [(r[0], r[1], r[2]) for r in each.groupBy("pii_type", "votes").count().collect()]
    belief = label_reliability(counts)
    ranked = spans.select(F.explode("spans").alias("s"), F.xxhash64(*[c for c in spans.columns if c != "spans"]).alias("h")).select("s.pii_type", "s.votes", "s.features", F.xxhash64("h", "s.start", "s.pii_type").alias("r"))
    rows = []
    for kind in TYPES:
        rows += bounded_sample(ranked.where(F.col("pii_type") == kind), F.col("r"), TRAIN_SPANS, sum(n for k, _, n in counts if k == kind)).select("pii_type", "votes", "features").collect()
    return fit_span_classifier([r["features"] for r in rows], np.array([belief[(r["pii_type"], r["votes"])] for r in rows]))


def choose(spans: list, weights: np.ndarray) -> list[tuple[int, int, str]]:
    """Accepted, non-overlapping spans of one text in reading order."""
    scored = []
    for s in spans:
        score = weights[np.asarray(s["features"], np.int64)].sum()
        if score > 0:
            scored.append((-score, s["start"], -s["end"], s["pii_type"]))
    taken: list[tuple[int, int, str]] = []
    for _, start, end, kind in sorted(scored):
        if all(-end <= a or start >= b for a, b, _ in taken):
            taken.append((start, -end, kind))
    return sorted(taken)


def found_places(spans: DataFrame, weights: np.ndarray) -> DataFrame:
    """Accepted spans, one row each: the columns of spans, pii_type and start_pos."""
    shared = spans.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("array<struct<start_pos:int,end_pos:int,pii_type:string>>")
    def accept(column: pd.Series) -> pd.Series:
        return pd.Series([[{"start_pos": a, "end_pos": b, "pii_type": k} for a, b, k in choose(s, shared.value)] for s in column], dtype=object)

    kept = [c for c in spans.columns if c != "spans"]
    return spans.select(*kept, F.explode(accept("spans")).alias("p")).select(*kept, "p.pii_type", "p.start_pos", "p.end_pos")


def redact(df: DataFrame, weights: np.ndarray, text: str = "text", out: str = "redacted") -> DataFrame:
    """df with the text in which accepted spans are typed placeholders; a narrow map."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        results = []
        for t in texts:
            if not isinstance(t, str):
                results.append(None)
                continue
            parts, last = [], 0
            for a, b, kind in choose([dict(zip(("pii_type", "start", "end", "votes", "features"), s)) for s in propose(t)], shared.value):
                parts += [t[last:a], PLACEHOLDER[kind]]
                last = b
            results.append("".join([*parts, t[last:]]))
        return pd.Series(results, dtype=object)

    return df.withColumn(out, mask(F.col(text)))
