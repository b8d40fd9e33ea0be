"""Text statistics of documents, their distance from the prose of their language, and what kind of text they are.

Every line is judged by its form (sentence, list item, row of fields, noise); a document's statistics are its counts,
ratios and the shares of its words in lines of each form. For each language the mean and covariance of the statistics
of prose are estimated robustly: start from documents made of sentences, then drop those beyond the 97.5 % quantile
and estimate mean and correlations again; the spreads stay those of all the documents it started from, as trimming
would take prose without end marks or in capitals for impossible. A document's squared Mahalanobis distance is the sum
of one contribution per statistic. A document is no prose if it is as far from the mean as mean prose would be with half
of its words moved out of sentences into lines of another form; it is a list, a table or junk by the largest
contribution of these forms. Moments are summed in partial sums over all documents; only one row of sums a language
reaches the driver.

Defined cases: null and blank texts have zero counts, no language and kind `blank`; texts of few words and characters
are `stub`; a null stored count is no finding; repeated rows give equal rows; whole texts are read; a
language with fewer than `LEAST` prose documents has the moments of all languages together, and `PRIOR` moments hold
where these are fewer too.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATISTICS = (
    "mean_word_length",
    "symbol_ratio",
    "digit_ratio",
    "upper_ratio",
    "line_end_ratio",
    "common_ratio",
    "log_words_per_line",
    "marks_per_word",
    "sentence_share",
    "list_share",
    "table_share",
    "noise_share",
    "odd_word_ratio",
)
LEAST = 50
PRIOR_MEAN = (5.0, 0.03, 0.01, 0.05, 0.9, 0.4, 3.0, 0.08, 1.0, 0.0, 0.0, 0.0, 0.01)
PRIOR_SPREAD = (1.0, 0.03, 0.03, 0.1, 0.25, 0.1, 1.0, 0.04, 0.05, 0.05, 0.02, 0.02, 0.03)
"""Mean and spread of the statistics of prose where there is too little of it to estimate them."""
STUB_WORDS, STUB_CHARS = 15, 150
COMMON_ROWS = 20_000

_TAG = regex.compile(r"</?[A-Za-z][^<>]{0,200}>")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_CELL = regex.compile(r"(?i)<t[dhr]\b")
_ITEM = regex.compile(r"(?i)<li\b")
_RULE = regex.compile(r"[-=+|: ]{3,}")
_COLUMNS = regex.compile(r" {2,}")
_INNER_END = regex.compile(r"[.!?][\"'”»)]? ")
_MARK = regex.compile(r"[.!?…](?:\s|$|[\"'”’»])")
_MARKER = regex.compile(r"^\s*(?:[-*+•·‣▪◦●○■□➢✓✔»>][ \t]|\d{1,3}[.)ºª°]?[.)\-][ \t]|\(?\d{1,3}\)[ \t]|\(?[a-zA-Z]{1,2}\)[ \t]|\(?[ivxIVX]{1,5}[.)][ \t]|\[[ xX]?\][ \t])")
_CODE = regex.compile(
    r"(?:[;{}]\s*$|^\s*[{}\])]+;?$|\)\s*\{|^\s*@\w+|^\s*[.#]?[\w\-]+\s*\{|^\s*(?:var|let|const|function|import|from|def|class|for|while|if|return|select|insert|update|elif|else)\b.*(?:[({:=]|\bin\b|,)|\w+\([^)]*\)\s*[;{]|^\s*<(?:script|style|!--)|^\s*//|^\s*#include|\w+\s*[+\-*/]?=\s*[\w\"'(]+)"
)
_HEX = regex.compile(r"^(?:[0-9a-fA-F]{2,8}[ :]){6,}")
_BLOB = regex.compile(r"[A-Za-z0-9+/=_\-]{36,}")
_END = regex.compile(r"[.!?…][\"'”’»)\]]*$")
_PAIR = regex.compile(r"^[^:.!?]{2,70}: [^.!?]{0,70}\([^()]{0,70}\)$")
_SYMBOL = regex.compile(r"[^\w\s|;,.:\-()'\"/]")
_ODD = regex.compile(r"(?i)[bcdfghjklmnpqrstvwxz]{5,}|^[bcdfghjklmnpqrstvwxz]{3,}$|(.)\1\1")


def _classes() -> np.ndarray:
    """Bits by code point of the basic plane: 1 letter, 2 digit, 4 upper case, 8 space, 16 letter or digit."""
    marks = np.zeros(1 << 16, np.uint8)
    for code in range(1 << 16):
        c = chr(code)
        marks[code] = c.isalpha() + 2 * c.isdigit() + 4 * c.isupper() + 8 * c.isspace() + 16 * c.isalnum()
    return marks


_CLASS: list[np.ndarray] = []


def _class_counts(text: str) -> np.ndarray:
    """How many characters have each bit; characters beyond the basic plane count as symbols."""
    if not _CLASS:
        _CLASS.append(_classes())
    marks = _CLASS[0][np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 0xFFFF)]
    counts = np.bincount(marks, minlength=32)
    return np.array([counts[_WITH_BIT[b]].sum() for b in range(5)])


_WITH_BIT = [np.array([m for m in range(32) if m >> b & 1]) for b in range(5)]


@functools.lru_cache(200_000)
def _is_odd(word: str) -> bool:
    return _ODD.search(word) is not None


def common_words(table: DataFrame) -> dict[str, dict[str, frozenset[str]]]:
    """language -> words; the table is a fixed list, its size is checked."""
    rows = table.where("word is not null and lang is not null").select("lang", "word").distinct().limit(COMMON_ROWS + 1).collect()
    if len(rows) > COMMON_ROWS:
        raise ValueError(f"more than {COMMON_ROWS} common words")
    words: dict[str, set[str]] = {}
    for lang, word in rows:
        words.setdefault(lang, set()).add(word.lower())
    return {k: frozenset(v) for k, v in sorted(words.items())}


def _cells(line: str) -> list[str]:
    return [c.strip() for c in regex.split(r"\||\t|;| {3,}", line.strip().strip("|"))]


def line_form(line: str, raw: str, words: list[str], share: float) -> str:
    """sentence, list, table, noise or title (a short line without end mark, judged by its neighbours).

    line is raw without markup, words its words and share the part of them that are common words.
    """
    marked = "<" in raw
    if marked and _CELL.search(raw):
        return "table"
    item = marked and _ITEM.search(raw) is not None
    if not line:
        return "empty"
    letters = sum(map(len, words))
    ended = _END.search(line) is not None
    prosaic = len(words) >= 6 and share >= 0.16
    if item:
        return "list"
    solid = len(line) - line.count(" ")
    if len(line) > 12 and letters < 0.8 * solid and len(_SYMBOL.findall(line)) > 0.3 * solid:
        return "noise"
    if line.count("|") >= 2 or "\t" in line and not (ended and prosaic):
        return "table"
    if not prosaic and _RULE.fullmatch(line):
        return "table"
    if line.count(";") >= 2 and "; " not in line and max(len(p.split()) for p in line.split(";")) <= 7 and letters > 0.3 * len(line) and not _CODE.search(line):
        return "table"
    if "   " in line and not ended and len(columns := _COLUMNS.split(line)) >= 2 and max(len(c.split()) for c in columns) <= 7:
        return "table"
    if ": " in line and line[-1] == ")" and len(words) <= 16 and _PAIR.fullmatch(line):
        return "table"
    if not prosaic and (_HEX.match(line) or (len(words) < 12 and "://" not in line and _BLOB.search(line))):
        return "noise"
    if not prosaic and _CODE.search(line) and not _MARKER.match(line):
        return "noise"
    if letters < 0.45 * solid and len(line) > 12:
        return "noise"
    if _MARKER.match(line) and not (ended and len(words) >= 9 and prosaic):
        return "list"
    for mark in ("; ", " / ", " • ", " · ", " – ", ", "):
        if line.count(mark) >= 3:
            items = [p for p in line.rstrip(" .;").split(mark) if p.strip()]
            if len(items) >= (6 if mark == ", " else 4) and max(len(p.split()) for p in items) <= 10 and not _INNER_END.search(line) and (mark != ", " or not ended):
                return "list"
    if len(words) >= 6 and share < 0.12:
        return "noise"
    return "sentence" if ended or len(words) > 12 or "," in line else "title"


def count_words(text: str) -> int:
    """Words separated by spaces, tabs or line breaks."""
    return sum(map(bool, text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")))


def measure(text: str | None, common: dict[str, frozenset[str]]) -> tuple[int, str | None, str, list[float]]:
    """(word count, language by common words, first kind, statistics) of one text."""
    if not text or not text.strip():
        return 0, None, "blank", [0.0] * len(STATISTICS)
    known = _union(tuple(common.values()))
    tokens = count_words(text)
    raw = [x for x in text.replace("\r", "\n").split("\n") if x.strip()]
    lines = [(_TAG.sub(" ", x) if "<" in x else x).strip() for x in raw]
    words_of = [_WORD.findall(x) for x in lines]
    lowered_of = [[w.lower() for w in words] for words in words_of]
    words = [w for found in words_of for w in found]
    seen = Counter(w for found in lowered_of for w in found if w in known)
    hits = {k: sum(n for w, n in seen.items() if w in v) for k, v in common.items()}
    lang = max(hits, key=lambda k: hits[k]) if hits and max(hits.values()) else None
    cut = common[lang] if lang and len(lines) == 1 else known
    forms = [line_form(x, y, found, sum(w in cut for w in low) / len(low) if low else 0.0) for x, y, found, low in zip(lines, raw, words_of, lowered_of)]
    sizes = [max(1, len(x.split())) for x in lines]
    shares = dict.fromkeys(("sentence", "list", "table", "noise"), 0.0)
    many = 10 * forms.count("title") >= 6 * len(forms) and len(forms) >= 4
    for i, form in enumerate(forms):
        if form == "title":
            neighbours = forms[max(0, i - 1) : i] + forms[i + 1 : i + 2]
            form = "list" if many and {"title", "list"} & set(neighbours) else "sentence"
        if form == "noise" and _BLOB.search(lines[i]):
            sizes[i] = max(sizes[i], len(lines[i]) // 6)
        if form in shares:
            shares[form] += sizes[i]
    total = sum(shares.values()) or 1.0
    plain = "\n".join(lines)
    letters, digits, upper, spaces, alnum = (int(n) for n in _class_counts(plain))
    chars = max(1, len(plain))
    solid = max(1, chars - spaces)
    stats = [
        sum(map(len, words)) / len(words) if words else 0.0,
        max(0, solid - alnum) / solid,
        digits / solid,
        upper / max(1, letters),
        sum(_END.search(x) is not None for x in lines) / len(lines),
        (hits[lang] / len(words)) if lang and words else 0.0,
        float(np.log1p(tokens / len(lines))),
        len(_MARK.findall(plain)) / max(1, len(words)),
        shares["sentence"] / total,
        shares["list"] / total,
        shares["table"] / total,
        shares["noise"] / total,
        sum(map(_is_odd, words)) / max(1, len(words)),
    ]
    kind = "stub" if tokens < STUB_WORDS and chars < STUB_CHARS else "text"
    return tokens, lang, kind, [float(s) for s in stats]


def reads_as_prose(measured: tuple[int, str | None, str, list[float]]) -> bool:
    """Most words are in lines of sentences that use common words."""
    stats = measured[3]
    return measured[2] == "text" and stats[8] >= 0.5 and stats[5] >= 0.1


@functools.lru_cache(8)
def _union(sets: tuple[frozenset[str], ...]) -> frozenset[str]:
    return frozenset().union(*sets)


def statistics(df: DataFrame, words: DataFrame, text: str = "text", chosen: Column | None = None) -> DataFrame:
    """df without the text, with `m`: word_count, lang, kind (blank, stub, text) and the statistics as an array."""
    common = df.sparkSession.sparkContext.broadcast(common_words(words))

    @F.pandas_udf("struct<word_count:int,lang:string,kind:string,stats:array<double>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [measure(t if isinstance(t, str) else None, common.value) for t in texts]
        return pd.DataFrame({"word_count": [r[0] for r in rows], "lang": [r[1] for r in rows], "kind": [r[2] for r in rows], "stats": [r[3] for r in rows]}, dtype=object)

    kept = [c for c in df.columns if c not in (text, "m")]
    return df.select(*kept, run(F.col(text)).alias("m"))


def quantile_of_chi2(share: float, degrees: int) -> float:
    """Wilson and Hilferty's approximation."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(share)
    return degrees * (1 - 2 / (9 * degrees) + z * np.sqrt(2 / (9 * degrees))) ** 3


K = len(STATISTICS)


def _moments(measured: DataFrame, model: dict | None, cutoff: float) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """lang -> (n, sums, products) over the prose documents within the cutoff of the model so far."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            x = np.stack(batch["stats"].to_numpy()) if len(batch) else np.zeros((0, K))
            lang = batch["lang"].to_numpy()
            keep = x[:, SENTENCES] >= 0.5
            for name in set(lang[keep]):
                rows = x[keep & (lang == name)]
                if model is not None:
                    rows = rows[distances(rows, model, name)[0] <= cutoff]
                if len(rows):
                    sums[name] = sums.get(name, 0) + np.concatenate([[len(rows)], rows.sum(0), (rows.T @ rows).ravel()])
        yield pd.DataFrame({"lang": list(sums), "v": [v.tolist() for v in sums.values()]})

    rows = measured.where("m.kind = 'text' and m.lang is not null").select("m.lang", "m.stats").mapInPandas(run, "lang string, v array<double>")
    total = rows.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()
    found: dict[str, np.ndarray] = {}
    for lang, i, value in total:
        found.setdefault(lang, np.zeros(1 + K + K * K))[i] = value
    if found:
        found["*"] = sum(found.values())
    return {k: (v[0], v[1 : 1 + K], v[1 + K :].reshape(K, K)) for k, v in found.items()}


Model = dict[str, tuple[np.ndarray, np.ndarray, float]]
SENTENCES, FORMS = 8, {"list": 9, "table": 10, "junk": 11}


def _entry(mean: np.ndarray, correlation: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, inverse covariance, and the distance of mean prose half of whose words are in lines of another form."""
    covariance = correlation * np.outer(spread, spread)
    covariance[np.diag_indices(K)] = spread**2 * 1.02
    inverse = np.linalg.inv(covariance)
    moves = np.zeros((len(FORMS), K))
    moves[:, SENTENCES] = -0.5
    moves[np.arange(len(FORMS)), list(FORMS.values())] = 0.5
    return mean, inverse, float(((moves @ inverse) * moves).sum(1).min())


def _spread(n: float, sums: np.ndarray, products: np.ndarray) -> np.ndarray:
    return np.maximum(np.sqrt(np.maximum(np.diag(products) / n - (sums / n) ** 2, 0)), 0.02)


def _model(moments: dict, spreads: dict[str, np.ndarray]) -> Model:
    model = {"*": _entry(np.array(PRIOR_MEAN), np.eye(K), np.array(PRIOR_SPREAD))}
    for name, (n, sums, products) in moments.items():
        if n >= LEAST:
            mean, own = sums / n, _spread(n, sums, products)
            model[name] = _entry(mean, (products / n - np.outer(mean, mean)) / np.outer(own, own), spreads[name])
    return model


def prose_model(measured: DataFrame, rounds: int = 2) -> Model:
    """Robust mean, inverse covariance and cutoff of the statistics of prose, by language; "*" is all together."""
    trim = quantile_of_chi2(0.975, K)
    moments = _moments(measured, None, trim)
    spreads = {k: _spread(*v) for k, v in moments.items()}
    model = _model(moments, spreads)
    for _ in range(rounds):
        model = _model(_moments(measured, model, trim), spreads)
    return model


def distances(x: np.ndarray, model: dict, lang: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and each statistic's contribution to them."""
    mean, inverse, _ = model.get(lang or "*", model["*"])
    z = x - mean
    parts = z * (z @ inverse)
    return parts.sum(1), parts


def judge(measured: DataFrame, model: dict) -> DataFrame:
    """The kind of each document (prose, list, table, junk, stub, blank), its distance and the statistics' contributions."""
    shared = measured.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<kind:string,distance:double,contributions:array<double>>")
    def run(m: pd.DataFrame) -> pd.DataFrame:
        out = {"kind": [], "distance": [], "contributions": []}
        for lang, kind, stats in zip(m["lang"], m["kind"], m["stats"]):
            x = np.asarray(stats, float)[None, :]
            d, parts = distances(x, shared.value, lang)
            if kind == "text":
                far = d[0] >= shared.value.get(lang or "*", shared.value["*"])[2]
                kind = max(FORMS, key=lambda k: parts[0, FORMS[k]]) if far else "prose"
            out["kind"].append(kind)
            out["distance"].append(round(float(d[0]), 6))
            out["contributions"].append([round(float(p), 6) for p in parts[0]])
        return pd.DataFrame(out, dtype=object)

    kept = [c for c in measured.columns if c != "m"]
    return measured.select(*kept, "m", run(F.col("m")).alias("j")).select(*kept, "m.word_count", "m.lang", "m.stats", "j.kind", "j.distance", "j.contributions")


def count_is_wrong(stored: Column, counted: Column) -> Column:
    """The text has at least 20 words and the stored count is off by more than a tenth."""
    return F.coalesce((counted >= 20) & (F.abs(stored - counted) * 10 > counted), F.lit(False))
