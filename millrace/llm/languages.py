"""Language of documents and of their parts: averaged hashed subword embeddings with a linear softmax.

A word's features are itself and its character 3- and 4-grams, hashed into `BUCKETS` embeddings of `DIM` numbers. A
sentence is the average of its features' embeddings; a linear softmax gives the languages' probabilities. Embeddings
and softmax are trained by stochastic gradient descent in numpy on sentences of at most `TRAIN_DOCUMENTS` documents
(chosen by hash), whose stated language agrees with the common words they use. A temperature and the confidence below
which a sentence is rejected are fitted on sentences held out. As the model is linear, a word's share of the scores is
computed once and looked up. Sentences of a document get the most probable sequence of languages, where every change
costs something; rejected sentences take their neighbours' language; runs under 12 words make no segment.

Defined cases: null and blank texts have no segments; a text in which every sentence is rejected has none either;
text without sentence marks is judged in stretches of words; repeated rows give equal rows; texts are read whole; with
no usable training sentence nothing is labelled.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textstats
from millrace.llm.samples import bounded_sample

BUCKETS, DIM = 1 << 15, 16
TRAIN_DOCUMENTS = 1500
EPOCHS, BATCH, RATE, LEAST_STEPS = 4, 128, 0.5, 400
SEGMENT_WORDS = 12
STRETCH = 12
CHANGE_COST = 4.0
LANGUAGES = ("pt", "en", "es", "fr")

# Spellings of language names and the marks for "not known".
LANGUAGE_NAMES = {
    "pt": "pt por ptb pt-br pt-pt português portugues portuguese portugués portugais brazilian brasileiro",
    "en": "en eng english inglês ingles inglés anglais",
    "es": "es spa esp spanish español espanol espanhol castellano castilian espagnol",
    "fr": "fr fra fre french français francais francês frances francés",
}
UNKNOWN_NAMES = frozenset("unknown und unk undefined undetermined none null nan n/a na n.a. nd n/d - -- ? ?? xx zxx mul mis other outro auto desconhecido desconhecida desconocido inconnu".split())
_NAMES = {name: code for code, names in LANGUAGE_NAMES.items() for name in names.split()}
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[.!?…][\"'”’»)])\s+|\n+")
_WORD = textstats._WORD
_ADDRESS = regex.compile(r"\S*(?:@|://)\S*")


@functools.lru_cache(10_000)
def language_code(label: str | None) -> str | None:
    """pt, en, es or fr for any spelling or regional form of these; None for missing; other labels in lower case."""
    if label is None:
        return None
    name = regex.sub(r"\s+", " ", label.strip().lower().replace("_", "-"))
    if not name or name in UNKNOWN_NAMES:
        return None
    return _NAMES.get(name) or _NAMES.get(regex.split(r"[-. (]", name)[0]) or name


def word_features(word: str) -> np.ndarray:
    marked = f"<{word}>"
    grams = [marked] + [marked[i : i + n] for n in (3, 4) for i in range(len(marked) - n + 1)]
    return np.array([zlib.crc32(g.encode("utf-8", "replace")) % BUCKETS for g in grams], np.int64)


def sentences(text: str) -> list[tuple[list[str], int]]:
    """Lower-case words of each sentence and how many words it has; long stretches without marks are cut.

    Addresses of mail and pages and capitalised words inside a sentence (names, mostly) count but say nothing about
    the language.
    """
    found = []
    for part in _SENTENCE.split(textstats._TAG.sub(" ", text) if "<" in text else text):
        if not part:
            continue
        if "@" in part or "://" in part:
            part = _ADDRESS.sub(" ", part)
        tokens = _WORD.findall(part)
        if not tokens:
            continue
        lowered = " ".join(tokens).lower().split(" ")
        loud = part.isupper()
        width = STRETCH if len(tokens) > 4 * STRETCH else len(tokens)
        for i in range(0, len(tokens), width):
            low = lowered[i : i + width]
            words = low if loud else [low[0], *[a for a, b in zip(low[1:], tokens[i + 1 : i + width]) if a[0] == b[0]]]
            found.append((words, len(low)))
    return found


class LanguageModel:
    def __init__(self, embeddings: np.ndarray, softmax: np.ndarray, bias: np.ndarray, temperature: float, least: float, kept: tuple[str, ...] = LANGUAGES):
        self.scores = embeddings @ softmax
        self.bias, self.temperature, self.least, self.kept = bias, temperature, least, kept
        self._codes: dict[str, int] = {}
        self._table, self._count = np.zeros((1024, len(kept))), np.zeros(1024)

    def __getstate__(self) -> dict:
        return {"scores": self.scores.astype(np.float32), "bias": self.bias, "temperature": self.temperature, "least": self.least, "kept": self.kept}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._codes, self._table, self._count = {}, np.zeros((1024, len(self.kept))), np.zeros(1024)

    def _code(self, word: str) -> int:
        code = self._codes.get(word)
        if code is None:
            code = self._codes[word] = len(self._codes)
            if code >= len(self._count):
                self._table, self._count = np.vstack([self._table, np.zeros_like(self._table)]), np.concatenate([self._count, np.zeros_like(self._count)])
            features = word_features(word)
            self._table[code], self._count[code] = self.scores[features].sum(0), len(features)
        return code

    def log_probabilities(self, parts: list[list[str]]) -> np.ndarray:
        words = [w for p in parts for w in p]
        found = list(map(self._codes.get, words))
        if None in found:
            if len(self._codes) > 300_000:
                self._codes.clear()
            found = list(map(self._code, words))
        codes = np.array(found, np.int64)
        starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
        raw = np.add.reduceat(self._table[codes], starts, axis=0) / np.add.reduceat(self._count[codes], starts)[:, None]
        z = (raw + self.bias) / self.temperature
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def segments(self, text: str | None) -> list[tuple[str, float, int]]:
        """(language, confidence, words) of each segment in reading order."""
        parts = sentences(text) if text and text.strip() else []
        if not parts:
            return []
        logp = np.maximum(self.log_probabilities([p for p, _ in parts]), -9.0)
        size = np.array([n for _, n in parts])
        told = np.array([len(p) for p, _ in parts])
        sure = np.exp(logp.max(1)) >= self.least
        if not sure.any():
            return []
        weight = sure * np.minimum(1.0, told / SEGMENT_WORDS)
        weighed = logp * weight[:, None]
        top = weighed.argmax(1)[weight > 0]
        if len(top) and (top == top[0]).all():
            p = np.exp(logp[:, top[0]])
            return [(self.kept[top[0]], round(float((size * p).sum() / size.sum()), 4), int(size.sum()))]
        if len(parts) > 1:
            best, back = weighed[0], []
            for row in weighed[1:]:
                stay = best >= best.max() - CHANGE_COST
                back.append(np.where(stay, np.arange(len(self.kept)), best.argmax()))
                best = np.where(stay, best, best.max() - CHANGE_COST) + row
            path = [int(best.argmax())]
            for step in reversed(back):
                path.append(int(step[path[-1]]))
            path = np.array(path[::-1])
        else:
            path = logp.argmax(1)
        runs: list[list] = []
        for state, words, p in zip(path, size, np.exp(logp[np.arange(len(path)), path])):
            if runs and runs[-1][0] == state:
                runs[-1][1] += words
                runs[-1][2] += words * p
            else:
                runs.append([state, int(words), words * p])
        merged: list[list] = []
        for run in [r for r in runs if r[1] >= SEGMENT_WORDS] or [max(runs, key=lambda r: r[1])]:
            if merged and merged[-1][0] == run[0]:
                merged[-1][1] += run[1]
                merged[-1][2] += run[2]
            else:
                merged.append(run)
        return [(self.kept[s], round(float(p / n), 4), int(n)) for s, n, p in merged]


def fit_model(examples: list[tuple[list[str], int]], seed: int = 7) -> LanguageModel:
    """Train on (words, language number); a tenth is held out for temperature and rejection."""
    rng = np.random.default_rng(seed)
    cache: dict[str, np.ndarray] = {}
    rows = []
    for words, _ in examples:
        rows.append(np.concatenate([cache.setdefault(w, word_features(w)) if w in cache or len(cache) < 500_000 else word_features(w) for w in words]))
    target = np.array([y for _, y in examples])
    order = rng.permutation(len(rows))
    held, train = order[: len(order) // 10], order[len(order) // 10 :]
    embeddings, softmax, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, len(LANGUAGES))), np.zeros(len(LANGUAGES))
    weight = len(train) / (len(LANGUAGES) * np.maximum(1, np.bincount(target[train], minlength=len(LANGUAGES))))
    batches = max(1, (len(train) + BATCH - 1) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // batches))
    steps, step = epochs * batches, 0
    for _ in range(epochs):
        train = rng.permutation(train)
        for i in range(0, len(train), BATCH):
            batch = train[i : i + BATCH]
            size = np.array([len(rows[b]) for b in batch])
            flat = np.concatenate([rows[b] for b in batch])
            starts = np.cumsum(size) - size
            hidden = np.add.reduceat(embeddings[flat], starts, axis=0) / size[:, None]
            z = hidden @ softmax + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), target[batch]] -= 1
            p *= weight[target[batch]][:, None]
            rate = RATE * (1 - step / steps) + 0.01
            back = (p @ softmax.T) / size[:, None]
            softmax -= rate * hidden.T @ p / len(batch) * 8
            bias -= rate * p.mean(0)
            np.add.at(embeddings, flat, -rate * np.repeat(back, size, axis=0))
            step += 1
    model = LanguageModel(embeddings, softmax, bias, 1.0, 0.0)
    if len(held):
        parts = [examples[i][0] for i in held]
        raw = model.log_probabilities(parts)
        loss = {}
        for temperature in np.exp(np.linspace(-2.5, 2.5, 41)):
            z = raw / temperature
            z = z - z.max(1, keepdims=True)
            z -= np.log(np.exp(z).sum(1, keepdims=True))
            loss[float(temperature)] = -z[np.arange(len(held)), target[held]].mean()
        model.temperature = max(0.05, min(loss, key=lambda t: loss[t]))
        logp = model.log_probabilities(parts)
        right = np.exp(logp.max(1))[logp.argmax(1) == target[held]]
        model.least = float(min(0.6, np.quantile(right, 0.002))) if len(right) else 0.0
    return model


def training_sentences(df: DataFrame, words: DataFrame, text: str = "text", label: str | None = "language", documents: int = TRAIN_DOCUMENTS) -> list[tuple[list[str], int]]:
    """Sentences of a bounded sample of documents for which label and common words agree (without label: by common words alone)."""
    common = textstats.common_words(words)
    stated = F.col(label) if label else F.lit("")
    labelled = df.where(stated.isNotNull() & (F.length(text) > 150)).select(F.col(text).alias("content"), stated.alias("stated"))
    sample = bounded_sample(labelled, F.col("content"), documents).select("content", "stated").collect()
    examples = []
    for content, stated in sample:
        code = language_code(stated) if label else textstats.measure(content, common)[1]
        if code not in common or code not in LANGUAGES:
            continue
        for part, _ in sentences(content):
            hits = {k: sum(w in v for w in part) for k, v in common.items()}
            if len(part) >= 6 and max(hits, key=lambda k: hits[k]) == code and hits[code] >= 0.2 * len(part):
                examples.append((part, LANGUAGES.index(code)))
    return examples


def label_segments(df: DataFrame, model: LanguageModel, text: str = "text", out: str = "segments") -> DataFrame:
    """df with `out`: array of (segment_no, lang, confidence, words)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<segment_no:int,lang:string,confidence:double,words:int>>")
    def run(texts: pd.Series) -> pd.Series:
        found = [shared.value.segments(t) if isinstance(t, str) else [] for t in texts]
        return pd.Series([[{"segment_no": i, "lang": g, "confidence": c, "words": n} for i, (g, c, n) in enumerate(s, 1)] for s in found], dtype=object)

    return df.withColumn(out, run(F.col(text)))


def mislabelled_segments(df: DataFrame, model: LanguageModel, words: DataFrame, key: str = "id", text: str = "text", label: str = "language", least_words: int = 25) -> DataFrame:
    """Segments of prose of at least least_words words whose label is missing or wrong or which mixes languages."""
    shared = df.sparkSession.sparkContext.broadcast((model, textstats.common_words(words)))

    @F.pandas_udf("array<struct<segment_no:int,lang:string,confidence:double>>")
    def run(texts: pd.Series, labels: pd.Series) -> pd.Series:
        judge, common = shared.value
        out = []
        for content, stated in zip(texts, labels):
            rows: list[dict] = []
            if isinstance(content, str) and textstats.count_words(content) >= least_words:
                found = judge.segments(content)
                wrong = len(found) > 1 or bool(found) and language_code(stated if isinstance(stated, str) else None) != found[0][0]
                if wrong and textstats.reads_as_prose(textstats.measure(content, common)):
                    rows = [{"segment_no": i, "lang": g, "confidence": c} for i, (g, c, _) in enumerate(found, 1)]
            out.append(rows)
        return pd.Series(out, dtype=object)

    return df.select(key, F.explode(run(F.col(text), F.col(label))).alias("s")).select(key, "s.segment_no", "s.lang", "s.confidence")
