"""Pages of repeated keywords, links or product tags: bagged decision trees on weak labels, smoothed by host.

A page is read in units (lines, and sentences inside lines). Each unit is mostly links with their captions, a product
or tag line, repeated keywords, a sentence, or something else; the words of each kind and further content and link
statistics are the features. Weak labels do not read the kinds of the units but seven other signs (end marks and common
words, links, repeated words and pairs, prices, rows), each of which says spam, no spam or nothing; pages on which they
say nothing or disagree have no label. Trees are grown in numpy on bootstrap samples of at most `TRAIN_PAGES` pages,
chosen by hash, those of them that have a label, and vote on all pages; a split lies in the middle of the gap it is in.
A page's log odds are then moved by those of the other pages of its host.

Defined cases: null and blank texts are no spam; pages without a host get no smoothing; repeated rows give equal
results; whole texts are read; without pages of both labels nothing is found.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textstats
from millrace.llm.samples import bounded_sample
from millrace.session import materialize

FEATURES = (
    "link_share",
    "product_share",
    "tag_share",
    "keyword_share",
    "sentence_share",
    "list_share",
    "table_share",
    "noise_share",
    "spam_share",
    "spam_to_sentence",
    "links_per_word",
    "distinct_ratio",
    "top_word_ratio",
    "repeated_pair_ratio",
    "common_ratio",
    "marks_per_word",
    "prices_per_word",
    "log_words",
)
TRAIN_PAGES = 8000
TREES, DEPTH, BINS, LEAF = 25, 6, 32, 8
HOST_WEIGHT, HOST_PRIOR = 0.3, 20.0

_URL = regex.compile(
    r"(?i)(?:https?://|www\.)[^\s<>\"')\]]+|(?<![\w@.])[\w\-]+(?:\.[\w\-]+)+/[^\s<>\"')\]]+|(?<![\w@.+\-])(?:[a-z0-9\-]+\.)+(?:com|org|net|info|biz|edu|gov|io|co|br|pt|es|fr|uk|eu|us|site|online|shop|store|example)\b(?!\.?\w)"
)
_ANCHOR = regex.compile(r"(?is)<a\b[^>]*>(.*?)</a>|\[([^\[\]]{1,120})\]\(\s*[^()\s]*\s*\)|\[url[^\]]*\](.*?)\[/url\]")
_TAG_MARK = regex.compile(r"(?i)class\s*=\s*[\"'][^\"']*\b(?:tag|label|badge|chip|keyword)s?\b|rel\s*=\s*[\"']tag|(?<!\S)#\w{2,}")
_PRODUCT = regex.compile(r"(?i)\b(?:sku|ref|cod|cód|ean|mpn)[\-:. ]*[a-z]?\d{3,}|(?:R\$|US\$|\$|€|£)\s?\d[\d.,]*|\d+(?:[.,]\d{2})\s?(?:€|reais|eur|usd)\b|-\d{1,2}\s?%(?=\s|$)")
_PRICE_SIGNS = ("$", "€", "£", "%", "sku", "reais", "eur", "usd", "ref.", "ref:", "ref ", "ref-", "cod.", "cod:", "cod ", "cod-", "cód.", "cód:", "cód ", "ean", "mpn")
_CLOSERS, _ENDS = "\"'”’»)] ", frozenset(".!?…")
_DOTTED = re.compile(r"[A-Za-z0-9]\.[A-Za-z]{2}")
_MARK = re.compile(r"[.!?…](?:\s|$|[\"'”’»])")
_UNIT = re.compile(r"(?<=[.!?…])\s+|(?<=[.!?…][\"”’»)])\s+")
_WORD = textstats._WORD


def _units(text: str) -> list[str]:
    return [u for line in text.replace("\r", "\n").split("\n") if line.strip() for u in _UNIT.split(line) if u.strip()]


def page_features(text: str | None, common: dict[str, frozenset[str]]) -> list[float] | None:
    """The features of a page, None for a blank one."""
    if not text or not text.strip():
        return None
    known = textstats._union(tuple(common.values()))
    low = text.lower()
    linked = "://" in low or "www." in low or _DOTTED.search(low) is not None
    anchored = "](" in low or "<a" in low or "[url" in low
    tagged = "#" in low or "class" in low or "rel" in low and "tag" in low
    priced = any(k in low for k in _PRICE_SIGNS)
    units = []
    for raw in _units(low):
        urls = _URL.findall(raw) if linked and ("/" in raw or _DOTTED.search(raw)) else []
        bare = _URL.sub(" ", raw) if urls else raw
        bare = (textstats._TAG.sub(" ", bare) if "<" in bare else bare).strip()
        units.append((raw, bare, urls, _WORD.findall(bare)))
    plain_words = [w for u in units for w in u[3]]
    count = Counter(plain_words)
    total = max(1, len(plain_words))
    enough = max(3, 0.012 * total)
    frequent = {w for w, n in count.items() if n >= enough}
    pair_count = Counter(p for p in zip(plain_words, plain_words[1:]) if p[0] in frequent and p[1] in frequent)
    often = {p for p, n in pair_count.items() if n >= enough and not (p[0] in known and p[1] in known)}
    content = Counter({w: n for w, n in count.items() if n > 1 and len(w) > 2 and w not in known})
    stuffed = {w for w, n in content.items() if n >= max(4, 0.04 * total)}
    mass = dict.fromkeys(("link", "product", "tag", "keyword", "sentence", "list", "table", "noise"), 0.0)
    links = prices = 0
    for raw, bare, urls, words in units:
        captions = [next(g for g in m.groups() if g is not None) for m in _ANCHOR.finditer(raw)] if anchored else []
        marks = len(_TAG_MARK.findall(raw)) if tagged else 0
        links += max(len(urls), len(captions))
        weight = float(len(words))
        link_weight = sum(len(u) / 9 for u in urls)
        share = len([w for w in words if w in known]) / len(words) if words else 0.0
        ended = bare.rstrip(_CLOSERS)[-1:] in _ENDS
        if urls or captions:
            caption_words = sum(len(_WORD.findall(c)) for c in captions)
            caption_line = bool(urls) and weight <= 12 and share < 0.3 and raw.rstrip(_CLOSERS)[-1:] not in _ENDS
            if caption_line or link_weight + caption_words >= 0.5 * (weight + link_weight):
                mass["link"] += max(weight, 1.0) + link_weight
                continue
        found = len(_PRODUCT.findall(bare)) if priced else 0
        prices += found
        if ended and share >= 0.42 and weight >= 6 and not marks:
            mass["sentence"] += weight
            continue
        repeated = sum(p in often for p in zip(words, words[1:])) / max(1, len(words) - 1) if often else 0.0
        dense = sum(w in stuffed for w in words) / len(words) if words and stuffed else 0.0
        form = textstats.line_form(bare, raw, words, share)
        if marks and weight <= 6 * marks + 2:
            mass["tag"] += max(weight, 1.0)
        elif form in ("table", "noise") and not (form == "noise" and (repeated > 0.3 or dense > 0.4)):
            mass[form] += max(weight, 1.0)
        elif found and share < 0.3 and not (ended and weight >= 9):
            mass["product"] += weight + found
        elif words and (share < 0.3 and (repeated >= 0.34 or dense >= 0.34) or len(words) >= 10 and dense >= 0.2 and share < 0.35 or share < 0.42 and repeated >= 0.5 and dense >= 0.15):
            mass["keyword"] += weight
        elif form in ("list", "title"):
            mass["list"] += weight
        else:
            mass["sentence"] += weight
    whole = sum(mass.values()) or 1.0
    spam = mass["link"] + mass["product"] + mass["tag"] + mass["keyword"]
    return [
        *(mass[k] / whole for k in mass),
        spam / whole,
        spam / max(1.0, spam + mass["sentence"]),
        links / total,
        len(count) / total,
        max(content.values(), default=0) / total,
        sum(pair_count[p] for p in often) / total,
        sum(n for w, n in count.items() if w in known) / total,
        len(_MARK.findall(low)) / total,
        prices / total,
        float(np.log1p(total)),
    ]


def weak_votes(x: np.ndarray) -> np.ndarray:
    """One row a labeler, one column a page: 1 spam, 0 none, -1 not said."""
    of = dict(zip(FEATURES, x.T))
    foreign = of["common_ratio"] < 0.25
    linkless = of["links_per_word"] < 0.02
    rows = of["table_share"] + of["noise_share"] >= 0.6
    items = (of["list_share"] >= 0.8) & (of["top_word_ratio"] < 0.04)
    return np.stack(
        [
            np.where((of["marks_per_word"] >= 0.025) & (of["common_ratio"] >= 0.33), 0, -1),
            np.where(of["links_per_word"] >= 0.1, 1, -1),
            np.where((of["top_word_ratio"] >= 0.08) & foreign, 1, -1),
            np.where((of["repeated_pair_ratio"] >= 0.35) & foreign, 1, -1),
            np.where((of["prices_per_word"] >= 0.06) & foreign, 1, -1),
            np.where(rows & linkless, 0, -1),
            np.where(items & linkless, 0, -1),
        ]
    )


def weak_label(x: np.ndarray) -> np.ndarray:
    """1 spam, 0 none, -1 where no labeler says anything or they disagree."""
    votes = weak_votes(x)
    yes, no = (votes == 1).any(0), (votes == 0).any(0)
    return np.where(yes & ~no, 1, np.where(no & ~yes, 0, -1))


class Forest:
    """Bagged trees on quantile bins; thresholds are kept as values, so it works on raw features."""

    def __init__(self, trees: list[list[tuple]]):
        self.trees = trees

    @classmethod
    def grow(cls, x: np.ndarray, y: np.ndarray, seed: int = 11) -> Forest:
        rng = np.random.default_rng(seed)
        even = np.linspace(0, 1, BINS + 1)[1:-1]
        edges = [np.unique(np.concatenate([np.quantile(c, even), c.min() + even * (c.max() - c.min())])) for c in x.T]
        binned = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], 1)
        trees = []
        for _ in range(TREES):
            pick = rng.integers(0, len(x), len(x))
            nodes: list[tuple] = []
            cls._split(binned[pick], y[pick].astype(float), np.arange(len(pick)), 0, nodes, edges, rng)
            trees.append(nodes)
        return cls(trees)

    @staticmethod
    def _split(binned: np.ndarray, y: np.ndarray, rows: np.ndarray, depth: int, nodes: list, edges: list, rng: np.random.Generator) -> int:
        at, n, s = len(nodes), len(rows), y[rows].sum()
        nodes.append((-1, 0.0, (s + 0.5) / (n + 1.0), 0, 0))
        if depth >= DEPTH or n < 2 * LEAF or s in (0, n):
            return at
        best = (1e-9, -1, 0)
        for j in rng.permutation(binned.shape[1])[: max(3, binned.shape[1] // 3)]:
            width = len(edges[j]) + 1
            cn = np.bincount(binned[rows, j], minlength=width).cumsum()[:-1]
            cs = np.bincount(binned[rows, j], y[rows], width).cumsum()[:-1]
            ok = (cn >= LEAF) & (n - cn >= LEAF)
            if ok.any():
                gain = np.where(ok, cs**2 / np.maximum(cn, 1) + (s - cs) ** 2 / np.maximum(n - cn, 1) - s**2 / n, -1)
                if gain.max() > best[0]:
                    gap = np.flatnonzero(cn == cn[gain.argmax()])
                    best = (gain.max(), j, int(gap[len(gap) // 2]))
        if best[1] < 0:
            return at
        left = binned[rows, best[1]] <= best[2]
        a = Forest._split(binned, y, rows[left], depth + 1, nodes, edges, rng)
        b = Forest._split(binned, y, rows[~left], depth + 1, nodes, edges, rng)
        nodes[at] = (int(best[1]), float(edges[best[1]][best[2]]), nodes[at][2], a, b)
        return at

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for nodes in self.trees:
            column, cut, value, left, right = (np.array(v) for v in zip(*nodes))
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = column[at] >= 0
                go_left = x[np.arange(len(x)), np.maximum(column[at], 0)] < cut[at]
                at = np.where(inner, np.where(go_left, left[at], right[at]), at)
            total += value[at]
        return total / max(1, len(self.trees))


def features(df: DataFrame, words: DataFrame, text: str = "text") -> DataFrame:
    """df without the text, with `x`: the features (null for blank texts)."""
    common = df.sparkSession.sparkContext.broadcast(textstats.common_words(words))

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([page_features(t if isinstance(t, str) else None, common.value) for t in texts], dtype=object)

    return df.select(*[c for c in df.columns if c not in (text, "x")], run(F.col(text)).alias("x"))


def fit(measured: DataFrame, key: str = "doc_id") -> Forest | None:
    rows = bounded_sample(measured.where("x is not null").select(key, "x"), F.col(key), TRAIN_PAGES).collect()
    if not rows:
        return None
    x = np.array([r["x"] for r in rows])
    y = weak_label(x)
    said = y >= 0
    return Forest.grow(x[said], y[said]) if len(set(y[said])) == 2 else None


def spam_probabilities(measured: DataFrame, forest: Forest | None, host: str = "site") -> DataFrame:
    """measured without the features, plus `own` (the trees' vote), `host_rate` (of the host's other pages) and `probability`."""
    shared = measured.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def vote(x: pd.Series) -> pd.Series:
        out = np.zeros(len(x))
        filled = x.notna().to_numpy()
        if filled.any() and shared.value is not None:
            out[filled] = shared.value.probability(np.stack(x[filled].to_numpy()))
        return pd.Series(out)

    voted = materialize(measured.withColumn("own", vote("x")).withColumn("blank", F.col("x").isNull()).drop("x"))
    sums = voted.groupBy(F.col(host).alias("__host")).agg(F.sum("own").alias("host_sum"), F.count("*").alias("host_pages"))
    overall = sums.agg((F.sum("host_sum") / F.sum("host_pages")).alias("overall"))
    logit = lambda p: F.log(p / (1 - p))
    clip = lambda p: F.greatest(F.lit(0.001), F.least(F.lit(0.999), p))
    rate = (F.col("host_sum") - F.col("own") + HOST_PRIOR * F.col("overall")) / (F.col("host_pages") - 1 + HOST_PRIOR)
    joined = voted.join(sums.join(F.broadcast(overall)), F.col(host) == F.col("__host"), "left").withColumn("host_rate", rate)
    moved = logit(clip(F.col("own"))) + F.coalesce(HOST_WEIGHT * (logit(clip(F.col("host_rate"))) - logit(clip(F.col("overall")))), F.lit(0.0))
    return joined.withColumn("probability", F.when(F.col("blank"), F.lit(0.0)).otherwise(1 / (1 + F.exp(-moved)))).drop("blank", "__host", "host_sum", "host_pages", "overall")
