"""Encoding of texts with a byte-level BPE vocabulary, as numpy matrix rounds inside Arrow batches.

A text is cut into pieces by the vocabulary's pattern. The distinct new pieces of a batch are put into padded
integer matrices by length. In every round each row merges its leftmost pair of minimum rank; pair ranks come
from an open-addressing hash table in numpy; finished rows leave the matrix (compaction). Pieces already seen by
a worker are looked up. The vocabulary is read from a path on each worker and never shipped with the library.

Defined cases: a null or empty text gives an empty list; a missing id column value stays null; repeated rows give
repeated rows; texts of any length are encoded whole; extra columns are carried through unless they have the name
of the result column, which replaces them.
"""

from __future__ import annotations

import base64
import heapq
import importlib.util
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
NONE = np.int32(2**31 - 1)
LONG_PIECE = 384
"""Pieces of more bytes than this are merged with a heap instead of matrix rounds; the result is the same."""
CACHE_PIECES = 400_000
SLICE = 500
"""Rows of an Arrow batch that are encoded at a time; bounds a worker's memory."""


def split_pattern(folder: str = TOKENIZERS) -> str:
    spec = importlib.util.spec_from_file_location("millrace_public_tokenizers", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


class PairTable:
    """Ranks of mergeable pairs in an open-addressing hash table with linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append((left << 32) | right)
                    values.append(rank)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        left = np.array(keys, np.int64)
        ranked = np.array(values, np.int32)
        slot = self._hash(left)
        while len(left):
            free = self.keys[slot] == -1
            first = np.zeros(len(left), bool)
            first[np.unique(slot[free], return_index=True)[1]] = True
            take = np.flatnonzero(free)[first[: free.sum()]]
            self.keys[slot[take]] = left[take]
            self.values[slot[take]] = ranked[take]
            keep = np.ones(len(left), bool)
            keep[take] = False
            left, ranked, slot = left[keep], ranked[keep], (slot[keep] + 1) & ((1 << self.bits) - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it cannot merge (or an id is -1, padding)."""
        keys = ((left.astype(np.int64) << 32) | right.astype(np.int64)).ravel()
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._hash(keys[todo])
        while len(todo):
            found = self.keys[slot]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (found != -1)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(left.shape)


class BytePairEncoder:
    """Encodes lists of pieces; one per worker and vocabulary."""

    _kept: dict[str, BytePairEncoder] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pairs = PairTable(ranks)
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pattern = regex.compile(pattern)

    @classmethod
    def load(cls, path: str, pattern: str) -> BytePairEncoder:
        if path not in cls._kept:
            with open(path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
            cls._kept[path] = cls(ranks, pattern)
        return cls._kept[path]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in order, and how many each piece has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        parts: list[np.ndarray | None] = [None] * len(pieces)
        for i in np.flatnonzero(lengths > LONG_PIECE):
            parts[i] = self._by_heap(pieces[i])
        short = np.flatnonzero(lengths <= LONG_PIECE)
        bucket = np.ceil(np.log2(np.maximum(lengths[short], 2)) * 2).astype(np.int64)
        for b in np.unique(bucket):
            rows = short[bucket == b]
            for start in range(0, len(rows), 20_000):
                self._by_rounds(rows[start : start + 20_000], pieces, lengths, parts)
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), counts

    def _by_rounds(self, rows: np.ndarray, pieces: list[bytes], lengths: np.ndarray, parts: list) -> None:
        length = lengths[rows]
        width = int(length.max())
        ids = np.full((len(rows), width + 1), -1, np.int32)
        inside = np.arange(width + 1)[None, :] < length[:, None]
        ids[inside] = self.byte_ids[np.frombuffer(b"".join([pieces[i] for i in rows]), np.uint8)]
        rank = self.pairs.lookup(ids[:, :-1], ids[:, 1:])
        at = np.arange(width + 1)
        while len(rows):
            best = rank.argmin(axis=1)
            row = np.arange(len(rows))
            low = rank[row, best]
            done = low == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    parts[rows[i]] = ids[i, : length[i]].copy()
                on = ~done
                rows, ids, rank, length, best, low = rows[on], ids[on], rank[on], length[on], best[on], low[on]
                if not len(rows):
                    return
                width = int(length.max())
                ids, rank, at = ids[:, : width + 1], rank[:, :width], at[: width + 1]
                row = np.arange(len(rows))
            later = at[None, :] > best[:, None]
            source = np.minimum(at[None, :] + later, width)
            ids = np.take_along_axis(ids, source, axis=1)
            ids[:, -1] = -1
            ids[row, best] = low
            rank = np.take_along_axis(rank, np.minimum(source[:, :-1], width - 1), axis=1)
            rank[:, -1] = NONE
            length = length - 1
            rank[row, best] = self.pairs.lookup(ids[row, best], ids[row, best + 1])
            left = best > 0
            rank[row[left], best[left] - 1] = self.pairs.lookup(ids[row[left], best[left] - 1], ids[row[left], best[left]])

    def _by_heap(self, piece: bytes) -> np.ndarray:
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(piece) and (rank := self.ranks.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (rank, i, parts[i], parts[j]))

        for i in range(len(piece) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else len(piece)
            if parts[i] != a or j >= len(piece) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[i] < len(piece):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([self.ranks[p] for p in parts if p is not None], np.int32)


class _Codes(dict):
    """Numbers pieces as they come; `new` holds those that are not encoded yet."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = code = len(self)
        self.new.append(piece)
        return code


class TextEncoder:
    """Encodes batches of texts with a growing table of pieces."""

    def __init__(self, encoder: BytePairEncoder):
        self.encoder = encoder
        self._clear()

    def _clear(self) -> None:
        self.codes, self.ids = _Codes(), np.zeros(0, np.int32)
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets (len(texts) + 1)."""
        if len(self.codes) > CACHE_PIECES:
            self._clear()
        find, code = self.encoder.pattern.findall, self.codes.__getitem__
        each = []
        for text in texts:
            pieces = find(text) if text else ()
            each.append(np.fromiter(map(code, pieces), np.int64, len(pieces)))
        if self.codes.new:
            ids, counts = self.encoder.encode_pieces([p.encode("utf-8", "replace") for p in self.codes.new])
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.ids = np.concatenate([self.ids, ids])
            self.codes.new = []
        codes = np.concatenate(each) if each else np.zeros(0, np.int64)
        counts = self.counts[codes]
        ends = np.cumsum(counts)
        flat = np.arange(int(ends[-1]) if len(ends) else 0)
        flat += np.repeat(self.starts[codes] - (ends - counts), counts)
        last = np.cumsum([len(e) for e in each], dtype=np.int64)
        offsets = np.concatenate([[0], np.concatenate([[0], ends])[last]]).astype(np.int64)
        return self.ids[flat], offsets


def _encoder(path: str, pattern: str) -> TextEncoder:
    return TextEncoder(BytePairEncoder.load(path, pattern))


def encode_texts(df: DataFrame, text: str = "text", out: str = "ids", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """df with the ids of `text` as ARRAY<INT> in `out`, whole texts, no special tokens. A narrow map: no shuffle."""
    path, pattern = os.path.join(folder, vocabulary), split_pattern(folder)
    kept = [f for f in df.schema.fields if f.name not in (out, text)]
    source = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                ids, offsets = encoder.encode(batch.column(batch.num_columns - 1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], out])

    return source.mapInArrow(run, schema)


def token_counts(text: Column, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> Column:
    """Number of ids of a text (0 for null or empty) as an Arrow function."""
    path, pattern = os.path.join(folder, vocabulary), split_pattern(folder)

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch]
            counts = [np.diff(encoder.encode(texts[i : i + SLICE])[1]) for i in range(0, len(texts), SLICE)]
            yield pd.Series(np.concatenate([np.zeros(0, np.int64), *counts]))

    return count(text)
