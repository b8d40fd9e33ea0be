"""Exact similarity join of documents on word triples, for small edits, insertions and new order.

Two texts are linked if their common triples are at least `share` of the triples that are in either (Jaccard
similarity; each text at least `least_words` words long). Ordering all triples by how rare they are, a text of n triples
that must share T of them has the first shared one among its first n - T + 1 (prefix principle); T is least
share / (1 + share) * (n + s) for sizes n and s. These rare triples are the pivots: a text lies in the
region of every pivot it holds, not just the nearest, which is what the triangle inequality leaves when almost all
distances are near 1 (see README). A region is one band of sizes and one shard of the triples (by hash; a band has as many
shards as its postings need, so no posting is written again for their number); a text enters its own band and, with the fewer pivots it needs there, the next one if its larger partners can be in it. Inside a region posting
lists give all pairs whose common pivot is early enough in both texts for their sizes; of these only pairs whose
parity sketches, a lower bound of the distance, allow a link leave the region, and are compared triple by triple.
Nothing is capped: every linked pair of different texts is found.

The order of rarity comes from a count sketch of fixed size over all rows; any order gives the same result, it only
decides how much is compared. Texts with equal sets of triples form a class and are compared once; inside it, rows with
equal title and text are copies (`copy` is the hash of both).

Defined cases: null titles and texts are empty; a row with a null id is left out; texts under `least_words` words have
no links; repeated rows of an id count once; whole texts are read; an empty table gives empty results.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import materialize

SKETCH_BITS = 22
SHARDS = 2
"""Least number of shards of a band."""
SKETCH_WORDS = 4, 64
"""A text has in each region a parity sketch of so many 64-bit words, by the band's sizes; it bounds the number of
different triples from below."""
BAND_SHARES = 1
"""A band of sizes spans a factor of 1 / share ** BAND_SHARES."""
REGION_POSTINGS = 8_000_000
"""Bands with more postings have more shards."""
BAND_REGIONS = 1 << 20
NEEDED_CLASSES = 300_000
"""Up to so many ids of compared texts are broadcast to the readers (at most some 20 MB); beyond, they are joined."""
EXPAND = 64
"""Exact copies of up to so many ids are listed as all pairs; larger groups stand as pairs with their first member."""
TOUCHES = 1_000_000
ROWS = 400
BITS = 55

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
_powers: list[np.ndarray] = []
_is_word: list[np.ndarray] = []


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_table() -> np.ndarray:
    if not _is_word:
        table = np.zeros(0x40000, bool)
        for code in range(0x40000):
            table[code] = unicodedata.category(chr(code))[0] in "LN"
        _is_word.append(table)
    return _is_word[0]


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < size:
        length = max(size, 1 << 20)
        _powers[:] = [np.cumprod(np.full(length, b, np.uint64)) for b in (_B, _B_INVERSE)]
    return _powers[0], _powers[1]


def triples(texts: list[str], least_words: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Distinct triple hashes of BITS bits of each text, sorted (flat, and the number of them); none for texts of few
    words. At most 2 ** (64 - BITS) texts at a time, whose number fills the rest of a sort key."""
    joined = "\n".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(lengths + 1) - lengths - 1
    word = _word_table()[np.minimum(codes, 0x3FFFF)]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power_tables(len(codes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], dtype=np.uint64)])
    hashes = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    owner = np.searchsorted(begins, starts, side="right") - 1
    enough = np.bincount(owner, minlength=len(texts)) >= least_words if len(owner) else np.zeros(len(texts), bool)
    if len(hashes) < 3:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    same = (owner[2:] == owner[:-2]) & enough[owner[:-2]]
    found = _mix(hashes[:-2] * np.uint64(3) + _mix(hashes[1:-1] + np.uint64(7)) * np.uint64(5) + _mix(hashes[2:] + np.uint64(11)))[same]
    of = owner[:-2][same]
    keys = np.sort((of.astype(np.uint64) << np.uint64(BITS)) | (found >> np.uint64(64 - BITS)))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return keys & np.uint64((1 << BITS) - 1), np.bincount((keys >> np.uint64(BITS)).astype(np.int64), minlength=len(texts))


def _class_hashes(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(flat + np.uint64(1)), dtype=np.uint64)])
    ends = np.cumsum(counts)
    return _mix(sums[ends] - sums[ends - counts] + counts.astype(np.uint64) * np.uint64(0x9E37)).view(np.int64)


def _parity(flat: np.ndarray, counts: np.ndarray, words: np.ndarray) -> list[bytes]:
    """Sketches of so many words of each text: a bit is set if an odd number of triples falls on it, so two texts have at
    least as many different triples as their sketches have different bits."""
    width = 64 * words.astype(np.int64)
    ends = np.cumsum(width)
    cell = (_mix(flat + np.uint64(5)) & np.repeat(width - 1, counts).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(np.repeat(ends - width, counts) + cell, minlength=int(width.sum())) & 1
    packed = np.packbits(odd.astype(np.uint8)).tobytes()
    return [packed[e - w : e] for e, w in zip((ends // 8).tolist(), (width // 8).tolist())]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A few rows at a time and their lower-case texts."""
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            yield batch, [t.lower() for t in batch.column(1).to_pylist()]


def _content(df: DataFrame, key: str) -> DataFrame:
    joined = F.concat(F.coalesce(F.col("title"), F.lit("")), F.lit(" "), F.coalesce(F.col("text"), F.lit("")))
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), joined.alias("content"), F.xxhash64(joined).alias("copy"))


def _pack_cells(used: np.ndarray, counts: np.ndarray) -> bytes:
    """Used cells in order and their counts: steps and counts by byte planes, most of them zero."""
    words = np.concatenate([np.diff(used, prepend=np.uint32(0)), counts]).astype("<u4")
    return zlib.compress(words.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _add_cells(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Used cells and their counts, summed over the packed parts."""
    cells = np.zeros(1 << SKETCH_BITS, np.uint32)
    for part in parts:
        planes = np.frombuffer(zlib.decompress(part), np.uint8).reshape(4, -1)
        steps, counts = np.ascontiguousarray(planes.T).view("<u4").reshape(2, -1)
        cells[np.cumsum(steps, dtype=np.uint32)] += counts
    used = np.flatnonzero(cells).astype(np.uint32)
    return used, cells[used]


def _rarity(cells: DataFrame) -> np.ndarray:
    """Counts of triples by sketch cell, on a logarithmic scale in one byte; 0 for cells used at most once.

    cells has one packed row a task; they are added in groups of about 8 until one is left (at most 32 MB), whatever the
    number of tasks.
    """

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cells": [_pack_cells(*_add_cells(group["cells"].tolist()))]})

    rows = cells
    while (n := rows.count()) > 1:
        rows = materialize(rows.groupBy(F.pmod(F.xxhash64("cells"), F.lit(-(-n // 8)))).applyInPandas(add, "cells binary"))
    used, counts = _add_cells([bytes(r["cells"]) for r in rows.collect()])
    rarity = np.zeros(1 << SKETCH_BITS, np.uint8)
    rarity[used] = np.where(counts > 1, np.minimum(255, np.floor(np.log2(np.maximum(counts, 1)) * 8)), 0).astype(np.uint8)
    return rarity


def least_common(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Common triples of two sets of these sizes at which their Jaccard similarity reaches the share."""
    return np.ceil(share / (1 + share) * (a + b) - 1e-9)


def _band(size: np.ndarray, share: float) -> np.ndarray:
    return np.floor(np.log(np.maximum(size, 1)) / (-BAND_SHARES * np.log(share)) + 1e-9).astype(np.int64)


def _band_words(band: np.ndarray, share: float) -> np.ndarray:
    """Words of the sketches in a band: about as many bits as its largest texts have triples, a power of two."""
    largest = np.power(share, -BAND_SHARES * (np.minimum(band, 40) + 1.0))
    return np.clip(np.exp2(np.ceil(np.log2(1.2 * largest / 64))), *SKETCH_WORDS).astype(np.int64)


def _postings(flat: np.ndarray, counts: np.ndarray, rarity: np.ndarray, share: float, shards: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """For every text and each band its larger partner can be in: region, triple, row, place and signed size of each row.

    In its own band a text is a larger one too and its size is positive; in the next it is only the smaller one: -size.
    The place in the order of rarity is in 256ths of the size, rounded down.
    """
    row = np.repeat(np.arange(len(counts)), counts)
    rare = rarity[(flat >> np.uint64(BITS - SKETCH_BITS)).astype(np.int64)]
    order = np.argsort((row.astype(np.uint64) << np.uint64(BITS)) | (rare.astype(np.uint64) << np.uint64(BITS - 8)) | (flat >> np.uint64(8)))
    flat, rare, row = flat[order], rare[order], row[order]
    begin = np.cumsum(counts) - counts
    place = np.arange(len(flat)) - begin[row]
    mixed = _mix(flat + np.uint64(99))
    largest = np.floor(counts / share + 1e-9).astype(np.int64)
    own, out = _band(counts, share), []
    for step in (0, 1):
        band = own + step
        if step == 0:
            active, need = counts > 0, np.ceil(share * counts - 1e-9)
        else:
            low = np.maximum(counts, np.floor(np.power(share, -BAND_SHARES * band.astype(float)) - 1e-6).astype(np.int64))
            active, need = (counts > 0) & (low <= largest) & (_band(largest, share) >= band), least_common(counts, low, share)
        reach = np.where(active, counts - need + 1, 0)
        take = (place < reach[row]) & (rare > 0)
        at = row[take]
        shard = (mixed[take] % shards[np.minimum(band, len(shards) - 1)][at].astype(np.uint64)).astype(np.int64)
        out.append((band[at] * BAND_REGIONS + shard, flat[take], at, (place[take] * 256 // counts[at]).astype(np.uint8), counts if step == 0 else -counts))
    return out


def _pairs_in_region(pivot: np.ndarray, held: np.ndarray, size: np.ndarray, asks: np.ndarray, sketch: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (larger, smaller) of rows that have a common pivot early enough in both and sketches that allow a link.

    Rows are in the order of their sizes; pivot has `held` postings of each row, 24 bits of the triple and 8 of the place.
    Only rows that ask are larger ones. A pair may come again.
    """
    part = share / (1 + share)
    bits = max(1, int(len(size) - 1).bit_length())
    key = (pivot >> np.uint32(8)).astype(np.uint64) << np.uint64(bits + 8)
    key |= np.repeat(np.arange(len(size), dtype=np.uint64) << np.uint64(8), held)
    key |= pivot & np.uint32(255)
    key.sort()
    mask = np.uint64((1 << bits) - 1)

    def rows(keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(8)) & mask).astype(np.int64)

    most = np.empty(len(key), np.int32)
    """Largest partner's size for which the place of the common pivot is early enough."""
    for at in range(0, len(key), TOUCHES):
        keys = key[at : at + TOUCHES]
        n = size[rows(keys)]
        most[at : at + TOUCHES] = np.minimum((n * (1 - part) - (keys & np.uint64(255)).astype(np.int64) * n / 256 + 1e-6) / part, 1 << 30)
    least_row = np.searchsorted(size, np.ceil(share * size - 1e-9), side="left").astype(np.uint64)
    for at in range(0, len(key), TOUCHES):
        keys = key[at : at + TOUCHES]
        who = rows(keys)
        index = np.flatnonzero(asks[who])
        keys, who = keys[index], who[index]
        top = np.minimum(np.searchsorted(size, most[at + index], side="right"), who).astype(np.uint64)
        list_of = keys >> np.uint64(bits + 8) << np.uint64(bits + 8)
        low = np.searchsorted(key, list_of | (least_row[who] << np.uint64(8)), side="left")
        high = np.searchsorted(key, list_of | (top << np.uint64(8)), side="left")
        some = np.flatnonzero(high > low)
        who, low, touched = who[some], low[some], (high - low)[some]
        total, begin = np.cumsum(touched), 0
        while begin < len(who):
            end = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + TOUCHES, side="right"))
            end = max(end, begin + 1)
            count = touched[begin:end]
            partner = np.arange(int(count.sum()))
            partner += np.repeat(low[begin:end] - (np.cumsum(count) - count), count)
            early = most[partner] >= np.repeat(size[who[begin:end]], count)
            a, b = np.repeat(who[begin:end], count)[early], rows(key[partner[early]])
            differ = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64)
            both = size[a] + size[b]
            near = differ <= both - 2 * np.ceil(part * both - 1e-9)
            if near.any():
                yield a[near], b[near]
            begin = end


def similar_pairs(df: DataFrame, key: str = "id", share: float = 0.6, least_words: int = 20, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(links, members): links of classes (class_a < class_b, common, size_a, size_b), and class and copy group of each id."""
    spark = df.sparkSession
    content = _content(df, key)

    def class_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "copy", "class", "size", "cells"]
        cells = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch, texts in _slices(batches):
            flat, counts = triples(texts, least_words)
            cell, n = np.unique((flat >> np.uint64(BITS - SKETCH_BITS)).astype(np.uint32), return_counts=True)
            cells[cell] += n.astype(np.uint32)
            take = counts > 0
            kept, copy = (batch.column(i).filter(pa.array(take)) for i in (0, 2))
            yield pa.RecordBatch.from_arrays([kept, copy, pa.array(_class_hashes(flat, counts)[take]), pa.array(counts[take]), pa.nulls(len(kept), pa.binary())], names=names)
        used = np.flatnonzero(cells).astype(np.uint32)
        if len(used):
            packed = pa.array([_pack_cells(used, cells[used])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), *[pa.array([0], pa.int64())] * 3, packed], names=names)

    read = materialize(content.mapInArrow(class_rows, "id string, copy long, class long, size long, cells binary"))
    rarity = spark.sparkContext.broadcast(_rarity(read.where("cells is not null").select("cells")))
    members = materialize(read.where("cells is null").groupBy("id").agg(F.min(F.struct("class", "copy", "size")).alias("m")).select("id", "m.*"))

    band = F.floor(F.log("size") / (-BAND_SHARES * np.log(share)) + 1e-9).cast("int")
    loads = dict(members.select("class", "size").distinct().groupBy(band.alias("band")).agg(F.sum((1 - share) * F.col("size") + 1).alias("n")).collect())
    needed = [int((loads.get(b, 0) + 0.4 * loads.get(b - 1, 0)) // REGION_POSTINGS) + 1 for b in range(max(loads, default=0) + 2)]
    band_shards = np.clip(needed, shards, BAND_REGIONS)

    def posting_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts in _slices(batches):
            flat, counts = triples(texts, least_words)
            klass = _class_hashes(flat, counts)
            fresh = np.array([c not in seen and not seen.add(c) for c in klass.tolist()], bool) & (counts > 0)
            if len(seen) > 1_000_000:
                seen.clear()
            flat, counts = flat[np.repeat(fresh, counts)], np.where(fresh, counts, 0)
            for region, triple, row, place, size in _postings(flat, counts, rarity.value, share, band_shards):
                if not len(region):
                    continue
                words = np.ones(len(counts), np.int64)
                words[row] = _band_words(region // BAND_REGIONS, share)
                sketch = _parity(flat, counts, words)
                order = np.argsort(region * ROWS + row)
                region, triple, row, place = region[order], triple[order], row[order], place[order]
                begin = np.flatnonzero(np.concatenate([[True], (region[1:] != region[:-1]) | (row[1:] != row[:-1])]))
                ends = np.concatenate([begin, [len(region)]]).astype(np.int32)
                values = ((triple.astype(np.uint32) << np.uint32(8)) | place).astype("<u4").tobytes()
                packed = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((ends * 4).tobytes()), pa.py_buffer(values)])
                row = row[begin]
                columns = [pa.array(region[begin].astype(np.int32)), pa.array(klass[row]), pa.array(size[row].astype(np.int32)), pa.array([sketch[r] for r in row.tolist()], pa.binary()), packed]
                yield pa.RecordBatch.from_arrays(columns, names=["region", "class", "size", "sketch", "pivots"])

    postings = content.mapInArrow(posting_rows, "region int, class long, size int, sketch binary, pivots binary")

    def join_region(table: pa.Table) -> pa.Table:
        classes, first = np.unique(table.column("class").to_numpy(), return_index=True)
        size = table.column("size").to_numpy()[first].astype(np.int64)
        order = np.argsort(np.abs(size), kind="stable")
        classes, first, size = classes[order], first[order], size[order]
        pivots, sketches = (table.column(c).take(pa.array(first)).to_pylist() for c in ("pivots", "sketch"))
        held = np.fromiter(map(len, pivots), np.int64, len(pivots)) // 4
        pivot, sketch = np.frombuffer(b"".join(pivots), "<u4"), np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
        del table, pivots, sketches
        found = [np.unique((a << 32) | b) for a, b in _pairs_in_region(pivot, held, np.abs(size), size > 0, sketch, share)]
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        a, b = classes[both >> 32], classes[both & 0xFFFFFFFF]
        return pa.table({"class_a": np.minimum(a, b), "class_b": np.maximum(a, b)})

    found = postings.groupBy("region").applyInArrow(join_region, "class_a long, class_b long")
    candidates = materialize(found.distinct())
    sets = _needed_sets(content, members, candidates, least_words)
    left = sets.select(F.col("class").alias("class_a"), F.col("triples").alias("set_a"))
    right = sets.select(F.col("class").alias("class_b"), F.col("triples").alias("set_b"))

    @F.pandas_udf("struct<common:int,size_a:int,size_b:int>")
    def compare(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            rows.append((len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
        return pd.DataFrame(rows, columns=["common", "size_a", "size_b"])

    compared = candidates.join(left, "class_a").join(right, "class_b").select("class_a", "class_b", compare("set_a", "set_b").alias("c"))
    close = F.col("c.common") >= share * (F.col("c.size_a") + F.col("c.size_b") - F.col("c.common")) - 1e-9
    return compared.where(close).select("class_a", "class_b", "c.common", "c.size_a", "c.size_b"), members.select("id", "class", "copy")


def _needed_sets(content: DataFrame, members: DataFrame, candidates: DataFrame, least_words: int) -> DataFrame:
    """class and sorted triples (binary) of the classes in candidates; once each, from its first member's text."""
    needed = candidates.select(F.col("class_a").alias("class")).union(candidates.select("class_b")).distinct()
    first = members.join(needed, "class", "left_semi").groupBy("class").agg(F.min("id").alias("id")).select("id")
    few = 2 * candidates.count() <= NEEDED_CLASSES
    content = content.join(F.broadcast(first) if few else first, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts in _slices(batches):
            flat, counts = triples(texts, least_words)
            klass, ends = _class_hashes(flat, counts), np.cumsum(counts)
            rows = [i for i in np.flatnonzero(counts > 0) if klass[i] not in seen and not seen.add(klass[i])]
            if len(seen) > 1_000_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(klass[rows]), pa.array([flat[ends[i] - counts[i] : ends[i]].tobytes() for i in rows], pa.binary())], names=["class", "triples"])

    sets = content.mapInArrow(run, "class long, triples binary")
    return sets.groupBy("class").agg(F.first("triples").alias("triples"))


def expand_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of ids: all pairs of different texts, and all pairs of copies; a group of more than EXPAND exact copies is
    represented by its first member, the others of it are paired with that one only. Members without a link or copy are
    left out before the joins."""
    both = links.select(F.col("class_a").alias("class")).unionAll(links.select("class_b"))
    shared = members.groupBy("class").agg(F.count("*").alias("ids")).where("ids > 1").select("class")
    members = materialize(members.join(both.unionAll(shared).distinct(), "class", "left_semi"))
    group = members.groupBy("class", "copy").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    grouped = members.join(group, ["class", "copy"])
    listed = grouped.where((F.col("n") <= EXPAND) | (F.col("id") == F.col("first_id"))).select("id", "class")
    a, b = listed.select(F.col("id").alias("id_1"), F.col("class").alias("class_a")), listed.select(F.col("id").alias("id_2"), F.col("class").alias("class_b"))
    across = links.select("class_a", "class_b").join(a, "class_a").join(b, "class_b").select("id_1", "id_2")
    within = listed.select(F.col("id").alias("id_1"), "class").join(listed.select(F.col("id").alias("id_2"), "class"), "class").where("id_1 < id_2").select("id_1", "id_2")
    stars = grouped.where((F.col("n") > EXPAND) & (F.col("id") != F.col("first_id"))).select(F.col("first_id").alias("id_1"), F.col("id").alias("id_2"))
    every = across.unionByName(within).unionByName(stars)
    return every.select(F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b")).where("id_a < id_b").distinct()


def link_counts(links: DataFrame, members: DataFrame) -> DataFrame:
    """One row per id: its class and the number of other classes it is linked with."""
    each = links.select(F.col("class_a").alias("class")).unionAll(links.select("class_b")).groupBy("class").agg(F.count("*").alias("links"))
    return members.join(each, "class", "left").select("id", "class", F.coalesce("links", F.lit(0)).alias("links"))
