"""Exact and near de-duplication of records in the core: keys, first-wins marks, record hashes and shingle similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.session import materialize

MIN_CHARS = 50
"""Texts under so many characters are never exact duplicates."""


def exact_key(text: Column) -> Column:
    return F.md5(tx.collapse(F.coalesce(text, F.lit(""))))


def strict_key(text: Column) -> Column:
    return F.sha2(tx.collapse(F.coalesce(text, F.lit(""))), 256)


def spaceless_key(text: Column) -> Column:
    return F.md5(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit("")))


REPEATED_KEYS = 200_000
"""Up to so many repeated keys are broadcast (at most some 20 MB); beyond, they are joined."""


def mark_first(df: DataFrame, key: Column, order: str, out: str = "is_duplicate") -> DataFrame:
    """out is true for rows after the first of their key; rows with a null key are never duplicates.

    Only (key, order) is aggregated, in partial sums, and only keys that occur more than once are joined to the rows: they
    are few, so as a rule no row is shuffled with its text. A hot key is one row of them, whatever its number of rows.
    """
    keyed = df.withColumn("__key", key)
    counted = df.select(key.alias("__key"), order).groupBy("__key").agg(F.min(order).alias("__first"), F.count("*").alias("__n"))
    repeated = counted.where("__n > 1").select("__key", "__first")
    known = repeated.limit(REPEATED_KEYS + 1).collect()
    if len(known) <= REPEATED_KEYS:
        repeated = F.broadcast(df.sparkSession.createDataFrame(known, repeated.schema))
    return keyed.join(repeated, "__key", "left").withColumn(out, F.coalesce(F.col(order) > F.col("__first"), F.lit(False))).drop("__key", "__first")


def mark_exact(df: DataFrame, text: str, order: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """mark_first by the text without regard to case and white space; shorter texts have no key."""
    long_enough = F.length(F.coalesce(F.col(text), F.lit(""))) >= min_chars
    return mark_first(df, F.when(long_enough, exact_key(F.col(text))), order)


def char_shingles(text: Column, size: int = 5) -> Column:
    """Distinct character shingles of the lower-case text with white space collapsed; none for shorter texts."""
    t = tx.single_spaces(F.lower(text))
    spots = F.when(F.length(t) >= size, F.sequence(F.lit(1), F.length(t) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(spots, lambda i: F.substring(t, i, F.lit(size))))


def jaccard(a: Column, b: Column) -> Column:
    together = F.size(F.array_union(a, b))
    return F.when(together > 0, F.size(F.array_intersect(a, b)) / together).otherwise(F.lit(0.0))


def record_hash(df: DataFrame) -> Column:
    """Content hash of a record: alpaca fields joined by |."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("instruction", "input", "output")]))


def short_id(*parts: Column) -> Column:
    return F.left(F.md5(F.concat_ws(":", *parts)), F.lit(16))


def _ratio(threshold: float) -> float:
    return math.log(1 / threshold)


def _bits(bucket: int, threshold: float) -> int:
    """Width of the parity sketches that compare sets of a size bucket with those of the same and the next one."""
    return max(128, 64 * math.ceil(math.exp((bucket + 1) * _ratio(threshold)) / 128))


def _shingle_hashes(text: str, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the character shingles."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < size:
        return np.empty(0, np.uint64)
    out = np.zeros(len(points) - size + 1, np.uint64)
    for i in range(size):
        out = (out ^ points[i : len(points) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def _parities(hashes: np.ndarray, bits: int) -> bytes:
    return np.packbits(np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def _close(a: pd.DataFrame, b: pd.DataFrame, bits: int, threshold: float, same: bool) -> Iterator[pd.DataFrame]:
    """Pairs of rows whose sketches don't rule the threshold out: two sets that reach it differ in at most
    (1 - threshold) / (1 + threshold) of their summed sizes, and parities differ in no more bits than sets in members."""

    def signs(rows: pd.DataFrame) -> np.ndarray:
        packed = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), -1)
        return np.unpackbits(packed, axis=1).astype(np.float32) * 2 - 1

    right, n_b = signs(b), b["n"].to_numpy(np.float32)
    most = (1 - threshold) / (1 + threshold)
    for at in range(0, len(a), 512):
        part = a.iloc[at : at + 512]
        apart = (bits - signs(part) @ right.T) / 2
        i, j = np.nonzero(apart <= most * (part["n"].to_numpy(np.float32)[:, None] + n_b[None, :]) + 0.5)
        if same:
            i, j = i[i + at < j], j[i + at < j]
        if len(i):
            yield pd.DataFrame({"c_a": part["c"].to_numpy()[i], "c_b": b["c"].to_numpy()[j]})


def text_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """id, t (white space collapsed, lower case) and class_id, the smallest id with the same t, of all texts that are
    long enough to be duplicates."""
    base = df.where(F.length(F.coalesce(F.col(text), F.lit(""))) >= MIN_CHARS).select(F.col(key).alias("id"), tx.single_spaces(F.lower(text)).alias("t"))
    keyed = materialize(base.withColumn("h", F.md5("t")))
    return keyed.join(keyed.groupBy("h").agg(F.min("id").alias("class_id")), "h").drop("h")


def similar_classes(classes: DataFrame, threshold: float = 0.85, size: int = 5, chunk: int = 3000) -> DataFrame:
    """All pairs (id_a < id_b, similarity) of classes whose shingle sets have at least the Jaccard threshold.

    Exact: sets are in buckets by size, so that those of a pair are in the same bucket or in two that follow each other;
    in these, chunks are compared all with all by sketches that never rule out a pair, and the shingles of what is left
    are compared. The work is quadratic in the sets of like size, at a bit of a sketch a comparison.
    """
    step, each = _ratio(threshold), "c string, n int, bucket int, wide binary, narrow binary"

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for c, t in zip(rows["c"], rows["t"]):
                hashes = _shingle_hashes(t, size)
                if n := len(hashes):
                    bucket = int(math.log(n) / step)
                    out.append((c, n, bucket, _parities(hashes, _bits(bucket, threshold)), _parities(hashes, _bits(max(bucket - 1, 0), threshold))))
            yield pd.DataFrame(out, columns=["c", "n", "bucket", "wide", "narrow"])

    def compare(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        bits, own = _bits(int(rows["at"].iloc[0]), threshold), rows["side"] == 0
        a, b = rows[own], rows[~own]
        if rows["x"].iloc[0] < 0:
            yield from _close(a, a, bits, threshold, True)
        elif len(a) and len(b):
            yield from _close(a, b, bits, threshold, False)

    firsts = classes.where("id = class_id").select(F.col("class_id").alias("id"), F.col("id").cast("string").alias("c"), "t")
    sketched = materialize(firsts.select("c", "t").mapInPandas(sketch, each).withColumn("k", F.pmod(F.xxhash64("c"), F.lit(1 << 20))))
    counts = sketched.groupBy("bucket").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    here = sketched.join(F.broadcast(counts), "bucket").withColumn("chunk", (F.col("k") % F.col("chunks")).cast("int"))
    nexts = counts.select((F.col("bucket") - 1).alias("bucket"), F.col("chunks").alias("after"))
    priors = counts.select((F.col("bucket") + 1).alias("bucket"), F.col("chunks").alias("before"))
    every = here.join(F.broadcast(nexts), "bucket", "left").join(F.broadcast(priors), "bucket", "left").withColumns({"after": F.coalesce("after", F.lit(0)), "before": F.coalesce("before", F.lit(0))})

    def spot(at: Column, x: Column, y: Column, side: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), x.cast("int").alias("x"), y.cast("int").alias("y"), side.cast("int").alias("side"))

    def upto(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    # x < 0: a chunk with itself. 0 <= x < 2 ** 20: two chunks of a bucket. From there on: chunks of two buckets.
    far, mine, bucket = F.lit(1 << 20), F.col("chunk"), F.col("bucket")
    spots = F.flatten(
        F.array(
            F.array(spot(bucket, F.lit(-1), mine, F.lit(0))),
            F.transform(F.filter(upto(F.col("chunks")), lambda v: v != mine), lambda v: spot(bucket, F.least(v, mine), F.greatest(v, mine), (v < mine).cast("int"))),
            F.transform(upto(F.col("after")), lambda v: spot(bucket, far + mine, v, F.lit(0))),
            F.transform(upto(F.col("before")), lambda v: spot(bucket - 1, far + v, mine, F.lit(1))),
        )
    )
    sent = every.withColumn("s", F.explode(spots)).select("c", "n", F.when((F.col("s.at") < bucket), F.col("narrow")).otherwise(F.col("wide")).alias("sketch"), "s.at", "s.x", "s.y", "s.side")

    def compared(batch: pd.DataFrame) -> pd.DataFrame:
        parts = list(compare(batch))
        return pd.concat(parts) if parts else pd.DataFrame({"c_a": [], "c_b": []}, dtype=object)

    near = materialize(sent.groupBy("at", "x", "y").applyInPandas(compared, "c_a string, c_b string"))
    wanted = near.select(F.explode(F.array("c_a", "c_b")).alias("c")).distinct()
    texts = materialize(firsts.join(wanted, "c").select("id", "c", "t"))
    a, b = (texts.select(F.col("c").alias(f"c_{k}"), F.col("id").alias(f"i{k}"), F.col("t").alias(f"t{k}")) for k in "ab")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for i, j, x, y in zip(rows["ia"], rows["ib"], rows["ta"], rows["tb"]):
                p, q = ({t[at : at + size] for at in range(len(t) - size + 1)} for t in (x, y))
                if (share := len(p & q) / len(p | q)) >= threshold:
                    out.append((min(i, j), max(i, j), share))
            yield pd.DataFrame(out, columns=["id_a", "id_b", "similarity"])

    kind = dict(firsts.dtypes)["id"]
    return near.join(a, "c_a").join(b, "c_b").select("ia", "ib", "ta", "tb").mapInPandas(verify, f"id_a {kind}, id_b {kind}, similarity double")


def similar_texts(df: DataFrame, key: str, text: str, threshold: float = 0.85, size: int = 5) -> DataFrame:
    """All pairs (id_a < id_b, similarity) of different texts with at least the threshold, each text by its smallest id,
    and a pair (smallest id, id, 1) for every further row of a text."""
    classes = text_classes(df, key, text)
    copies = classes.where("id > class_id").select(F.col("class_id").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("similarity"))
    return similar_classes(classes, threshold, size).unionByName(copies)


def components(links: DataFrame) -> DataFrame:
    """id and component, the smallest id that links (id_a, id_b) lead to."""
    edges = materialize(links.select("id_a", "id_b").unionByName(links.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"))).distinct())
    at = materialize(edges.groupBy(F.col("id_a").alias("id")).agg(F.least(F.min("id_b"), F.col("id")).alias("component")))
    while True:
        seen = edges.join(at, edges["id_b"] == at["id"]).groupBy(F.col("id_a").alias("id")).agg(F.min("component").alias("other"))
        jump = at.select(F.col("id").alias("component"), F.col("component").alias("beyond"))
        moved = at.join(seen, "id").join(jump, "component").select("id", F.least("component", "other", "beyond").alias("component"), F.col("component").alias("was"))
        moved = materialize(moved)
        at = moved.select("id", "component")
        if moved.where("component < was").isEmpty():
            return at


def first_wins(links: DataFrame) -> DataFrame:
    """(id, like) of the ids that links (id_a < id_b) make duplicates when rows come in the order of ids and each is one if
    it is linked to an earlier row that is none; like is the smallest such row.

    In rounds over the links, without a task that holds a component: an id without undecided earlier partners stays, so
    its later partners go; decided ids leave the links. For ids in no special order few rounds do.
    """
    edges, gone = materialize(links.select("id_a", "id_b")), None
    while not edges.isEmpty():
        stays = edges.select("id_a").distinct().join(edges.select(F.col("id_b").alias("id_a")).distinct(), "id_a", "left_anti")
        goes = materialize(edges.join(stays, "id_a").select(F.col("id_b").alias("id")).distinct())
        gone = goes if gone is None else gone.unionByName(goes)
        decided = goes.unionByName(stays.select(F.col("id_a").alias("id")))
        left = edges.join(decided.select(F.col("id").alias("id_a")), "id_a", "left_anti")
        edges = materialize(left.join(decided.select(F.col("id").alias("id_b")), "id_b", "left_anti").select("id_a", "id_b"))
    if gone is None:
        return links.select(F.col("id_b").alias("id"), F.col("id_a").alias("like")).limit(0)
    first = links.join(gone.select(F.col("id").alias("id_a")), "id_a", "left_anti").groupBy(F.col("id_b").alias("id")).agg(F.min("id_a").alias("like"))
    return first.join(gone, "id", "left_semi")


def mark_similar(df: DataFrame, key: str, text: str, threshold: float = 0.85, size: int = 5) -> DataFrame:
    """id, class_id, component, is_duplicate and similar_to of rows long enough to be duplicates: in the order of the key,
    a row is a duplicate if an earlier row that is none has the same text or is similar, as when rows come one by one."""
    classes = text_classes(df, key, text)
    bare = classes.where("id = class_id").withColumn("h", F.md5(F.trim("t"))).select("id", "h")
    same = bare.alias("a").join(bare.alias("b"), (F.col("a.h") == F.col("b.h")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
    links = materialize(similar_classes(classes, threshold, size).select("id_a", "id_b").unionByName(same).distinct())
    judged = components(links).join(first_wins(links), "id", "left").select(F.col("id").alias("class_id"), "component", "like")
    first = F.coalesce("like", F.when(F.col("id") > F.col("class_id"), F.col("class_id")))
    return classes.drop("t").join(judged, "class_id", "left").select("id", "class_id", F.coalesce("component", "class_id").alias("component"), first.isNotNull().alias("is_duplicate"), first.alias("similar_to"))
