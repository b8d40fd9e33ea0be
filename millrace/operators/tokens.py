"""Token streams: audit statistics, runs, offsets, blocks and mixture reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as tx

VOCABULARY = 50257


def hashed_tokens(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, token_id): words as ids by hash, a stand-in vocabulary that other engines can compute too."""
    ids = F.transform(tx.words(F.col(text)), lambda w: (F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % VOCABULARY))
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(ids).alias("pos", "token_id"))


def histogram(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("token_id").agg(F.count("*").alias("n"))


def audit(tokens: DataFrame, key: str = "doc_id", vocabulary: int = VOCABULARY) -> DataFrame:
    """One row: range, moments, entropy, diversity, dominance, repetition. Two aggregations, both with partial sums."""
    counts = histogram(tokens)
    same = F.lag("token_id").over(Window.partitionBy(key).orderBy("pos"))
    moments = tokens.withColumn("same", F.coalesce((F.col("token_id") == same).cast("long"), F.lit(0))).agg(
        F.count("*").alias("total"),
        F.min("token_id").alias("least"),
        F.max("token_id").alias("most"),
        F.round(F.avg("token_id"), 6).alias("mean"),
        F.round(F.stddev_pop("token_id"), 4).alias("std"),
        F.count_if(F.col("token_id") < 0).alias("negative"),
        F.count_if(F.col("token_id") >= vocabulary).alias("beyond"),
        F.sum("same").alias("repeated"),
    )
    shape = counts.agg(
        F.count("*").alias("distinct_tokens"),
        F.sum("n").alias("__n"),
        F.max("n").alias("__top"),
        F.sum(F.col("n") * F.log2("n")).alias("__nlogn"),
    )
    both = moments.crossJoin(shape)  # one row each
    return both.select(
        "total", "least", "most", "mean", "std", "negative", "beyond", "repeated", "distinct_tokens",
        F.round(F.log2("__n") - F.col("__nlogn") / F.col("__n"), 6).alias("entropy_bits"),
        F.round(F.col("distinct_tokens") / F.col("total"), 6).alias("diversity"),
        F.round(F.col("__top") / F.col("total"), 6).alias("dominant_ratio"),
        F.round(F.col("repeated") / (F.col("total") - 1), 8).alias("repetition_ratio"),
    )


def verdict(audited: DataFrame) -> DataFrame:
    """FAIL for ids out of range or no tokens, minor warnings for dominance, repetition or low entropy, else PASS."""
    bad = (F.col("negative") > 0) | (F.col("beyond") > 0) | (F.col("total") == 0)
    odd = (F.col("dominant_ratio") > 0.1) | (F.col("repetition_ratio") > 0.01) | (F.col("entropy_bits") < 6)
    return audited.withColumn("verdict", F.when(bad, "FAIL").when(odd, "PASS WITH MINOR WARNINGS").otherwise("PASS"))


def runs(tokens: DataFrame, key: str = "doc_id", least: int = 128) -> DataFrame:
    """Maximal runs of one token of at least `least` positions: key, start_pos, token_id, length."""
    order = Window.partitionBy(key).orderBy("pos")
    begins = F.coalesce((F.col("token_id") != F.lag("token_id").over(order)).cast("int"), F.lit(1))
    numbered = tokens.withColumn("__run", F.sum(begins).over(order))
    return numbered.groupBy(key, "__run").agg(F.min("pos").alias("start_pos"), F.first("token_id").alias("token_id"), F.count("*").alias("length")).where(F.col("length") >= least).drop("__run")


def blocks(lengths: DataFrame, size: int, order: str = "doc_id", length: str = "n") -> DataFrame:
    """Which documents share which block of `size` positions of the concatenated stream: order, block, from_pos, to_pos."""
    from millrace.operators.sampling import running_offsets

    placed = running_offsets(lengths, order, length)
    first, last = F.floor(F.col("offset") / size), F.floor((F.col("offset") + F.col(length) - 1) / size)
    each = placed.where(F.col(length) > 0).withColumn("block", F.explode(F.sequence(first, last)))
    return each.select(order, F.col("block").cast("long").alias("block"), F.greatest(F.col("offset"), F.col("block") * size).cast("long").alias("from_pos"), F.least(F.col("offset") + F.col(length), (F.col("block") + 1) * size).cast("long").alias("to_pos"))


def split_position(position: Column, total: Column, fraction: float = 0.005) -> Column:
    """Contiguous split: the last floor(total * fraction) positions are validation."""
    return F.when(position >= total - F.floor(total * fraction), "validation").otherwise("train")


def concatenated(documents: DataFrame, ids: Column, key: str = "doc_id", text: str = "text", end: int = 50256, least_chars: int = 10) -> DataFrame:
    """key, ids (with the end token) and n of the documents of a token stream; texts under least_chars characters without
    the white space around them are left out."""
    kept = documents.where(F.length(F.regexp_replace(F.col(text), r"^\s+|\s+$", "")) >= least_chars)
    return kept.select(key, F.concat(ids, F.array(F.lit(end))).alias("ids")).withColumn("n", F.size("ids").cast("long"))


EDGE_BYTES, CONTEXT = 4, 16


def sample_check(ids: list[int], start: int, length: int, coder, vocabulary: int) -> tuple[bool, bool, str | None]:
    """(round trip holds, it depends on the window's edges, where bytes are no UTF-8: edge, mid or None) of a window.

    The window must give its own ids when decoded and encoded again; where it does not, it may do so together with up to
    CONTEXT tokens on both sides.
    """
    window = [int(i) for i in ids[start : start + length]]
    wide = [int(i) for i in ids[max(0, start - CONTEXT) : start + length + CONTEXT] if 0 <= i < vocabulary]
    invalid = None
    raw = coder.decode_bytes(wide)
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError as e:
        invalid = "edge" if e.start < EDGE_BYTES or e.end >= len(raw) - EDGE_BYTES else "mid"
    if any(not 0 <= i < vocabulary for i in window):
        return False, False, invalid
    if coder.encode_ordinary(coder.decode_bytes(window).decode("utf-8", "replace")) == window:
        return True, False, invalid
    return coder.encode_ordinary(raw.decode("utf-8", "replace")) == wide, True, invalid


def round_trip(tokens: DataFrame, key: str = "doc_id", length: int = 64, folder: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """One window a document (key, ids), its start chosen by hash: key, start, roundtrip_ok, boundary_sensitive,
    invalid_utf8 and the decoded text. Documents without tokens have no window."""
    from millrace.functions import bpe

    folder, vocabulary = folder or bpe.FOLDER, vocabulary or bpe.VOCABULARY
    start = F.pmod(F.xxhash64(key), F.greatest(F.lit(1), F.size("ids") - length + 1)).cast("int")
    placed = tokens.where(F.size("ids") > 0).select(key, "ids", start.alias("start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = bpe.encoding(folder, vocabulary)
        for rows in batches:
            checks = [sample_check(i, s, length, coder, coder.n_vocab) for i, s in zip(rows["ids"], rows["start"])]
            texts = [coder.decode_bytes([int(x) for x in i[s : s + length] if 0 <= x < coder.n_vocab]).decode("utf-8", "replace") for i, s in zip(rows["ids"], rows["start"])]
            yield pd.DataFrame({key: rows[key], "start": rows["start"], "roundtrip_ok": [c[0] for c in checks], "boundary_sensitive": [c[1] for c in checks], "invalid_utf8": [c[2] for c in checks], "text": texts})

    kind = dict(placed.dtypes)[key]
    return placed.mapInPandas(run, f"{key} {kind}, start int, roundtrip_ok boolean, boundary_sensitive boolean, invalid_utf8 string, text string")


def round_trip_report(windows: DataFrame) -> DataFrame:
    """Windows, share of mismatches in percent, windows that depend on their edges and that hold broken characters."""
    return windows.agg(
        F.count("*").alias("samples"),
        F.round(100 * F.count_if(~F.col("roundtrip_ok")) / F.greatest(F.lit(1), F.count("*")), 4).alias("mismatch_pct"),
        F.count_if("boundary_sensitive").alias("boundary_sensitive"),
        F.count_if(F.col("invalid_utf8") == "edge").alias("invalid_edge"),
        F.count_if(F.col("invalid_utf8") == "mid").alias("invalid_mid"),
    )


def contamination(detected: DataFrame, expected: str, found: str) -> DataFrame:
    """By expected language: documents with a detected language, and how many percent of them are in another one."""
    said = detected.where(F.col(expected).isNotNull() & F.col(found).isNotNull() & (F.col(found) != "unknown"))
    return said.groupBy(F.col(expected).alias("expected")).agg(F.count("*").alias("detected"), F.round(100 * F.count_if(F.col(found) != F.col(expected)) / F.count("*"), 4).alias("contamination_pct"))
