"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, key: Column, most: int, total: int | None = None) -> DataFrame:
    """At most `most` rows, chosen by the hash of key; tasks send the driver some 1.5 * most rows in all, however many
    tasks there are: rows beyond that share of the hash range are filtered before any are sent."""
    keyed = df.withColumn("__hash", F.xxhash64(key))
    total = keyed.count() if total is None else total
    if total > 2 * most:
        share = 1.5 * most / total
        keyed = keyed.where(F.shiftrightunsigned("__hash", 11) < int(share * (1 << 53)))
    return keyed.orderBy("__hash").limit(most).drop("__hash")
