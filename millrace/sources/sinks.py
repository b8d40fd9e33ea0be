"""Writers: partitioned JSON lines, format fan-out, split files, sized shards with manifest, token stores, reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import sampling

SHARD_RECORDS = 25_000


def write_jsonl(df: DataFrame, path: str, by: tuple[str, ...] = ("source", "topic", "language"), compress: bool = False, mode: str = "append") -> None:
    """JSON lines in folders by source, topic and language; the commit protocol replaces buffers and flushes."""
    writer = df.write.mode(mode).partitionBy(*[c for c in by if c in df.columns])
    (writer.option("compression", "gzip") if compress else writer).json(path)


def write_formats(df: DataFrame, path: str, forms: tuple[str, ...] = ("alpaca", "sharegpt", "chatml")) -> None:
    """One folder a format from a frame with one JSON column a format, computed once."""
    kept = df.persist()
    for form in forms:
        kept.select(form).write.mode("overwrite").text(f"{path}/{form}")
    kept.unpersist()


def write_splits(df: DataFrame, path: str, key: str, train: float = 0.9, validation: float = 0.05) -> None:
    sampling.split_by_hash(df, key, train, validation).write.mode("overwrite").partitionBy("split").json(path)


def write_shards(df: DataFrame, path: str, records: int = SHARD_RECORDS) -> DataFrame:
    """Files of at most `records` records and their manifest (file, records)."""
    df.write.mode("overwrite").option("maxRecordsPerFile", records).json(path)
    back = df.sparkSession.read.schema(df.schema).json(path)
    return back.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("records"))


CHUNK_TOKENS = 4_000_000
"""Tokens of one stored cell (16 MB), whatever the size of a partition."""


def write_tokens(df: DataFrame, path: str, ids: str = "ids", order: str = "doc_id", end: int | None = 50256, chunk: int = CHUNK_TOKENS) -> DataFrame:
    """Token ids as flat uint32 rows in order: chunks of at most `chunk` tokens, numbered inside a range of the order, with
    (part, chunk, tokens). A task's chunks are written by the commit of that task, so a crash leaves no half one."""
    tail = F.array(F.lit(end)) if end is not None else F.array().cast("array<int>")
    ranged = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).select(F.concat(ids, tail).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for t in batch["t"]:
                held.append(np.asarray(t, np.uint32))
                size += len(held[-1])
                while size >= chunk:
                    flat = np.concatenate(held)
                    yield pd.DataFrame({"part": [part], "chunk": [number], "tokens": [chunk], "content": [flat[:chunk].tobytes()]})
                    held, size, number = [flat[chunk:]], len(flat) - chunk, number + 1
        if size:
            yield pd.DataFrame({"part": [part], "chunk": [number], "tokens": [size], "content": [np.concatenate(held).tobytes()]})

    ranged.mapInPandas(run, "part int, chunk int, tokens long, content binary").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path).select("part", "chunk", "tokens")


def write_with_report(df: DataFrame, path: str, report: str, most: int | None = None, **counts) -> dict[str, int]:
    """JSON lines and, beside them, a one-line report of the rows written and of named conditions, observed while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    kept = df if most is None else df.limit(most)
    kept.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in counts.items()]).write.mode("overwrite").json(path)
    found = {k: int(v or 0) for k, v in seen.get.items()}
    write_report(df.sparkSession.createDataFrame([tuple(found.values())], ", ".join(f"{k} long" for k in found)), report)
    return found


STATE = "source string, topic string, last_page int, last_offset long, total_collected long, updated timestamp, metadata map<string,string>"


def save_state(state: DataFrame, path: str) -> None:
    """Adds rows of run state by source and topic; the latest row of a key holds, so a half-written run changes nothing."""
    state.write.mode("append").parquet(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """The latest state of each source and topic."""
    rows = spark.read.schema(STATE).parquet(path)
    rest = [c for c in rows.columns if c not in ("source", "topic")]
    return rows.groupBy("source", "topic").agg(F.max_by(F.struct(*rest), "updated").alias("s")).select("source", "topic", "s.*")


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", "true").csv(path)


def append_audit(df: DataFrame, path: str) -> None:
    """Audit entries as JSON lines, nulls kept."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report of few rows as one file."""
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def remaining(items: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """What a resumed run still has to do."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def merge_stores(spark: SparkSession, paths: list[str], path: str) -> None:
    spark.read.parquet(*paths).write.mode("overwrite").parquet(path)
