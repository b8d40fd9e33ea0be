"""Readers of landed files: JSON lines (tolerant or strict), logs, metric tables, listings and binary token stores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_DOCUMENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "source", "source_url", "title", "text", "summary", "author", "topic", "subtopic", "language")]
    + [T.StructField("published_date", T.TimestampType()), T.StructField("collected_date", T.TimestampType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]
)
METRICS = T.StructType([T.StructField(n, T.StringType()) for n in ("step", "loss", "val_loss", "lr", "tokens", "tokens_per_sec", "timestamp")])
DECISIONS = (
    "timestamp timestamp, step long, tokens long, regime string, policy string, metrics map<string,double>, action struct<type:string,param:string,before:double,after:double,change_pct:double>, "
    "justification string, checkpoint_saved boolean, decision_valid boolean, validation_reason string, executed boolean"
)
"""Schema of a decision log; entries without a decision have no policy and no action."""


def jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str = RAW_DOCUMENT, tolerant: bool = True, recursive: bool = False) -> DataFrame:
    """JSON lines; bad lines are dropped (tolerant) or fail the read; blank lines are skipped. The schema is fixed, so
    nothing is read twice and unused fields are not parsed."""
    reader = spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST")
    return reader.option("recursiveFileLookup", str(recursive).lower()).json(path)


def jsonl_with_errors(spark: SparkSession, path: str | list[str], schema: T.StructType = RAW_DOCUMENT) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines with their file)."""
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_name").alias("file")).where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"})).withColumn("ok", F.get_json_object("value", "$").isNotNull())
    return parsed.where("ok").select("r.*", "file"), parsed.where("not ok").select("file", "value")


def valid_entries(df: DataFrame) -> DataFrame:
    """Rows a typed entry accepts: a text, a score in [0, 1] and counts from 0 on (nulls take defaults)."""
    return df.where("text is not null and coalesce(quality_score, 0.7d) between 0 and 1 and coalesce(token_count, 0) >= 0 and coalesce(word_count, 0) >= 0")


def metrics_csv(spark: SparkSession, path: str) -> DataFrame:
    """Training metrics; blanks and unreadable numbers are null, counts may be written as decimals."""
    raw = spark.read.schema(METRICS).option("header", "true").csv(path)
    whole = lambda c: F.col(c).try_cast("double").cast("long").alias(c)
    number = lambda c: F.col(c).try_cast("double").alias(c)
    return raw.select(whole("step"), number("loss"), number("val_loss"), number("lr"), whole("tokens"), number("tokens_per_sec"), F.try_to_timestamp("timestamp").alias("timestamp"))


def decision_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Entries of a decision log in JSON lines; broken lines are dropped."""
    return jsonl(spark, path, DECISIONS)


def log_values(spark: SparkSession, path: str, pattern: str = r"GradNorm:\s*([\d.]+)") -> DataFrame:
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(F.regexp_extract("value", pattern, 1).try_cast("double").alias("value"))


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """name, size_mb, modified, and the step and the reason in the name, without reading the files' content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    low = F.lower(name)
    reason = F.when(F.contains(low, F.lit("best")), "best_val_loss").when(F.contains(low, F.lit("interrupt")), "interrupt").when(F.contains(low, F.lit("manager")), "manager_decision").otherwise("scheduled")
    return files.select(name.alias("name"), reason.alias("reason"), F.round(F.col("length") / (1 << 20), 3).alias("size_mb"), F.col("modificationTime").alias("modified"), F.regexp_extract(name, r"(\d{5,})", 1).try_cast("long").alias("step"))


RANGE_BYTES = 1 << 26
"""Bytes of a token file that one task reads at a time."""


def token_store(spark: SparkSession, path: str, dtype: str = "uint16", most_bytes: int = RANGE_BYTES) -> DataFrame:
    """(source, pos, token_id) of flat binary token files, in byte ranges, so a file of any size is read by many tasks and
    never held whole. Only names and lengths are listed first; the folder must be one that all executors see."""
    width = np.dtype(dtype).itemsize
    step = max(1, most_bytes // width) * width
    files = spark.read.format("binaryFile").load(path).select("path", "length").where(F.col("length") >= width)
    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("begin")
    ranges = files.select("path", "length", begins)
    tasks = max(1, ranges.count())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.parse import unquote, urlparse

        for batch in batches:
            for name, length, begin in zip(batch["path"], batch["length"], batch["begin"]):
                end = min(begin + step, length // width * width)
                with open(unquote(urlparse(name).path), "rb") as file:
                    file.seek(begin)
                    ids = np.frombuffer(file.read(max(0, end - begin)), dtype)
                for start in range(0, len(ids), 1_000_000):
                    part = ids[start : start + 1_000_000]
                    first = begin // width + start
                    yield pd.DataFrame({"source": name.rsplit("/", 1)[-1], "pos": np.arange(first, first + len(part)), "token_id": part.astype(np.int64)})

    return ranges.repartition(min(tasks, 10_000), "path", "begin").mapInPandas(run, "source string, pos long, token_id long")
