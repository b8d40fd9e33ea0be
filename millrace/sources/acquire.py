"""Acquisition: fallback chains of sources, paged reads with retries, catalogs, metadata sidecars, search plans."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PROBE_CHARS = 10
CATALOG_ROWS = 100_000


def usable(df: DataFrame, text_fields: tuple[str, ...], least_chars: int = PROBE_CHARS) -> str | None:
    """The first of the text fields that the source's first row fills with at least least_chars characters, else None."""
    fields = [f for f in text_fields if f in df.columns]
    rows = df.select(*fields).limit(1).collect() if fields else []
    return next((f for f in fields if rows and isinstance(rows[0][f], str) and len(rows[0][f].strip()) >= least_chars), None)


def first_usable(candidates: list[tuple[int, str, Callable[[], DataFrame]]], text_fields: tuple[str, ...] = ("text", "content"), least_chars: int = PROBE_CHARS) -> tuple[str | None, DataFrame | None, list[tuple[str, str]]]:
    """(name, source, why the earlier ones were passed over) of the first usable candidate (priority, name, opener) by
    rising priority. Only one row of each candidate is read; one that cannot be opened counts as unavailable. The
    source's text stands in the column `text`."""
    refused = []
    for _, name, opener in sorted(candidates, key=lambda c: (c[0], c[1])):
        try:
            df = opener()
            field = usable(df, text_fields, least_chars)
        except Exception as error:  # noqa: BLE001  whatever keeps a source from being read sends us to the next one
            refused.append((name, type(error).__name__))
            continue
        if field is not None:
            return name, df if field == "text" else df.withColumn("text", F.col(field)), refused
        refused.append((name, "no text"))
    return None, None, refused


def bilingual(chains: dict[str, list[tuple[int, str, Callable[[], DataFrame]]]], **probe) -> DataFrame | None:
    """The first usable source of each language's chain, with the columns lang, source and text; languages without one are
    left out."""
    found = [(lang, *first_usable(chain, **probe)[:2]) for lang, chain in chains.items()]
    parts = [df.select(F.lit(lang).alias("lang"), F.lit(name).alias("source"), "text") for lang, name, df in found if df is not None]
    every = None
    for part in parts:
        every = part if every is None else every.unionByName(part)
    return every


def with_retries(call: Callable[[], object], attempts: int = 5, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """The call's result; after a failure it is repeated, with pauses that double each time."""
    for attempt in range(attempts):
        try:
            return call()
        except (OSError, ValueError):
            if attempt == attempts - 1:
                raise
            sleep(pause * 2**attempt)
    raise ValueError("attempts must be positive")


def refill(tokens: float, elapsed: float, rate: float, capacity: float) -> float:
    """A token bucket after some seconds without use."""
    return min(capacity, tokens + elapsed * rate)


class Pages(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__(first)
        self.first, self.last = first, last


class PagedReader(DataSourceReader):
    """Reads numbered pages of JSON records, a range of pages a task. A page is only given on when it was read whole, so
    neither a repeated call nor a repeated task gives a record twice."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.pages, self.per_task = int(options.get("pages", "1")), int(options.get("pagesPerTask", "1"))
        self.attempts, self.pause = int(options.get("attempts", "5")), float(options.get("pause", "1.0"))

    def partitions(self) -> list[Pages]:
        return [Pages(p, min(self.pages, p + self.per_task)) for p in range(0, self.pages, self.per_task)]

    def fetch(self, page: int) -> list[dict]:
        """One page; a landing job's folder here, a service in a subclass."""
        with open(os.path.join(self.folder, f"page-{page:05d}.json"), encoding="utf-8") as file:
            return json.load(file)

    def read(self, partition: Pages) -> Iterator[tuple]:
        for page in range(partition.first, partition.last):
            for i, record in enumerate(with_retries(lambda page=page: self.fetch(page), self.attempts, self.pause)):
                yield page, i, record.get("id"), record.get("text")


class PagedSource(DataSource):
    """spark.read.format("millrace_pages").option("path", folder).option("pages", n): page, place, id, text."""

    @classmethod
    def name(cls) -> str:
        return "millrace_pages"

    def schema(self) -> str:
        return "page int, place int, id string, text string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)


def catalog(spark: SparkSession, path: str, section: str | None = None) -> DataFrame:
    """Rows (name, attributes: map of JSON values) of a YAML or JSON catalog of stages, topics or sources: a mapping from
    names, or a list of mappings with a name. Catalogs are small; their size is checked."""
    with open(path, encoding="utf-8") as file:
        if path.endswith((".yaml", ".yml")):
            import yaml

            content = yaml.safe_load(file)
        else:
            content = json.load(file)
    for part in section.split(".") if section else ():
        content = (content or {}).get(part)
    content = content or {}
    items = list(content.items()) if isinstance(content, dict) else [(c.get("name", str(i)) if isinstance(c, dict) else str(c), c) for i, c in enumerate(content)]
    if len(items) > CATALOG_ROWS:
        raise ValueError(f"more than {CATALOG_ROWS} entries in {path}")
    rows = [(str(name), {str(k): json.dumps(v, ensure_ascii=False, default=str) for k, v in (value if isinstance(value, dict) else {"value": value}).items()}) for name, value in items]
    return spark.createDataFrame(rows, "name string, attributes map<string,string>")


def best_existing(metadata: DataFrame, listing: DataFrame, key: str, value: str) -> DataFrame:
    """One row (best_key, best_value): the entry with the least value whose file is in the listing; of equal values the
    first key. Entries without a value do not count; nothing is left of an empty table but nulls."""
    there = metadata.where(F.col(value).isNotNull()).join(listing.select(key), key, "left_semi")
    return there.agg(F.min(F.struct(F.col(value).alias("v"), F.col(key).alias("k"))).alias("b")).select(F.col("b.k").alias("best_key"), F.col("b.v").alias("best_value"))


def best_checkpoint(spark: SparkSession, folder: str, value: str = "val_ce_loss") -> DataFrame:
    """The checkpoint (step_*.pt) with the least value in its sidecar step_*.json; unreadable sidecars are passed over."""
    name = lambda suffix: F.regexp_extract("path", r"([^/]+)\.%s$" % suffix, 1)
    files = lambda suffix: spark.read.format("binaryFile").option("pathGlobFilter", f"step_*.{suffix}").load(folder)
    sidecars = files("json").select(name("json").alias("name"), F.get_json_object(F.col("content").cast("string"), f"$.{value}").try_cast("double").alias(value))
    return best_existing(sidecars, files("pt").select(name("pt").alias("name")), "name", value)


def search_plan(spark: SparkSession, years: list[int], topics: list[str], per_page: int = 50, pages: int = 20) -> DataFrame:
    """One row a request of a search by year and topic: year, topic, query, offset. Years and topics are short lists."""
    of_years = spark.createDataFrame([(y,) for y in years], "year int")
    of_topics = spark.createDataFrame([(t,) for t in topics], "topic string")
    offsets = F.explode(F.transform(F.sequence(F.lit(0), F.lit(pages - 1)), lambda p: p * per_page)).alias("offset")
    return of_years.crossJoin(F.broadcast(of_topics)).select("year", "topic", F.concat_ws(" ", "topic", F.col("year").cast("string")).alias("query"), offsets)


def in_years(published: Column, first: int, last: int) -> Column:
    """A published date in the years from first to last; a null date is in none."""
    return F.coalesce(published.between(F.make_timestamp(F.lit(first), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), F.make_timestamp(F.lit(last), F.lit(12), F.lit(31), F.lit(23), F.lit(59), F.lit(59.999999))), F.lit(False))
