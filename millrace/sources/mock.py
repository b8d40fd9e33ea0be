"""A data source of made-up records: spark.read.format("millrace_mock").option("years", "2020,2021").load()."""

from __future__ import annotations

import random
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed templates.
TEMPLATES = (
    "The market for {thing} grew by {n} percent in {year}.",
    "Researchers published {n} papers on {thing} in {year}.",
    "A survey of {n} firms found that {thing} was the main topic of {year}.",
    "The price of {thing} changed {n} times in {year}.",
)
THINGS = ("solar panels", "batteries", "vaccines", "chips", "grain", "bonds", "satellites", "reactors")


class Year(InputPartition):
    def __init__(self, year: int):
        self.year = year


class MockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.years = [int(y) for y in options.get("years", "2024").split(",")]
        self.rows, self.seed = int(options.get("rows", "5000")), int(options.get("seed", "0"))

    def partitions(self) -> list[Year]:
        return [Year(y) for y in self.years]

    def read(self, partition: Year) -> Iterator[tuple]:
        pick = random.Random(f"{self.seed}|{partition.year}")
        for i in range(self.rows):
            text = pick.choice(TEMPLATES).format(thing=pick.choice(THINGS), n=pick.randint(2, 900), year=partition.year)
            yield f"{partition.year}-{i:06d}", f"Report {i}", text, f"{partition.year}-{pick.randint(1, 12):02d}-{pick.randint(1, 28):02d}"


class MockSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "millrace_mock"

    def schema(self) -> str:
        return "id string, title string, text string, date string"

    def reader(self, schema) -> MockReader:
        return MockReader(self.options)


def register(spark: SparkSession) -> None:
    """Every collector registers its data source here."""
    spark.dataSource.register(MockSource)
