"""Mixing of sources to target weights.

Each record gets a hash-random 64-bit key. Within its source, records are ordered by that key; the key's leading bits
cut every source into equal ranges, so a source of any size is spread over `RANGES` groups and none is collected into
one task. Sums per range, a running sum over ranges (at most RANGES rows a source) and a running sum inside a range
give each record its place in tokens. A line of the plan takes the records before its budget, the last one in part,
and goes through the source again from the front as often as `repeat` allows.

Defined cases: names are compared without case, spaces, `-` and `_`; null, zero and negative token counts add nothing
and are not selected; rows with one id in one source count once (the largest count holds); null or negative weights
are 0, as are weights without a value in decimal(38, 12) (not a number, infinite); weights are taken to 12 decimals, so
that their sum does not depend on the order of addition; null `repeat` is 1, negative is 0; null `max_tokens` is no limit; a source without records has 0 tokens
available; a stage without positive weights needs 0 tokens of every source; records with a null id or source are not
part of any source; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES_BITS = 12
"""Every source is cut into 2**12 key ranges."""
PLAN_ROWS = 20_000
"""Plans of at most so many lines are broadcast; larger ones are joined by source and range."""


def source_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[\\s_-]", "")


def _positive(value: Column) -> Column:
    value = value.cast("double")
    return F.when(value.isNull() | F.isnan(value) | (value < 0), F.lit(0.0)).otherwise(value)


def _weight(value: Column) -> Column:
    """Exact decimal, 0 for null, negative and unusable weights."""
    exact = F.coalesce(value.cast("double").try_cast("decimal(38,12)"), F.lit(0).cast("decimal(38,12)"))
    return F.greatest(exact, F.lit(0).cast("decimal(38,12)"))


def keyed_records(records: DataFrame, seed: int = 0) -> DataFrame:
    """Distinct records with a positive size: source_key, record_id, tokens, order_key, key_range."""
    return (
        records.select(source_key(F.col("source")).alias("source_key"), "record_id", F.col("token_count").cast("long").alias("tokens"))
        .where("source_key is not null and record_id is not null and tokens > 0")
        .groupBy("record_id", "source_key")
        .agg(F.max("tokens").alias("tokens"))
        .withColumn("order_key", F.xxhash64(F.lit(seed), "record_id"))
        .withColumn("key_range", F.shiftright("order_key", 64 - RANGES_BITS))
    )


def range_offsets(keyed: DataFrame) -> DataFrame:
    """Prefix sums over the ranges of each source: source_key, key_range, range_tokens, before."""
    sums = keyed.groupBy("source_key", "key_range").agg(F.sum("tokens").alias("range_tokens"))
    order = Window.partitionBy("source_key").orderBy("key_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sums.withColumn("before", F.sum("range_tokens").over(order) - F.col("range_tokens"))


def plan_budgets(offsets: DataFrame, sources: DataFrame, stages: DataFrame) -> DataFrame:
    """One row per line of `sources`: needed, available and planned tokens, whole epochs and the rest of the last one."""
    totals = offsets.groupBy("source_key").agg(F.max(F.col("before") + F.col("range_tokens")).alias("source_tokens"))
    share = Window.partitionBy("stage")
    lines = (
        sources.select("stage", "name", F.col("weight"), F.col("repeat"), F.col("max_tokens"))
        .withColumn("source_key", source_key(F.col("name")))
        .withColumn("weight", _weight(F.col("weight")))
        .withColumn("weights", F.sum("weight").over(share).cast("double"))
        .withColumn("weight", F.col("weight").cast("double"))
        .withColumn("weight_share", F.col("weight") / F.nullif(F.col("weights"), F.lit(0.0)))
        .withColumn("repeat", F.when(F.col("repeat").isNull(), 1.0).otherwise(_positive(F.col("repeat"))))
        .join(stages.select("stage", "target_tokens"), "stage", "left")
        .join(totals, "source_key", "left")
    )
    total = F.coalesce(F.col("source_tokens"), F.lit(0))
    once = F.greatest(F.lit(0), F.least(total, F.coalesce(F.col("max_tokens"), total)))
    return (
        lines.withColumn("epoch_tokens", once.cast("long"))
        .withColumn("needed", F.coalesce(F.col("target_tokens") * F.col("weight") / F.nullif(F.col("weights"), F.lit(0.0)), F.lit(0.0)))
        .withColumn("available", F.col("epoch_tokens") * F.col("repeat"))
        .withColumn("planned", F.floor(F.least("needed", "available")).cast("long"))
        .withColumn("whole_epochs", F.when(F.col("epoch_tokens") > 0, F.expr("planned div epoch_tokens")).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest_tokens", F.col("planned") - F.col("whole_epochs") * F.col("epoch_tokens"))
        .withColumn("short", F.col("available") < F.col("needed"))
    )


def select_records(keyed: DataFrame, offsets: DataFrame, budgets: DataFrame) -> DataFrame:
    """Rows taken by each line: stage, name, record_id, tokens, times (whole uses) and tokens_taken (all uses together)."""
    inside = Window.partitionBy("source_key", "key_range").orderBy("order_key", "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        keyed.withColumn("in_range", F.sum("tokens").over(inside) - F.col("tokens"))
        .join(offsets.select("source_key", "key_range", "before"), ["source_key", "key_range"])
        .withColumn("start", F.col("before") + F.col("in_range"))
    )
    wanted = budgets.where("planned > 0").select("stage", "name", "source_key", "epoch_tokens", "whole_epochs", "rest_tokens")
    if wanted.limit(PLAN_ROWS + 1).count() <= PLAN_ROWS:
        joined = placed.join(F.broadcast(wanted), "source_key")
    else:
        ranges = F.explode(F.sequence(F.lit(-(1 << (RANGES_BITS - 1))), F.lit((1 << (RANGES_BITS - 1)) - 1)))
        joined = placed.join(wanted.withColumn("key_range", ranges), ["source_key", "key_range"])
    size = F.col("tokens")
    whole = F.greatest(F.lit(0), F.least(size, F.col("epoch_tokens") - F.col("start")))
    rest = F.greatest(F.lit(0), F.least(size, F.col("rest_tokens") - F.col("start")))
    return (
        joined.withColumn("tokens_taken", whole * F.col("whole_epochs") + rest)
        .where("tokens_taken > 0")
        .select("stage", "name", "record_id", "tokens", (F.col("whole_epochs") + (rest > 0).cast("long")).alias("times"), "tokens_taken")
    )


def mix(records: DataFrame, sources: DataFrame, stages: DataFrame, seed: int = 0) -> dict[str, DataFrame]:
    """The plan (`budgets`), the rows it takes (`selected`) and, from these rows, what each line got (`report`)."""
    keyed = keyed_records(records, seed)
    offsets = range_offsets(keyed)
    budgets = plan_budgets(offsets, sources, stages)
    selected = select_records(keyed, offsets, budgets)
    return {"budgets": budgets, "selected": selected, "report": mix_report(budgets, selected)}


def mix_report(budgets: DataFrame, selected: DataFrame) -> DataFrame:
    got = selected.groupBy("stage", "name").agg(F.sum("tokens_taken").alias("actual_tokens"), F.count("*").alias("records"), F.max("times").alias("most_uses"))
    lines = budgets.select("stage", "name", "weight_share", "needed", "planned", "epoch_tokens").distinct().join(got, ["stage", "name"], "left").na.fill(0, ["actual_tokens", "records", "most_uses"])
    stage_total = F.sum("actual_tokens").over(Window.partitionBy("stage"))
    return lines.select(
        "stage",
        "name",
        F.floor("needed").cast("long").alias("needed_tokens"),
        F.col("planned").alias("planned_tokens"),
        "actual_tokens",
        "records",
        "most_uses",
        F.round(F.col("actual_tokens") / F.when(F.col("epoch_tokens") > 0, F.col("epoch_tokens")), 6).alias("repeats"),
        F.round("weight_share", 6).alias("target_share"),
        F.round(F.col("actual_tokens") / F.when(stage_total > 0, stage_total), 6).alias("actual_share"),
    )


def unreachable_shares(records: DataFrame, sources: DataFrame, stages: DataFrame) -> DataFrame:
    """Lines whose source, used as often as allowed, has fewer tokens than the line needs."""
    budgets = plan_budgets(range_offsets(keyed_records(records)), sources, stages)
    return budgets.where("short").select("stage", "name").distinct()
