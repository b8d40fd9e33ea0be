"""Stages, splits, interleaving, weighted choice and packing of token streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGE_ROWS = 10_000


def resolve_stage(steps: DataFrame, stages: DataFrame) -> DataFrame:
    """Each step's stage: the last one begun that has not ended, else the first of all. The stages are a small table; its
    size is checked, then it becomes one expression, so steps are not shuffled."""
    rows = stages.select("stage", "start_step", "end_step").orderBy("start_step").limit(STAGE_ROWS + 1).collect()
    if len(rows) > STAGE_ROWS:
        raise ValueError(f"more than {STAGE_ROWS} stages")
    chosen = F.lit(rows[0]["stage"]) if rows else F.lit(None).cast("string")
    for r in rows:
        inside = F.col("step") >= r["start_step"]
        if r["end_step"] is not None:
            inside = inside & (F.col("step") < r["end_step"])
        chosen = F.when(inside, F.lit(r["stage"])).otherwise(chosen)
    return steps.select("*", chosen.alias("stage"))


def hash_order(key: Column, seed: int = 0) -> Column:
    """A random-looking order key that other engines can compute too."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def hash_unit(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the first 8 hex digits of the order key."""
    return F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def split_by_hash(df: DataFrame, key: str, train: float = 0.9, validation: float = 0.05, seed: int = 0) -> DataFrame:
    u = hash_unit(F.col(key), seed)
    return df.withColumn("split", F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test"))


def round_robin(df: DataFrame, source: str, order: str, parts: int = 256) -> DataFrame:
    """df plus `turn`, the position of a row in its source; reading by (turn, source) interleaves the sources.

    `order` is a number, unique within a source. Positions are counted in ranges of it, so that a source of any size is
    spread over `parts` groups; only the ranges' counts are summed up by source.
    """
    edges = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    lo, hi = (edges["lo"] or 0), (edges["hi"] or 0)
    ranged = df.withColumn("__range", F.floor((F.col(order) - lo) / max(1, (hi - lo) // parts + 1)))
    counts = ranged.groupBy(source, "__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(source).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.join(counts.select(source, "__range", before.alias("__before")), [source, "__range"])
    inside = F.row_number().over(Window.partitionBy(source, "__range").orderBy(order))
    return placed.withColumn("turn", F.col("__before") + inside).drop("__range", "__before")


def first_per_group(df: DataFrame, by: str, order: list, most: int, salts: int = 64) -> DataFrame:
    """The first `most` rows of each group; large groups are cut in salted parts before they meet."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    part = F.row_number().over(Window.partitionBy(by, "__salt").orderBy(*order))
    few = salted.withColumn("__rn", part).where(F.col("__rn") <= most)
    return few.withColumn("__rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__rn") <= most).drop("__rn", "__salt")


def interleave(first: DataFrame, second: DataFrame, order: str, probability: float, seed: int = 0) -> DataFrame:
    """Rows of two streams with their output slot: each slot takes the next row of the first stream with the given
    probability, else of the second, until the chosen stream has ended. `order` is a number, unique in each stream."""
    spark = first.sparkSession
    sizes = [df.count() for df in (first, second)]
    slots = spark.range(0, sum(sizes)).select(F.col("id").alias("slot"), (hash_unit(F.col("id"), seed) < probability).cast("long").alias("__a"))
    counted = running_offsets(slots, "slot", "__a").withColumn("__i", F.when(F.col("__a") == 1, F.col("offset")).otherwise(F.col("slot") - F.col("offset")))
    ended = counted.where(((F.col("__a") == 1) & (F.col("__i") >= sizes[0])) | ((F.col("__a") == 0) & (F.col("__i") >= sizes[1]))).agg(F.min("slot").alias("end")).first()["end"]
    kept = counted if ended is None else counted.where(F.col("slot") < ended)
    tagged = [running_offsets(df.withColumn("__one", F.lit(1)), order, "__one").withColumnRenamed("offset", "__i").withColumn("__a", F.lit(a).cast("long")).drop("__one") for df, a in ((first, 1), (second, 0))]
    return tagged[0].unionByName(tagged[1]).join(kept.select("slot", "__a", "__i"), ["__a", "__i"]).drop("__a", "__i")


def weighted_choice(draws: DataFrame, sources: DataFrame, u: str = "u") -> DataFrame:
    """The source of each draw u in [0, 1) by cumulative weight * max(repeat, 0); without weight the first source."""
    rows = sources.select("name", (F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)) * F.greatest(F.coalesce("repeat", F.lit(1.0)), F.lit(0.0))).alias("w")).orderBy("name").limit(STAGE_ROWS + 1).collect()
    if len(rows) > STAGE_ROWS:
        raise ValueError(f"more than {STAGE_ROWS} sources")
    total, before = sum(r["w"] for r in rows), 0.0
    chosen = F.lit(rows[0]["name"]) if rows else F.lit(None).cast("string")
    for r in rows:
        if total > 0 and r["w"] > 0:
            chosen = F.when(F.col(u) >= before / total, F.lit(r["name"])).otherwise(chosen)
            before += r["w"]
    return draws.withColumn("name", chosen)


def running_offsets(df: DataFrame, order: str, size: str, parts: int = 1024) -> DataFrame:
    """df plus `offset`, the sum of `size` over all rows before in `order`, without putting all rows into one task: sums
    of ranges of the order key first (few rows), then running sums inside each range."""
    low_high = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    lo, hi = (low_high["lo"] or 0), (low_high["hi"] or 0)
    width = max(1, (hi - lo) // parts + 1)
    ranged = df.withColumn("__range", F.floor((F.col(order) - lo) / width))
    sums = ranged.groupBy("__range").agg(F.sum(size).alias("__sum"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    inside = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(before), "__range").withColumn("offset", F.col("__before") + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop("__range", "__before")


def windows_of(length: Column, size: int, stride: int) -> Column:
    """Begins of strided windows over a sequence, up to the first that reaches its end."""
    last = F.greatest(F.lit(0), F.ceil((length - size) / stride)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: i * stride)


def shifted_sample(tokens: Column, start: Column, length: int) -> tuple[Column, Column]:
    """input_ids and labels of a window; short windows are padded with 0 and -100."""
    window = F.slice(tokens, start + 1, F.lit(length + 1))
    inputs = F.slice(window, F.lit(1), F.least(F.size(window), F.lit(length)))
    labels = F.slice(window, F.lit(2), F.lit(length))
    pad = lambda a, v: F.concat(a, F.array_repeat(F.lit(v), F.greatest(F.lit(0), F.lit(length) - F.size(a))))
    return pad(inputs, 0), pad(labels, -100)


def shard_manifest(counts: DataFrame, source: str, records: str, size: int = 25_000) -> DataFrame:
    """(source, shard, records) of the size-bounded shards that counts of records make; sources without records have none."""
    shard = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({records} - 1) div {size}"))).alias("shard")
    each = counts.where(F.col(records) > 0).select(source, F.col(records).alias("__n"), shard)
    return each.select(source, "shard", F.least(F.lit(size), F.col("__n") - F.col("shard") * size).cast("long").alias("records"))
