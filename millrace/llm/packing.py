"""Filling containers of fixed capacity with documents, splitting only what is larger than a container.

A document larger than the capacity gives full pieces, each a container of its own, and a rest. Items (rests and whole
documents) are dealt to shards by hash and packed there in falling size by best fit under conflicts: open bins are kept
in order of their free space; each bin carries a bitmap of its sources and one of its duplicate clusters; from the
smallest sufficient free space on, the search goes to the next larger one until a compatible bin is found, which is
then the tightest. Two documents of one duplicate cluster never share a container, nor do documents of two sources that
`source_conflicts` names. The bins of a shard that stay less full than `full` are opened again, and their items are
packed together once more in fewer shards, until one shard's worth is left; the number of those is small, as every
shard leaves few open bins.

Defined cases: null and empty texts have size 0 and stand in no container (container and order are null, piece 0);
a null id is packed like any other; ties are broken by id and text; repeated rows are different items of one cluster,
so each stands in another container; a capacity that is null or under 1 gives no rows; empty tables give none either.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import materialize

SHARD_ITEMS = 20_000
"""Items that one task packs at a time; the number of shards follows the number of items."""
FULL = 0.98
PLANS = 1000
SOURCE_CONFLICTS = (("legal", "social_media"), ("legal", "forums"), ("academic", "social_media"), ("academic", "forums"))
"""Sources the queries keep apart: edited reference texts do not share a container with unmoderated talk."""


class BestFit:
    """Bins ordered by free space, with bitmaps of sources and duplicate clusters."""

    def __init__(self, capacity: int, conflicts: dict[int, int] | None = None):
        self.capacity, self.conflicts = capacity, conflicts or {}
        self.free: list[tuple[int, int]] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.room: list[int] = []
        self.items: list[list[int]] = []

    def place(self, item: int, size: int, source: int, cluster: int) -> int:
        """The bin of the item: the tightest compatible one, else a new one. cluster and source are bit numbers, -1 none."""
        at = bisect_left(self.free, (size, -1))
        bad = self.conflicts.get(source, 0)
        mark = 1 << cluster if cluster >= 0 else 0
        while at < len(self.free):
            number = self.free[at][1]
            if not self.clusters[number] & mark and not self.sources[number] & bad:
                break
            at += 1
        if at < len(self.free):
            room, number = self.free.pop(at)
        else:
            number, room = len(self.room), self.capacity
            self.sources.append(0)
            self.clusters.append(0)
            self.room.append(room)
            self.items.append([])
        self.sources[number] |= 1 << source if source >= 0 else 0
        self.clusters[number] |= mark
        self.room[number] = room - size
        self.items[number].append(item)
        if room > size:
            insort(self.free, (room - size, number))
        return number


def pack_items(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int, conflicts: dict[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, position in it and the bin's free space of each item, packed in falling size."""
    packer = BestFit(capacity, conflicts)
    kinds, cluster_of = np.unique(clusters, return_inverse=True)
    several = np.bincount(cluster_of, minlength=len(kinds)) > 1
    bit = np.where(several, np.cumsum(several) - 1, -1)[cluster_of] if len(kinds) else np.zeros(0, np.int64)
    bins = np.zeros(len(sizes), np.int64)
    for i in np.lexsort((np.arange(len(sizes)), -sizes)):
        bins[i] = packer.place(int(i), int(sizes[i]), int(sources[i]), int(bit[i]))
    place = np.zeros(len(sizes), np.int64)
    for members in packer.items:
        for position, item in enumerate(members):
            place[item] = position
    return bins, place, np.array(packer.room, np.int64)[bins] if len(bins) else bins


def _source_bits(conflicts: tuple[tuple[str, str], ...]) -> tuple[dict[str, int], dict[int, int]]:
    """Number of each source that has conflicts, and by that number the bitmap of the sources it conflicts with."""
    number = {n: i for i, n in enumerate(sorted({n for pair in conflicts for n in pair}))}
    bad = dict.fromkeys(number.values(), 0)
    for a, b in conflicts:
        bad[number[a]] |= 1 << number[b]
        bad[number[b]] |= 1 << number[a]
    return number, bad


def _source_number(number: dict[str, int]) -> Column:
    known = F.create_map(*[F.lit(x) for kv in number.items() for x in kv])[F.col("source")] if number else F.lit(None)
    return F.coalesce(known, F.lit(-1)).cast("int")


def near_copy_cluster(text: Column) -> Column:
    """Equal for texts that differ in case, punctuation and spaces only; null for texts without letters and digits."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.length(words) > 0, F.xxhash64(words))


def pack(sized: DataFrame, plans: DataFrame, source_conflicts: tuple[tuple[str, str], ...] = (), rounds: int = 2) -> DataFrame:
    """plan_id, container, position, piece, doc_id, tokens for sized (doc_id, tokens, source, cluster) and plans (plan_id, seq_len).

    container is a string (plan, round, shard, number), unique within a plan.
    """
    capacities = plans.where("seq_len >= 1 and plan_id is not null").select("plan_id", F.col("seq_len").cast("long").alias("seq_len")).distinct().limit(PLANS + 1).collect()
    if len(capacities) > PLANS:
        raise ValueError(f"more than {PLANS} plans")
    number, bits = _source_bits(source_conflicts)
    items = sized.select("doc_id", F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("tokens"), _source_number(number).alias("source"), F.coalesce(F.col("cluster"), F.xxhash64("doc_id")).cast("long").alias("cluster"))
    plan_rows = [F.struct(F.lit(r["plan_id"]).cast("int").alias("plan_id"), F.lit(r["seq_len"]).cast("long").alias("seq_len")) for r in capacities]
    no_plan = F.from_json(F.lit("[]"), "array<struct<plan_id:int,seq_len:long>>")
    every = items.withColumn("plan", F.explode(F.array(*plan_rows) if plan_rows else no_plan)).select("*", "plan.plan_id", "plan.seq_len").drop("plan")
    none = every.where("tokens <= 0").select("plan_id", F.lit(None).cast("string").alias("container"), F.lit(None).cast("int").alias("position"), F.lit(0).alias("piece"), "doc_id", "tokens")
    wholes = F.expr("tokens div seq_len")
    whole = every.where("tokens >= seq_len").select("plan_id", "seq_len", "doc_id", F.explode(F.sequence(F.lit(0), (wholes - 1).cast("int"))).alias("piece"))
    full = whole.select("plan_id", F.concat_ws("-", "plan_id", F.lit("full"), "doc_id", "piece", F.monotonically_increasing_id()).alias("container"), F.lit(0).alias("position"), "piece", "doc_id", F.col("seq_len").alias("tokens"))
    rest = every.where("tokens > 0 and tokens % seq_len > 0").select("plan_id", "seq_len", "doc_id", wholes.cast("int").alias("piece"), F.expr("tokens % seq_len").alias("tokens"), "source", "cluster")
    packed = None
    for turn in range(rounds):
        counts = rest.groupBy("plan_id").agg(F.count("*").alias("n"))
        shards = F.greatest(F.lit(1), F.ceil(F.col("n") / SHARD_ITEMS)).cast("long")
        dealt = rest.join(F.broadcast(counts), "plan_id").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster", F.lit(turn)), shards)).drop("n")
        filled = _pack_shards(dealt, turn, bits)
        last = turn == rounds - 1
        done = filled if last else filled.where(F.col("room") <= (1 - FULL) * F.col("seq_len"))
        done = done.select("plan_id", "container", "position", "piece", "doc_id", "tokens")
        packed = done if packed is None else packed.unionByName(done)
        rest = filled.where(F.col("room") > (1 - FULL) * F.col("seq_len")).select("plan_id", "seq_len", "doc_id", "piece", "tokens", "source", "cluster")
    return packed.unionByName(full).unionByName(none)


def _pack_shards(dealt: DataFrame, turn: int, bits: dict[int, int]) -> DataFrame:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["tokens", "cluster", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        capacity = int(group["seq_len"].iloc[0])
        bins, place, room = pack_items(group["tokens"].to_numpy(), group["source"].to_numpy(), group["cluster"].to_numpy(), capacity, bits)
        head = f"{group['plan_id'].iloc[0]}-{turn}-{group['shard'].iloc[0]}-"
        return group.assign(container=[head + str(b) for b in bins], position=place.astype("int32"), room=room).drop(columns="shard")

    columns = "plan_id int, seq_len long, doc_id {doc}, piece int, tokens long, source int, cluster long, container string, position int, room long"
    kind = dealt.schema["doc_id"].dataType.simpleString()
    ordered = dealt.select("plan_id", "seq_len", "doc_id", "piece", "tokens", "source", "cluster", "shard")
    return materialize(ordered.groupBy("plan_id", "shard").applyInPandas(run, columns.format(doc=kind)))


def fill_rate(packed: DataFrame, plans: DataFrame) -> DataFrame:
    """Containers, tokens and used share of each plan."""
    used = packed.where("container is not null").groupBy("plan_id").agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    return used.join(plans.select("plan_id", "seq_len"), "plan_id").select("plan_id", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("seq_len")), 6).alias("used_share"))


def violations(packed: DataFrame, sized: DataFrame, plans: DataFrame, source_conflicts: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """For each plan the documents placed, and what must be 0: containers beyond the capacity, with conflicting sources or
    with two documents of a cluster; documents split without need; documents whose pieces do not add up to their size."""
    number, bits = _source_bits(source_conflicts)
    known = sized.select(F.col("doc_id").alias("doc"), F.coalesce("tokens", F.lit(0)).alias("size"), _source_number(number).alias("source"), F.coalesce("cluster", F.xxhash64("doc_id")).alias("cluster"))
    placed = packed.join(known, F.col("doc_id").eqNullSafe(F.col("doc"))).join(F.broadcast(plans.select("plan_id", "seq_len").distinct()), "plan_id")
    boxes = placed.where("container is not null").groupBy("plan_id", "seq_len", "container").agg(F.sum("tokens").alias("used"), F.collect_set("source").alias("sources"), (F.count("*") - F.count_distinct("cluster")).alias("twins"))
    clash = F.lit(False)
    for a, bad in bits.items():
        for b in range(a + 1, len(number)):
            if bad >> b & 1:
                clash = clash | F.array_contains("sources", a) & F.array_contains("sources", b)
    count = lambda condition, name: F.sum(F.when(condition, 1).otherwise(0)).alias(name)
    bad_boxes = boxes.groupBy("plan_id").agg(count(F.col("used") > F.col("seq_len"), "over_capacity"), count(clash, "conflicts"), count(F.col("twins") > 0, "twins"))
    documents = placed.groupBy("plan_id", "seq_len", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("size").alias("size"))
    split = (F.col("pieces") > 1) & (F.col("size") <= F.col("seq_len")) | (F.col("pieces") > F.ceil(F.col("size") / F.col("seq_len"))) & (F.col("size") > 0)
    bad_documents = documents.groupBy("plan_id").agg(F.count("*").alias("documents"), count(split, "split"), count(F.col("tokens") != F.col("size"), "incomplete"))
    return bad_documents.join(bad_boxes, "plan_id", "left").na.fill(0).select("plan_id", "documents", "over_capacity", "conflicts", "twins", "split", "incomplete")
