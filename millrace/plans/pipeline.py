"""Batch pipelines: cleaning to kept and dropped documents with reasons, and the instruction builder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions import udfs
from millrace.operators import dedup, guardrails, quality
from millrace.session import materialize, spread


def process(documents: DataFrame, key: str = "doc_id", text: str = "text", targets: tuple[str, ...] = ("pt", "en", "es"), least_confidence: float = 0.2, min_score: float = 0.6) -> DataFrame:
    """documents plus cleaned text, scores, drop_reason (null: kept) and pii_removed.

    The order of the steps is clean, language, quality, duplicate, content, personal data; a document has one reason, the
    first. Duplicates, equal or similar texts, are looked for among documents that passed language and quality only, and
    one that content rejects still makes later copies duplicates. In the clean_text of kept documents personal data is
    masked; pii_removed says where there was any. Of the other documents clean_text stays as it was judged.

    The cleaned text and then the scores are written once to the checkpoint folder: filters on either would otherwise take
    the whole chain of expressions along and evaluate it again at every mention.
    """
    cleaned = materialize(spread(documents).withColumn("clean_text", tx.clean(F.col(text))))
    judged = guardrails.detect_language(cleaned, "clean_text", targets, least_confidence)
    scored = quality.with_quality(judged, "clean_text", min_score=min_score)
    early = F.when(~F.col("is_target"), "language").when(~F.col("passed"), "quality")
    staged = materialize(scored.withColumn("__early", early))
    marks = dedup.mark_similar(staged.where("__early is null"), key, "clean_text")
    repeated = marks.where("is_duplicate").select(F.col("id").alias(key), F.lit(True).alias("__repeated")).distinct()
    content = F.size(guardrails.content_reasons(F.col("clean_text"))) > 0
    reason = F.coalesce(F.col("__early"), F.when(F.col("__repeated"), "duplicate"), F.when(content, "content"))
    reasoned = staged.join(repeated, key, "left").withColumn("drop_reason", reason).drop("__early", "__repeated")
    kept = F.col("drop_reason").isNull()
    masked = udfs.mask_pii(F.when(kept, F.col("clean_text")), guardrails.pii_patterns(), labels=guardrails.PII_LABELS)
    removed = F.coalesce(F.col("__masked") != F.col("clean_text"), F.lit(False))
    return reasoned.withColumn("__masked", masked).withColumn("pii_removed", removed).withColumn("clean_text", F.coalesce("__masked", "clean_text")).drop("__masked")


def counters(processed: DataFrame) -> DataFrame:
    """reason (kept for none), documents, share of all and documents with personal data removed."""
    each = processed.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("documents"), F.count_if("pii_removed").alias("pii_removed"))
    each = materialize(each)
    total = each.agg(F.sum("documents").alias("total"))
    return each.crossJoin(F.broadcast(total)).select("reason", "documents", F.round(F.col("documents") / F.greatest(F.lit(1), F.col("total")), 6).alias("share"), "pii_removed")


def build_instructions(items: DataFrame, key: str = "id", most: int | None = None) -> DataFrame:
    """Instruction rows from items with title and text: cleaned, long enough, past the blacklist, first of their kind."""
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    kept = items.withColumn("text", text).where(F.length("text") >= 50).where(guardrails.blacklist_passes(F.col("text")) & guardrails.blacklist_passes(F.col("title")))
    first = dedup.mark_first(kept, dedup.spaceless_key(F.col("text")), key).where(~F.col("is_duplicate"))
    rows = first.select(
        key,
        F.concat(F.lit("Explain the following topic: "), F.coalesce("title", F.lit(""))).alias("instruction"),
        F.lit("").alias("input"),
        F.col("text").alias("output"),
        guardrails.topics(F.col("text")).alias("topics"),
        guardrails.entities(F.col("text")).alias("entities"),
    )
    return rows.orderBy(key).limit(most) if most is not None else rows


def augment(rows: DataFrame, wanted: int, key: str = "id", seed: int = 0) -> DataFrame:
    """rows topped up to `wanted` with copies whose sentences are shuffled, marked in the instruction."""
    have = rows.count()
    if have == 0 or have >= wanted:
        return rows.withColumn("copy", F.lit(0))
    rounds = -(-(wanted - have) // have)
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    parts = F.split("output", r"\. ")
    order = F.array_sort(F.transform(parts, lambda p, i: F.struct(F.xxhash64(F.lit(seed), F.col(key), F.col("copy"), i).alias("h"), p.alias("p"))))
    mixed = F.array_join(F.transform(order, lambda s: s["p"]), ". ")
    made = copies.withColumn("output", mixed).withColumn("instruction", F.concat("instruction", F.when(F.col("copy") == 1, " (Augmented)").otherwise(" [Synthetically Generated]")))
    return rows.withColumn("copy", F.lit(0)).unionByName(made.orderBy("copy", key).limit(wanted - have))
