"""Quality score of a text from four parts: length, special characters, repetition and sentence structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as tx

# Defaults of the score.
MIN_TOKENS, MAX_TOKENS = 50, 4096
MAX_SPECIAL, MAX_REPETITION, MIN_SCORE = 0.1, 0.3, 0.6
WEIGHTS = {"length": 0.3, "special": 0.2, "repetition": 0.25, "sentence": 0.25}


def with_quality(df: DataFrame, text: str = "text", min_tokens: int = MIN_TOKENS, max_tokens: int = MAX_TOKENS, min_score: float = MIN_SCORE) -> DataFrame:
    """df plus the four scores, quality_score, passed and reasons. Row by row, no shuffle; null counts as empty text."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = df.withColumn("__t", t).withColumn("__words", tx.words(F.col("__t"))).withColumn("__sizes", F.transform(tx.sentences(F.col("__t")), lambda s: F.size(tx.words(s))))
    words, sizes = F.col("__words"), F.col("__sizes")
    measured = base.withColumns(
        {
            "__tokens": tx.approx_tokens(F.col("__t")),
            "__special": F.regexp_count("__t", F.lit(r"[^\p{L}\p{N}\s.,!?;:'\"-]")) / F.greatest(F.lit(1), F.length("__t")),
            "__distinct": F.size(F.array_distinct(words)),
            "__once": F.size(F.array_distinct(words)) - F.size(_repeated(words)),
            "__letters": F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)),
            "__mean": F.when(F.size(sizes) > 0, F.aggregate(sizes, F.lit(0), lambda a, n: a + n) / F.size(sizes)).otherwise(F.lit(0.0)),
        }
    )
    tokens, special, mean = F.col("__tokens"), F.col("__special"), F.col("__mean")
    repetition = F.when(F.col("__distinct") > 0, (F.col("__distinct") - F.col("__once")) / F.col("__distinct")).otherwise(F.lit(0.0))
    average = F.when(F.size(words) > 0, F.col("__letters") / F.size(words)).otherwise(F.lit(0.0))
    odd_length = (average < 2) | (average > 15)
    length_score = F.when(tokens < min_tokens, tokens / min_tokens).when(tokens > max_tokens, F.greatest(F.lit(0.0), 1 - (tokens - max_tokens) / max_tokens)).otherwise(F.lit(1.0))
    special_score = F.greatest(F.lit(0.0), 1 - special / MAX_SPECIAL)
    repetition_score = F.greatest(F.lit(0.0), 1 - repetition / MAX_REPETITION) * F.when(odd_length, 0.8).otherwise(1.0)
    sentence_score = F.when(mean < 3, mean / 3).when(mean > 50, F.greatest(F.lit(0.5), 1 - (mean - 50) / 100)).otherwise(F.lit(1.0))
    scored = measured.withColumns({"length_score": length_score, "special_char_score": special_score, "repetition_score": repetition_score, "sentence_score": sentence_score})
    total = WEIGHTS["length"] * F.col("length_score") + WEIGHTS["special"] * F.col("special_char_score") + WEIGHTS["repetition"] * F.col("repetition_score") + WEIGHTS["sentence"] * F.col("sentence_score")
    empty = F.col("__t") == ""
    reasons = F.array_compact(
        F.array(
            F.when(tokens < min_tokens, F.lit("too_short")),
            F.when(tokens > max_tokens, F.lit("too_long")),
            F.when(special > MAX_SPECIAL, F.lit("too_many_special_chars")),
            F.when(repetition > MAX_REPETITION, F.lit("high_word_repetition")),
            F.when((average < 2) & (F.size(words) > 0), F.lit("words_too_short")),
            F.when(average > 15, F.lit("words_too_long")),
            F.when(F.col("sentence_score") < 0.5, F.lit("poor_sentence_structure")),
        )
    )
    done = scored.withColumn("quality_score", F.when(empty, 0.0).otherwise(total)).withColumn("reasons", F.when(empty, F.array(F.lit("empty_text"))).otherwise(reasons))
    done = done.withColumn("passed", (F.col("quality_score") >= min_score) & (F.size("reasons") == 0))
    return done.drop("__t", "__words", "__sizes", "__tokens", "__special", "__distinct", "__once", "__letters", "__mean")


def _repeated(words: Column) -> Column:
    """Distinct words that occur more than once: those equal to their neighbour when sorted."""
    ordered = F.array_sort(words)
    pairs = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.array_compact(F.zip_with(F.slice(ordered, F.lit(1), pairs), F.slice(ordered, F.lit(2), pairs), lambda a, b: F.when(a == b, a))))


def quality_summary(scored: DataFrame, *by: str) -> DataFrame:
    return scored.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if("passed").alias("passed"),
        F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"),
        F.round(F.avg("quality_score"), 6).alias("avg_score"),
        F.round(F.min("quality_score"), 6).alias("min_score"),
        F.round(F.max("quality_score"), 6).alias("max_score"),
    )


def reason_counts(scored: DataFrame) -> DataFrame:
    return scored.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
