"""Probabilities, sampling filters, quantisation and norms on vectors, one row an element or array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def softmax(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, i, v, p): one row an element. Computed inside the row before it is exploded: no shuffle."""
    e = F.transform(vector, lambda v: v.cast("double"))
    z = F.transform("__e", lambda v: F.exp(v - F.array_max("__e")))
    rows = df.select(key, e.alias("__e")).withColumn("__z", z).withColumn("__s", F.aggregate("__z", F.lit(0.0), lambda a, x: a + x))
    pairs = F.transform("__z", lambda x, i: F.struct(i.alias("i"), F.get("__e", i).alias("v"), (x / F.col("__s")).alias("p")))
    return rows.select(key, F.inline(pairs))


def top_k(probabilities: DataFrame, key: str, k: int) -> DataFrame:
    """Elements whose probability is at least the k-th; ties stay."""
    return probabilities.withColumn("__r", F.rank().over(Window.partitionBy(key).orderBy(F.desc("p")))).where(F.col("__r") <= k).drop("__r")


def min_p(probabilities: DataFrame, key: str, share: float) -> DataFrame:
    return probabilities.withColumn("__m", F.max("p").over(Window.partitionBy(key))).where(F.col("p") >= share * F.col("__m")).drop("__m")


def top_p(probabilities: DataFrame, key: str, mass: float) -> DataFrame:
    """Elements before which, in falling order, at most `mass` has been taken."""
    order = Window.partitionBy(key).orderBy(F.desc("p"), "i").rowsBetween(Window.unboundedPreceding, 0)
    return probabilities.withColumn("__b", F.sum("p").over(order) - F.col("p")).where(F.col("__b") <= mass).drop("__b")


def penalise(logit: Column, count: Column, repetition: float, frequency: float, presence: float) -> Column:
    changed = F.when(logit > 0, logit / repetition).otherwise(logit * repetition) - frequency * count - presence
    return F.when(count > 0, changed).otherwise(logit)


def squares(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))


def rms(vector: Column, epsilon: float = 1e-6) -> Column:
    return F.sqrt(squares(vector) / F.size(vector) + epsilon)


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot / F.greatest(F.sqrt(squares(a)) * F.sqrt(squares(b)), F.lit(1e-12))


def ternary_scale(vector: Column) -> Column:
    return F.greatest(F.aggregate(vector, F.lit(0.0), lambda a, v: a + F.abs(v)) / F.size(vector), F.lit(1e-5))


def ternary(vector: Column) -> Column:
    """-1, 0 or 1 for each weight over the mean absolute weight, rounded half to even."""
    scale = ternary_scale(vector)
    return F.transform(vector, lambda v: F.bround(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v / scale)), 0).cast("int"))


def router_load(probabilities: DataFrame, key: str, experts: int, k: int) -> DataFrame:
    """How many tokens each expert gets by the top k, and its mean probability."""
    ranked = probabilities.withColumn("expert", (F.col("i") % experts).cast("int")).withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("p"), "i")))
    return ranked.groupBy("expert").agg(F.count_if(F.col("__r") <= k).alias("routed"), F.round(F.avg("p"), 8).alias("mean_p"))


def tensor_categories(tensors: DataFrame, name: str, values: str, patterns: dict[str, str]) -> DataFrame:
    """By category (the first pattern that the tensor's name matches, else other): tensors, means of the tensors' mean
    magnitude, deviation, least and greatest value, root of the summed squares, and tensors with NaN or infinite values.

    A tensor's statistics are computed inside its row; only finite values count in them.
    """
    v = F.filter(values, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))
    n = F.size(v)
    total = lambda f: F.aggregate(v, F.lit(0.0), lambda a, x: a + f(x))
    kind = F.lit(None).cast("string")
    for label, pattern in reversed(patterns.items()):
        kind = F.when(F.col(name).rlike(pattern), F.lit(label)).otherwise(kind)
    each = tensors.select(
        F.coalesce(kind, F.lit("other")).alias("category"),
        (total(F.abs) / n).alias("magnitude"),
        F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (total(lambda x: x * x) - total(lambda x: x) * total(lambda x: x) / n) / (n - 1)))).alias("std"),
        F.array_min(v).alias("least"),
        F.array_max(v).alias("most"),
        total(lambda x: x * x).alias("squares"),
        F.exists(values, F.isnan).alias("has_nan"),
        F.exists(values, lambda x: F.abs(x) == float("inf")).alias("has_inf"),
    )
    means = [F.avg(c).alias(c) for c in ("magnitude", "std", "least", "most")]
    return each.groupBy("category").agg(F.count("*").alias("tensors"), *means, F.sqrt(F.sum("squares")).alias("norm"), F.count_if("has_nan").alias("nan_tensors"), F.count_if("has_inf").alias("inf_tensors"))
