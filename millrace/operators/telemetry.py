"""Ordered metric series: rolling statistics, counters, plateaus, phases and training regimes.

A series is a set of rows with a run key and an order; all functions use window frames partitioned by run. Fewer rows
than a statistic needs give 0.0, as the training loop reports them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Regimes and thresholds of the classifier.
CLIP_DOMINANT, CLIP_PERSISTENT, CLIP_SHARE, CLIP_RUN = 0.80, 0.70, 0.95, 5
LOSS_CV_HIGH, GRAD_STD_HIGH, NOISY_STD = 0.3, 2.0, 0.01
GRAD_STD_SCALE = 1.5
PLATEAU_DELTA, PLATEAU_PATIENCE, OVERFIT_EVALS = 0.02, 3, 5
STEADY_LR, STEADY_LOSS = 1e-6, 0.05


def frame(run: str, order: list[str], size: int) -> Window:
    return Window.partitionBy(run).orderBy(*order).rowsBetween(-(size - 1), 0)


def ratio(a: Column, b: Column) -> Column:
    """a / b of doubles; by zero infinite, or nan for 0 / 0, as in floating point, where Spark's division stops the query."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


def slope(value: Column, position: Column, over: Window) -> Column:
    n = F.count(value).over(over)
    return F.when(n >= 3, F.regr_slope(value, position).over(over)).otherwise(F.lit(0.0))


def rolling(df: DataFrame, value: str, run: str, order: list[str], size: int) -> DataFrame:
    """df plus n, mean, std, variation and trend of the last `size` values."""
    over = frame(run, order, size)
    v = F.col(value)
    numbered = df.withColumn("pos", F.row_number().over(Window.partitionBy(run).orderBy(*order)))
    n = F.count(v).over(over)
    return numbered.withColumns(
        {
            "n": n,
            "mean": F.coalesce(F.avg(v).over(over), F.lit(0.0)),
            "std": F.when(n >= 2, F.stddev_samp(v).over(over)).otherwise(F.lit(0.0)),
            "variation": F.when(n >= 2, F.max(v).over(over) - F.min(v).over(over)).otherwise(F.lit(0.0)),
            "trend": slope(v, F.col("pos"), over),
        }
    )


def consecutive(df: DataFrame, flag: Column, run: str, order: list[str], out: str) -> DataFrame:
    """df plus the number of rows up to this one for which flag has held without a break."""
    w = Window.partitionBy(run).orderBy(*order)
    held = df.withColumn("__flag", F.coalesce(flag, F.lit(False))).withColumn("__breaks", F.sum((~F.col("__flag")).cast("int")).over(w))
    inside = Window.partitionBy(run, "__breaks").orderBy(*order)
    return held.withColumn(out, F.sum(F.col("__flag").cast("long")).over(inside)).drop("__flag", "__breaks")


def divergence(df: DataFrame, value: str, run: str, order: list[str], slack: float = 0.001) -> DataFrame:
    """df plus best so far, whether the value is worse than it by more than slack, and for how many rows in a row."""
    best = F.min(value).over(Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    marked = df.withColumn("best", best).withColumn("diverged", F.col(value) > F.col("best") + slack)
    return consecutive(marked, F.col("diverged"), run, order, "diverged_for")


def stagnation(df: DataFrame, value: str, run: str, order: str, delta: float = PLATEAU_DELTA) -> DataFrame:
    """Rows since the best value last improved by more than delta, where only such values become the best.

    The counter depends on its own past, so each run is one group, gone through once in its order; a run's length is
    bounded by its number of evaluations. A null value is no improvement.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (run, order)}

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows, best, counter, out = rows.sort_values(order, kind="stable"), float("inf"), 0, []
        for v in rows[value]:
            better = v is not None and v < best - delta
            best, counter = (v, 0) if better else (best, counter + 1)
            out.append(counter)
        return pd.DataFrame({run: rows[run], order: rows[order], "counter": out})

    return df.select(run, order, value).groupBy(run).applyInPandas(fold, f"{run} {kinds[run]}, {order} {kinds[order]}, counter long")


def exponential_average(df: DataFrame, value: str, run: str, order: str, weight: float = 0.1) -> DataFrame:
    """Last exponential moving average of each run: prev * (1 - weight) + x * weight, starting at the first value."""
    listed = df.groupBy(run).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("__v"))
    fold = F.aggregate(F.slice(F.col("__v"), F.lit(2), F.greatest(F.size("__v") - 1, F.lit(0))), F.get("__v", F.lit(0)), lambda a, x: a * (1 - weight) + x * weight)
    return listed.select(run, fold.alias("average"))


def _evaluations(steps: DataFrame, run: str, order: list[str], loss: str, val_loss: str) -> DataFrame:
    """steps plus what the evaluations so far say: their number, range and deviation of the last PLATEAU_PATIENCE
    validation losses, and whether the last OVERFIT_EVALS had falling training and rising validation loss throughout."""
    evaluated = F.col(val_loss).isNotNull()
    of = Window.partitionBy(run, "__eval").orderBy(*order)
    last, before = of.rowsBetween(-(PLATEAU_PATIENCE - 1), 0), of.rowsBetween(-(OVERFIT_EVALS - 2), 0)
    parted = (F.col(loss) < F.lag(loss).over(of)) & (F.col(val_loss) > F.lag(val_loss).over(of))
    marked = steps.withColumn("__eval", evaluated).withColumn("__parted", F.coalesce(parted, F.lit(False)).cast("int"))
    each = marked.withColumns(
        {
            "__n": F.row_number().over(of),
            "__range": F.max(val_loss).over(last) - F.min(val_loss).over(last),
            "__std": F.coalesce(F.stddev_samp(val_loss).over(last), F.lit(0.0)),
            "__over": F.sum("__parted").over(before) >= OVERFIT_EVALS - 1,
        }
    )
    so_far = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    names = {"__n": "evals", "__range": "val_range", "__std": "val_std", "__over": "overfit"}
    held = {name: F.last(F.when(F.col("__eval"), F.col(c)), True).over(so_far) for c, name in names.items()}
    return each.withColumns(held).drop("__eval", "__parted", *names)


def classify(steps: DataFrame, run: str, order: list[str], loss: str, grad: str, clip: float, lr: str = "lr", val_loss: str = "val_loss", window: int = 50, scaled: bool = True) -> DataFrame:
    """steps plus the regime at each row, from rolling statistics of its run (no state, one sort a run).

    A row with a validation loss is an evaluation, its training loss is the row's. scaled: the classifier that knows
    clipping and tolerates noisier gradients, by precedence a run of clipped steps, dominant clipping, instability,
    persistent clipping without a clear fall of the loss, overfitting, plateaus, convergence, health; else the plain one,
    without clipping. Under ten steps every run is healthy.
    """
    base = Window.partitionBy(run).orderBy(*order)
    over, wide = frame(run, order, window), frame(run, order, 100)
    clipped = F.coalesce(F.col(grad) >= CLIP_SHARE * clip, F.lit(False))
    counted = consecutive(steps, clipped, run, order, "clipped_run").withColumn("pos", F.row_number().over(base))
    trend, recent = frame(run, order, 30), frame(run, order, 20)
    measured = _evaluations(counted, run, order, loss, val_loss).withColumns(
        {
            "loss_mean": F.coalesce(F.avg(loss).over(over), F.lit(0.0)),
            "loss_std": F.coalesce(F.stddev_samp(loss).over(over), F.lit(0.0)),
            "grad_std": F.coalesce(F.stddev_samp(grad).over(over), F.lit(0.0)),
            "clip_share": F.avg(clipped.cast("double")).over(frame(run, order, 50)),
            "clip_share_wide": F.avg(clipped.cast("double")).over(wide),
            "loss_trend": slope(F.col(loss), F.col("pos"), trend),
            "trend_mean": F.coalesce(F.avg(loss).over(trend), F.lit(0.0)),
            "trend_std": F.coalesce(F.stddev_samp(loss).over(trend), F.lit(0.0)),
            "lr_range": F.max(lr).over(frame(run, order, 10)) - F.min(lr).over(frame(run, order, 10)),
            "loss_range": F.max(loss).over(recent) - F.min(loss).over(recent),
        }
    )
    cv = F.col("loss_std") / F.greatest("loss_mean", F.lit(1e-6))
    noise = F.greatest(F.col("trend_std") / F.col("trend_mean"), F.lit(1e-6))
    falling = (F.col("loss_trend") < 0) & ((F.col("trend_mean") <= 1e-6) | (-F.col("loss_trend") / F.col("trend_mean") >= 0.1 * noise))
    persistent = (F.col("pos") >= 50) & (F.col("clip_share_wide") >= CLIP_PERSISTENT)
    unstable = (cv > LOSS_CV_HIGH) | (F.col("grad_std") > GRAD_STD_HIGH * (GRAD_STD_SCALE if scaled else 1))
    overfit = (F.col("evals") >= OVERFIT_EVALS) & F.col("overfit")
    flat = (F.col("evals") >= PLATEAU_PATIENCE) & (F.col("val_range") < PLATEAU_DELTA)
    steady = (F.col("pos") >= 5) & (F.col("lr_range") < STEADY_LR) & (F.col("loss_range") < STEADY_LOSS)
    regime, noisy = F.when(F.col("pos") < 10, "HEALTHY_LEARNING"), "PLATEAU_RUIDOSO_COM_CLIPPING"
    if scaled:
        regime = regime.when(F.col("clipped_run") >= CLIP_RUN, noisy).when((F.col("pos") >= 25) & (F.col("clip_share") >= CLIP_DOMINANT), noisy)
    regime = regime.when(unstable, "UNSTABLE_EXPLORATION")
    if scaled:
        regime = regime.when(persistent & ~falling, noisy)
        overfit = overfit & ~persistent
    regime = regime.when(overfit, "LATE_OVERFITTING").when(flat & (F.col("val_std") < NOISY_STD), "REAL_PLATEAU").when(flat, "NOISY_PLATEAU").when(steady, "CONVERGENCE")
    return measured.withColumn("regime", (regime.when(persistent, noisy) if scaled else regime).otherwise("HEALTHY_LEARNING"))


def filter_decisions(log: DataFrame, policy: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Entries of a decision log whose policy is the given one or whose action's type contains it in any case, with steps
    from first to last; the action is a struct and may be null, as in entries without a decision."""
    kept = log
    if policy not in (None, "all"):
        kept = kept.where(F.coalesce(F.col("policy") == policy, F.lit(False)) | F.coalesce(F.contains(F.lower("action.type"), F.lit(policy.lower())), F.lit(False)))
    if first is not None:
        kept = kept.where(F.col("step") >= first)
    return kept if last is None else kept.where(F.col("step") <= last)


def perplexity(nll: Column, tokens: Column, most: float = 100.0) -> Column:
    """exp of the summed loss over the summed tokens, infinite from `most` on, nan without tokens."""
    mean = F.sum(nll) / F.sum(tokens)
    return F.when(F.coalesce(F.sum(tokens), F.lit(0)) <= 0, F.lit(float("nan"))).when(mean < most, F.exp(mean)).otherwise(F.lit(float("inf")))


def memory_gigabytes(parameters: Column, layers: Column, width: Column, batch: Column, length: Column) -> Column:
    """Parameters, gradients, optimizer states and activations of training in GB (10 ** 9), each to two places."""
    parts = {"params_gb": parameters * 4, "grads_gb": parameters * 4, "optim_gb": parameters * 8, "activations_gb": layers * batch * length * width * 2}
    named = [F.round(v / 1e9, 2).alias(k) for k, v in parts.items()]
    return F.struct(*named, F.round(sum(parts.values(), F.lit(0.0)) / 1e9, 2).alias("total_gb"))


def trained_tokens(stored: Column, step: Column, batch: Column, accumulation: Column, length: Column) -> Column:
    """The stored count, or what the steps amount to where there is none."""
    return F.when(F.coalesce(stored, F.lit(0)) != 0, stored).otherwise(step.cast("long") * batch * accumulation * length)


def timeline(df: DataFrame, state: str, run: str, order: list[str]) -> DataFrame:
    """Only the rows where the state changes, with the order value of the next change as the end."""
    w = Window.partitionBy(run).orderBy(*order)
    changed = df.withColumn("__before", F.lag(state).over(w)).where(F.col("__before").isNull() | (F.col("__before") != F.col(state)))
    return changed.withColumn("until", F.lead(order[0]).over(w)).drop("__before")


def validate_decision(kind: Column, before: Column, after: Column, justification: Column, critical: Column, floor: float, peak: float) -> Column:
    """Why a decision is refused, or "valid"."""
    change = F.abs(after - before) / F.greatest(F.abs(before), F.lit(1e-12))
    return (
        F.when(F.length(F.coalesce(justification, F.lit(""))) < 10, "justification_too_short")
        .when((kind == "lr") & (change > F.when(critical, 0.7).otherwise(0.2)), "change_too_large")
        .when((kind == "lr") & ((after < floor) | (after > peak)), "out_of_bounds")
        .when((kind == "grad_clip") & (after > 2.0), "clip_too_high")
        .when((kind == "dropout") & ((after < 0) | (after > 0.1)), "dropout_out_of_bounds")
        .otherwise("valid")
    )
