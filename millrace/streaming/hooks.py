"""Stateful streams: per-step training hooks, evaluation hooks with policies, first-seen filters, event-time windows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.session import materialize

WINDOW, CLIP_SHARE, CLIP_RUN = 50, 0.95, 5
STEP_STATE = "losses array<double>, clipped int, steps long, top_lr double"
STEP_OUT = "run_id string, step long, mean_loss double, loss_trend double, clipped_run int, clipping_dominant boolean, max_lr double"
EVAL_STATE = "best double, stagnant int, diverged int, cooldown int, evals long"
EVAL_OUT = "run_id string, step long, best double, stagnant int, diverged int, action string, lr_factor double"
PATIENCE, DELTA, COOLDOWN, DIVERGENCE = 3, 0.02, 3, 2


def _slope(values: list[float]) -> float:
    if len(values) < 3:
        return 0.0
    x = np.arange(len(values)) - (len(values) - 1) / 2
    return float((x * np.asarray(values)).sum() / (x * x).sum())


def step_rows(run: str, rows: pd.DataFrame, state: tuple | None) -> tuple[list[tuple], tuple]:
    """The step hook on rows in order of step: rolling loss, its trend, how long gradients have been at the limit."""
    losses, clipped, steps, top = (list(state[0]), state[1], state[2], state[3]) if state else ([], 0, 0, 0.0)
    out = []
    for r in rows.sort_values("step").itertuples():
        losses = (losses + [float(r.loss)])[-WINDOW:]
        clipped = clipped + 1 if r.grad_norm >= CLIP_SHARE * r.clip else 0
        steps, top = steps + 1, max(top, float(r.lr))
        out.append((run, int(r.step), float(np.mean(losses)), _slope(losses), clipped, clipped >= CLIP_RUN, top))
    return out, (losses, clipped, steps, top)


def eval_rows(run: str, rows: pd.DataFrame, state: tuple | None) -> tuple[list[tuple], tuple]:
    """The evaluation hook: counters first, then the first policy that applies, then its cooldown."""
    best, stagnant, diverged, cooldown, evals = state or (float("inf"), 0, 0, 0, 0)
    out = []
    for r in rows.sort_values("step").itertuples():
        loss, evals, cooldown = float(r.val_loss), evals + 1, max(0, cooldown - 1)
        stagnant = 0 if loss < best - DELTA else stagnant + 1
        diverged = diverged + 1 if loss > best + 0.001 else 0
        best = min(best, loss) if stagnant == 0 or loss < best else best
        action, factor = "none", 1.0
        if evals >= 3 and cooldown == 0:
            if diverged >= DIVERGENCE:
                action, factor = "val_divergence", 0.8
            elif stagnant >= PATIENCE:
                action, factor = "reduce_on_plateau", 0.8
            if action != "none":
                cooldown, stagnant, diverged = COOLDOWN, 0, 0
        out.append((run, int(r.step), best, stagnant, diverged, action, factor))
    return out, (best, stagnant, diverged, cooldown, evals)


def _stateful(function, columns: list[str]):
    def update(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        out, kept = function(key[0], rows, state.get if state.exists else None)
        state.update(kept)
        yield pd.DataFrame(out, columns=columns)

    return update


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def on_step(steps: DataFrame) -> DataFrame:
    """Stream of (run_id, step, loss, grad_norm, clip, lr) to one row a step; state per run, bounded by WINDOW."""
    return steps.groupBy("run_id").applyInPandasWithState(_stateful(step_rows, _names(STEP_OUT)), STEP_OUT, STEP_STATE, "append", GroupStateTimeout.NoTimeout)


def on_eval(evals: DataFrame) -> DataFrame:
    """Stream of (run_id, step, val_loss) to one decision row an evaluation."""
    return evals.groupBy("run_id").applyInPandasWithState(_stateful(eval_rows, _names(EVAL_OUT)), EVAL_OUT, EVAL_STATE, "append", GroupStateTimeout.NoTimeout)


def on_step_batch(steps: DataFrame) -> DataFrame:
    """The same hook over a finished table: each run is one group, as its steps depend on one another."""
    return steps.groupBy("run_id").applyInPandas(lambda key, rows: pd.DataFrame(step_rows(key[0], rows, None)[0], columns=_names(STEP_OUT)), STEP_OUT)


def on_eval_batch(evals: DataFrame) -> DataFrame:
    return evals.groupBy("run_id").applyInPandas(lambda key, rows: pd.DataFrame(eval_rows(key[0], rows, None)[0], columns=_names(EVAL_OUT)), EVAL_OUT)


def resume_evals(evals: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, state) of the evaluation hook over a batch that goes on from a saved state (run_id and the columns of
    EVAL_STATE); runs without a saved state start anew, runs without rows keep theirs. Saving the second frame and giving
    it to the next call is snapshot and restore: any cut of a series gives the rows of the whole."""
    kept = [c for c in _names(EVAL_STATE)]
    out = "run_id string, " + ", ".join(f"r_{c}" for c in EVAL_OUT.split(", ")[1:]) + ", " + EVAL_STATE

    def run(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        before = tuple(old[kept].iloc[0]) if len(old) else None
        rows, after = eval_rows(key[0], new, before) if len(new) else ([], before)
        frame = pd.DataFrame(rows, columns=["run_id", *[f"r_{c}" for c in _names(EVAL_OUT)[1:]]])
        last = pd.DataFrame([(key[0], *after)], columns=["run_id", *kept]) if after is not None else pd.DataFrame(columns=["run_id", *kept])
        return pd.concat([frame, last], ignore_index=True).reindex(columns=_names(out)).astype(object).where(lambda x: x.notna(), None)

    both = state.select("run_id", *kept).groupBy("run_id").cogroup(evals.groupBy("run_id")).applyInPandas(run, out)
    both = materialize(both)
    rows = both.where("r_step is not null").select("run_id", *[F.col(f"r_{c}").alias(c) for c in _names(EVAL_OUT)[1:]])
    return rows, both.where("r_step is null").select("run_id", *kept)


def first_seen(stream: DataFrame, key: str, time: str, within: str = "1 day") -> DataFrame:
    """Each key once within the watermark: the incremental index of seen hashes, with bounded state."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, time: str, value: str, by: str, size: str = "1 hour", late: str = "30 minutes", slide: str | None = None) -> DataFrame:
    """Event-time windows with late rows up to the watermark."""
    span = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(span.alias("span"), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def sessions(stream: DataFrame, time: str, by: str, gap: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("span"), by).agg(F.count("*").alias("n"))


def land_shards(stream: DataFrame, path: str, checkpoint: str, records: int = 25_000):
    """Acquisition stream to sized JSON shards; starts where the checkpoint stopped."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).option("maxRecordsPerFile", records).trigger(availableNow=True).start()
