"""Dates, durations and schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed names of Portuguese months and days and what they stand for, in the order they are replaced.
PT_NAMES = [
    ("janeiro", "jan"), ("fevereiro", "feb"), ("março", "mar"), ("abril", "apr"), ("maio", "may"), ("junho", "jun"), ("julho", "jul"), ("agosto", "aug"), ("setembro", "sep"), ("outubro", "oct"), ("novembro", "nov"), ("dezembro", "dec"),
    ("fev", "feb"), ("abr", "apr"), ("mai", "may"), ("ago", "aug"), ("set", "sep"), ("out", "oct"), ("dez", "dec"),
]
FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy HH:mm", "dd/MM/yyyy",
    "dd-MM-yyyy", "dd.MM.yyyy", "d MMM yyyy HH:mm:ss XX", "d MMM yyyy HH:mm:ss z", "d MMM yyyy", "MMM d, yyyy", "yyyyMMdd",
)


def portuguese_to_english(raw: Column) -> Column:
    text = F.lower(raw)
    for name, month in PT_NAMES:
        text = F.regexp_replace(text, rf"\b{name}\b\.?", month)
    return F.regexp_replace(text, r"\bde\b ", "")


def parse_date(raw: Column) -> Column:
    """The first format that fits, else null; a leading weekday is dropped, Z is +00:00, Portuguese months are read."""
    bare = F.regexp_replace(F.trim(raw), r"^[\p{L}]{3,13}\.?, ?", "")
    english = F.initcap(portuguese_to_english(bare))
    zoned = F.regexp_replace(bare, "Z$", "+00:00")
    tries = [F.try_to_timestamp(zoned, F.lit(f)) for f in FORMATS if "MMM" not in f]
    tries += [F.try_to_timestamp(english, F.lit(f)) for f in FORMATS if "MMM" in f]
    tries += [F.when(raw.rlike(r"^\d{9,10}$"), F.timestamp_seconds(raw.try_cast("long")))]
    return F.coalesce(*tries)


def iso_duration_seconds(raw: Column) -> Column:
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(raw, rf"(\d+){unit}", 1), F.lit("")).try_cast("long"), F.lit(0))
    return part("H") * 3600 + part("M") * 60 + part("S")


def cosine_schedule(step: Column, warmup: int, total: int, peak: float, least: float) -> Column:
    progress = F.least(F.lit(1.0), (step - warmup) / F.lit(float(total - warmup)))
    return F.when(step < warmup, peak * step / warmup).otherwise(least + 0.5 * (peak - least) * (1 + F.cos(F.lit(math.pi) * progress)))


def wsd_schedule(step: Column, warmup: int, total: int, peak: float, least: float, stable: float = 0.7) -> Column:
    """Warm-up, a stable share of the steps, then cosine decay."""
    flat_until = warmup + int((total - warmup) * stable)
    progress = F.least(F.lit(1.0), (step - flat_until) / F.lit(float(total - flat_until)))
    return F.when(step < warmup, peak * step / warmup).when(step < flat_until, F.lit(peak)).otherwise(least + 0.5 * (peak - least) * (1 + F.cos(F.lit(math.pi) * progress)))
