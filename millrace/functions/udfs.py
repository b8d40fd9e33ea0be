"""Text steps that Spark has no function for, as Arrow functions."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import text as tx

MOJIBAKE_SIGNS = ("Ã", "â", "Â")


def repair_mojibake(text: str) -> str:
    """Drop NUL and BOM; undo UTF-8 read as Latin-1 where that gives readable text."""
    text = text.replace("\x00", "").replace("﻿", "")
    if any(sign in text for sign in MOJIBAKE_SIGNS):
        try:
            fixed = text.encode("latin-1").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return text
        if fixed.isprintable() or "\n" in fixed:
            return fixed
    return text


def _each(function) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([function(t) if isinstance(t, str) else None for t in batch], dtype=object)

    return run


def repair(text: Column) -> Column:
    return _each(repair_mojibake)(text)


def nfkc(text: Column) -> Column:
    return _each(lambda t: unicodedata.normalize("NFKC", t))(text)


def unescape(text: Column) -> Column:
    return _each(html.unescape)(text)


_BLOCKS = re.compile(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]+>")
OLD_BOILERPLATE = re.compile(r"(?i)Copyright © \d{4}|All rights reserved|Subscribe to our newsletter|Read more at")


def plain_text(source: str) -> str:
    """Markup to text with spaces between parts, NFKC, white space collapsed, English boilerplate removed."""
    text = unicodedata.normalize("NFKC", html.unescape(_BLOCKS.sub(" ", source)))
    return OLD_BOILERPLATE.sub("", " ".join(text.split())).strip()


def html_to_text(text: Column) -> Column:
    return _each(plain_text)(text)


def full_clean(text: Column) -> Column:
    """All cleaning steps in order: repair, NFKC, markup, entities, then the JVM steps; null and empty give ''."""

    def first(t: str) -> str:
        return html.unescape(re.sub(tx.HTML_TAG, "", unicodedata.normalize("NFKC", repair_mojibake(t))))

    cleaned = F.coalesce(_each(first)(text), F.lit(""))
    for step in (tx.remove_urls, tx.mask_emails, tx.remove_boilerplate, tx.normalize_whitespace, tx.normalize_punctuation):
        cleaned = step(cleaned)
    return F.regexp_replace(cleaned, r"^\s+|\s+$", "")


def mask_matches(text: str, patterns: dict[str, str | tuple[str, ...]], mode: str = "safe", labels: dict[str, str] | None = None) -> str:
    """Matches replaced by [TYPE], or [label] for types in labels. "safe": the leftmost, longest match is replaced
    together with the rest of matches that overlap it; "reference": by falling start on the changing text with the first
    text's offsets, so that overlapping matches spoil it, as the old masker does."""
    found = [(m.start(), m.end(), (labels or {}).get(k, k.upper())) for k, ps in patterns.items() for p in ([ps] if isinstance(ps, str) else ps) for m in re.finditer(p, text)]
    if mode == "reference":
        for start, end, kind in sorted(found, key=lambda f: -f[0]):
            text = text[:start] + f"[{kind}]" + text[end:]
        return text
    parts, last = [], 0
    for start, end, kind in sorted(found, key=lambda f: (f[0], -f[1])):
        if start >= last:
            parts += [text[last:start], f"[{kind}]"]
        last = max(last, end)
    return "".join([*parts, text[last:]])


def mask_pii(text: Column, patterns: dict[str, str | tuple[str, ...]], mode: str = "safe", labels: dict[str, str] | None = None) -> Column:
    return _each(lambda t: mask_matches(t, patterns, mode, labels))(text)


def sentence_chunks(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of about `size` approximate tokens that end at the last full stop beyond their half, where there is one."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    width, back, chunks, start = 4 * size, 4 * overlap, [], 0
    while start < len(text):
        end = min(len(text), start + width)
        stop = text.rfind(".", start, end)
        if end < len(text) and stop > start + width // 2:
            end = stop + 1
        chunks.append(text[start:end])
        if end >= len(text):
            break
        start = max(start + 1, end - back)
    return chunks


def chunk_sentences(text: Column, size: int = 512, overlap: int = 50) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([sentence_chunks(t, size, overlap) if isinstance(t, str) else [] for t in texts], dtype=object)

    return run(text)
