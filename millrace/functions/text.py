"""Scalar text functions as Spark columns; all of them stay in the JVM.

Words are runs of letters, digits and underscores in lower case; sentences are the non-blank parts between [.!?]+.
Null gives null unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: markup, addresses and lines that carry no content.
HTML_TAG = r"<[^>]+>"
URL = r"(?i)https?://[A-Za-z0-9_.%-]+[^\s]*"
EMAIL = r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
EMOJI = "[\U0001f600-\U0001f64f\U0001f300-\U0001f5ff\U0001f680-\U0001f6ff\U0001f700-\U0001f77f\U0001f780-\U0001f7ff\U0001f800-\U0001f8ff\U0001f900-\U0001f9ff\U0001fa00-\U0001fa6f\U0001fa70-\U0001faff✂-➰Ⓜ-\U0001f251]+"
BOILERPLATE_LINES = (
    r"compartilh(?:e|ar)",
    r"siga-nos",
    r"inscreva-se",
    r"assine.*newsletter",
    r"publicidade",
    r"leia (?:também|mais)",
    r"veja (?:também|mais)",
    r"copyright",
    r"todos os direitos reservados",
    r"\d+ comentários?",
)
WORD = r"[\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"[.!?]+", -1), lambda s: F.regexp_replace(s, r"[ \t\r\n]+", "") != "")


def single_spaces(text: Column) -> Column:
    """Runs of white space as one space; a lone space, which is most of it, is no match and costs nothing."""
    return F.regexp_replace(text, r"[\t\r\n\f\x0B][ \t\r\n\f\x0B]*| [ \t\r\n\f\x0B]+", " ")


def collapse(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(single_spaces(F.lower(text)))


def whitespace_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[ \t\r\n]+", -1), lambda w: w != ""))


def approx_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, HTML_TAG, "")


def remove_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, "")


def mask_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, "[EMAIL]")


def remove_emojis(text: Column) -> Column:
    return F.regexp_replace(text, EMOJI, "")


def remove_boilerplate(text: Column) -> Column:
    return F.regexp_replace(text, r"(?imdu)^[ \t]*(?:" + "|".join(BOILERPLATE_LINES) + r").*$", "")


def normalize_whitespace(text: Column) -> Column:
    trimmed = F.regexp_replace(F.regexp_replace(text, r"(?md)^[ \t]+|[ \t]+$", ""), " {2,}", " ")
    return F.regexp_replace(trimmed, r"\n{3,}", "\n\n")


def normalize_punctuation(text: Column) -> Column:
    shorter = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\.{4,}", "..."), r"!{2,}", "!"), r"\?{2,}", "?")
    return F.translate(shorter, "„‚—–", "\"'--")


def clean(text: Column) -> Column:
    """The JVM part of cleaning in its fixed order: markup, addresses, boilerplate, white space, punctuation."""
    cleaned = F.coalesce(text, F.lit(""))
    for step in (strip_html, remove_urls, mask_emails, remove_boilerplate, normalize_whitespace, normalize_punctuation):
        cleaned = step(cleaned)
    return F.trim(F.regexp_replace(cleaned, r"^[ \t\r\n]+|[ \t\r\n]+$", ""))


def truncate_tokens(text: Column, most: int) -> Column:
    """At most `most` approximate tokens, with "..." where something was cut."""
    return F.when(F.length(text) > 4 * most, F.concat(F.substring(text, 1, 4 * most - 3), F.lit("..."))).otherwise(text)


def fixed_chunks(text: Column, size: int, overlap: int) -> Column:
    """Chunks of `size` approximate tokens, each starting size - overlap tokens after the one before."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    width, step = 4 * size, 4 * (size - overlap)
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - width) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(width)))


def human_bytes(n: Column) -> Column:
    units = ["B", "KB", "MB", "GB", "TB"]
    shown = F.concat(F.format_string("%.2f", n / F.lit(float(1024**4))), F.lit(" TB"))
    for i in reversed(range(4)):
        shown = F.when(n < 1024 ** (i + 1), F.concat(F.format_string("%.2f", n / F.lit(float(1024**i))), F.lit(" " + units[i]))).otherwise(shown)
    return shown


def elapsed(seconds: Column) -> Column:
    """1d 2h 3m 4s, without leading zero units."""
    s = seconds.cast("long")
    parts = [(F.floor(s / 86400), "d"), (F.floor(s % 86400 / 3600), "h"), (F.floor(s % 3600 / 60), "m"), (s % 60, "s")]
    texts = [F.concat(v.cast("long").cast("string"), F.lit(u)) for v, u in parts]
    return F.when(s >= 86400, F.concat_ws(" ", *texts)).when(s >= 3600, F.concat_ws(" ", *texts[1:])).when(s >= 60, F.concat_ws(" ", *texts[2:])).otherwise(texts[3])


def text_flags(text: Column) -> Column:
    """Signs of damage in decoded text: html, punctuation_run, control_chars, replacement_edge, replacement_mid."""
    letters = F.greatest(F.lit(1), F.length(text))
    control = F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    inner = F.regexp_replace(text, "(?s)^.|.$", "")
    return F.array_compact(
        F.array(
            F.when(text.rlike(r"(?i)</?(?:html|body|div|p|span|a|script|table|br)\b[^>]*>"), F.lit("html")),
            F.when(text.rlike(r"[^\p{L}\p{N}_\s]{4,}"), F.lit("punctuation_run")),
            F.when(control / letters > 0.01, F.lit("control_chars")),
            F.when(text.startswith("�") | text.endswith("�"), F.lit("replacement_edge")),
            F.when(F.contains(inner, F.lit("�")), F.lit("replacement_mid")),
        )
    )
