"""Exact tokens by a public byte-pair vocabulary, as Arrow functions; its folder is a parameter."""

from __future__ import annotations

import base64
import functools
import importlib.util
import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FOLDER = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"


@functools.lru_cache(4)
def encoding(folder: str = FOLDER, vocabulary: str = VOCABULARY):
    """The encoder of a vocabulary file of ranks, once a process."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("millrace_core_tokenizers", os.path.join(folder, "__init__.py"))
    public = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(public)
    with open(os.path.join(folder, vocabulary), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _plain(text: str | None) -> str:
    """Unpaired surrogates have no bytes to encode and become replacement characters."""
    return text.encode("utf-8", "replace").decode() if isinstance(text, str) else ""


def token_ids(text: Column, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Column:
    """Ids of a text, none for null and empty ones."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([encoding(folder, vocabulary).encode_ordinary(_plain(t)) for t in texts], dtype=object)

    return run(text)


def token_count(text: Column, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([len(encoding(folder, vocabulary).encode_ordinary(_plain(t))) for t in texts], dtype="int64")

    return run(text)


def truncate(text: Column, tokens: int, ellipsis: bool = True, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Column:
    """The text itself up to so many tokens, else its first tokens and "..."; a character cut in half is left out."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        coder, out = encoding(folder, vocabulary), []
        for t in texts:
            ids = coder.encode_ordinary(_plain(t))
            short = coder.decode_bytes(ids[:tokens]).decode("utf-8", "ignore") + ("..." if ellipsis else "")
            out.append(None if not isinstance(t, str) else t if len(ids) <= tokens else short)
        return pd.Series(out, dtype=object)

    return run(text)
