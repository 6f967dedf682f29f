"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.plans.sizing import spread

#: Folder of the vocabulary files, which every executor must see.
TOKENIZER_FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str):
    """The encoding of a file of ranks, read once per worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(rows: DataFrame, key: str, text: str, *keep: str, folder: str = TOKENIZER_FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, tokens, *keep): the size of each whole text; null and empty texts have none."""
    path = f"{folder}/{vocabulary}"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for pdf in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["_text"]]
            yield pdf.drop(columns="_text").assign(tokens=sizes)

    named = rows.select(key, F.col(text).alias("_text"), *keep)
    fields = ", ".join(f"`{c}` {t}" for c, t in named.drop("_text").dtypes)
    return spread(named).mapInPandas(count, f"{fields}, tokens long")
