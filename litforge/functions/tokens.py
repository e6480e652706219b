"""Cutting texts by a model's tokens."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict = {}


def encoding(vocabulary: str):
    """The encoding of a file of base64 tokens and ranks, loaded once a process."""
    if vocabulary not in _loaded:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _loaded[vocabulary] = tiktoken.Encoding("cut", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[vocabulary]


def first_tokens(text: Column, most: int = 2048, vocabulary: str = VOCABULARY) -> Column:
    """The text of the first `most` tokens; a sign that the cut goes through is left out. The vocabulary must lie at its
    path on every executor."""

    @F.pandas_udf(StringType())
    def cut(texts: pd.Series) -> pd.Series:
        found = encoding(vocabulary)

        def one(t):
            tokens = None if t is None else found.encode_ordinary(t)
            return t if tokens is None or len(tokens) <= most else found.decode_bytes(tokens[:most]).decode("utf-8", "ignore")

        return texts.map(one)

    return cut(text)
