"""Sizes of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vocabulary file (ranks of byte sequences) where the session names none; any folder that all executors see.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The session's setting that names another one.
SETTING = "spark.marlgrid.vocabulary"
#: Fixed value: how byte-level BPE of this family cuts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(spark: SparkSession) -> str:
    """The vocabulary file of a session."""
    return spark.conf.get(SETTING, VOCABULARY)


@lru_cache(maxsize=4)
def encoding(path: str):
    """The vocabulary as an encoder, loaded once per process."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of a text; 0 for an empty one, null for null."""

    @F.pandas_udf(T.IntegerType())
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(vocabulary).encode_ordinary
        for texts in batches:
            yield pd.Series([None if t is None else len(encode(t)) for t in texts], dtype="Int32")

    return counted(text)
