"""Tokenizing with a public byte-level BPE vocabulary; its file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie unless a caller names another.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level BPE cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a vocabulary of ranks; loaded once in a worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_lengths(path: str) -> np.ndarray:
    """How many bytes each token of the vocabulary has."""
    enc = encoding(path)
    return np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)], dtype=np.int64)


def token_ends(text: str, path: str = TOKENIZER) -> np.ndarray:
    """Where each token of the text ends, in bytes of its UTF-8 form."""
    return np.cumsum(token_lengths(path)[encoding(path).encode_ordinary(text)], dtype=np.int64)


def with_token_counts(df: DataFrame, text: str, keep: list[str], path: str = TOKENIZER) -> DataFrame:
    """`keep` and `n_tokens` of each row; null texts have 0 tokens. Texts travel in Arrow batches, only counts return."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            n = np.fromiter((len(enc.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()), dtype=np.int64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n)], names=[*keep, "n_tokens"])

    rows = df.select(*keep, F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(count, df.select(*keep).schema.add("n_tokens", "long"))
