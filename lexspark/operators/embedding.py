"""Embedders: a protocol for models run in Arrow batches over distinct texts, and a stand-in computed in the JVM."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """A model, loaded in the worker."""

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


def mock_vector(text: Column, size: int = 16) -> Column:
    """A vector that depends on the text alone, the same in every process: components in [-0.5, 0.5) from md5."""
    one = lambda i: F.conv(F.substring(F.md5(F.concat(text, F.lit("#"), i.cast("string"))), 1, 6), 16, 10).cast("double") / 16777216.0 - 0.5
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), one)


def prefix_of(entry: dict) -> str:
    """The text put before every input: what stands before {text} in prompt_template, or an instruction, or nothing."""
    if entry.get("prompt_template"):
        return entry["prompt_template"].split("{text}", 1)[0]
    return f"Instruct: {entry['instruction']}\nQuery: " if entry.get("instruction") else ""


def embed_words(words: DataFrame, word: str, load: Callable[[], Embedder], prefix: str = "", batch: int = 32) -> DataFrame:
    """(word, embedding) of the distinct non-null words. `load` runs once per task, so weights never travel with the
    plan; texts are embedded `batch` at a time."""
    distinct = words.select(F.col(word).alias("word")).filter("word IS NOT NULL").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for f in frames:
            texts = [prefix + t for t in f["word"]]
            vectors = [v for i in range(0, len(texts), batch) for v in model.embed_batch(texts[i : i + batch])]
            yield pd.DataFrame({"word": f["word"], "embedding": [[float(x) for x in v] for v in vectors]})

    return distinct.mapInPandas(run, "word string, embedding array<float>")


class HashEmbedder:
    """The stand-in as a model of its own: the vectors of `mock_vector`, computed in the worker."""

    def __init__(self, size: int = 16):
        self.size = size

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [[int(hashlib.md5(f"{t}#{i}".encode()).hexdigest()[:6], 16) / 16777216.0 - 0.5 for i in range(self.size)] for t in texts]


class TokenPoolEmbedder:
    """A transformer that gives a vector per token, pooled: the first token's (`cls`) or the mean of the others without
    the last (`mean`). Needs the library and the model's files on the workers."""

    def __init__(self, name: str, pooling: str = "cls", max_length: int = 64):
        if pooling not in ("cls", "mean"):
            raise ValueError(f"unknown pooling {pooling!r}")
        from transformers import AutoModel, AutoTokenizer

        self.pooling, self.max_length = pooling, max_length
        self.tokenizer, self.model = AutoTokenizer.from_pretrained(name), AutoModel.from_pretrained(name).eval()

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        import torch

        with torch.no_grad():
            batch = self.tokenizer(texts, padding=True, truncation=True, max_length=self.max_length, return_tensors="pt")
            hidden, mask = self.model(**batch).last_hidden_state.numpy(), batch["attention_mask"].numpy()
        return pool_tokens(hidden, mask, self.pooling).tolist()


def pool_tokens(hidden: np.ndarray, mask: np.ndarray, pooling: str) -> np.ndarray:
    """One vector per text from (text x token x dimension): the first token's, or the mean over the attended tokens
    between the first and the last; that of all attended ones where there is none between."""
    if pooling == "cls":
        return hidden[:, 0]
    inner, length = mask.astype("float64").copy(), mask.sum(axis=1).astype(int)
    inner[:, 0] = 0
    inner[np.arange(len(inner)), np.maximum(length - 1, 0)] = 0
    inner[inner.sum(axis=1) == 0] = mask[inner.sum(axis=1) == 0]
    return (hidden * inner[:, :, None]).sum(axis=1) / np.maximum(inner.sum(axis=1, keepdims=True), 1)


class SentenceEmbedder:
    """A sentence model. Needs the library and the model's files on the workers."""

    def __init__(self, name: str, model_kwargs: dict | None = None, encode_kwargs: dict | None = None):
        from sentence_transformers import SentenceTransformer

        self.model, self.encode_kwargs = SentenceTransformer(name, **(model_kwargs or {})), encode_kwargs or {}

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return self.model.encode(texts, **self.encode_kwargs).tolist()


def factory(entry: dict) -> Callable[[], Embedder]:
    """How to load the model of a configuration entry (kind: mock, pooled, sentence; name; pooling, max_length,
    model_kwargs, encode_kwargs) in a worker. Nothing is loaded here."""
    kind = entry.get("kind", "mock")
    if kind == "mock":
        return lambda: HashEmbedder(entry.get("size", 16))
    if kind == "pooled":
        return lambda: TokenPoolEmbedder(entry["name"], entry.get("pooling", "cls"), entry.get("max_length", 64))
    if kind == "sentence":
        return lambda: SentenceEmbedder(entry["name"], entry.get("model_kwargs"), entry.get("encode_kwargs"))
    raise ValueError(f"unknown kind of model {kind!r}")


def health(stats: DataFrame) -> DataFrame:
    """A flag per model from off-diagonal mean and std and from separation (within less between similarity):
    COLLAPSED (std < 0.05), POOR-SEP (separation < 0.05), HIGH-MEAN (mean > 0.95), else ok."""
    flag = F.when(F.col("std") < 0.05, "COLLAPSED").when(F.col("separation") < 0.05, "POOR-SEP").when(F.col("mean") > 0.95, "HIGH-MEAN").otherwise("ok")
    return stats.withColumn("flag", flag)
