"""Splitting oversized texts at natural boundaries, by recursive bisection, with overlap.

A text is tokenized once; positions are token indexes from then on. A span that is too long is cut at the strongest
natural boundary near its midpoint (line end before end of sentence; nearest of equal strength), or, where it holds
none, at the token nearest the midpoint. Halves still too long are cut again; at last every piece is extended to the
left by the overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.llm.tokens import TOKENIZER, encoding, token_lengths

_LINE = re.compile(rb"(?:\r\n|[\n\r\x0b\x0c]|\xc2\x85|\xe2\x80[\xa8\xa9])+")
_BLANK_LINE = re.compile(rb"(?:\r\n|\n|\r(?!\n)|\xe2\x80\xa9)[ \t]*(?:\r\n|\n|\r)")
_SENTENCE = re.compile(rb"(?:[.!?]|\xe2\x80\xa6)+(?:[\"')\]]|\xe2\x80[\x9d\x99]|\xc2\xbb)*(?=[\s]|\xc2\xa0|$)")


@dataclass(frozen=True)
class Piece:
    """A piece of a text in tokens and bytes: it covers [start, stop) after repeating [overlap_start, start)."""

    start: int
    stop: int
    overlap_start: int
    byte_start: int
    byte_own: int
    byte_stop: int
    n_tokens: int  # of the piece by itself, overlap included
    cut: str  # how it ends: natural, forced, or end


def boundaries(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token indexes after which a natural boundary lies, and its strength: 3 blank line, 2 line end, 1 end of sentence."""
    strength: dict[int, int] = {}
    for rx, s in ((_SENTENCE, 1), (_LINE, 2)):
        for m in rx.finditer(data):
            here = 3 if s == 2 and _BLANK_LINE.search(m.group()) else s
            at = int(np.searchsorted(ends, m.end())) + 1  # the token that reaches the boundary belongs to the left side
            if at < len(ends):
                strength[at] = max(strength.get(at, 0), here)
    pos = np.array(sorted(strength), dtype=np.int64)
    return pos, np.array([strength[int(p)] for p in pos], dtype=np.int64)


def _cuts(start: int, stop: int, most: int, pos: np.ndarray, strength: np.ndarray, legal: np.ndarray) -> list[tuple[int, str]]:
    """(position, kind) of all cuts of [start, stop) such that no span is longer than `most`, in order."""
    out, todo = [], [(start, stop)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= most:
            continue
        mid = (lo + hi) / 2
        a, b = np.searchsorted(pos, [lo, hi], side="right")
        inner, force = pos[a:b], strength[a:b]
        if len(inner) and inner[-1] == hi:
            inner, force = inner[:-1], force[:-1]
        kind = "natural"
        if len(inner):
            near = np.abs(inner - mid) <= (hi - lo) / 4
            if near.any():
                inner, force = inner[near], force[near]
            best = inner[force == force.max()]
            at = int(best[np.argmin(np.abs(best - mid))])
        else:
            kind, a, b = "forced", *np.searchsorted(legal, [lo, hi], side="right")
            free = legal[a:b]
            free = free[free < hi]
            if not len(free):
                continue  # one character of more tokens than the limit
            at = int(free[np.argmin(np.abs(free - mid))])
        out.append((at, kind))
        todo += [(lo, at), (at, hi)]
    return sorted(out)


def split_text(text: str, limit: int = 2048, overlap: int = 64, path: str = TOKENIZER) -> list[Piece]:
    """The pieces of a text, in order; one piece if it has at most `limit` tokens. Without their overlaps they make up
    the text. No piece has more than `limit` tokens, counted on the piece by itself: where tokens at its seams come out
    otherwise than in the text and it has more, it is cut once more. An error if that is impossible, a character with
    its overlap having more tokens than the limit; `limit` must exceed `overlap` by 8 at least."""
    if overlap < 0 or limit < overlap + 8:
        raise ValueError("limit must be 8 more than overlap at least")
    enc = encoding(path)
    ids = enc.encode_ordinary(text)
    n, data = len(ids), text.encode("utf-8")
    if n <= limit:
        return [Piece(0, n, 0, 0, 0, len(data), n, "end")]
    ends = np.cumsum(token_lengths(path)[ids], dtype=np.int64)
    raw = np.frombuffer(data + b" ", dtype=np.uint8)
    legal = np.flatnonzero((raw[ends] & 0xC0) != 0x80) + 1  # token ends that are ends of characters
    pos, strength = boundaries(data, ends)
    ok = np.isin(pos, legal)
    pos, strength = pos[ok], strength[ok]
    byte = np.concatenate([[0], ends])

    def piece(a: int, b: int, kind: str) -> Piece:
        o = max(a - overlap, 0)
        k = int(np.searchsorted(legal, o))
        o = int(legal[k]) if o and k < len(legal) and legal[k] <= a else o
        return Piece(a, b, o, int(byte[o]), int(byte[a]), int(byte[b]), len(enc.encode_ordinary(data[byte[o] : byte[b]].decode("utf-8"))), kind)

    def spans(a: int, b: int, kind: str, most: int) -> list[tuple[int, int, str]]:
        cuts = [*_cuts(a, b, most, pos, strength, legal), (b, kind)]
        return [(lo, hi, k) for lo, (hi, k) in zip([a, *(c for c, _ in cuts)], cuts)]

    done, todo = [], spans(0, n, "end", limit - overlap)[::-1]
    while todo:
        a, b, kind = todo.pop()
        p = piece(a, b, kind)
        if p.n_tokens <= limit:
            done.append(p)
            continue
        finer = spans(a, b, kind, b - a - 1)
        if len(finer) == 1:
            raise ValueError(f"a character has more than {limit - overlap} tokens")
        todo += finer[::-1]
    return done


def split_oversized(df: DataFrame, id: str, text: str, limit: int = 2048, overlap: int = 64, path: str = TOKENIZER) -> DataFrame:
    """Pieces of the texts of more than `limit` tokens: id, piece_no (from 0), n_pieces, piece, n_tokens,
    overlap_chars (how many characters at its start repeat the piece before), cut_kind (natural, forced, or end).

    Null and empty texts, and those within the limit, give no pieces. A text of at most `limit` bytes cannot have more
    tokens than that (a token of a byte-level vocabulary has at least one byte), so most rows never leave the JVM.
    Rows with equal ids are split each by itself.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column(1).to_pylist()):
                pieces = split_text(t, limit, overlap, path)
                if len(pieces) == 1:
                    continue
                data = t.encode("utf-8")
                texts = [data[p.byte_start : p.byte_stop].decode("utf-8") for p in pieces]
                k = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, 1).take(pa.array([0] * k)), pa.array(range(k), pa.int32()), pa.array([k] * k, pa.int32()), pa.array(texts), pa.array([p.n_tokens for p in pieces], pa.int32()),
                        pa.array([len(data[p.byte_start : p.byte_own].decode("utf-8")) for p in pieces], pa.int32()), pa.array([p.cut for p in pieces]),
                    ], names=["id", "piece_no", "n_pieces", "piece", "n_tokens", "overlap_chars", "cut_kind"],
                )

    rows = df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).filter(F.octet_length("text") > limit)
    schema = T.StructType([rows.schema["id"], *(T.StructField(n, t) for n, t in (("piece_no", T.IntegerType()), ("n_pieces", T.IntegerType()), ("piece", T.StringType()), ("n_tokens", T.IntegerType()), ("overlap_chars", T.IntegerType()), ("cut_kind", T.StringType())))])
    return rows.mapInArrow(split, schema).withColumnRenamed("id", id)


def cut_kinds(pieces: DataFrame, id: str) -> DataFrame:
    """id, cut_kind of each split text: forced if any of its cuts had no natural boundary to go to, else natural."""
    return pieces.groupBy(id).agg(F.when(F.bool_or(F.col("cut_kind") == "forced"), "forced").otherwise("natural").alias("cut_kind"))
