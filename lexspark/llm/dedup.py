"""Duplicates hidden by formatting: records that are equal but for blanks, case, punctuation and field order.

The bytes of an Arrow batch stream, about a megabyte at a time, through a skip-and-fold table (separator, ignored, or
the folded, decomposed letters) into rolling polynomial hashes of words, of the words of a field, and of the fields in
any order. No canonical string is built and only (id, hash) decides the grouping. Rows whose hashes agree are then
verified against the kept record: two pointers walk over the two texts from word to word, skipping what separates them,
without the table or anything else the hashes come from. Should two different records share a hash, the rest of the
group is hashed again with another seed.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.session import cut

#: The fields of a test record.
RECORD_FIELDS = ("test", "participant", "session", "responses")

_U = np.uint64
_SEP, _MOST = 0, 4  # the unit of a separator; the most units of a character
#: How many bytes of text are folded at a time.
_WINDOW = 1 << 20


def _fold(ch: str) -> tuple[int, ...]:
    """The folded units of one character: its decomposed letters, digits and marks without case, 0 for what separates
    words, nothing for invisible formatting."""
    out = unicodedata.normalize("NFD", unicodedata.normalize("NFD", ch).casefold())
    return tuple(ord(c) if unicodedata.category(c)[0] in "LNM" else _SEP for c in out if unicodedata.category(c) != "Cf" or c in "\u200b\ufeff")


def _classes(ch: str) -> tuple[int, int]:
    """Combining classes of the first and the last character of the decomposed form."""
    out = unicodedata.normalize("NFD", ch)
    return unicodedata.combining(out[0]), unicodedata.combining(out[-1])


@lru_cache(maxsize=1)
def _table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every code point below 0x10000: the number of its units, the units, and its combining classes."""
    n, units, marks = np.zeros(0x10000, dtype=np.int8), np.zeros((0x10000, _MOST), dtype=np.int32), np.zeros((0x10000, 2), dtype=np.int16)
    for cp in range(0x10000):
        if 0xD800 <= cp < 0xE000:
            n[cp] = 1
        else:
            n[cp], units[cp], marks[cp] = _entry(cp)
    return n, units, marks


def _entry(cp: int) -> tuple[int, list[int], tuple[int, int]]:
    f = _fold(chr(cp))
    if len(f) > _MOST:
        raise ValueError(f"U+{cp:04X} folds to {len(f)} units, room is for {_MOST}")
    return len(f), [*f, *[0] * (_MOST - len(f))], _classes(chr(cp))


def _looked_up(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of each code point in the table, and the table), with rows for the code points beyond 0xFFFF that occur."""
    n, units, marks = _table()
    high = cp > 0xFFFF
    if not high.any():
        return cp, n, units, marks
    found, place = np.unique(cp[high], return_inverse=True)
    more = [_entry(int(c)) for c in found]
    at = cp.copy()
    at[high] = 0x10000 + place
    return at, np.append(n, [m[0] for m in more]), np.vstack([units, [m[1] for m in more]]), np.vstack([marks, [m[2] for m in more]])


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    with np.errstate(over="ignore"):
        z = x.astype(_U) + _U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
        return z ^ (z >> _U(31))


def _powers(n: int, seed: int) -> np.ndarray:
    base = _U(int(_mix(np.array([seed + 77], dtype=_U), 5)[0]) | 1)
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, dtype=_U), np.full(max(n - 1, 0), base, dtype=_U)]))


def _poly(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """Polynomial hash, modulo 2**64, of each run of `values`; 0 for empty runs."""
    out = np.zeros(len(starts), dtype=_U)
    full = lengths > 0
    if not full.any():
        return out
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    with np.errstate(over="ignore"):
        terms = _mix(values, seed) * _powers(int(lengths.max()), seed)[within]
        out[full] = np.add.reduceat(terms, (np.cumsum(lengths) - lengths)[full])
    return out


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the position where each text begins (one more at the end)."""
    arr = texts.cast(pa.large_string()).fill_null("")
    _, off, data = arr.buffers()
    off = np.frombuffer(off, dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, dtype=np.int64)
    b = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, dtype=np.uint8)
    lead = (b & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    b0 = b[at].astype(np.int32)
    cp = b0.copy()
    pad = np.concatenate([b, np.zeros(3, dtype=np.uint8)]).astype(np.int32) & 0x3F
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        m = (b0 >= low) & (b0 < high)
        if m.any():
            v = b0[m] & mask
            for k in range(1, more + 1):
                v = (v << 6) | pad[at[m] + k]
            cp[m] = v
    count = np.concatenate([[0], np.cumsum(lead)])
    return cp, count[off - off[0]]


@dataclass
class Parsed:
    """Folded units of a batch, its words, and the field each word belongs to (5 for none, -1 for a field's label)."""

    units: np.ndarray  # without separators
    word_start: np.ndarray  # in units; one more at the end
    word_row: np.ndarray
    word_field: np.ndarray
    rows: int


def _words(texts: pa.Array, ordered: bool = False):
    cp, begin = _code_points(texts)
    at, n_of, unit_of, marks = _looked_up(cp)
    rows = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    if not ordered and len(cp) > 1:  # marks on a letter may stand in any order; rare, so those rows are put in order one by one
        swapped = (marks[at[:-1], 1] > marks[at[1:], 0]) & (marks[at[1:], 0] > 0)
        if swapped.any():
            hit = set(rows[1:][swapped].tolist())
            fixed = [unicodedata.normalize("NFD", t) if i in hit and t is not None else t for i, t in enumerate(texts.to_pylist())]
            return _words(pa.array(fixed, pa.large_string()), ordered=True)
    n = n_of[at].astype(np.int64)
    src = np.repeat(np.arange(len(cp)), n)
    k = np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n)
    unit = unit_of[at[src], k]
    row = rows[src]
    inside = unit != _SEP
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (row[1:] != row[:-1])
    kept = np.flatnonzero(inside)
    start_at = np.flatnonzero(new)
    starts = np.searchsorted(kept, start_at)
    word_start = np.append(starts, len(kept))
    end_cp = src[kept[word_start[1:] - 1]] if len(start_at) else np.zeros(0, dtype=np.int64)
    return unit[kept], word_start, row[start_at], end_cp - begin[row[start_at]] if len(start_at) else end_cp


def _parse(texts: pa.Array, fields: Sequence[str]) -> Parsed:
    texts = _unescaped(texts)
    units, word_start, word_row, word_end = _words(texts)
    rows, n = len(texts), len(word_row)
    lens = np.diff(word_start)
    h = _poly(units, word_start[:-1], lens, 11)
    names = _words(pa.array([" ".join(fields)]))
    label_h = _poly(names[0], names[1][:-1], np.diff(names[1]), 11)
    label = np.full(n, -1)
    for i, v in enumerate(label_h):
        label[h == v] = i
    marker = label >= 0
    if marker.any():
        times = np.bincount(word_row[marker] * len(fields) + label[marker], minlength=rows * len(fields))
        for cell in np.flatnonzero(times > 1):  # a response may read like a label
            r, lab = divmod(int(cell), len(fields))
            at = np.flatnonzero(marker & (word_row == r) & (label == lab))
            text = texts[r].as_py()
            named = [w for w in at if re.match(r"[\"'”]?\s*[:=]", text[int(word_end[w]) + 1 :])]
            marker[at] = False
            marker[(named or list(at))[0]] = True
    # the label that holds at each word: the last marker of its row before it
    idx = np.where(marker, np.arange(n), -1)
    last = np.maximum.accumulate(idx) if n else idx
    ok = (last >= 0) & (word_row[np.maximum(last, 0)] == word_row) if n else np.zeros(0, dtype=bool)
    field = np.where(ok, label[np.maximum(last, 0)] if n else 0, len(fields))
    return Parsed(units, word_start, word_row, np.where(marker, -1, field), rows)


def _unescaped(texts: pa.Array) -> pa.Array:
    """JSON escapes in texts that look like JSON objects are read as the characters they stand for."""
    hit = pc.fill_null(pc.match_substring(texts, "\\"), False)
    if not pc.any(hit).as_py():
        return texts
    one = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}

    def read(t: str) -> str:
        t = re.sub(r"\\u([dD][89abAB]..)\\u([dD][c-fC-F]..)", lambda m: chr(0x10000 + ((int(m[1], 16) - 0xD800) << 10) + int(m[2], 16) - 0xDC00), t)
        t = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: " " if 0xD800 <= int(m[1], 16) < 0xE000 else chr(int(m[1], 16)), t)
        return re.sub(r"\\(.)", lambda m: one.get(m[1], m[1]), t)

    return pa.array([read(t) if h and t.lstrip().startswith("{") else t for t, h in zip(texts.to_pylist(), hit.to_pylist())], pa.large_string())


def _windows(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of about _WINDOW bytes; a longer text is a slice of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        base = size[lo - 1] if lo else 0
        hi = max(int(np.searchsorted(size, base + _WINDOW, side="right")), lo + 1)
        yield texts.slice(lo, hi - lo)
        lo = hi


def record_hashes(texts: pa.Array, fields: Sequence[str] = RECORD_FIELDS, seed: int = 0, bits: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h1, h2, has_words) of each text; equal records have equal hashes. A missing field equals an empty one."""
    parts = [_hashes(w, fields, seed, bits) for w in _windows(texts)]
    return tuple(np.concatenate([p[i] for p in parts] or [np.zeros(0, dtype=t)]) for i, t in enumerate((np.int64, np.int64, bool)))


def _hashes(texts: pa.Array, fields: Sequence[str], seed: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = _parse(texts, fields)
    keep = p.word_field >= 0
    word = np.flatnonzero(keep)
    key = p.word_row[word] * (len(fields) + 1) + p.word_field[word]
    order = np.argsort(key, kind="stable")
    cell, at, n = np.unique(key[order], return_index=True, return_counts=True)
    row, field = np.divmod(cell, len(fields) + 1)
    out = []
    for s in (2 * seed, 2 * seed + 1):
        wh = _poly(p.units, p.word_start[:-1], np.diff(p.word_start), 100 + s)[word][order]
        fh = _poly(wh, at, n, 200 + s)
        total = np.zeros(p.rows, dtype=_U)
        with np.errstate(over="ignore"):
            np.add.at(total, row, _mix(fh + _mix(field.astype(_U), 300 + s), 400 + s))
        out.append(total)
    h1, h2 = out
    if bits < 128:
        h1, h2 = (h1 & _U((1 << min(bits, 63)) - 1)), np.zeros_like(h2)
    return h1.view(np.int64), h2.view(np.int64), np.bincount(row, minlength=p.rows)[: p.rows] > 0


@lru_cache(maxsize=1)
def _word_pattern():
    import regex

    return regex.compile(r"(?V1)[\p{L}\p{N}\p{M}][\p{L}\p{N}\p{M}[\p{Cf}--[\u200b\ufeff]]]*")


def _plain(word: str) -> str:
    """A word without case, decomposed, and without invisible formatting."""
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFD", word.casefold()) if unicodedata.category(c) != "Cf")


def _runs(text: str, labels: dict[str, int], initials: set[str]) -> dict[int, tuple[int, int]]:
    """Where the words of each field stand in a text, from behind its label up to the next label; what stands before
    the first label is a field of its own."""
    seen: dict[int, list[tuple[int, int]]] = {}
    for m in _word_pattern().finditer(text):
        if m.group()[0].casefold()[:1] in initials and (i := labels.get(_plain(m.group()))) is not None:
            seen.setdefault(i, []).append(m.span())
    marks = []
    for i, spans in seen.items():  # a response may read like a label: the one that looks like a label is it, else the first
        named = spans if len(spans) == 1 else [s for s in spans if re.match(r"[\"'”]?\s*[:=]", text[s[1] : s[1] + 9])]
        marks.append(((named or spans)[0], i))
    marks.sort()
    edges = [*(s[0] for s, _ in marks), len(text)]
    return {len(labels): (0, edges[0])} | {i: (s[1], end) for (s, i), end in zip(marks, edges[1:])}


def _same_words(a: str, a_run: tuple[int, int], b: str, b_run: tuple[int, int]) -> bool:
    """Two pointers, from word to word on either side."""
    word, (i, a_end), (j, b_end) = _word_pattern(), a_run, b_run
    while True:
        m, n = word.search(a, i, a_end), word.search(b, j, b_end)
        if m is None or n is None:
            return m is n
        if m.group() != n.group() and _plain(m.group()) != _plain(n.group()):
            return False
        i, j = m.end(), n.end()


def same_records(left: pa.Array, right: pa.Array, fields: Sequence[str] = RECORD_FIELDS) -> np.ndarray:
    """Exact comparison, row by row, that shares nothing with the hashes but the reading of JSON escapes."""
    labels = {_plain(unicodedata.normalize("NFD", f)): i for i, f in enumerate(fields)}
    initials = {f[0] for f in labels}
    out = np.zeros(len(left), dtype=bool)
    kept: tuple[str | None, str, dict[int, tuple[int, int]]] = (None, "", {})
    decomposed = lambda t: t if t.isascii() else unicodedata.normalize("NFD", t)
    for r, (raw, x, y) in enumerate(zip(right.to_pylist(), _unescaped(left).to_pylist(), _unescaped(right).to_pylist())):
        if x is None or y is None:
            continue
        if raw != kept[0]:
            t = decomposed(y)
            kept = raw, t, _runs(t, labels, initials)
        _, b, q = kept
        a = decomposed(x)
        p = _runs(a, labels, initials)
        out[r] = a == b or all(_same_words(a, p.get(i, (0, 0)), b, q.get(i, (0, 0))) for i in p.keys() | q.keys())
    return out


def collapse(df: DataFrame, id: str, payload: str, fields: Sequence[str] = RECORD_FIELDS, bits: int = 128, max_rounds: int = 20, part_rows: int = 50_000) -> DataFrame:
    """(kept_id, copy_id): for each set of equal records the smallest id with each other one.

    Records are equal if their fields hold the same words in the same order, the fields in any order. Null payloads
    and payloads without any word equal nothing. Rows repeated with their id are one record. An empty table gives no pairs.
    Groups are never collected: the kept record is found by a map-side combined minimum, and each copy meets it in a
    join; the kept record of a group of more than `part_rows` is repeated so that its copies are spread over that many
    more keys.
    """
    rows = df.select(F.col(id).alias("id"), F.col(payload).cast("string").alias("payload"))
    kind = rows.schema["id"].dataType.simpleString()
    done: list[DataFrame] = []
    for seed in range(max_rounds):

        def hashes(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    h1, h2, ok = record_hashes(b.column(1), fields, seed, bits)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h1, mask=~ok), pa.array(h2, mask=~ok)], names=["id", "h1", "h2"])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same_records(b.column(2), b.column(3), fields))], names=["kept_id", "copy_id", "same"])

        hashed = cut(rows.filter("payload IS NOT NULL").mapInArrow(hashes, f"id {kind}, h1 bigint, h2 bigint").filter("h1 IS NOT NULL"), "hashes")
        firsts = hashed.groupBy("h1", "h2").agg(F.min("id").alias("kept_id"), F.count("*").alias("n")).filter("n > 1").withColumn("parts", F.ceil(F.col("n") / part_rows)).drop("n")
        salt = F.pmod(F.xxhash64("id"), F.col("parts")).alias("salt")
        members = hashed.join(firsts, ["h1", "h2"]).filter("id <> kept_id").select("kept_id", F.col("id").alias("copy_id"), salt)
        one, two = rows.select(F.col("id").alias("copy_id"), F.col("payload").alias("p1")), rows.select(F.col("id").alias("kept_id"), F.col("payload").alias("p2"))
        kept = two.join(firsts.select("kept_id", "parts"), "kept_id").select("kept_id", "p2", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("salt"))
        pairs = members.join(one, "copy_id").join(kept, ["kept_id", "salt"]).select("kept_id", "copy_id", "p1", "p2")
        verified = cut(pairs.mapInArrow(compare, f"kept_id {kind}, copy_id {kind}, same boolean"), "pairs")
        done.append(verified.filter("same").select("kept_id", "copy_id"))
        wrong = verified.filter("NOT same").select(F.col("copy_id").alias("id")).distinct()
        if wrong.isEmpty():
            break
        rows = rows.join(wrong, "id", "left_semi")
    else:
        raise RuntimeError(f"different records still share a hash after {max_rounds} rounds; use more bits")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.distinct()


def distinct_records(df: DataFrame, id: str, payload: str, pairs: DataFrame) -> DataFrame:
    """The kept records with the number of their copies, themselves included: id, payload, n_copies. `pairs` is what
    `collapse` gives. Records equal to nothing are kept with 1 copy."""
    counts = pairs.groupBy(F.col("kept_id").alias("_k")).agg(F.count("*").alias("_n"))
    rows = df.select(id, payload)
    copies = pairs.select(F.col("copy_id").alias("_c"))
    out = rows.join(copies, rows[id] == copies["_c"], "left_anti").join(counts, F.col(id) == F.col("_k"), "left")
    return out.select(id, payload, (F.coalesce("_n", F.lit(0)) + 1).alias("n_copies"))
