"""Filling fixed-capacity containers with items: exact-complement hashing over a histogram of lengths.

Lengths lie between 1 and the capacity, so however many items there are, their histogram has at most `capacity`
entries. The plan is made on that histogram: the longest length in stock opens containers, and one, two or three other
lengths that fill the gap exactly are looked up in the index of single, pair and triple sums and consumed in bulk, as
many containers at once as the counts allow. What finds no exact complement is placed by best fit. The items are then
dealt to the plan by their rank among items of the same length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.llm.tokens import TOKENIZER, with_token_counts
from lexspark.operators.ranking import running_offset
from lexspark.session import cut


def _sums(stock: np.ndarray) -> np.ndarray:
    """Index of pair sums: entry s tells whether two different lengths in stock, or one twice, add up to s."""
    cap = len(stock) - 1
    have = (stock > 0).astype(np.float64)
    size = 1 << (2 * cap + 1).bit_length()
    f = np.fft.rfft(have, size)
    return np.rint(np.fft.irfft(f * f, size)[: cap + 1]) > 0


def _complement(stock: np.ndarray, pairs: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """Lengths in stock, three at most, that add up to `gap`: the fewest, and the longest first among those."""
    if gap and stock[gap]:
        return (gap,)
    enough = lambda c: all(stock[x] >= c.count(x) for x in set(c))
    lengths = np.flatnonzero(stock[: gap + 1])[::-1]
    if gap >= 2 and pairs[gap]:
        for a in lengths[(stock[gap - lengths] > 0) & (lengths * 2 >= gap)]:
            if enough(c := (int(a), int(gap - a))):
                return c
    for a in lengths[pairs[gap - lengths] & (lengths < gap)] if gap >= 3 else ():
        rest = gap - int(a)
        inner = lengths[(lengths <= min(rest, a)) & (lengths * 2 >= rest)]
        for b in inner[stock[rest - inner] > 0]:
            if rest - int(b) > 0 and enough(c := (int(a), int(b), rest - int(b))):
                return c
    return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a container, number of such containers)]: every item of the histogram in exactly one container."""
    stock = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} outside 1..{capacity}")
        stock[length] += n
    done: list[tuple[tuple[int, ...], int]] = []
    left = np.zeros_like(stock)
    pairs, stale = _sums(stock), False
    for length in range(capacity, 0, -1):
        while stock[length]:
            if stale:
                pairs, stale = _sums(stock), False
            stock[length] -= 1
            other = _complement(stock, pairs, capacity - length) if length < capacity else ()
            stock[length] += 1
            if other is None:
                break
            use = (length, *other)
            k = min(int(stock[x]) // use.count(x) for x in set(use))
            for x in use:
                stock[x] -= k
                stale = stale or not stock[x]
            done.append((use, k))
        left[length], stock[length] = stock[length], 0
        stale = stale or bool(left[length])
    # best fit, longest first: containers with the same room are kept together
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    room = np.zeros(capacity + 1, dtype=np.int64)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        for gap in np.flatnonzero(room[length:]) + length:
            while n and open_[int(gap)]:
                p, have = next(iter(open_[int(gap)].items()))
                times = min(int(gap) // length, n)  # as many of this length as fit
                k = min(have, n // times)
                if k == have:
                    del open_[int(gap)][p]
                else:
                    open_[int(gap)][p] -= k
                room[gap] -= k
                open_[int(gap) - times * length][(*p, *[length] * times)] += k
                room[int(gap) - times * length] += k
                n -= k * times
            if not n:
                break
        per = capacity // length
        for times, k in ((per, n // per), (n % per, 1)):
            if times and k:
                open_[capacity - times * length][(length,) * times] += k
                room[capacity - times * length] += k
    done += [(p, k) for by in open_.values() for p, k in by.items()]
    return done


def fill_containers(items: DataFrame, length: str, capacity: int, order: Column) -> DataFrame:
    """`items` with a container each: the columns of items and container_id (from 0). Lengths must lie in 1..capacity.

    Only the histogram of lengths (at most `capacity` rows) reaches the driver. The rank of an item among those of its
    length is found through bucketed counts, so a length that a third of all items share is not ordered in one task.
    `order` is a bigint that spreads items (a hash of their key); an empty table gives an empty table.
    """
    histogram = {int(r[0]): int(r[1]) for r in items.groupBy(F.col(length).cast("int")).count().collect()}
    moves: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # length -> (first rank, first container, times)
    used: dict[int, int] = defaultdict(int)
    base = 0
    for lengths, k in plan(histogram, capacity):
        for x in set(lengths):
            times = lengths.count(x)
            moves[x].append((used[x], base, times))
            used[x] += times * k
        base += k
    table = {x: tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) for x, rows in moves.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column(b.num_columns - 2).to_numpy().astype(np.int64)
            rank = b.column(b.num_columns - 1).to_numpy()
            out = np.zeros(len(size), dtype=np.int64)
            for x in np.unique(size):
                at = size == x
                first, container, times = table[int(x)]
                j = np.searchsorted(first, rank[at], side="right") - 1
                out[at] = container[j] + (rank[at] - first[j]) // times[j]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(out)], names=[*b.schema.names[:-2], "container_id"])

    columns = items.columns
    rows = items.withColumn("_len", F.col(length).cast("int"))
    ranked = running_offset(rows, ["_len"], order, ties=[c for c in columns if c != length][:2], name="_rank").select(*columns, "_len", "_rank")
    return ranked.mapInArrow(deal, T.StructType([*items.schema.fields, T.StructField("container_id", T.LongType())]))


def document_items(df: DataFrame, id: str, text: str, capacity: int = 2048, path: str = TOKENIZER) -> DataFrame:
    """Items to be packed: id, part_no, token_from, token_to, n_tokens. A text of more than `capacity` tokens is divided
    into parts of exactly the capacity and a rest; every other text is one item. Texts without tokens (null, empty)
    take no room and are no items."""
    counted = with_token_counts(df, text, [id], path).filter("n_tokens > 0")
    part = F.explode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / capacity).cast("int"))).alias("part_no")
    rows = counted.select(id, "n_tokens", part)
    start = (F.col("part_no") * capacity).cast("int")
    stop = F.least(start + capacity, F.col("n_tokens")).cast("int")
    return rows.select(id, "part_no", start.alias("token_from"), stop.alias("token_to"), (stop - start).alias("n_tokens"))


def pack_documents(df: DataFrame, id: str, text: str, capacity: int = 2048, path: str = TOKENIZER) -> DataFrame:
    """The items of `document_items`, each with its container_id."""
    items = cut(document_items(df, id, text, capacity, path), "items")
    return fill_containers(items, "n_tokens", capacity, F.xxhash64(id, "part_no"))


def containers(packed: DataFrame, id: str, capacity: int = 2048) -> DataFrame:
    """A row per container: container_id, n_items, used, unused, contents (list of id, part_no, token_from, token_to).
    A container holds at most `capacity` items, so its list is bounded."""
    item = F.struct(F.col(id).alias("id"), "part_no", "token_from", "token_to")
    out = packed.groupBy("container_id").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("used"), F.sort_array(F.collect_list(item)).alias("contents"))
    return out.select("container_id", "n_items", "used", (F.lit(capacity) - F.col("used")).alias("unused"), "contents")
