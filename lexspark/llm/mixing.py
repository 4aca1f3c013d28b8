"""Mixing sources to target weights, in fixed-length blocks of tokens.

The texts of a source, in pseudorandom order, are laid end to end and cut into blocks of equal length (the last one of
a source is shorter); only token counts and positions are handled, never the texts. A mix is a number of slots. The k-th
slot of a source takes the block that a pseudorandom permutation of the source's block numbers sends k to - a new
permutation each time the source is used up - so slots find their blocks by an equi-join on (source, block). A source
has as many slots as it takes to reach its share of the tokens; its last slot takes the beginning of its block only, so
that the share is met to the token. How many slots of a source lie in an output shard is a multinomial draw, by what the
earlier shards left of each source and never more than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.functions.values import code_key
from lexspark.llm.tokens import TOKENIZER, with_token_counts
from lexspark.operators.ranking import running_offset
from lexspark.session import cut


def _round_function(x: np.ndarray, key: np.ndarray, r: int, bits: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (x + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15) + key
        z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        z = z ^ (z >> np.uint64(29))
    return z & ((np.uint64(1) << bits) - np.uint64(1))


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each key, evaluated at `index`: a four-round Feistel network over the
    next even power of two, walked along its cycle until the value is below n. `inverse` finds the index of a value."""
    x, n, key = index.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    half = np.maximum((np.ceil(np.log2(np.maximum(n, 2).astype(np.float64)) / 2)).astype(np.uint64), np.uint64(1))
    half = half + ((np.uint64(1) << (np.uint64(2) * half)) < n).astype(np.uint64)
    todo = np.ones(len(x), dtype=bool)
    while todo.any():
        v, h, k = x[todo], half[todo], key[todo]
        left, right = v >> h, v & ((np.uint64(1) << h) - np.uint64(1))
        for r in range(4):
            if inverse:
                left, right = right ^ _round_function(left, k, 3 - r, h), left
            else:
                left, right = right, left ^ _round_function(right, k, r, h)
        x[todo] = (left << h) | right
        todo = x >= n
    return x.astype(np.int64)


def pass_key(key: np.ndarray, passes: np.ndarray) -> np.ndarray:
    """The key of a source's permutation in its first, second .. pass."""
    return _round_function(passes.astype(np.uint64), key.astype(np.int64).view(np.uint64), 7, np.full(len(passes), 63, dtype=np.uint64))


def source_spans(df: DataFrame, id: str, text: str, source: str, block: int = 2048, seed: int = 0, path: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(counts, spans). counts: id, source_key, n_tokens of every row. spans: source_key, block, id, token_from,
    token_to, block_from - the tokens of each text that lie in each block of its source, and where in the block they
    begin. Texts without tokens are in no block, texts without a source count only in the whole. The order within a
    source is a hash of the id, whose running sum is bucketed, so that a source with a third of the rows is spread over
    many tasks."""
    counted = with_token_counts(df.withColumn("_key", code_key(F.col(source).cast("string"))), text, [id, "_key"], path)
    counts = cut(counted.select(F.col(id).alias("id"), F.col("_key").alias("source_key"), "n_tokens"), "counts")
    some = counts.filter("n_tokens > 0 AND source_key IS NOT NULL")
    laid = running_offset(some, ["source_key"], F.xxhash64(F.lit(seed), F.col("id")), F.col("n_tokens"), ties=["id", "n_tokens"], name="at")
    size = F.lit(block).cast("bigint")
    first, last = F.expr(f"at div {block}"), F.expr(f"(at + n_tokens - 1) div {block}")
    rows = laid.withColumn("block", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("block") * size - F.col("at"), F.lit(0))
    stop = F.least((F.col("block") + 1) * size - F.col("at"), F.col("n_tokens"))
    return counts, rows.select("source_key", "block", "id", start.alias("token_from"), stop.alias("token_to"), F.greatest(F.col("at") - F.col("block") * size, F.lit(0)).alias("block_from"))


def plan_slots(rows: pd.DataFrame, block: int) -> pd.DataFrame:
    """`rows` (source_tokens, needed_tokens, max_repeats, key_hash) with n_blocks, allowed_tokens, slots, and last_limit:
    how many tokens the last slot takes. The slots hold the tokens needed, or all that are allowed if those are fewer."""
    have = rows["source_tokens"].to_numpy(dtype="int64")
    repeats = np.maximum(rows["max_repeats"].to_numpy(dtype="int64"), 0)
    wanted = np.ceil(np.maximum(rows["needed_tokens"].to_numpy(dtype="float64"), 0.0)).astype("int64")
    goal = np.minimum(wanted, have * repeats)
    n = -(-have // block)
    short = have - (n - 1) * block  # tokens of the last block
    passes, rest = np.divmod(goal, np.maximum(have, 1))
    some = n > 0
    at = np.zeros_like(n)  # when the short block comes in the last pass
    at[some] = permute((n - 1)[some], n[some], pass_key(rows["key_hash"].to_numpy()[some], passes[some]), inverse=True)
    lack = block - short
    more = np.where(rest > at * block, -(-(rest + lack) // block), -(-rest // block))
    before = np.maximum(more - 1, 0)
    held = before * block - np.where(before > at, lack, 0)
    limit = np.where(rest > 0, rest - held, block)
    return rows.assign(n_blocks=n, allowed_tokens=have * repeats, slots=np.where(some, passes * n + more, 0), last_limit=limit)


def draw_slots(slots: np.ndarray, rng: np.random.Generator, shards: int) -> Iterator[np.ndarray]:
    """The slots of each source in shard after shard: multinomial counts by what is left of each source; where a draw
    exceeds that, the surplus is drawn again among the others. Shards differ by one slot at most, and all slots are dealt."""
    left = slots.astype("int64").copy()
    for s in range(shards):
        size = int(left.sum()) // (shards - s)
        here = left.copy() if s == shards - 1 else np.zeros_like(left)
        while (open_ := size - int(here.sum())) > 0:
            room = left - here
            here += np.minimum(rng.multinomial(open_, room / room.sum()), room)
        yield here
        left -= here


def mix_sources(df: DataFrame, targets: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", block: int = 2048, seed: int = 0, shards: int = 256, slots_per_shard: int = 1_000_000, max_targets: int = 100_000, path: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(contents, report).

    contents: mix_id, shard, slot (a number by which the slots of a shard are to be ordered), source, block, repeat_no
    (0 for the first use of the block), id, token_from, token_to. report: a row per target with mix_tokens,
    source_tokens, needed_tokens, allowed_tokens, slots, and of the mix as it was drawn filled (slots that found their
    block), reached_tokens, reached_share (of mix_tokens), actual_share (of all tokens the mix reached) and repeats (the
    most any block is used).

    `targets`: mix_id, source, target_share, max_repeats, size_ratio; it is configuration and its number of rows is
    checked against `max_targets`. A source gives the tokens of its share, to the token, or, where those exceed
    max_repeats times its tokens, all it may give. Spellings of a source are compared by letters and digits in lower
    case. Null or zero shares and repeats give no slots; a null mix_id is a mix of its own; shares that add up to more
    than 1 make the mix larger than mix_tokens; empty documents give mixes of no slots. A shard has at most
    `slots_per_shard` slots; there are `shards` of them where a mix is large enough.
    """
    spark = df.sparkSession
    counts, spans = source_spans(df, id, text, source, block, seed, path)
    keyed = targets.select("mix_id", "source", F.col("target_share").cast("double").alias("target_share"), F.coalesce("max_repeats", F.lit(0)).cast("bigint").alias("max_repeats"), F.col("size_ratio").cast("double").alias("size_ratio"), code_key(F.col("source").cast("string")).alias("key"), F.xxhash64(F.lit(seed), F.lit("mix"), "mix_id").alias("mix_hash"))
    keyed = keyed.withColumn("key_hash", F.xxhash64("mix_hash", "key"))
    totals = counts.groupBy("source_key").agg(F.sum("n_tokens").alias("source_tokens"))
    rows = keyed.join(totals, F.col("key") == F.col("source_key"), "left").limit(max_targets + 1).toPandas().sort_values(["mix_id", "source"], kind="stable").reset_index(drop=True)
    if len(rows) > max_targets:
        raise ValueError(f"more than {max_targets} target rows")
    whole = int(totals.agg(F.sum("source_tokens")).first()[0] or 0)
    rows["row"] = np.arange(len(rows))
    rows["source_tokens"] = rows["source_tokens"].fillna(0).astype("int64")
    rows["mix_tokens"] = rows["size_ratio"].astype("float64").fillna(0.0) * whole
    rows["needed_tokens"] = rows["target_share"].astype("float64").fillna(0.0) * rows["mix_tokens"]
    rows = plan_slots(rows, block)
    kinds = {"row": "bigint", "mix_id": targets.schema["mix_id"].dataType.simpleString(), "source": "string", "key": "string", "mix_hash": "bigint", "key_hash": "bigint", "target_share": "double", "max_repeats": "bigint", "mix_tokens": "double", "source_tokens": "bigint", "needed_tokens": "double", "allowed_tokens": "bigint", "n_blocks": "bigint", "slots": "bigint", "last_limit": "bigint"}
    plain = lambda v: None if v is None or v is pd.NA or v != v else v.item() if isinstance(v, np.generic) else v
    exact = {"mix_id": int} if isinstance(targets.schema["mix_id"].dataType, T.IntegralType) else {}
    local = [tuple(exact.get(c, lambda x: x)(v) if (v := plain(x)) is not None else None for c, x in zip(kinds, r)) for r in rows[list(kinds)].itertuples(index=False, name=None)]
    planned = spark.createDataFrame(local, ", ".join(f"`{c}` {t}" for c, t in kinds.items()))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The target rows of a mix -> how many slots of each row lie in each shard, and in those before it."""
        for f in frames:
            for mix_hash, row, slots in zip(f["mix_hash"], f["row"], f["slots"]):
                row, slots = np.asarray(row), np.asarray(slots)
                n = int(max(1, min(shards, slots.sum() // 16), -(-int(slots.sum()) // slots_per_shard)))
                base = np.zeros_like(slots)
                for s, here in enumerate(draw_slots(slots, np.random.default_rng([seed, mix_hash & 0x7FFFFFFFFFFFFFFF]), n)):
                    at = np.flatnonzero(here)
                    yield pd.DataFrame({"row": row[at], "shard": np.int64(s), "base": base[at], "n": here[at]})
                    base = base + here

    ordered = F.sort_array(F.collect_list(F.struct("row", "slots")))
    mixes = planned.filter("slots > 0").groupBy("mix_hash").agg(ordered.alias("r")).select("mix_hash", "r.row", "r.slots")  # at most max_targets rows
    dealt = mixes.mapInPandas(deal, "row bigint, shard bigint, base bigint, n bigint")
    ranges = dealt.repartition("row", "shard").join(planned.select("row", "mix_id", "source", "key", "key_hash", "n_blocks", "slots", "last_limit"), "row")
    kth = ranges.withColumn("k", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("n") - 1)))
    kth = kth.withColumn("limit", F.when(F.col("k") == F.col("slots") - 1, F.col("last_limit")).otherwise(F.lit(block).cast("bigint")))
    carried = ["mix_id", "shard", "row", "source", "key", "k", "limit"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
                k, n = c["k"].to_numpy(), c["n_blocks"].to_numpy()
                at = permute(k % n, n, pass_key(c["key_hash"].to_numpy(), k // n))
                yield pa.RecordBatch.from_arrays([*(c[x] for x in carried), pa.array(at), pa.array(k // n)], names=[*carried, "block", "repeat_no"])

    kth = kth.select(*carried, "n_blocks", "key_hash")
    slots = kth.mapInArrow(place, T.StructType([*(kth.schema[c] for c in carried), T.StructField("block", T.LongType()), T.StructField("repeat_no", T.LongType())]))
    inside = F.least(F.col("token_to"), F.col("token_from") + F.col("limit") - F.col("block_from"))
    contents = slots.join(spans, (F.col("key") == F.col("source_key")) & (slots["block"] == spans["block"])).filter("block_from < limit").select(
        "mix_id", "shard", F.xxhash64("mix_id", "row", "k").alias("slot"), "source", slots["block"].alias("block"), "repeat_no", F.col("id").alias(id), "token_from", inside.alias("token_to")
    )
    sizes = spans.groupBy("source_key", "block").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("tokens"))
    got = slots.join(sizes, (F.col("key") == F.col("source_key")) & (slots["block"] == sizes["block"])).groupBy("row").agg(F.count("*").alias("filled"), F.sum(F.least("tokens", "limit")).alias("reached_tokens"), (F.max("repeat_no") + 1).alias("repeats"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    report = cut(planned.join(got, "row", "left").select("mix_hash", "mix_id", "source", "target_share", "max_repeats", "mix_tokens", "source_tokens", "needed_tokens", "allowed_tokens", "slots", zero("filled"), zero("reached_tokens"), zero("repeats")), "report")
    of_mix = report.groupBy("mix_hash").agg(F.sum("reached_tokens").alias("_all"))
    share = lambda whole: F.col("reached_tokens") / F.when(F.col(whole) > 0, F.col(whole))
    return contents, report.join(of_mix, "mix_hash").select("mix_id", "source", "target_share", "max_repeats", "mix_tokens", "source_tokens", "needed_tokens", "allowed_tokens", "slots", "filled", "reached_tokens", share("mix_tokens").alias("reached_share"), share("_all").alias("actual_share"), "repeats")


def unreachable(report: DataFrame) -> DataFrame:
    """The targets whose share the drawn mix did not reach although every repeat was used."""
    return report.filter(F.col("reached_tokens") < F.col("needed_tokens"))
