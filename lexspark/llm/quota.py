"""Samples that match target category proportions.

Categories are counted, integer quotas are allocated per draw (on counts only), and the rows with the smallest random
keys of each category are taken. The rank of a key is found through bucketed counts, so a category that holds a third
of all rows is never ordered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.functions.values import code_key
from lexspark.operators.ranking import running_offset
from lexspark.session import cut

DIMENSIONS = ("cosine_quartile", "diagnosis", "model")


def allocate(share: np.ndarray, floor: np.ndarray, available: np.ndarray, size: int) -> np.ndarray:
    """Integer quotas: floor <= quota <= available where both can hold (available wins), in all `size` or as near to it
    as floors and availability allow; proportional to `share` between the bounds, rounded by largest remainder (the
    first of remainders equal to nine places). Floors that add up to more than `size` are kept; `floor_excess` in the
    report says by how much."""
    high = available.astype("int64")
    low = np.minimum(floor.astype("int64"), high)
    total = int(min(max(size, low.sum()), high.sum()))
    share = np.maximum(np.nan_to_num(share.astype("float64")), 0.0)
    if total <= low.sum() or share.sum() <= 0:
        return low
    share = np.where(share > 0, np.maximum(share / share.max(), 1e-12), 0.0)
    # the level x at which the shares x * share, kept between the bounds, add up to the total: their sum rises along
    # straight lines that bend where a share leaves its floor or meets its bound; the bends around it are found by halving
    level = lambda x: np.clip(x * share, low, high)
    some = share > 0
    bends = np.unique(np.concatenate([[0.0], low[some] / share[some], high[some] / share[some]]))
    a, b = 0, len(bends) - 1
    while b - a > 1:
        m = (a + b) // 2
        a, b = (m, b) if level(bends[m]).sum() < total else (a, m)
    under, over = level(bends[a]).sum(), level(bends[b]).sum()
    ideal = level(bends[a] + min(max((total - under) / (over - under), 0.0), 1.0) * (bends[b] - bends[a]) if over > under else bends[b])
    quota = np.clip(np.floor(ideal + 1e-9), low, high).astype("int64")
    order = np.argsort(-np.round(ideal - quota, 9), kind="stable")
    while (left := total - int(quota.sum())) > 0:
        free = [i for i in order if quota[i] < high[i] and share[i] > 0][:left]
        if not free:
            break
        quota[free] += 1
    return quota


def _category(dims: Sequence[str], used: Sequence[Column]) -> Column:
    """The key of a row's category among the dimensions its draw is divided by; null if one of them is null."""
    parts = [F.when(u, F.col(f"k_{d}")).otherwise(F.lit("*")) for d, u in zip(dims, used)]
    missing = [u & F.col(f"k_{d}").isNull() for d, u in zip(dims, used)]
    any_missing = missing[0]
    for m in missing[1:]:
        any_missing = any_missing | m
    return F.when(~any_missing, F.concat_ws("\u0001", *parts))


def _codes(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    return df.withColumns({f"k_{d}": code_key(F.col(d).cast("string")) for d in dims})


def categorized(pool: DataFrame, targets: DataFrame, dims: Sequence[str] = DIMENSIONS, salts: int = 16) -> DataFrame:
    """Distinct (draw_id, category, pair_id) of the pool; category by the dimensions the draw's targets use. Pairs with
    a null code in one of them are in no category. The few rows that say how a draw is divided are joined with salted
    keys, so that a draw with a third of the pool is spread over `salts` keys."""
    shapes = targets.groupBy("draw_id").agg(*[F.bool_or(F.col(d).isNotNull()).alias(f"u_{d}") for d in dims])
    shapes = shapes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = _codes(pool.select("draw_id", "pair_id", *dims), dims).withColumn("_salt", F.pmod(F.xxhash64("pair_id"), F.lit(salts)).cast("int"))
    rows = rows.join(shapes, ["draw_id", "_salt"]).withColumn("category", _category(dims, [F.col(f"u_{d}") for d in dims]))
    return rows.filter("category IS NOT NULL AND pair_id IS NOT NULL").select("draw_id", "category", "pair_id").distinct()


def quota_plan(members: DataFrame, targets: DataFrame, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """A row per target: target_id, draw_id, category, sample_size, target_share, min_pairs, needed, available, quota,
    floor_excess. Needed is the greater of min_pairs and the share of sample_size to the nearest whole number;
    floor_excess is by how much the floors of the draw, as far as there are pairs, exceed its sample_size."""
    t = _codes(targets, dims).withColumn("category", _category(dims, [F.col(d).isNotNull() for d in dims]))
    counts = members.groupBy("draw_id", "category").agg(F.count("*").alias("available"))
    t = t.join(counts, ["draw_id", "category"], "left").select(
        "target_id", "draw_id", "category", F.col("sample_size").cast("bigint").alias("sample_size"), F.col("target_share").cast("double").alias("target_share"), F.coalesce("min_pairs", F.lit(0)).cast("bigint").alias("min_pairs"),
        F.greatest(F.coalesce("min_pairs", F.lit(0)), F.coalesce(F.floor(F.col("target_share") * F.col("sample_size") + 0.5), F.lit(0))).cast("bigint").alias("needed"), F.coalesce("available", F.lit(0)).cast("bigint").alias("available"),
    )

    def quotas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by draw: the draws of a batch are allocated one after the other, the last one waits for the next batch."""
        held: pa.Table | None = None
        for b in chain(batches, (None,)):
            if b is not None and not b.num_rows:
                continue
            t = held if b is None else pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if t is None:
                return
            draw = t["draw_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(draw)) + 1, [len(draw)]])
            last = len(starts) - 1 if b is None else len(starts) - 2
            share, floor, have, size = (t[c].to_numpy() for c in ("target_share", "min_pairs", "available", "sample_size"))
            quota, excess = np.zeros(len(draw), dtype=np.int64), np.zeros(len(draw), dtype=np.int64)
            for lo, hi in zip(starts[:last], starts[1:]):
                n = size[lo:hi].astype("float64")
                whole = 0 if np.isnan(n).all() else int(np.nanmax(n))
                quota[lo:hi] = allocate(share[lo:hi], floor[lo:hi], have[lo:hi], whole)
                excess[lo:hi] = max(int(np.minimum(floor[lo:hi], have[lo:hi]).sum()) - whole, 0)
            done = int(starts[last])
            if done:
                yield from t.slice(0, done).append_column("quota", pa.array(quota[:done])).append_column("floor_excess", pa.array(excess[:done])).combine_chunks().to_batches()
            held = t.slice(done)

    return t.repartition("draw_id").sortWithinPartitions("draw_id", "target_id").mapInArrow(quotas, T.StructType([*t.schema.fields, T.StructField("quota", T.LongType()), T.StructField("floor_excess", T.LongType())]))


def quota_sample(pool: DataFrame, targets: DataFrame, dims: Sequence[str] = DIMENSIONS, seed: int = 20260507) -> tuple[DataFrame, DataFrame]:
    """(sample, report). sample: draw_id, target_id, pair_id of the `quota` pairs of each category with the smallest
    random keys (a hash of seed and pair_id; pair_id decides ties). report: `quota_plan` with `drawn`, the pairs of the
    sample, and `shortfall`, how many of the pairs needed the selection could not find.

    A category is drawn as far as the greater of quota and need, and the sample holds the first `quota` of these; the
    others only show that a quota below the need is owed to other categories' floors and not to missing pairs. Repeated
    exports of a pair are one pair. Draws without targets are not sampled; an empty pool gives an empty sample and a
    report of shortfalls."""
    members = cut(categorized(pool, targets, dims), "members")
    plan = cut(quota_plan(members, targets, dims), "plan")
    ranked = running_offset(members, ["draw_id", "category"], F.xxhash64(F.lit(seed), F.col("pair_id")), ties=["pair_id"], name="rank")
    drawn = ranked.join(plan.select("draw_id", "category", "target_id", "quota", "needed"), ["draw_id", "category"]).filter(F.col("rank") < F.greatest("quota", "needed"))
    counts = drawn.groupBy(F.col("target_id").alias("_t"), F.col("draw_id").alias("_d")).agg(F.count_if(F.col("rank") < F.col("quota")).alias("drawn"), F.count_if(F.col("rank") < F.col("needed")).alias("_within"))
    report = plan.join(counts, (F.col("target_id").eqNullSafe(F.col("_t"))) & (F.col("draw_id") == F.col("_d")), "left")
    report = report.select(*plan.columns, F.coalesce("drawn", F.lit(0)).alias("drawn"), (F.col("needed") - F.coalesce("_within", F.lit(0))).alias("shortfall"))
    return drawn.filter("rank < quota").select("draw_id", "target_id", "pair_id"), report
