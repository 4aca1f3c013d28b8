"""Deterministic samples: strata, training rows, pair ids, rater order.

Which positions are drawn is decided by a seeded numpy generator from the strata's sizes alone; the rows' positions come
from bucketed ranks, so no key is collected and no stratum is ordered in one task.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.operators.ranking import running_offset

#: Seeds of the main and the training sample.
PRIMARY_SEED, TRAINING_SEED = 20260507, 20260514
#: What a rater must not see.
SENSITIVE = ("participant_id", "gender", "age", "diagnosis", "mmse", "cosine_sim")


def pair_uuid(seed: int, index: int) -> str:
    """A version-4 uuid that depends on the sum of seed and index alone: seeds less than a sample's size apart share ids, so
    the ids of a sample are unique within it, not across samples."""
    return str(uuid.UUID(bytes=np.random.default_rng(seed + index).bytes(16), version=4))


def draw_stratified(df: DataFrame, stratum: str, key: str, per_stratum: int = 50, seed: int = PRIMARY_SEED) -> DataFrame:
    """`per_stratum` rows of each stratum with `pair_id` and `draw_no`. Strata are drawn in order from one generator;
    rows stand in the order of a hash of their key. An error if a stratum is smaller; null strata are not drawn."""
    rows = df.filter(F.col(stratum).isNotNull())
    sizes = sorted((r[0], r[1]) for r in rows.groupBy(stratum).count().collect())  # a few strata
    small = [(s, n) for s, n in sizes if n < per_stratum]
    if small:
        raise ValueError(f"stratum {small[0][0]} has only {small[0][1]} rows, {per_stratum} are needed")
    rng, picks = np.random.default_rng(seed), []
    for s, n in sizes:
        picks += [(s, int(p)) for p in rng.choice(n, size=per_stratum, replace=False)]
    kind = df.schema[stratum].dataType.simpleString()
    table = df.sparkSession.createDataFrame([(s, p, i, pair_uuid(seed, i)) for i, (s, p) in enumerate(picks)], f"_s {kind}, _p bigint, draw_no int, pair_id string")
    ranked = running_offset(rows.drop("pair_id", "draw_no"), [stratum], F.xxhash64(key), ties=[key], name="_rank")
    return ranked.join(table, (F.col(stratum) == F.col("_s")) & (F.col("_rank") == F.col("_p"))).drop("_s", "_p", "_rank")


def draw_training(eligible: DataFrame, live: DataFrame, on: list[str], key: str, n: int = 20, seed: int = TRAINING_SEED) -> DataFrame:
    """n rows that are not in `live` (anti-join on `on`); an error if fewer are left."""
    rest = eligible.join(live.select(*on).distinct(), on, "left_anti").withColumn("_all", F.lit(0))
    return draw_stratified(rest, "_all", key, n, seed).drop("_all")


def rater_view(sample: DataFrame, rater_seed: int, target: str | None = None, response: str | None = None) -> DataFrame:
    """What a rater sees: order_idx, pair_id, target, response and empty rating columns; columns are allowed one by
    one, so nothing else can leak. The order is a seeded hash of the pair id."""
    t = target or next(c for c in ("target", "gold") if c in sample.columns)
    r = response or next(c for c in ("raw_response", "normalized", "response") if c in sample.columns)
    rows = sample.select("pair_id", F.col(t).alias("target"), F.col(r).alias("response"))
    ranked = running_offset(rows, [], F.xxhash64(F.lit(rater_seed), "pair_id"), ties=["pair_id"], name="order_idx")
    return ranked.select("order_idx", "pair_id", "target", "response", *[F.lit(None).cast(k).alias(c) for c, k in (("rating", "int"), ("category", "string"), ("is_compound", "boolean"), ("notes", "string"))])
