"""Ranks and running sums within groups of any size, without collecting a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread_key(df: DataFrame, value: str, parts: int = 16) -> Column:
    """A bigint that rises with a numeric column and spreads over the whole key range, so that the buckets of the
    functions here are used evenly: the range between two of `parts` approximate quantiles gets an equal share of the
    keys, divided linearly, so values far off crowd no others. Equal keys are told apart by their ties. Null for null,
    NaN above all numbers."""
    x = F.col(value).cast("double")
    edges = df.select(x.alias("x")).filter(~F.isnan("x")).agg(F.percentile_approx("x", [i / parts for i in range(parts + 1)], 10 * parts).alias("q"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if edges["lo"] is None or edges["hi"] <= edges["lo"]:
        return F.when(x.isNotNull(), F.when(F.isnan(x), F.lit(1)).otherwise(F.lit(0))).cast("bigint")
    at = sorted({edges["lo"], *edges["q"], edges["hi"]})
    n = len(at) - 1

    def place(lo: int, hi: int) -> Column:
        """Where x lies among the ranges lo..hi-1, as a number from 0 to n, by halving."""
        if hi - lo == 1:
            return F.lit(float(lo)) + F.least(F.greatest((x - F.lit(at[lo])) / F.lit(at[hi] - at[lo]), F.lit(0.0)), F.lit(1.0))
        mid = (lo + hi) // 2
        return F.when(x < F.lit(at[mid]), place(lo, mid)).otherwise(place(mid, hi))

    return F.when(F.isnan(x), F.lit(2**63 - 1)).when(x.isNotNull(), (place(0, n) / n * (2.0**64 - 2.0**20) - 2.0**63).cast("bigint"))


def _matched(by: Sequence[str]) -> Column:
    cond = F.col("_slot") == F.col("_g_slot")
    for i, c in enumerate(by):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_g_{i}"))
    return cond


def running_offset(df: DataFrame, by: Sequence[str], key: Column, weight: Column | None = None, ties: Sequence[str] = (), bits: int = 10, name: str = "offset") -> DataFrame:
    """Adds `name`: the sum of `weight` (1 if not given, so the 0-based rank) of the rows of the same group `by` that
    come before, in the order of `key` (a bigint) and `ties`.

    The key range is divided into 2**bits buckets by its highest bits. Sums per (group, bucket) are aggregated on the
    map side; only 2**bits sums per group are ever ordered together, and the rows of one bucket are ordered in a task
    of their own, so a group holding a third of the table is spread over 2**bits tasks. Nulls in `by` form a group;
    null weights count 0; an empty table stays empty.
    """
    return running_offsets(df, by, key, {name: weight if weight is not None else F.lit(1)}, ties, bits)


def running_offsets(df: DataFrame, by: Sequence[str], key: Column, weights: dict[str, Column], ties: Sequence[str] = (), bits: int = 10, previous: Sequence[str] = (), prefix: str = "prev_") -> DataFrame:
    """`running_offset` of several weights at once, each under its name, and prefix + name of each of `previous`: the
    value in the row before (null for the first row of a group). The rows are ordered once."""
    names = list(weights)
    w = {f"_w{i}": F.coalesce(weights[n], F.lit(0)).cast("bigint") for i, n in enumerate(names)}
    rows = df.withColumns({"_key": F.coalesce(key.cast("bigint"), F.lit(0)), **w}).withColumn("_slot", F.shiftright("_key", 64 - bits).cast("int"))
    g = [*(F.col(c) for c in by)]
    last = [F.max_by(F.struct(*previous), F.struct("_key", *ties)).alias("_last")] if previous else []
    sums = rows.groupBy(*g, "_slot").agg(*[F.sum(c).alias(f"_sum{c}") for c in w], *last)
    slots = Window.partitionBy(*g).orderBy("_slot")
    before = slots.rowsBetween(Window.unboundedPreceding, -1)
    ends = [F.lag("_last").over(slots).alias("_before")] if previous else []
    sums = sums.select(*[F.col(c).alias(f"_g_{i}") for i, c in enumerate(by)], F.col("_slot").alias("_g_slot"), *[F.coalesce(F.sum(f"_sum{c}").over(before), F.lit(0)).alias(f"_base{c}") for c in w], *ends)
    order = Window.partitionBy(*g, "_slot").orderBy("_key", *ties)
    inner = order.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(sums, _matched(by))
    if previous:
        out = out.withColumn("_p", F.coalesce(F.lag(F.struct(*previous)).over(order), F.col("_before")))
    return out.select(*df.columns, *[(F.col(f"_base{c}") + F.sum(c).over(inner) - F.col(c)).alias(n) for c, n in zip(w, names)], *[F.col(f"_p.{v}").alias(f"{prefix}{v}") for v in previous])


def previous_values(df: DataFrame, by: Sequence[str], key: Column, values: Sequence[str], ties: Sequence[str] = (), bits: int = 10, prefix: str = "prev_") -> DataFrame:
    """Adds prefix + name of each of `values`: those of the row before in the same group, in the order of `key` and
    `ties`; null for the first row. And `has_prev`, false for the first row.

    A lag that does not order a group in one task: rows look back within their bucket of the key range, the first of a
    bucket takes the last row of the bucket before it that is not empty.
    """
    rows = df.withColumn("_key", F.coalesce(key.cast("bigint"), F.lit(-(2**63)))).withColumn("_slot", F.shiftright("_key", 64 - bits).cast("int"))
    g = [*(F.col(c) for c in by)]
    last = rows.groupBy(*g, "_slot").agg(F.max_by(F.struct(*values), F.struct("_key", *ties)).alias("_last"))
    ends = last.select(*[F.col(c).alias(f"_g_{i}") for i, c in enumerate(by)], F.col("_slot").alias("_g_slot"), F.lag("_last").over(Window.partitionBy(*g).orderBy("_slot")).alias("_before"))
    w = Window.partitionBy(*g, "_slot").orderBy("_key", *ties)
    seen = rows.join(ends, _matched(by)).withColumn("_p", F.coalesce(F.lag(F.struct(*values)).over(w), F.col("_before")))
    return seen.select(*df.columns, *[F.col(f"_p.{v}").alias(f"{prefix}{v}") for v in values], F.col("_p").isNotNull().alias("has_prev"))
