"""Rank and agreement statistics, effect sizes, bootstrap intervals.

Ranks over a whole table are found from counts per distinct value and bucketed running sums (no window without a
partition). Contingency statistics are closed forms over counts. Undefined results are null, never NaN.
"""

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.operators.ranking import running_offset, spread_key
from lexspark.session import cut, release, release_shuffles


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """(by, value, n, rank): the average rank of each distinct value within its group, and how often it occurs.
    Null values have no rank."""
    counts = cut(df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n")), "counts")
    before = running_offset(counts, list(by), spread_key(counts, value), F.col("n"), ties=[value], name="_before")
    return before.select(*by, value, "n", (F.col("_before") + (F.col("n") + 1) / 2).alias(name))


def with_average_rank(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """df with the average rank of its value, null for null values."""
    r = average_ranks(df, value, by, "_r").drop("n").withColumnRenamed(value, "_v")
    cond = F.col(value) == F.col("_v")
    for i, c in enumerate(by):
        r = r.withColumnRenamed(c, f"_b{i}")
        cond = cond & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    return df.join(r, cond, "left").select(*[df[c] for c in df.columns], F.col("_r").alias(name))


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r of the rows that have both, as an aggregate; null where one side does not vary (the built-in divides
    by zero there)."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    var = F.var_pop(a) * F.var_pop(b)
    return F.covar_pop(a, b) / F.sqrt(F.when(var > 0, var))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), min_n: int = 2) -> DataFrame:
    """by, n, spearman_rho of the rows where both are given; null below `min_n` rows or where one does not vary.

    The correlation is computed from the sums over distinct (x, y) cells."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("x"), F.col(y).alias("y"))
    cells = cut(both.groupBy(*by, "x", "y").agg(F.count("*").alias("w")), "cells")
    for v in ("x", "y"):
        marg = cells.groupBy(*by, v).agg(F.sum("w").alias("n"))
        r = running_offset(marg, list(by), spread_key(marg, v), F.col("n"), ties=[v], name="_before").select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col(v).alias("_v"), (F.col("_before") + (F.col("n") + 1) / 2).alias(f"r{v}"))
        cond = F.col(v) == F.col("_v")
        for i, c in enumerate(by):
            cond = cond & F.col(c).eqNullSafe(F.col(f"_b{i}"))
        cells = cells.join(r, cond).drop("_v", *[f"_b{i}" for i in range(len(by))])
    w, a, b = F.col("w"), F.col("rx"), F.col("ry")
    g = cells.groupBy(*by).agg(F.sum("w").alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"), F.sum(w * a * b).alias("sab"), F.sum(w * a * a).alias("saa"), F.sum(w * b * b).alias("sbb"))
    n = F.col("n")
    var = (F.col("saa") - F.col("sa") * F.col("sa") / n) * (F.col("sbb") - F.col("sb") * F.col("sb") / n)
    rho = (F.col("sab") - F.col("sa") * F.col("sb") / n) / F.sqrt(F.when(var > 0, var))
    return g.select(*by, "n", F.when(n >= min_n, rho).alias("spearman_rho"))


def kruskal(df: DataFrame, value: str, group: str, by: Sequence[str] = (), least: int = 1) -> DataFrame:
    """by, k, n, h of the groups with `least` values or more: rank sums with tie correction; null for fewer than two
    groups or if no value differs. Null groups and values are left out."""
    rows = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).select(*by, F.col(group).alias("g"), F.col(value).alias("v"))
    cells = rows.groupBy(*by, "g", "v").agg(F.count("*").alias("w"))
    if least > 1:
        enough = cells.groupBy(*by, "g").agg(F.sum("w").alias("_n")).filter(F.col("_n") >= least).drop("_n")
        cells = cells.join(enough, [*by, "g"])
    cells = cut(cells, "cells")
    marg = cells.groupBy(*by, "v").agg(F.sum("w").alias("n"))
    ranks = running_offset(marg, list(by), spread_key(marg, "v"), F.col("n"), ties=["v"], name="_before").select(*by, "v", (F.col("_before") + (F.col("n") + 1) / 2).alias("r"), F.col("n").alias("t"))
    sums = cells.join(ranks, [*by, "v"]).groupBy(*by, "g").agg(F.sum("w").alias("ng"), F.sum(F.col("w") * F.col("r")).alias("rs"))
    per = sums.groupBy(*by).agg(F.count("*").alias("k"), F.sum("ng").alias("n"), F.sum(F.col("rs") * F.col("rs") / F.col("ng")).alias("q"))
    t = F.col("t").cast("double")
    ties = ranks.groupBy(*by).agg(F.sum(t * t * t - t).alias("ties"))
    n = F.col("n").cast("double")
    joined = per.join(ties, list(by)) if by else per.withColumn("_one", F.lit(1)).join(ties.withColumn("_one", F.lit(1)), "_one")
    h = (12.0 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / F.when(n * n * n - n - F.col("ties") > 0, 1 - F.col("ties") / (n * n * n - n))
    return joined.select(*by, "k", F.col("n").cast("bigint").alias("n"), F.when((F.col("k") >= 2) & (n > 1), h).alias("h"))


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution: 1 - P(df/2, x/2), by series or continued fraction."""
    if x is None or df is None or df <= 0 or math.isnan(x):
        return float("nan")
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for i in range(1, 1000):
            term *= x / (a + i)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - scale * total)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 1000):
        an, b = -i * (i - a), b + 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def t_two_sided(t: float, df: float) -> float:
    """Two-sided tail of Student's distribution: the incomplete beta function at df / (df + t**2)."""
    if t is None or df is None or df <= 0 or math.isnan(t):
        return float("nan")
    return _beta(df / 2, 0.5, df / (df + t * t))


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(0, 500):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c or 1e-300
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * (f - 1)


def chi2_p(x: Column, df: Column) -> Column:
    """`chi2_sf` of columns; one call per row of a result table."""

    @F.pandas_udf("double")
    def tail(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([chi2_sf(a, b) if pd.notna(a) and pd.notna(b) else None for a, b in zip(x, df)], dtype="float64")

    return tail(x, df)


def t_p(t: Column, df: Column) -> Column:
    """`t_two_sided` of columns; one call per row of a result table."""

    @F.pandas_udf("double")
    def tails(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(a, b) if pd.notna(a) and pd.notna(b) else None for a, b in zip(t, df)], dtype="float64")

    return tails(t, df)


def with_rho_p(df: DataFrame, rho: str = "spearman_rho", n: str = "n", name: str = "p_value") -> DataFrame:
    """Two-sided p of a rank correlation by the t approximation; 0 for |rho| = 1; null below three rows."""
    r, k = F.col(rho), F.col(n)
    t = F.abs(r) * F.sqrt((k - 2) / F.when(F.abs(r) < 1, 1 - r * r))
    return df.withColumn(name, F.when(k < 3, None).when(F.abs(r) >= 1, 0.0).otherwise(t_p(t, (k - 2).cast("double"))))


def kappa(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """by, n, kappa: unweighted, (po - pe) / (1 - pe), of the rows where both are given; null if pe is 1."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))
    ra = cells.groupBy(*by, F.col("a").alias("v")).agg(F.sum("c").alias("na"))
    rb = cells.groupBy(*by, F.col("b").alias("v")).agg(F.sum("c").alias("nb"))
    tot = cells.groupBy(*by).agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("c"))), F.lit(0)).alias("same"))
    chance = ra.join(rb, [*by, "v"]).groupBy(*by).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("e"))
    key = list(by)
    if not by:
        tot, chance, key = tot.withColumn("_k", F.lit(1)), chance.withColumn("_k", F.lit(1)), ["_k"]
    n = F.col("n").cast("double")
    po, pe = F.col("same") / n, F.coalesce(F.col("e"), F.lit(0.0)) / (n * n)
    return tot.join(chance, key, "left").filter("n > 0").select(*by, "n", ((po - pe) / F.when(pe < 1, 1 - pe)).alias("kappa"))


def weighted_kappa(df: DataFrame, a: str, b: str, by: Sequence[str] = (), levels: int = 4) -> DataFrame:
    """by, n, weighted_kappa with quadratic weights over the fixed labels 0..levels-1: from means and variances alone,
    1 - sum (a-b)^2 over its value by chance. Null if chance gives no distance."""
    rows = df.filter(F.col(a).between(0, levels - 1) & F.col(b).between(0, levels - 1))
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum((x - y) * (x - y)).alias("d"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"))
    chance = F.col("sxx") + F.col("syy") - 2 * F.col("sx") * F.col("sy") / F.col("n")
    return g.filter("n > 0").select(*by, "n", (1 - F.col("d") / F.when(chance > 0, chance)).alias("weighted_kappa"))


def confusion(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """true_label, predicted_label, n over the fixed labels 0 and 1, cells without rows included."""
    g = df.agg(*[F.count_if((truth.cast("int") == i) & (predicted.cast("int") == j)).alias(f"c{i}{j}") for i in (0, 1) for j in (0, 1)])
    cells = F.array(*[F.struct(F.lit(i).alias("true_label"), F.lit(j).alias("predicted_label"), F.col(f"c{i}{j}").alias("n")) for i in (0, 1) for j in (0, 1)])
    return g.select(F.inline(cells))


def cohens_d(df: DataFrame, value: str, group: str, pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """by, group_a, group_b, n_a, n_b, d with the pooled deviation; null below two values or without spread."""
    g = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(group).alias("g")).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    wanted = df.sparkSession.createDataFrame(list(pairs), "group_a string, group_b string")
    a = g.select(*by, F.col("g").alias("group_a"), F.col("n").alias("n_a"), F.col("m").alias("m_a"), F.col("v").alias("v_a"))
    b = g.select(*by, F.col("g").alias("group_b"), F.col("n").alias("n_b"), F.col("m").alias("m_b"), F.col("v").alias("v_b"))
    j = wanted.join(a, "group_a").join(b, [*by, "group_b"])
    pooled = ((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b")) / F.when(F.col("n_a") + F.col("n_b") > 2, F.col("n_a") + F.col("n_b") - 2)
    d = (F.col("m_a") - F.col("m_b")) / F.sqrt(F.when(pooled > 0, pooled))
    return j.select(*by, "group_a", "group_b", "n_a", "n_b", F.when((F.col("n_a") > 1) & (F.col("n_b") > 1), d).alias("d"))


def residuals(df: DataFrame, y: str, x: str, name: str = "residual") -> DataFrame:
    """df with what the least-squares line of y on x leaves; null where x or y is."""
    slope, icept = df.agg(F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")), F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double"))).first()
    if slope is None:
        return df.withColumn(name, F.lit(None).cast("double"))
    return df.withColumn(name, F.col(y) - (F.lit(float(slope)) * F.col(x) + F.lit(float(icept))))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, n, r of every two columns, over the rows that have both; r null where one does not vary. One aggregation."""
    two = [(i, j) for i in range(len(columns)) for j in range(len(columns))]
    x = [F.col(c).cast("double") for c in columns]
    g = df.agg(*[e for i, j in two if i <= j for e in (correlation(x[i], x[j]).alias(f"r{i}_{j}"), F.count(F.when(x[i].isNotNull(), x[j])).alias(f"n{i}_{j}"))])
    at = lambda k, i, j: F.col(f"{k}{min(i, j)}_{max(i, j)}")
    return g.select(F.inline(F.array(*[F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), at("n", i, j).alias("n"), finite(at("r", i, j)).alias("r")) for i, j in two])))


def exact_percentiles(df: DataFrame, value: str, probabilities: Sequence[float]) -> list[float]:
    """Percentiles by linear interpolation, exact, over all non-null values; empty for an empty column. The values at
    the positions in question are found through bucketed running counts of distinct values, so no task holds them all."""
    counts = cut(df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return []
    at = [(total - 1) * p for p in probabilities]
    wanted = sorted({k for h in at for k in (math.floor(h), math.ceil(h))})
    placed = running_offset(counts, [], spread_key(counts, "v"), F.col("n"), ties=["v"], name="_before")
    hit = F.array(*[F.lit(k) for k in wanted])
    rows = placed.select("v", F.explode(F.filter(hit, lambda k: (k >= F.col("_before")) & (k < F.col("_before") + F.col("n")))).alias("k")).collect()
    found = {r["k"]: r["v"] for r in rows}
    return [found[math.floor(h)] + (found[math.ceil(h)] - found[math.floor(h)]) * (h - math.floor(h)) for h in at]


def quartile_cutpoints(df: DataFrame, value: str) -> list[float]:
    """The edges of qcut with four parts: minimum, exact quartiles by linear interpolation, maximum; equal edges
    dropped. Empty for an empty column."""
    return sorted(set(exact_percentiles(df, value, (0.0, 0.25, 0.5, 0.75, 1.0))))


def assign_quartile(df: DataFrame, value: str, name: str = "cosine_quartile") -> DataFrame:
    """df with the right-closed quartile 0..3 of its value (fewer labels if edges coincide); null for null."""
    edges = quartile_cutpoints(df, value)
    label = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        label = F.when(F.col(value) <= edges[i + 1], i).otherwise(label)
    return df.withColumn(name, F.when(F.col(value).isNotNull(), label))


def bootstrap_spearman(df: DataFrame, x: str, y: str, by: Sequence[str], order: str, n_boot: int = 1000, seed: int = 20260507, exact_rows: int = 100_000, few: int = 1000, per_range: int = 20_000) -> DataFrame:
    """by, n, spearman_rho, ci_low, ci_high. Resamples whose values do not vary are dropped; below three rows null.

    One estimator at every size: in a resample a row weighs Poisson(1), so c rows with the same two values weigh
    Poisson(c), drawn by a seeded hash of their values; every resample is ranked anew through its counts of distinct
    values. `exact_rows` only says where: a group of at most so many rows is computed in one task, a larger one in many,
    with the same weights. If one of the two columns has at most `few` distinct values there, sums per range of the other
    column, of `per_range` cells or more, are all that leaves a task (`_by_ranges`); else a row per cell and resample is written, a few resamples at a
    time (`_by_rows`). `order` is not read, as no row's place matters.
    """
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    cells = cut(both.groupBy(*by, "x", "y").agg(F.count("*").alias("c")).withColumn("h", F.xxhash64(F.lit(seed), *by, "x", "y")), "cells")
    base = [f for f in both.schema.fields if f.name in by]
    schema = T.StructType([*base, T.StructField("n", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("spearman_rho", "ci_low", "ci_high"))])
    sizes = cells.groupBy(*by).agg(F.sum("c").alias("n"))

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["x", "y"])
        c, n = g["c"].to_numpy(), int(g["c"].sum())
        places = [np.unique(g[v].to_numpy(), return_inverse=True)[1] for v in ("x", "y")]
        rho = weighted_rank_correlation(*places, c[:, None].astype(float))[0] if n >= 3 else np.nan
        out = [weighted_rank_correlation(*places, w.astype(float)) for w in resample_weights(g["h"].to_numpy(), c, n_boot if n >= 3 else 0)]
        kept = np.concatenate([np.empty(0), *out])
        kept = kept[~np.isnan(kept)]
        lo, hi = np.percentile(kept, [2.5, 97.5]) if len(kept) else (np.nan, np.nan)
        row = {k: g[k].iloc[0] for k in by} | {"n": n, "spearman_rho": rho, "ci_low": lo, "ci_high": hi}
        return pd.DataFrame([{k: None if isinstance(v, float) and math.isnan(v) else v for k, v in row.items()}], columns=[f.name for f in schema])

    if sizes.filter(F.col("n") > exact_rows).isEmpty():
        return cells.groupBy(*by).applyInPandas(whole, schema)
    size = sizes.select(*[F.col(k).alias(f"_{k}") for k in by], "n")
    sized = cells.join(size, _same(by)).drop(*[f"_{k}" for k in by])
    small = sized.filter(F.col("n") <= exact_rows).drop("n").groupBy(*by).applyInPandas(whole, schema)
    large = cut(sized.filter(F.col("n") > exact_rows).drop("n"), "large")
    distinct = [large.groupBy(*by, v).agg(F.lit(1).alias("_one")).groupBy(*by).agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] for v in ("x", "y")]
    if min(distinct) > few:
        resamples = _by_rows(large, base, n_boot)
    else:  # the correlation is the same with the columns exchanged
        turned = large if distinct[0] <= distinct[1] else large.select(*by, F.col("y").alias("x"), F.col("x").alias("y"), "c", "h")
        resamples = _by_ranges(turned, base, n_boot, max(per_range, 80 * min(distinct)))
    drawn = F.when(F.col("b") >= 0, F.col("rho"))
    big = resamples.groupBy(*by).agg(F.max(F.when(F.col("b") < 0, F.col("n"))).cast("bigint").alias("n"), F.max(F.when(F.col("b") < 0, F.col("rho"))).alias("spearman_rho"), F.percentile(drawn, F.lit(0.025)).alias("ci_low"), F.percentile(drawn, F.lit(0.975)).alias("ci_high"))
    return small.unionByName(big.select(*[f.name for f in schema]))


def _same(by: Sequence[str], on: Column | None = None) -> Column:
    """Each of `by` like the column of that name with _ before it, nulls too."""
    cond = F.lit(True) if on is None else on
    for k in by:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return cond


def _by_ranges(cells: DataFrame, base: Sequence[T.StructField], n_boot: int, per_range: int) -> DataFrame:
    """(base, b, n, rho) of every resample, -1 being the data. x has few distinct values.

    A group is divided into ranges of y of about `per_range` cells. A task ranks y within its range, for every resample,
    and returns per x value the sums of weights and of weighted ranks. What the ranges before weigh is added when the
    ranges of a group are put together, a block of resamples in a task; so no weight is ever written."""
    by = [f.name for f in base]
    counts = cut(cells.groupBy(*by, "y").agg(F.count("*").alias("m")), "counts")
    placed = running_offset(counts, by, spread_key(counts, "y"), F.col("m"), ties=["y"], name="_o")
    ranges = placed.select(*[F.col(k).alias(f"_{k}") for k in by], F.col("y").alias("_v"), F.floor(F.col("_o") / per_range).cast("int").alias("q"))
    ranged = cells.join(ranges, _same(by, F.col("y") == F.col("_v"))).drop("_v", *[f"_{k}" for k in by])
    double = T.ArrayType(T.DoubleType())
    part = T.StructType([*base, *(T.StructField(c, T.IntegerType()) for c in ("q", "b")), *(T.StructField(c, double) for c in ("xs", "w", "wr", "t"))])

    def sums(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["y", "x"])
        c, h = g["c"].to_numpy(), g["h"].to_numpy()
        xs, px = np.unique(g["x"].to_numpy(), return_inverse=True)
        py = np.unique(g["y"].to_numpy(), return_inverse=True)[1]
        starts = np.flatnonzero(np.diff(py, prepend=-1))
        cuts = [0]
        for s in starts:  # about 2000 cells at a time, a value of y never divided
            if s - cuts[-1] >= 2000:
                cuts.append(int(s))
        out: dict[int, list[np.ndarray]] = {}
        for lo, hi in zip(cuts, [*cuts[1:], len(g)]):
            x, runs = px[lo:hi], np.flatnonzero(np.diff(py[lo:hi], prepend=-1))
            run, order = py[lo:hi] - py[lo], np.argsort(x, kind="stable")
            heads = np.flatnonzero(np.diff(x[order], prepend=-1))
            here, b = x[order][heads], -1
            for w in [c[lo:hi, None], *resample_weights(h[lo:hi], c[lo:hi], n_boot)]:
                k, w = w.shape[1], w.astype(float)
                if b not in out:
                    out[b] = [np.zeros((len(xs), k)), np.zeros((len(xs), k)), np.zeros(k), np.zeros(k)]
                a, r, t, before = out[b]
                m = np.add.reduceat(w, runs, axis=0)
                rank = before + np.cumsum(m, axis=0) - (m - 1) / 2
                a[here] += np.add.reduceat(w[order], heads, axis=0)
                r[here] += np.add.reduceat((w * rank[run])[order], heads, axis=0)
                t += (m * m * m - m).sum(0)
                before += m.sum(0)
                b = b + k
        rows = [{"b": b, "xs": xs, "w": a.ravel(), "wr": r.ravel(), "t": t} for b, (a, r, t, _) in out.items()]
        return pd.DataFrame(rows).assign(q=g["q"].iloc[0], **{k: g[k].iloc[0] for k in by})[part.names]

    def together(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("q")
        xs, k = np.unique(np.concatenate(g["xs"].tolist())), len(g["t"].iloc[0])
        a, r, t, n = np.zeros((len(xs), k)), np.zeros((len(xs), k)), np.zeros(k), np.zeros(k)
        for own, w, wr, ties in zip(g["xs"], g["w"], g["wr"], g["t"]):
            at, w = np.searchsorted(xs, own), np.reshape(w, (-1, k))
            a[at] += w
            r[at] += np.reshape(wr, (-1, k)) + n * w
            t += ties
            n += w.sum(0)
        middle = (n + 1) / 2
        rx = np.cumsum(a, axis=0) - (a - 1) / 2 - middle
        va, vc = (a * rx * rx).sum(0), (n * n * n - n - t) / 12
        ok = (va > 1e-6) & (vc > 1e-6)
        rho = np.where(ok, (rx * (r - middle * a)).sum(0) / np.sqrt(np.where(ok, va * vc, 1.0)), np.nan)
        out = pd.DataFrame({"b": np.arange(k, dtype="int32") + int(g["b"].iloc[0]), "n": n, "rho": [None if math.isnan(v) else v for v in rho]})
        return out.assign(**{c: g[c].iloc[0] for c in by})[[*by, "b", "n", "rho"]]

    tasks = -(-2 * cells.count() // per_range)  # small rows, much to compute: adaptive execution would put them together
    parts = ranged.repartition(tasks, *by, "q").groupBy(*by, "q").applyInPandas(sums, part)
    return parts.groupBy(*by, "b").applyInPandas(together, T.StructType([*base, T.StructField("b", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in ("n", "rho"))]))


def _by_rows(cells: DataFrame, base: Sequence[T.StructField], n_boot: int, at_once: int = 25) -> DataFrame:
    """As `_by_ranges`, for any number of distinct values: a row per cell and resample in which it occurs, ranked by
    bucketed running sums. `at_once` resamples lie on disk at a time."""
    by = [f.name for f in base]
    drawn_schema = T.StructType([*base, *(T.StructField(c, T.DoubleType()) for c in ("x", "y")), T.StructField("b", T.IntegerType()), T.StructField("w", T.LongType())])
    key = [*by, "b"]

    def some(first: int) -> DataFrame:
        def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for start in range(0, len(f), 1000):
                    g = f.iloc[start : start + 1000]
                    c = g["c"].to_numpy()
                    b = first if first < 0 else first // 100 * 100
                    for w in [c[:, None]] if first < 0 else resample_weights(g["h"].to_numpy(), c, min(n_boot, b + 100), first=b):
                        w = w if first < 0 else w[:, first - b : first - b + at_once]
                        i, j = np.nonzero(w)
                        yield pd.DataFrame({**{k: g[k].to_numpy()[i] for k in by}, "x": g["x"].to_numpy()[i], "y": g["y"].to_numpy()[i], "b": (first + j).astype("int32"), "w": w[i, j].astype("int64")})

        drawn = ranked = cut(cells.mapInPandas(draw, drawn_schema), "drawn")
        written = [drawn]
        for v in ("x", "y"):
            counts = cut(drawn.groupBy(*key, v).agg(F.sum("w").alias("m")), "counts")
            written.append(counts)
            placed = running_offset(counts, key, spread_key(counts, v), F.col("m"), ties=[v], name="_o")
            rank = placed.select(*[F.col(k).alias(f"_{k}") for k in key], F.col(v).alias("_v"), (F.col("_o") + (F.col("m") + 1) / 2).alias(f"r{v}"))
            ranked = ranked.join(rank, _same(key, F.col(v) == F.col("_v"))).drop("_v", *[f"_{k}" for k in key])
        a, c, w = F.col("rx"), F.col("ry"), F.col("w").cast("double")
        middle = (F.col("n") + 1) / 2
        s = ranked.groupBy(*key).agg(F.sum(w).alias("n"), F.sum(w * a * c).alias("s1"), F.sum(w * a * a).alias("s2"), F.sum(w * c * c).alias("s3"))
        va, vc = (F.col(v) - F.col("n") * middle * middle for v in ("s2", "s3"))
        out = cut(s.select(*key, "n", F.when((va > 1e-6) & (vc > 1e-6), (F.col("s1") - F.col("n") * middle * middle) / F.sqrt(va * vc)).alias("rho")), "resamples")
        release(*written)
        release_shuffles(cells.sparkSession)
        return out

    return reduce(DataFrame.unionByName, [some(b) for b in (-1, *range(0, n_boot, at_once))])


def resample_weights(h: np.ndarray, c: np.ndarray, n_boot: int, at_once: int = 100, first: int = 0) -> Iterator[np.ndarray]:
    """Weights (cell x resample) of cells of c rows, in blocks of resamples: Poisson(c) by the cell's hash and block. The
    blocks begin with the one at `first`."""
    for start in range(first, n_boot, at_once):
        k = min(at_once, n_boot - start)
        yield np.stack([np.random.default_rng([int(x) & 0x7FFFFFFFFFFFFFFF, start]).poisson(n, k) for x, n in zip(h, c)])


def weighted_rank_correlation(px: np.ndarray, py: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Spearman's rho with average ranks of every column of weights (cell x resample), px and py being the places of
    the cells' values among the distinct ones; NaN where one side does not vary."""
    total, ranks = w.sum(0), []
    for p in (px, py):
        order = np.argsort(p, kind="stable")
        counts = np.add.reduceat(w[order], np.searchsorted(p[order], np.arange(p.max() + 1)), axis=0)
        ranks.append((np.cumsum(counts, axis=0) - (counts - 1) / 2)[p] - (total + 1) / 2)
    a, b = ranks
    va, vb = (w * a * a).sum(0), (w * b * b).sum(0)
    return np.where((va > 1e-6) & (vb > 1e-6), (w * a * b).sum(0) / np.sqrt(np.where((va > 1e-6) & (vb > 1e-6), va * vb, 1.0)), np.nan)


def rank_correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Spearman's rho with average ranks; NaN where one side does not vary."""
    ra, rb = (pd.Series(v).rank().to_numpy() for v in (a, b))
    ra, rb = ra - ra.mean(), rb - rb.mean()
    s = math.sqrt(float(ra @ ra) * float(rb @ rb))
    return float(ra @ rb) / s if s > 0 else float("nan")


def bootstrap_mean(df: DataFrame, value: str, n_boot: int = 1000, seed: int = 20260507) -> DataFrame:
    """n, mean, ci_low, ci_high of the mean (of absolute errors, say) by Poisson resampling: each row weighs into
    n_boot sums on the map side, so nothing but those sums moves, at any size. Null values are left out."""
    rows = df.select(F.col(value).cast("double").alias("v"), F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns]).alias("h")).filter("v IS NOT NULL")

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n_boot, 2))
        for f in frames:
            for start in range(0, len(f), 1000):
                v, h = f["v"].to_numpy()[start : start + 1000], f["h"].to_numpy()[start : start + 1000]
                w = np.stack([np.random.default_rng(int(x) & 0x7FFFFFFFFFFFFFFF).poisson(1.0, n_boot) for x in h])
                total += np.stack([w.sum(0), v @ w], axis=1)
        yield pd.DataFrame({"b": np.arange(n_boot), "n": total[:, 0], "s": total[:, 1]})

    means = rows.mapInPandas(partial, "b int, n double, s double").groupBy("b").agg((F.sum("s") / F.when(F.sum("n") > 0, F.sum("n"))).alias("m"))
    ci = means.agg(F.percentile("m", F.lit(0.025)).alias("ci_low"), F.percentile("m", F.lit(0.975)).alias("ci_high")).withColumn("_k", F.lit(1))
    return rows.agg(F.count("*").alias("n"), F.avg("v").alias("mean")).withColumn("_k", F.lit(1)).join(ci, "_k").drop("_k")
