import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexspark.operators import ranking, sequence, vectors


def test_keys_rise_with_values_and_one_outlier_crowds_no_others(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=5000), [1e12, -1e15, float("nan")]])
    df = spark.createDataFrame([(None if i == 7 else float(v),) for i, v in enumerate(values)], "x double")
    rows = df.withColumn("k", ranking.spread_key(df, "x")).withColumn("slot", F.shiftright("k", 54)).collect()
    assert [r.x for r in rows if r.k is None] == [None] and {r.k for r in rows if r.x is not None and np.isnan(r.x)} == {2**63 - 1}
    known = sorted((r for r in rows if r.x is not None and not np.isnan(r.x)), key=lambda r: r.x)
    assert all(a.k <= b.k for a, b in zip(known, known[1:]))
    sizes = pd.Series([r.slot for r in known]).value_counts()
    assert sizes.iloc[2:].max() < 200 and sizes.max() < 500  # the two ranges at the ends hold the outliers
    for one in ([], [(3.0,)], [(None,)], [(3.0,), (3.0,)]):
        d = spark.createDataFrame(one, "x double")
        assert d.withColumn("k", ranking.spread_key(d, "x")).filter("k <> 0").count() == 0


def test_offsets_and_previous_values_in_one_pass(spark):
    rng = np.random.default_rng(2)
    p = pd.DataFrame({"g": rng.choice(["a", "b", None], 400), "x": rng.permutation(400).astype(float), "w": rng.integers(0, 5, 400)})
    df = spark.createDataFrame(p)
    got = ranking.running_offsets(df, ["g"], ranking.spread_key(df, "x"), {"rank": F.lit(1), "sum": F.col("w")}, ["x"], previous=["x"]).toPandas()
    want = p.assign(g=p.g.fillna("-")).sort_values("x")
    want["rank"], want["sum"], want["prev_x"] = want.groupby("g").cumcount(), want.groupby("g").w.cumsum() - want.w, want.groupby("g").x.shift()
    got = got.assign(g=got.g.fillna("-")).sort_values("x")
    for c in ("rank", "sum", "prev_x"):
        np.testing.assert_array_equal(got[c].to_numpy(dtype=float), want[c].to_numpy(dtype=float))


@pytest.mark.parametrize("long", [False, True])
def test_sweep_is_the_metrics_at_each_threshold(spark, long):
    rng = np.random.default_rng(3)
    rows = [(g, i, None if i == 0 else float(rng.random())) for g in "abc" for i in range({"a": 1, "b": 30, "c": 90}[g])]
    sims = spark.createDataFrame(rows, "g string, pos long, sim double")
    got = {(r.g, r.threshold): tuple(r)[2:] for r in sequence.threshold_sweep(sims, ["g"], [0.2, 0.5, 0.9], long).collect()}
    for t in (0.2, 0.5, 0.9):
        for r in sequence.cluster_metrics(sequence.detect_clusters(sims, ["g"], t), ["g"]).collect():
            assert got.pop((r.g, t)) == tuple(r)[1:]
    assert not got


def test_similarity_health_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 5)) + 0.5
    rows = [(i, ["x", "y", None][i % 3], v[i].tolist()) for i in range(60)] + [(100, "x", None), (101, "x", [0.0] * 5)]
    r = vectors.similarity_health(spark.createDataFrame(rows, "i int, l string, v array<double>"), "i", "v", "l", block=16).first()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    c = u @ u.T
    up = np.triu_indices(60, 1)
    same = np.array([a % 3 == b % 3 and a % 3 < 2 for a, b in zip(*up)])
    assert r.n == 60 and (r["mean"], r["std"], r["min"], r["max"]) == pytest.approx((c[up].mean(), c[up].std(), c[up].min(), c[up].max()))
    assert r.separation == pytest.approx(c[up][same].mean() - c[up][~same].mean())
    empty = vectors.similarity_health(spark.createDataFrame([], "i int, l string, v array<double>"), "i", "v", "l")
    assert [x["mean"] for x in empty.collect()] in ([None], [])
