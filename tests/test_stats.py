import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexspark.operators import agreement, regression, sampling, stats, summaries
from lexspark.operators.ranking import running_offset


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    p = pd.DataFrame({"id": np.arange(300), "g": rng.choice(["a", "b", "c"], 300), "x": rng.integers(0, 9, 300).astype(float), "y": rng.normal(size=300).round(1)})
    p.loc[::17, "x"] = np.nan
    return p, spark.createDataFrame(p).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).cache()


def test_running_offset_is_an_exclusive_running_sum(spark):
    rows = spark.createDataFrame([(i, i % 3 if i % 7 else None, i * 7919 % 101) for i in range(200)], "i int, g int, w int")
    got = running_offset(rows, ["g"], F.xxhash64("i"), F.col("w"), ties=["i"], bits=4).toPandas()
    order = {r.i: r.h for r in rows.select("i", F.xxhash64("i").alias("h")).collect()}
    for _, part in got.groupby("g", dropna=False):
        part = part.sort_values("i", key=lambda s: s.map(order))
        assert (part["offset"].to_numpy() == np.concatenate([[0], np.cumsum(part["w"])[:-1]])).all()
    assert len(got) == 200 and running_offset(rows.limit(0), [], F.col("i")).count() == 0


def test_ranks_and_spearman(frame):
    p, df = frame
    ok = p.dropna()
    want = {g: float(np.corrcoef(q["x"].rank(), q["y"].rank())[0, 1]) for g, q in ok.groupby("g")}
    got = {r.g: r.spearman_rho for r in stats.spearman(df, "x", "y", ["g"]).collect()}
    assert got == {g: pytest.approx(v) for g, v in want.items()}
    ranks = stats.with_average_rank(df, "y").toPandas().set_index("id")["rank"]
    assert np.allclose(ranks.loc[p["id"]], p["y"].rank())
    assert stats.spearman(df.limit(0), "x", "y", ["g"]).count() == 0
    constant = df.withColumn("x", F.lit(1.0))
    assert stats.spearman(constant, "x", "y").first().spearman_rho is None


def test_kruskal_and_tails(frame):
    p, df = frame
    ok = p.dropna()
    r, n = ok["x"].rank(), len(ok)
    t = ok["x"].value_counts()
    h = (12 / (n * (n + 1)) * sum(r[ok["g"] == g].sum() ** 2 / (ok["g"] == g).sum() for g in "abc") - 3 * (n + 1)) / (1 - (t**3 - t).sum() / (n**3 - n))
    got = stats.kruskal(df, "x", "g").first()
    assert got.h == pytest.approx(h) and got.k == 3 and got.n == n
    assert stats.kruskal(df.filter("g = 'a'"), "x", "g").first().h is None
    assert stats.chi2_sf(5.991464547107979, 2) == pytest.approx(0.05) and stats.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05) and stats.chi2_sf(0, 3) == 1.0
    assert stats.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05) and stats.t_two_sided(0, 5) == pytest.approx(1.0)


def test_kappas(spark):
    a, b = [0, 1, 2, 3, 3, 2, 1, 0, 2, 2], [0, 1, 1, 3, 2, 2, 1, 1, 2, 3]
    df = spark.createDataFrame(list(zip(a, b)), "a int, b int")
    o = np.zeros((4, 4))
    for i, j in zip(a, b):
        o[i, j] += 1
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    w = (np.arange(4)[:, None] - np.arange(4)[None]) ** 2
    assert stats.weighted_kappa(df, "a", "b").first().weighted_kappa == pytest.approx(1 - (w * o).sum() / (w * e).sum())
    assert stats.kappa(df, "a", "b").first().kappa == pytest.approx((np.trace(o) - np.trace(e)) / (o.sum() - np.trace(e)))
    assert stats.kappa(df.select(F.lit(1).alias("a"), F.lit(1).alias("b")), "a", "b").first().kappa is None
    assert {(r.true_label, r.predicted_label): r.n for r in stats.confusion(df, F.col("a") >= 2, F.col("b") >= 2).collect()} == {(0, 0): 4, (0, 1): 0, (1, 0): 1, (1, 1): 5}


def test_quartiles_drop_equal_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 0, 0, 1, 2, 3)], "v double")
    got = [r.q for r in stats.assign_quartile(df, "v", "q").orderBy("v").collect()]
    assert got == pd.qcut([0, 0, 0, 1, 2, 3], 4, labels=False, duplicates="drop").tolist()
    assert stats.assign_quartile(df.limit(0), "v", "q").count() == 0


def test_effect_sizes_and_residuals(frame):
    p, df = frame
    ok = p.dropna()
    a, b = ok.loc[ok.g == "a", "x"], ok.loc[ok.g == "b", "x"]
    pooled = math.sqrt(((len(a) - 1) * a.var() + (len(b) - 1) * b.var()) / (len(a) + len(b) - 2))
    assert stats.cohens_d(df, "x", "g", [("a", "b")]).first().d == pytest.approx((a.mean() - b.mean()) / pooled)
    s, i = np.polyfit(ok["x"], ok["y"], 1)
    got = stats.residuals(df, "y", "x").dropna().toPandas().sort_values("id")["residual"]
    assert np.allclose(got, ok["y"] - s * ok["x"] - i)


def test_bootstrap_small_and_large_agree(frame):
    _, df = frame
    small = stats.bootstrap_spearman(df, "x", "y", ["g"], "id", 300).orderBy("g").collect()
    large = stats.bootstrap_spearman(df, "x", "y", ["g"], "id", 300, exact_rows=10).orderBy("g").collect()
    for s, b in zip(small, large):
        assert s.n == b.n and s.spearman_rho == pytest.approx(b.spearman_rho) and abs(s.ci_low - b.ci_low) < 0.08 and abs(s.ci_high - b.ci_high) < 0.08
    m = stats.bootstrap_mean(df.select("id", "y"), "y", 300).first()
    assert m.ci_low < m["mean"] < m.ci_high


def test_stratified_draws_are_deterministic(frame, spark):
    _, df = frame
    one = sampling.draw_stratified(df, "g", "id", 20).orderBy("draw_no").collect()
    assert [r.asDict() for r in one] == [r.asDict() for r in sampling.draw_stratified(df.repartition(7), "g", "id", 20).orderBy("draw_no").collect()]
    assert pd.Series([r.g for r in one]).value_counts().to_dict() == {"a": 20, "b": 20, "c": 20} and len({r.pair_id for r in one}) == 60 and len({r.id for r in one}) == 60
    with pytest.raises(ValueError):
        sampling.draw_stratified(df, "g", "id", 10_000)
    live = spark.createDataFrame([(r.id,) for r in one], "id long")
    assert not {r.id for r in sampling.draw_training(df, live, ["id"], "id", 20).collect()} & {r.id for r in one}
    view = sampling.rater_view(sampling.draw_stratified(df, "g", "id", 5).withColumns({"gold": F.lit("t"), "raw_response": F.lit("r"), "mmse": F.lit(1)}), 1)
    assert not set(view.columns) & set(sampling.SENSITIVE) and sorted(r.order_idx for r in view.collect()) == list(range(15))


def test_agreement_pieces(spark):
    f = lambda rows: spark.createDataFrame(rows, "pair_id string, rating int, category string, is_compound boolean")
    a, b = f([("1", 0, "other", True), ("2", 3, "hypernym", False), ("3", 2, "other", False)]), f([("1", 1, "other", True), ("2", 3, "other", False)])
    r = agreement.reliability(a, b).first()
    assert r.n_pairs == 2 and r.spearman_rho == pytest.approx(1.0) and r.compound_kappa == 1.0
    assert {x.pair_id: x.rating for x in agreement.consolidate([a, b]).collect()} == {"1": 0.5, "2": 3.0}
    assert [x.pair_id for x in agreement.missing_pairs(a, b).collect()] == ["3"]
    agreement.validate_ratings(a)
    for bad in (("1", 7, "other", True), ("1", None, "other", True), ("1", 1, "no", True)):
        with pytest.raises(ValueError):
            agreement.validate_ratings(f([bad]))
    with pytest.raises(ValueError):
        agreement.validate_ratings(a.drop("rating"))
    with pytest.raises(ValueError):
        agreement.check_missing_share(f([("1", None, "x", True), ("2", 1, "x", True)]), ["rating"])
    cat = agreement.divergence_catalog(f([(str(i), i % 4, "other", False) for i in range(20)]), spark.createDataFrame([(str(i), "t", "r", 0.5) for i in range(20)], "pair_id string, target string, response string, cosine_sim double"), 0.4)
    assert cat.filter("is_divergence_case").count() == 10


def test_regression(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 2))
    p = pd.DataFrame({"participant_id": [f"u{i}" for i in range(120)], "diagnosis": rng.choice(["HC", "AD"], 120), "a": x[:, 0], "b": 5 * x[:, 1], "mmse": 25 + 2 * x[:, 0] - x[:, 1] + rng.normal(scale=0.1, size=120)})
    df = spark.createDataFrame(p)
    t = {r.feature: r for r in regression.correlation_table(df, ["a", "b"]).collect()}
    assert t["a"].r == pytest.approx(np.corrcoef(p.a, p.mmse)[0, 1]) and t["a"].passes and t["a"].p_value < 1e-6
    z = np.column_stack([np.ones(120), p.a, p.b, p.mmse])
    w = regression.ridge_from_moments(z.T @ z, 3.0)
    s = (p[["a", "b"]] - p[["a", "b"]].mean()) / p[["a", "b"]].std(ddof=0)
    beta = np.linalg.solve(s.T @ s + 3.0 * np.eye(2), s.T @ (p.mmse - p.mmse.mean()))
    assert np.allclose(w[1:], beta / p[["a", "b"]].std(ddof=0))
    folds = regression.ridge_cv(df, ["a", "b"]).toPandas()
    assert (folds.mmse - folds.prediction).abs().mean() < 0.2 and folds.groupby("fold").size().max() - folds.groupby("fold").size().min() <= 2
    svr = regression.svr_cv(df, ["a", "b"], max_rows=60).toPandas()
    assert len(svr) == 60 and (svr.truth - svr.prediction).abs().mean() < 1.5
    y = p.mmse.to_numpy() - 25
    beta, k = regression.svr_fit(x, y, 1.0, 0.5, tol=1e-8, epochs=2000), np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(-1)) + 1
    r = y - k @ beta
    assert np.all(np.abs(r[np.abs(beta) < 1e-9]) <= 0.1 + 1e-4) and np.allclose(np.abs(r[(np.abs(beta) > 1e-6) & (np.abs(beta) < 1 - 1e-6)]), 0.1, atol=1e-3)
    held = spark.createDataFrame(folds)
    assert regression.most_common_setting(held, "alpha").count() == 1
    mae, cm, kappa = regression.evaluation(held, n_boot=50)
    assert mae.first()["mean"] < 0.2 and cm.count() == 4 and kappa.first().kappa > 0.8


def test_summaries(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0), ("a", "y", None), ("b", None, 4.0)], "g string, v string, n double")
    assert {tuple(r) for r in summaries.value_counts(df, "v").collect()} == {("x", 2, 0.5), ("y", 1, 0.25), (None, 1, 0.25)}
    assert [(r.g, r.v, r.position) for r in summaries.top_k_values(df, ["g"], "v", 1).collect()] == [("a", "x", 1)]
    assert {(r.column_name, r.n_missing) for r in summaries.missing_cells(df, ["g", "v", "n"]).collect()} == {("g", 0), ("v", 1), ("n", 1)}
    best = summaries.best_by(spark.createDataFrame([("m", 0.1, 2.0), ("m", 0.2, 2.0), ("m", 0.3, None)], "metric string, t double, h double"), ["metric"], "h", "t").first()
    assert (best.t, best.h) == (0.1, 2.0)
    for empty in (summaries.value_counts(df.limit(0), "v"), summaries.demographics(df.limit(0).selectExpr("g", "v as gender", "n as age"), "g")):
        assert empty.count() == 0


def test_previous_values_over_buckets_equal_lag(spark):
    from lexspark.operators.ranking import previous_values, spread_key

    rows = spark.createDataFrame([(None if i % 5 == 0 else i % 3, None if i == 77 else i * 7919 % 1009, f"v{i}" if i % 4 else None) for i in range(300)], "g int, k int, v string")
    got = previous_values(rows, ["g"], spread_key(rows, "k"), ["v", "k"], ["k", "v"], bits=5).toPandas()
    for _, part in got.groupby("g", dropna=False):
        part = part.sort_values("k", na_position="first", kind="stable")
        assert part["prev_v"].tolist()[1:] == part["v"].tolist()[:-1] and part["has_prev"].tolist() == [False] + [True] * (len(part) - 1)
    assert previous_values(rows.limit(0), ["g"], F.col("k"), ["v"]).count() == 0


def test_exact_percentiles(spark):
    v = np.round(np.random.default_rng(4).normal(size=501), 2)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    assert np.allclose(stats.exact_percentiles(df, "v", (0, 0.1, 0.25, 0.5, 0.9, 1)), np.percentile(v, [0, 10, 25, 50, 90, 100]))
    assert stats.exact_percentiles(df.filter("v is null"), "v", (0.5,)) == [] and stats.exact_percentiles(df.limit(1), "v", (0.3,)) == [df.first()[0]]
