import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm import consensus as C

SCHEMA = "rating_id bigint, pair_id string, rater_id string, rating int, category string, is_compound string"


@pytest.fixture(scope="module")
def judged(spark):
    """Sixty raters of known kinds over 300 pairs and one pair that everybody judges many times."""
    rng = np.random.default_rng(3)
    truth = rng.integers(0, 4, 300)
    kinds = {f"r{i:02d}": k for i, k in enumerate(["good"] * 40 + ["severe"] * 6 + ["mild"] * 6 + ["random"] * 5 + ["opposed"] * 3)}
    rows = []
    for rater, kind in kinds.items():
        for p in rng.choice(300, 60, replace=False).tolist() + [0] * 10:
            t = truth[p]
            noisy = int(np.clip(t + rng.choice([-1, 0, 0, 0, 0, 1]), 0, 3))
            v = {"good": noisy, "severe": max(noisy - 1, 0), "mild": min(noisy + 1, 3), "random": int(rng.integers(0, 4)), "opposed": 3 - noisy}[kind]
            cat = C.CATEGORIES[t] if kind == "good" or rng.random() < 0.8 else C.CATEGORIES[int(rng.integers(0, 7))]
            rows.append((len(rows), f"p{p}", rater, v, cat.upper() + " ", "Y" if t >= 2 else " no"))
    df = spark.createDataFrame(rows, SCHEMA)
    return df.union(df.limit(50)).cache(), truth, kinds


def test_unrelated_and_opposed_raters_are_found(judged):
    df, truth, kinds = judged
    items, raters = C.community_consensus(df, C.RATING)
    found = {r.rater for r in C.unrelated_raters(raters).collect()}
    assert found == {r for r, k in kinds.items() if k in ("random", "opposed")}
    assert {r.community for r in raters.collect() if kinds[r.rater] == "opposed"} == {"opposed"}
    got = {r.item: r for r in items.collect()}
    assert np.mean([got[f"p{i}"].consensus == str(t) for i, t in enumerate(truth) if f"p{i}" in got]) > 0.9
    assert got["p0"].n_labels >= 600 and all(0 <= r.confidence <= 1 for r in got.values())


def test_nominal_tasks(judged):
    df, truth, _ = judged
    items, raters = C.community_consensus(df, C.CATEGORY)
    got = {r.item: r.consensus for r in items.collect()}
    assert np.mean([got[f"p{i}"] == C.CATEGORIES[t] for i, t in enumerate(truth) if f"p{i}" in got]) > 0.97
    flags, raters = C.community_consensus(df, C.COMPOUND)
    assert all(r.reliability > 0.9 for r in raters.collect())
    a = C.overall_agreement(C.clean_judgements(df, [C.COMPOUND]), [C.COMPOUND]).first()
    assert a.observed == 1.0 and a.coefficient == pytest.approx(1.0)


def test_few_labels_are_read_with_the_community(judged, spark):
    df, truth, _ = judged
    few = spark.createDataFrame([(10**6 + i, f"p{i}", "new", int(truth[i]), None, None) for i in range(2)], SCHEMA)
    _, raters = C.community_consensus(df.union(few), C.RATING)
    r = raters.filter("rater = 'new'").first()
    assert r.n_labels == 2 and r.reliability > 0.3


def test_nulls_impossible_labels_and_empty_tables(spark, judged):
    df, _, _ = judged
    bad = spark.createDataFrame([(1, "p1", "x", 9, "nope", "?"), (2, "p1", "x", None, None, None), (3, None, "x", 1, "other", "1"), (4, "p1", None, 1, "other", "1"), (None, "p9", "y", 2, "other", "1")], SCHEMA).withColumns({"item": F.lit(1), "rater": F.lit(2), "l": F.lit(3)})
    assert [tuple(r) for r in C.clean_labels(bad, C.RATING).collect()] == [("p9", "y", 2)]
    items, raters = C.community_consensus(bad, C.RATING)
    one = items.first()
    assert (one.item, one.n_labels, one.agreement) == ("p9", 1, None) and raters.count() == 1
    items, raters = C.community_consensus(df.limit(0), C.RATING)
    assert items.count() == 0 and raters.count() == 0


def test_tasks_together_give_what_they_give_alone(judged):
    df, _, _ = judged
    tasks = (C.RATING, C.CATEGORY, C.COMPOUND)
    together = C.community_models(C.clean_judgements(df, tasks).cache(), tasks)
    for task, (items, raters) in zip(tasks, together):
        alone = C.community_consensus(df, task)
        assert {r.rater: round(r.reliability, 4) for r in raters.collect()} == {r.rater: round(r.reliability, 4) for r in alone[1].collect()}
        assert {r.item: (r.consensus, r.n_labels) for r in items.collect()} == {r.item: (r.consensus, r.n_labels) for r in alone[0].collect()}


def test_hot_items_and_raters_are_salted(judged):
    df, _, _ = judged
    one, two = ({r.rater: round(r.reliability, 6) for r in C.community_consensus(df, C.RATING, part_labels=k)[1].collect()} for k in (10**9, 25))
    assert one == two


def test_the_last_delivery_holds(spark):
    rows = [(1, "p", "a", 0, "other", None, 5), (1, "p", "a", 3, "Other ", "yes", 9), (1, "p", "a", 2, None, "no", 7), (None, "p", "b", 1, None, None, 1), (None, "p", "b", 1, None, None, 2), (None, "p", "b", 2, None, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA + ", s long").withColumn("loaded_at", F.timestamp_seconds("s"))
    got = sorted(map(tuple, C.clean_judgements(df, (C.RATING, C.CATEGORY, C.COMPOUND)).collect()))
    assert got == [("p", "a", 3, 6, 1), ("p", "b", 1, None, None), ("p", "b", 2, None, None)]
