import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexspark.llm import quota

PAIRS = "draw_id bigint, pair_id string, cosine_quartile int, diagnosis string, model string"
TARGETS = "target_id bigint, draw_id bigint, cosine_quartile int, diagnosis string, model string, target_share double, min_pairs int, sample_size int"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 20), st.integers(0, 60)), min_size=1, max_size=8), st.integers(0, 120))
def test_quotas_keep_floors_and_availability(rows, size):
    share, floor, have = (np.array(x) for x in zip(*rows))
    q = quota.allocate(share, floor, have, size)
    low = np.minimum(floor, have)
    assert (q >= low).all() and (q <= have).all()
    if share.sum() > 0 and (share > 0).all():
        assert q.sum() == min(max(size, low.sum()), have.sum())


def test_quotas_are_proportional():
    assert quota.allocate(np.array([0.5, 0.3, 0.2]), np.zeros(3), np.full(3, 100), 10).tolist() == [5, 3, 2]
    assert quota.allocate(np.array([0.5, 0.25, 0.25]), np.zeros(3), np.full(3, 100), 3).tolist() in ([1, 1, 1], [2, 1, 0])
    assert quota.allocate(np.array([0.9, 0.1]), np.array([0, 5]), np.array([100, 100]), 20).tolist() == [15, 5]
    assert quota.allocate(np.array([0.5, 0.5]), np.array([0, 0]), np.array([3, 100]), 20).tolist() == [3, 17]


@pytest.fixture(scope="module")
def tables(spark):
    pairs = spark.createDataFrame([(1, f"a{i}", i % 4, ["HC", "h.c. ", "MCI"][i % 3], "m-1") for i in range(60)] + [(1, "a0", 0, "HC", "M 1"), (1, "z", None, "okänd", None), (2, "b1", None, None, "M1"), (2, "b2", 1, None, "m2"), (None, None, None, None, None)], PAIRS)
    targets = spark.createDataFrame([(1, 1, None, "HC", None, 0.5, 0, 20), (2, 1, None, "MCI", None, 0.5, 25, 20), (3, 2, None, None, "m1", 0.5, 0, 3), (4, 2, None, None, "m2", 0.5, 0, 2), (5, 3, 0, None, None, 1.0, 1, 5)], TARGETS)
    return pairs, targets


def test_sample_and_report(tables):
    pairs, targets = tables
    extra = pairs.withColumns({"target_id": F.lit(1), "category": F.lit("x"), "sample_size": F.lit(0)})
    sample, report = quota.quota_sample(extra.union(extra), targets)
    r = {x.target_id: x for x in report.collect()}
    assert (r[1].needed, r[1].available) == (10, 40) and (r[2].needed, r[2].available, r[2].shortfall, r[2].quota) == (25, 20, 5, 20)
    assert (r[3].needed, r[3].available, r[3].shortfall) == (2, 1, 1)  # 1.5 rounds up
    assert (r[4].shortfall, r[5].available, r[5].shortfall) == (0, 0, 5)
    got = {x.target_id: x["count"] for x in sample.groupBy("target_id").count().collect()}
    assert all(v.drawn == v.quota and v.shortfall == max(v.needed - v.available, 0) for v in r.values())
    assert r[2].floor_excess == 0 and got == {k: v.quota for k, v in r.items() if v.quota} and sample.select("pair_id").distinct().count() == sample.count()
    assert sorted(sample.collect()) == sorted(quota.quota_sample(pairs.repartition(9), targets)[0].collect())


def test_empty_tables(tables):
    pairs, targets = tables
    sample, report = quota.quota_sample(pairs.limit(0), targets)
    assert sample.count() == 0 and report.count() == 5 and report.filter("shortfall = needed").count() == 5
    assert quota.quota_sample(pairs, targets.limit(0))[0].count() == 0


def test_floors_beyond_the_size_are_reported(tables):
    pairs, targets = tables
    over = targets.filter("draw_id = 1").withColumns({"min_pairs": F.lit(15), "sample_size": F.lit(20)})
    sample, report = quota.quota_sample(pairs, over)
    assert {(x.quota, x.drawn, x.floor_excess, x.shortfall) for x in report.collect()} == {(15, 15, 10, 0)} and sample.count() == 30
