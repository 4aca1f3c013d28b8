from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexspark.llm import packing as P


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 60), st.data())
def test_every_item_once_and_no_container_overfull(capacity, data):
    h = data.draw(st.dictionaries(st.integers(1, capacity), st.integers(1, 50), max_size=12))
    plan = P.plan(h, capacity)
    used = Counter()
    for lengths, k in plan:
        assert k > 0 and sum(lengths) <= capacity
        for x in lengths:
            used[x] += k
    assert used == Counter(h)
    n, total = sum(k for _, k in plan), sum(x * c for x, c in h.items())
    assert n >= -(-total // capacity)
    open_ = sorted(sum(p) for p, k in plan for _ in range(min(k, 2)))[:2]
    assert len(open_) < 2 or sum(open_) > capacity  # no two containers could be one


def test_exact_complements_are_used():
    assert sum(k for _, k in P.plan({7: 10, 3: 10}, 10)) == 10
    assert sum(k for _, k in P.plan({5: 4, 2: 4, 3: 4}, 10)) == 4
    assert sum(k for _, k in P.plan({4: 3, 1: 3, 2: 3, 3: 3}, 10)) == 3
    with pytest.raises(ValueError):
        P.plan({11: 1}, 10)
    assert P.plan({}, 10) == []


def test_waste_is_small():
    rng = np.random.default_rng(0)
    sizes = np.clip(rng.lognormal(5.2, 0.8, 20_000).astype(int), 1, 2048)
    n = sum(k for _, k in P.plan({int(a): int(b) for a, b in zip(*np.unique(sizes, return_counts=True))}, 2048))
    assert n <= 1.001 * sizes.sum() / 2048 + 1


def test_documents(spark):
    texts = [None, "", "hej", "hej hopp " * 30, "a b c " * 2000, "ord " * 17] + [f"text {i} " * (i % 40 + 1) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumns({"_len": F.lit(1), "container_id": F.lit(2)})
    packed = P.pack_documents(df, "doc_id", "text", 256).cache()
    out = P.containers(packed, "doc_id", 256).collect()
    assert all(r.used + r.unused == 256 and 0 < r.used <= 256 and len(r.contents) == r.n_items for r in out)
    assert sorted(r.container_id for r in out) == list(range(len(out)))
    spans = {}
    for r in packed.collect():
        spans.setdefault(r.doc_id, []).append((r.part_no, r.token_from, r.token_to))
    assert set(spans) == set(range(len(texts))) - {0, 1}
    for parts in spans.values():
        parts.sort()
        assert parts[0][1] == 0 and all(a[2] == b[1] for a, b in zip(parts, parts[1:])) and all(b - a == 256 for _, a, b in parts[:-1])
    total = sum(r.used for r in out)
    assert len(out) <= 1.05 * total / 256 + 2
    assert P.containers(P.pack_documents(df.limit(0), "doc_id", "text", 256), "doc_id", 256).count() == 0
