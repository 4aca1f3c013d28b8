from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexspark.llm import mixing as M

TARGETS = "mix_id int, source string, target_share double, max_repeats int, size_ratio double"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000])
def test_permutations(n):
    for key in (0, 1, 2**63):
        assert sorted(M.permute(np.arange(n), np.full(n, n), np.full(n, key, dtype=np.uint64))) == list(range(n))
    if n == 1000:
        a, b = (M.permute(np.arange(n), np.full(n, n), np.full(n, k, dtype=np.uint64)) for k in (1, 2))
        assert (a != b).mean() > 0.9 and abs(np.corrcoef(a, np.arange(n))[0, 1]) < 0.2


@pytest.mark.parametrize("n", [1, 2, 5, 17, 1000])
def test_inverse_permutations(n):
    i, m, k = np.arange(n), np.full(n, n), np.full(n, 2**60 + 5, dtype=np.uint64)
    assert (M.permute(M.permute(i, m, k), m, k, inverse=True) == i).all()


@pytest.mark.parametrize("have", [1, 63, 64, 65, 640, 1000])
def test_slots_hold_the_needed_tokens_to_the_token(have):
    needs = [0.0, 0.4, 1.0, 63.0, 64.0, 65.5, 200.0, 639.0, 999.0, 1000.0, 1500.0, 5000.0]
    t = pd.DataFrame({"source_tokens": have, "needed_tokens": needs, "max_repeats": 3, "key_hash": np.arange(len(needs)) * 7919 - 3})
    for r in M.plan_slots(t, 64).itertuples():
        n, got = -(-have // 64), 0
        for k in range(r.slots):
            at = int(M.permute(np.array([k % n]), np.array([n]), M.pass_key(np.array([r.key_hash]), np.array([k // n])))[0])
            got += min(64 if at < n - 1 else have - 64 * (n - 1), r.last_limit if k == r.slots - 1 else 64)
        assert got == min(int(np.ceil(r.needed_tokens)), 3 * have)


def test_draws_deal_all_slots():
    slots = np.array([500, 300, 200, 0, 1])
    drawn = np.stack(list(M.draw_slots(slots, np.random.default_rng(7), 32)))
    assert (drawn.sum(0) == slots).all() and set(drawn.sum(1)) <= {31, 32} and (drawn >= 0).all() and drawn[:, 0].std() > 1


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"ord nummer {i} " * (i % 9 + 3), ["A-b", "a_b", "c", None, "d"][i % 5]) for i in range(400)] + [(1000, None, "c"), (1001, "", "c"), (1002, "x y z " * 3000, "d")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({"id": F.lit(1), "block": F.lit(2), "source_key": F.lit("q")})


def test_mix(spark, docs):
    targets = spark.createDataFrame([(1, "ab", 0.6, 2, 0.5), (1, "c", 0.3, 1, 0.5), (1, "nowhere", 0.1, 9, 0.5), (2, "A b", 0.9, 1, 1.0), (2, "d", 0.1, 1, 1.0), (3, "c", None, None, None)], TARGETS)
    contents, report = M.mix_sources(docs, targets, block=64)
    counts, spans = M.source_spans(docs, "doc_id", "text", "source", 64)
    size = {r.id: r.n_tokens for r in counts.collect()}
    per_block = Counter()
    for r in spans.collect():
        per_block[(r.source_key, r.block)] += r.token_to - r.token_from
    last = {s: max(b for k, b in per_block if k == s) for s, _ in per_block}
    assert all(n == 64 or b == last[s] for (s, b), n in per_block.items()) and sum(per_block.values()) == sum(size.values()) - sum(size[i] for i in range(3, 400, 5))
    rows = contents.collect()
    use = Counter((r.mix_id, r.source, r.block) for r in {(r.mix_id, r.source, r.block, r.repeat_no, r.slot): r for r in rows}.values())
    limit = {(1, "ab"): 2, (1, "c"): 1, (2, "A b"): 1, (2, "d"): 1}
    assert all(n <= limit[(m, s)] for (m, s, _), n in use.items())
    rep = {(r.mix_id, r.source): r for r in report.collect()}
    got = Counter()
    for r in rows:
        got[(r.mix_id, r.source)] += r.token_to - r.token_from
    assert all(rep[k].reached_tokens == got[k] for k in rep) and len(rep) == 6
    whole = sum(size.values())
    for k, r in rep.items():
        assert r.reached_tokens == min(int(np.ceil(r.needed_tokens)), r.allowed_tokens), k
        assert r.filled == r.slots and r.repeats <= r.max_repeats
        if r.reached_tokens:
            assert r.actual_share == pytest.approx(r.reached_tokens / sum(x.reached_tokens for x in rep.values() if x.mix_id == r.mix_id))
    assert all(r.token_from < r.token_to for r in rows) and rep[(3, "c")].slots == 0 and rep[(1, "nowhere")].filled == 0 and rep[(1, "c")].mix_tokens == pytest.approx(whole / 2)
    short = {tuple(r) for r in M.unreachable(report).select("mix_id", "source").collect()}
    assert short == {k for k, r in rep.items() if r.allowed_tokens < r.needed_tokens} and (1, "nowhere") in short and (2, "A b") in short
    again = {tuple(r) for r in M.mix_sources(docs.repartition(5), targets, block=64)[0].collect()}
    assert again == {tuple(r) for r in rows}


def test_empty(spark, docs):
    targets = spark.createDataFrame([(1, "c", 1.0, 2, 0.5)], TARGETS)
    contents, report = M.mix_sources(docs.limit(0), targets)
    assert contents.count() == 0 and report.first().slots == 0
    assert M.mix_sources(docs, targets.limit(0))[1].count() == 0
    with pytest.raises(ValueError):
        M.mix_sources(docs, targets.union(targets), max_targets=1)
