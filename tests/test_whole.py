"""Registered queries do the whole job: no bound on words, paths, lists or rows decides what they give."""

import hashlib
import os
from collections import Counter, defaultdict, deque

import numpy as np
import pandas as pd
import pytest

from lexspark.__main__ import main
from lexspark.operators import regression, stats
from lexspark.plans import base, reference

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def neighbours(n):
    """The sense graph over n parts, as sets of neighbours."""
    out = defaultdict(set)
    for k in range(n):
        for to in [("PRIM..1" if k <= 1 else f"s{(k + 4) // 6}"), *([f"s{k // 3}"] if k > 5 and k % 5 == 0 else [])]:
            out[f"s{k}"].add(to)
            out[to].add(f"s{k}")
    return out


def distances(graph, source):
    far, queue = {source: 0}, deque([source])
    while queue:
        for x in graph[(at := queue.popleft())]:
            if x not in far:
                far[x] = far[at] + 1
                queue.append(x)
    return far


@pytest.fixture(scope="module")
def parts(tmp_path_factory):
    """A folder with 700 parts, keys from 0."""
    d = tmp_path_factory.mktemp("parts")
    pd.DataFrame({"p_partkey": range(700), "p_name": [f"a w{k}" for k in range(700)]}).to_parquet(d / "part.parquet")
    return str(d)


def test_paths_of_any_length(spark, parts):
    graph = neighbours(700)
    want = {(f"s{k}", f"s{k // 3 + 1}"): distances(graph, f"s{k}").get(f"s{k // 3 + 1}") for k in range(2, 700)}
    got = {(r.s1, r.s2): r.path_length for r in reference.graph_path(spark, parts).collect()}
    assert got == want and max(want.values()) > 4


@tables
def test_all_words_meet_the_whole_graph(spark):
    n = len(pd.read_parquet(f"{FOLDER}/part.parquet"))
    graph = neighbours(n)
    sense = lambda w: None if w is None else f"s{int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % n}"
    j = base.rated(spark, FOLDER).join(base.pool(spark, FOLDER), "pair_id").select("rating", "target", "response").collect()
    rows = pd.DataFrame([(float(r.rating), distances(graph, sense(r.target)).get(sense(r.response))) for r in j], columns=["rating", "path"])
    ok = rows.dropna()
    want = ok["rating"].rank().corr((1.0 / (1 + ok["path"])).rank())
    got = {r.measure: r for r in reference.graph_agreement(spark, FOLDER).collect()}["path_similarity"]
    assert (got.n, got.n_oov) == (len(ok), len(rows) - len(ok)) and got.spearman_rho == pytest.approx(want, abs=1e-6)
    assert rows["path"].max() > 4 and any(len(r.response or "") > 12 for r in j)


@tables
def test_every_word_of_a_list_is_in_a_cell(spark):
    lists = {r.participant_id: r.responses for r in base.participants(spark, FOLDER).collect()}
    want = {p: [x.strip(" ") for x in ",".join(x or "" for x in r).split(",")] for p, r in lists.items() if r}
    cells = reference.fas_triplets(spark, FOLDER).collect()
    counts = Counter()
    for r in cells:
        counts[r.participant_id] += r.n_compact
    assert dict(counts) == {p: sum(x != "" for x in r) for p, r in want.items()}
    for r in cells:
        assert (r.word_f, r.word_a, r.word_s) == tuple(reference_word(x) for x in (want[r.participant_id] + ["", ""])[3 * r.cell_no : 3 * r.cell_no + 3])


def reference_word(x):
    return (x[1:-1].strip(" ") if x[:1] == "<" and x[-1:] == ">" else x).lower()


@tables
def test_thresholds_in_steps_of_a_fortieth(spark, monkeypatch):
    tried = []
    sweep = reference.sequence.threshold_sweep
    monkeypatch.setattr(reference.sequence, "threshold_sweep", lambda s, k, grid: tried.extend(grid) or sweep(s, k, grid))
    assert reference.threshold_kruskal(spark, FOLDER).count() == 3
    assert tried == [i / 1000 for i in range(0, 301, 25)]


def test_one_interval_wherever_it_is_computed(spark):
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"id": np.arange(120), "g": ["a"] * 80 + ["b"] * 40, "x": rng.integers(0, 4, 120).astype(float), "y": rng.integers(0, 12, 120) / 4})
    df = spark.createDataFrame(p)
    one, two = ({r.g: r for r in stats.bootstrap_spearman(df, "x", "y", ["g"], "id", 60, exact_rows=k).collect()} for k in (100, 50))
    assert set(one) == {"a", "b"}
    for g in one:
        assert tuple(one[g])[1:] == pytest.approx(tuple(two[g])[1:], abs=1e-9)
    assert one["a"].spearman_rho == pytest.approx(p[p.g == "a"].x.rank().corr(p[p.g == "a"].y.rank()))


def test_large_groups_write_no_row_per_resample(spark, monkeypatch):
    """Resamples in ranges of y, with x and y exchanged and as rows a few at a time: the interval of one task, and a row
    per cell and resample in the last case only, released when it is used."""
    rng = np.random.default_rng(5)
    p = pd.DataFrame({"g": np.where(np.arange(9000) % 3, "a", None), "x": rng.integers(0, 7, 9000) / 3, "y": rng.permutation(9000) // 2 / 7})
    df = spark.createDataFrame(p.assign(y=p["y"] + p["x"].round()))
    cut, written, released = stats.cut, [], []
    monkeypatch.setattr(stats, "cut", lambda d, name="cut": written.append((name, cut(d, name))) or written[-1][1])
    monkeypatch.setattr(stats, "release", lambda *t: released.extend(t))
    get = lambda *columns, **k: {r.g: tuple(r)[1:] for r in stats.bootstrap_spearman(df, *columns, ["g"], "y", 30, **k).collect()}
    want = get("x", "y")
    assert set(want) == {"a", None} and want["a"][0] == 6000
    for columns in (("x", "y"), ("y", "x")):
        got = get(*columns, exact_rows=2000, per_range=500)
        for g in want:
            assert got[g][:2] == pytest.approx(want[g][:2], abs=1e-9) and got[g][2:] == pytest.approx(want[g][2:], abs=1e-9 if columns[0] == "x" else 0.03)
    assert max(t.count() for _, t in written) <= len(p)
    written.clear()
    got = get("x", "y", exact_rows=2000, few=1)
    assert all(got[g] == pytest.approx(want[g], abs=1e-9) for g in want)
    drawn = [t for name, t in written if name == "drawn"]
    assert len(drawn) == 3 and {id(t) for t in drawn} <= {id(t) for t in released} and max(t.count() for t in drawn) < 26 * len(p)


def test_a_resample_is_ranked_by_its_own_counts():
    x, y, w = np.array([0, 0, 1, 2, 2]), np.array([1, 0, 1, 2, 0]), np.array([[2.0], [0.0], [1.0], [3.0], [1.0]])
    rows = np.repeat(np.arange(5), w[:, 0].astype(int))
    assert stats.weighted_rank_correlation(x, y, w)[0] == pytest.approx(stats.rank_correlation(x[rows], y[rows]))


@tables
def test_intervals_come_from_a_thousand_resamples(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(reference.stats, "bootstrap_spearman", lambda *a, n_boot=1000, **k: seen.append(a[5] if len(a) > 5 else n_boot))
    monkeypatch.setattr(reference.regression, "evaluation", lambda p, n_boot=1000: [seen.append(n_boot)])
    monkeypatch.setattr(reference, "ridge_cv", lambda s, d: None)
    reference.spearman_ci(spark, FOLDER)
    reference.regression_mae(spark, FOLDER)
    assert seen == [1000, 1000]


def test_every_labelled_row_is_predicted(spark, monkeypatch):
    monkeypatch.setattr(regression, "SVR_C", (1.0,))
    monkeypatch.setattr(regression, "SVR_GAMMA", (0.1,))
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 2))
    df = spark.createDataFrame(pd.DataFrame({"participant_id": [f"u{i}" for i in range(150)], "diagnosis": "HC", "a": x[:, 0], "b": x[:, 1], "mmse": 25 + x[:, 0] - x[:, 1]}))
    got = regression.svr_cv(df, ["a", "b"], fit_rows=40).toPandas()
    assert sorted(got.participant_id) == sorted(f"u{i}" for i in range(150)) and got.groupby("fold").size().tolist() == [30] * 5
    assert (got.truth - got.prediction).abs().mean() < 1.0


@tables
def test_drift_command_writes_the_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    assert main(["drift", "--input", f"{FOLDER}/sheet_records.parquet", "--output-dir", str(tmp_path)]) == 0
    assert spark.read.parquet(f"{tmp_path}/changes").count() > 0
