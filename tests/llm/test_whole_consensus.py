import numpy as np
import pytest

from lexspark.llm import consensus as C
from lexspark.llm import queries


def ratings(spark):
    rng = np.random.default_rng(5)
    truth = rng.integers(0, 4, 60)
    noise = (0.3, 0.6, 0.9, 1.2, 2.0)
    rows = [(i * 5 + r, f"p{i}", f"r{r}", int(np.clip(round(truth[i] + rng.normal(0, noise[r])), 0, 3))) for i in range(60) for r in range(5)]
    return spark.createDataFrame(rows, "rating_id long, pair_id string, rater_id string, rating int")


def test_passes_go_on_until_nothing_moves(spark, monkeypatch):
    passes, fit = [], C._fit

    def watched(stats, tasks, models, rounds, live):
        old = models[0].shares()
        fit(stats, tasks, models, rounds, live)
        passes.append(float(np.abs(models[0].shares() - old).max()))

    monkeypatch.setattr(C, "_fit", watched)
    items, _ = C.community_consensus(ratings(spark), tolerance=5e-3)
    assert items.count() == 60 and passes[-1] < 5e-3 and len(passes) > 2
    with pytest.raises(RuntimeError):
        C.community_consensus(ratings(spark), tolerance=1e-12, most_rounds=1)


def test_watched_raters_stand_still_for_two_passes(spark):
    one = {r.rater for r in C.unrelated_raters(C.community_consensus(ratings(spark), watch=0.45)[1]).collect()}
    two = {r.rater for r in C.unrelated_raters(C.community_consensus(ratings(spark), tolerance=1e-6)[1]).collect()}
    assert one == two


def test_the_consensus_queries_ask_for_convergence(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(queries, "table", lambda s, d, n: None)
    monkeypatch.setattr(queries, "cut", lambda df, name: None)
    monkeypatch.setattr(C, "clean_judgements", lambda r, t: None)

    def fake(judgements, tasks, tolerance=1e-4, watch=None):
        asked.append((tolerance, watch))
        return [(spark.range(1), spark.range(1))] * len(tasks)

    monkeypatch.setattr(C, "community_models", fake)
    queries.p3_consensus(spark, "")
    queries.p3_raters(spark, "")
    assert asked == [(1e-4, None)] * 2
