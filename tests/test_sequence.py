import pytest
from pyspark.sql import functions as F

from lexspark.operators import sequence as S
from lexspark.operators import vectors


def sims(spark, *values):
    return spark.createDataFrame([("p", i, v) for i, v in enumerate([None, *values])], "participant_id string, pos int, sim double")


def sizes(clustered):
    return [r[1] for r in sorted(clustered.groupBy("cluster_id").count().collect())]


def test_chain_clusters_and_metrics(spark):
    c = S.detect_clusters(sims(spark, 0.64, 0.52, 0.38, 0.60, 0.34), ["participant_id"], 0.5)
    assert sizes(c) == [3, 2, 1]
    assert tuple(S.cluster_metrics(c, ["participant_id"]).first()) == ("p", 3, 2, 2.0, 3)
    assert sizes(S.detect_clusters(sims(spark, 0.50, 0.49), ["participant_id"], 0.5)) == [2, 1]
    with pytest.raises(ValueError):
        S.detect_clusters(sims(spark, 0.5), ["participant_id"], 0.5, "other")
    none = S.with_empty(S.cluster_metrics(c, ["participant_id"]), spark.createDataFrame([("p",), ("q",)], "participant_id string"), ["participant_id"])
    assert {r[0]: tuple(r)[1:] for r in none.collect()}["q"] == (0, 0, None, 0)


def test_profile(spark):
    r = S.similarity_profile(sims(spark, 0.2, 0.4, 0.9), ["participant_id"]).first()
    assert (r.n_words, round(r.mean_consecutive_similarity, 6)) == (4, 0.5)
    assert r.temporal_gradient == pytest.approx(0.2 - 0.65) and r.similarity_slope == pytest.approx(0.35)
    r = S.similarity_profile(sims(spark, 0.2), ["participant_id"]).first()
    assert r.temporal_gradient is None and r.similarity_slope is None
    r = S.similarity_profile(sims(spark), ["participant_id"]).first()
    assert (r.n_words, r.mean_consecutive_similarity) == (1, None)


def words(spark, *ws, letter="f", flagged=()):
    return spark.createDataFrame([("p", letter, i, w, w in flagged) for i, w in enumerate(ws)], "participant_id string, letter string, pos int, word string, is_flagged boolean")


def test_counts(spark):
    assert tuple(S.count_metrics(words(spark, "hund", "katt", "kisse", "hund", "fisk", "katt"), ["participant_id"]).first()) == ("p", 6, 4, 2)
    c = S.letter_counts(words(spark, "fisk", "fredrik", flagged=("fredrik",)), ["participant_id", "letter"])
    assert tuple(c.first())[2:] == (2, 1, 0, 1)
    twice = S.letter_counts(words(spark, "fredrik", "fredrik", "fil", flagged=("fredrik",)), ["participant_id", "letter"]).first()
    assert (twice.flagged, twice.repetitions, twice.valid) == (2, 1, 0)
    t = S.fas_totals(c, ["participant_id"]).first()
    assert (t.total_fas_score, t.valid_a, t.proper_nouns_count) == (1, 0, 1) and t.letter_asymmetry == pytest.approx((2 / 9) ** 0.5)


@pytest.mark.parametrize(("said", "want"), [(("frukt", "frid", "färg"), [2, 1]), (("sand", "stand"), [2]), (("fil", "fal"), [2]), (("fil", "frukt", "färg"), [1, 1, 1])])
def test_phonemic_clusters(spark, said, want):
    assert sizes(S.phonemic_clusters(words(spark, *said), ["participant_id", "letter"])) == want


def test_pooled_and_filtered(spark):
    all_ = words(spark, "frukt", "frid", "färg").union(words(spark, "ank", "ana", "and", letter="a")).union(words(spark, "sand", "stand", letter="s"))
    r = S.pooled_clusters(S.phonemic_clusters(all_, ["participant_id", "letter"]), ["participant_id"]).first()
    assert (r.cluster_count_total, r.switch_count_total, r.mean_cluster_size) == (4, 1, 2.0)
    kept = S.first_of_each(words(spark, "fil", "Fil", "frukt", "anna", "", "färg", flagged=("anna",)), ["participant_id"]).orderBy("pos")
    assert [r.word for r in kept.collect()] == ["fil", "frukt", "färg"]
    assert S.adjacent_edit_distance(words(spark, "fil"), ["participant_id"]).first().mean_edit_distance is None


def test_vectors(spark):
    rows = spark.createDataFrame([("g", 0, [1.0, 0.0]), ("g", 1, [-1.0, 0.0]), ("g", 2, [1.0, 1.0]), ("g", 3, [0.0, 0.0]), ("h", 4, [1.0, 0.0]), ("g", 5, None)], "g string, i int, v array<double>")
    a = {r.i: r.sim for r in vectors.adjacent(rows, "g", "i", "v").collect()}
    assert a[0] is None and a[1] == 0.0 and a[2] == 0.0 and a[3] is None and a[5] is None
    for block in (1, 2, 512):
        p = {r.g: r for r in vectors.pairwise_mean(rows, "g", "i", "v", block=block).collect()}
        assert p["g"].n_pairs == 3 and p["g"]["mean"] == pytest.approx(0.5**0.5 / 3) and p["h"]["mean"] is None
    assert vectors.pairwise_mean(rows.filter("g = 'z'"), "g", "i", "v").count() == 0


def test_sweep_matches_single_thresholds(spark):
    s = sims(spark, 0.1, 0.2, 0.3, 0.2)
    sweep = {r.threshold: r.cluster_count for r in S.threshold_sweep(s, ["participant_id"], [0.0, 0.2, 0.25, 0.5]).collect()}
    assert sweep == {0.0: 1, 0.2: 2, 0.25: 4, 0.5: 5}
    assert s.filter(F.col("pos") < 0).transform(lambda d: S.threshold_sweep(d, ["participant_id"], [0.1])).count() == 0


def test_long_sequences_give_the_same(spark):
    rows = spark.createDataFrame([(f"g{i % 3 if i % 2 else 0}", i * 37 % 1009, [float(i % 5), 1.0, float(i % 3)]) for i in range(400)], "g string, i int, v array<double>")
    short, long = vectors.adjacent(rows, "g", "i", "v").cache(), vectors.adjacent(rows, "g", "i", "v", long=True).cache()
    key = lambda d: sorted((r.g, r.pos, r.i, r.sim) for r in d.collect() if r.sim is not None)
    assert key(short) == key(long) and long.filter("sim IS NULL").count() == short.filter("sim IS NULL").count() == 3
    a, b = (S.detect_clusters(d.select("g", "pos", "sim"), ["g"], 0.9, long=x) for d, x in ((short, False), (long, True)))
    assert sorted(map(tuple, a.select("g", "pos", "cluster_id").collect())) == sorted(map(tuple, b.select("g", "pos", "cluster_id").collect()))
