"""Every command on small files."""

import json
import os

import numpy as np
import pandas as pd
import pytest
from test_sheets import META, write_xlsx

from lexspark.__main__ import main
from lexspark.operators import embedding, matching, regression
from lexspark.plans import pipelines


@pytest.fixture
def run(spark, monkeypatch):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    return lambda *a: main([str(x) for x in a])


@pytest.fixture
def sheet(tmp_path):
    write_xlsx(tmp_path / "s.xlsx", [["Gold", "User-1", "User-2.1"], ["kamel", "kamel", "häst"], ["sol", "måne", None], *META])
    return tmp_path / "s.xlsx"


def read(spark, path):
    return spark.read.option("header", True).csv(str(path))


def test_sheets_and_models(spark, run, sheet, tmp_path, capsys):
    for c in ("bnt", "svf", "fas"):
        assert run(c, "--data", sheet, "--output", tmp_path / c, *(["--mock"] if c != "fas" else [])) == 0
    assert read(spark, tmp_path / "bnt").count() == 4 and read(spark, tmp_path / "svf").count() == 2 and len(read(spark, tmp_path / "fas").columns) == 28
    (tmp_path / "m.json").write_text(json.dumps([{"label": "a", "prompt_template": "ord: {text} !"}, {"label": "b", "kind": "sentence", "name": "nowhere"}, {"label": "c"}]))
    models = ("models", "--config", tmp_path / "m.json", "--data", sheet, "--output-dir", tmp_path / "out", "--skip", "c")
    assert run(*models, "--dry-run") == 0 and not os.path.exists(tmp_path / "out")
    assert run(*models) == 0 and run(*models, "--skip-existing") == 0
    said = capsys.readouterr().out
    assert "a: done" in said and "a: skipped" in said and "b: " in said and "c: " not in said  # one that fails stops no other
    (tmp_path / "w.csv").write_text("word,label\nhund,djur\nkatt,djur\nbil,sak\n", encoding="utf-8")
    assert run("probe", "--config", tmp_path / "m.json", "--words", tmp_path / "w.csv", "--models", "a,c") == 0
    assert capsys.readouterr().out.count("\n| ") >= 3


def test_calibrate(run, sheet, tmp_path, capsys):
    assert run("calibrate", "--data", sheet, "--output", tmp_path / "cal", "--min-threshold", 0, "--max-threshold", 0.1, "--step", 0.1) == 0
    assert "metric" in capsys.readouterr().out


def test_regression(spark, run, tmp_path):
    rng = np.random.default_rng(1)
    t = pd.DataFrame({"participant_id": [f"u{i}" for i in range(60)], "diagnosis": ["HC", "AD"] * 30, "mmse": 20 + 5 * rng.random(60), **{c: rng.random(60) for c in ("mean_cluster_size", "switch_count_total", "mean_word_frequency")}})
    t["total_fas_score"] = t.mmse * 2 + rng.random(60)
    t.to_csv(tmp_path / "t.csv", index=False)
    ask = ("regression", "--kind", "fas", "--output-dir", tmp_path / "r")
    assert run(*ask, "--input", tmp_path / "t.csv", "--dry-run") == 0 and not os.path.exists(tmp_path / "r")
    assert run(*ask, "--input", tmp_path / "t.csv") == 0
    assert read(spark, tmp_path / "r/ridge_predictions").count() == 60 and read(spark, tmp_path / "r/svr_predictions").count() == 60
    t.assign(total_fas_score=1.0, mean_cluster_size=1.0, switch_count_total=1.0, mean_word_frequency=1.0).to_csv(tmp_path / "none.csv", index=False)
    assert run(*ask, "--input", tmp_path / "none.csv") == 2
    t.head(4).to_csv(tmp_path / "few.csv", index=False)
    assert run(*ask, "--input", tmp_path / "few.csv") == 3


def test_lexicon(run, tmp_path, capsys):
    sense = lambda i, to: f'<LexicalEntry><Lemma><FormRepresentation><feat att="writtenForm" val="w{i}"/><feat att="partOfSpeech" val="nn"/></FormRepresentation></Lemma><Sense id="w{i}..1"><SenseRelation targets="{to}"><feat att="label" val="primary"/></SenseRelation></Sense></LexicalEntry>'
    (tmp_path / "l.xml").write_text(f"<L>{sense(1, 'PRIM..1')}{sense(2, 'w1..1')}</L>", encoding="utf-8")
    for extra, code in ((("--senses", 3), 0), ((), 0), (("--senses", 9, "--rebuild"), 1)):
        assert run("lexicon", "--input", tmp_path / "l.xml", "--output", tmp_path / "g", *extra) == code
    assert "expected 9" in capsys.readouterr().out


def test_rating_study(spark, run, tmp_path, capsys):
    rows = [(f"u{i}", "F", 70.0, "HC", 28.0, f"w{i % 7}", f"r{i}", f"r{i}", False, False, i / 100, 0) for i in range(100)]
    cols = "participant_id gender age diagnosis mmse gold raw_response normalized is_exact_match is_non_response cosine_sim binary_score".split()
    os.mkdir(tmp_path / "models")
    pd.DataFrame(rows, columns=cols).to_csv(tmp_path / "models/m.csv", index=False)
    assert run("eligibility", "--input", tmp_path / "models/m.csv", "--output-dir", tmp_path / "e") == 0 and "Quartile edges" in (tmp_path / "e/eligibility.md").read_text()
    assert run("sample", "--input", tmp_path / "models/m.csv", "--output-dir", tmp_path / "s", "--target-size", 40, "--model", "m") == 0
    master = read(spark, tmp_path / "s/master").toPandas()
    master.to_csv(tmp_path / "master.csv", index=False)
    for name, k in (("ratings_a", 4), ("ratings_b", 3), ("ratings_b_round2", 2)):
        pd.DataFrame({"pair_id": master.pair_id, "target": master.target, "response": master.response, "rating": np.arange(40) % k, "category": "other", "is_compound": True, "notes": ""}).to_csv(tmp_path / f"{name}.csv", index=False)
    sense = lambda i, to: f'<LexicalEntry><Lemma><FormRepresentation><feat att="writtenForm" val="{i}"/></FormRepresentation></Lemma><Sense id="{i}..1"><SenseRelation targets="{to}"><feat att="label" val="primary"/></SenseRelation></Sense></LexicalEntry>'
    (tmp_path / "l.xml").write_text("<L>" + "".join(sense(f"w{i}", "PRIM..1") for i in range(7)) + "".join(sense(f"r{i}", f"w{i % 5}..1") for i in range(90)) + "</L>", encoding="utf-8")
    run("lexicon", "--input", tmp_path / "l.xml", "--output", tmp_path / "g")
    assert run("analyze", "--ratings", f"{tmp_path}/ratings_*.csv", "--sampled-pairs", tmp_path / "master.csv", "--models", f"{tmp_path}/models/*.csv", "--output-dir", tmp_path / "a", "--lexicon", tmp_path / "g") == 0
    report = (tmp_path / "a/report.md").read_text()
    assert "Agreement by category" in report and "of 40 pairs diverge" in report and "Agreement with the lexicon" in report
    models = read(spark, tmp_path / "a/models").first()
    assert float(models.ci_low) <= float(models.spearman_rho) <= float(models.ci_high)
    catalog = read(spark, tmp_path / "a/divergence").toPandas()
    assert catalog.disagreement.astype(float).is_monotonic_decreasing and list(catalog.columns) == ["pair_id", "target", "response", "rater_mean_rating", "cosine_sim_primary_model", "disagreement", "rater_category", "is_compound", "relation_summary", "is_divergence_case"]
    assert {"oov(r)", "mother(t→r)"} & set(catalog.relation_summary)
    r = read(spark, tmp_path / "a/reliability").collect()
    assert len(r) == 1  # the file of the second round is left to the retest branch
    with pytest.raises(ValueError):
        run("analyze", "--ratings", f"{tmp_path}/ratings_a.csv", "--sampled-pairs", tmp_path / "master.csv", "--models", f"{tmp_path}/models/*.csv", "--output-dir", tmp_path / "b")


def test_wide(spark, run, tmp_path):
    spark.createDataFrame([(1, "svf", "u", "Age:", "70", None)], "row_id long, test_code string, participant_id string, attr_name string, attr_value string, entered_at timestamp").write.parquet(str(tmp_path / "in"))
    assert run("wide", "--input", tmp_path / "in", "--output", tmp_path / "out") == 0 and spark.read.parquet(str(tmp_path / "out")).first().Age == 70.0


def test_embedders(spark):
    hidden, mask = np.arange(24.0).reshape(2, 4, 3), np.array([[1, 1, 1, 0], [1, 1, 0, 0]])
    assert embedding.pool_tokens(hidden, mask, "cls").tolist() == hidden[:, 0].tolist()
    assert embedding.pool_tokens(hidden, mask, "mean").tolist() == [hidden[0, 1].tolist(), hidden[1, :2].mean(0).tolist()]
    words = spark.createDataFrame([("hund",), ("katt",), ("hund",), (None,)], "word string")
    got = {r.word: r.embedding for r in embedding.embed_words(words, "word", embedding.factory({"kind": "mock"})).collect()}
    want = {r.word: r.v for r in words.distinct().withColumn("v", embedding.mock_vector(words.word)).collect()}
    assert set(got) == {"hund", "katt"} and all(got[w] == pytest.approx(want[w], abs=1e-6) for w in got)
    with pytest.raises(ValueError):
        embedding.factory({"kind": "x"})
    assert matching.score_pairs(spark, ["hund", "hund", None], ["hund", "katt", "katt"], pipelines.mock_vectors)[::2] == pytest.approx([1.0, 0.0])
    with pytest.raises(ValueError):
        matching.score_pairs(spark, ["hund"], [], pipelines.mock_vectors)


def test_a_model_of_ones_own(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=120)
    df = spark.createDataFrame(pd.DataFrame({"participant_id": [f"u{i}" for i in range(120)], "diagnosis": "HC", "x": x, "mmse": 25 + 2 * x}))

    def fit(a, y, setting):
        w = np.linalg.lstsq(np.column_stack([np.ones(len(a)), a * setting["use"]]), y, rcond=None)[0]
        return lambda v: np.column_stack([np.ones(len(v)), v * setting["use"]]) @ w

    out = regression.model_cv(df, ["x"], fit, [{"use": 0}, {"use": 1}]).toPandas()
    assert len(out) == 120 and set(out.setting) == {"{'use': 1}"} and (out.truth - out.prediction).abs().max() < 1e-6
