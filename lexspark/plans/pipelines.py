"""End-to-end pipelines: from test sheets to scored tables, from scored tables to rater samples and reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators import agreement, embedding, frequency, graph, matching, regression, sampling, sequence, stats, summaries, vectors
from lexspark.operators.graph import SenseGraph
from lexspark.session import cut
from lexspark.sources import sheets, tables


class NoFeature(ValueError):
    """No feature is left to regress on."""


WordVectors = Callable[[DataFrame], DataFrame]


def mock_vectors(words: DataFrame) -> DataFrame:
    """(word, embedding) by the built-in stand-in for a model."""
    return words.select("word").distinct().withColumn("embedding", embedding.mock_vector(F.col("word")))


def model_vectors(load: Callable[[], embedding.Embedder], prefix: str = "", batch: int = 32) -> WordVectors:
    """(word, embedding) by a model that `load` returns in the worker."""
    return lambda words: embedding.embed_words(words, "word", load, prefix, batch)


def bnt(spark: SparkSession, path: str, vectors_of: WordVectors = mock_vectors, sheet: str = "0") -> DataFrame:
    """Scored naming answers. Only words that need a similarity are embedded, each once."""
    answers, meta = sheets.load_bnt(sheets.read_sheet(spark, path, sheet))
    rows = cut(matching.long_responses(answers, meta), "answers")
    need = rows.filter(~F.col("is_exact_match") & ~F.col("is_non_response"))
    words = need.select(F.col("normalized").alias("word")).union(need.select("gold")).distinct()
    return matching.score_responses(rows, cut(vectors_of(words), "vectors"))


def svf(words: DataFrame, meta: DataFrame, vectors_of: WordVectors = mock_vectors, frequencies: DataFrame | None = None, threshold: float = 0.45) -> DataFrame:
    """One row per participant with the 17 columns of the scored table. `words`: participant_id, pos, word."""
    key = ["participant_id"]
    dim = cut(vectors_of(words.select("word").distinct()), "vectors")
    placed = words.join(dim, "word")
    sims = cut(vectors.adjacent(placed, "participant_id", "pos", "embedding").select("participant_id", "pos", "word", "sim"), "sims")
    unique = placed.groupBy("participant_id", "word").agg(F.first("embedding").alias("embedding"))
    pairs = vectors.pairwise_mean(unique, "participant_id", "word", "embedding").select("participant_id", F.col("mean").alias("pairwise_similarity_mean"))
    parts = [sequence.count_metrics(words, key), sequence.similarity_profile(sims, key).drop("n_words"), pairs, sequence.cluster_metrics(sequence.detect_clusters(sims, key, threshold), key)]
    if frequencies is not None:
        parts.append(frequency.mean_word_frequency(words.select("participant_id", "word").distinct(), frequencies, key))
    out = meta
    for p in parts:
        out = out.join(p, "participant_id", "left")
    if frequencies is None:
        out = out.withColumn("mean_word_frequency", F.lit(None).cast("double"))
    return out.na.fill(0, ["total_words", "unique_words", "repetitions", "cluster_count", "switch_count", "max_cluster_size"]).select(*tables.SVF_COLUMNS)


def fas(words: DataFrame, meta: DataFrame, frequencies: DataFrame | None = None) -> DataFrame:
    """One row per participant with the 28 columns of the scored table. `words`: participant_id, letter, pos, word,
    is_flagged."""
    key = ["participant_id"]
    totals = sequence.fas_totals(sequence.letter_counts(words, ["participant_id", "letter"]), key)
    first = sequence.first_of_each(words, ["participant_id", "letter"])
    clustered = cut(sequence.phonemic_clusters(first, ["participant_id", "letter"]), "clusters")
    per = sequence.cluster_metrics(clustered, ["participant_id", "letter"])
    wide = per.groupBy(*key).agg(*[F.max(F.when(F.col("letter") == x, F.col(m))).alias(f"{m}_{x}") for x in "fas" for m in ("cluster_count", "mean_cluster_size", "switch_count")])
    out = meta.join(totals, "participant_id", "left").join(wide, "participant_id", "left").join(sequence.pooled_clusters(clustered, key), "participant_id", "left")
    out = out.join(frequency.mean_word_frequency(first, frequencies, key), "participant_id", "left") if frequencies is not None else out.withColumn("mean_word_frequency", F.lit(None).cast("double"))
    zero = [c for c in out.columns if c.startswith(("total_", "valid_", "cluster_count", "switch_count")) or c in ("proper_nouns_count", "repetitions_count")]
    return out.na.fill(0, zero).na.fill(0.0, ["letter_asymmetry"]).select(*tables.FAS_COLUMNS)


def sheet_svf(spark: SparkSession, path: str, sheet: str = "0", **options) -> DataFrame:
    words, meta = sheets.load_svf(sheets.read_sheet(spark, path, sheet))
    return svf(words, meta, **options)


def sheet_fas(spark: SparkSession, path: str, sheet: str = "0", **options) -> DataFrame:
    words, meta = sheets.load_fas(sheets.read_sheet(spark, path, sheet))
    return fas(words, meta, **options)


def rater_samples(scored: DataFrame, model_name: str, raters: int = 2, per_quartile: int = 50, training: int = 20) -> dict[str, DataFrame]:
    """master sample and, per rater, a blinded sheet and a training sheet: eligible answers, quartiles of their
    similarity, a draw per quartile, and other answers for training."""
    eligible = cut(stats.assign_quartile(matching.eligible_pairs(scored.withColumn("key", F.concat_ws("\u0001", "gold", "normalized"))), "cosine_sim"), "eligible")
    master = cut(sampling.draw_stratified(eligible, "cosine_quartile", "key", per_quartile), "master")
    train = cut(sampling.draw_training(eligible, master, ["key"], "key", training), "training")
    out = {"master": master.select("pair_id", F.col("gold").alias("target"), F.col("raw_response").alias("response"), "cosine_sim", "cosine_quartile", "participant_id", "diagnosis", F.lit(model_name).alias("model"))}
    for i in range(raters):
        out[f"rater{i + 1}"] = sampling.rater_view(master, sampling.PRIMARY_SEED + i)
        out[f"training{i + 1}"] = sampling.rater_view(train, sampling.TRAINING_SEED + i)
    return out


def rating_analysis(files: Sequence[DataFrame], sample: DataFrame, models: DataFrame, lexicon: SenseGraph | None = None, test_retest: bool = False, n_boot: int = 1000) -> dict[str, DataFrame]:
    """reliability of every two raters (or of two rounds) with its summary: the mean weighted kappa and the flag by it;
    agreement of each model with the mean rating, with bootstrap intervals - in all, by quartile, by category (null below
    15 pairs); with a lexicon the agreement of ratings with its graph; and the divergence catalog of the first model by
    name, the greatest disagreement first, with the words' relation in the lexicon.

    Two or three rating tables are expected, exactly two for test and retest."""
    if not (len(files) == 2 if test_retest else 2 <= len(files) <= 3):
        raise ValueError("2 or 3 rating tables are needed, exactly 2 for test and retest")
    for f in files:
        agreement.validate_ratings(f)
    pairs = [(i, j) for i in range(len(files)) for j in range(i + 1, len(files))]
    rel = None
    for i, j in pairs:
        r = agreement.reliability(files[i], files[j]).select(F.lit(i).alias("rater_a"), F.lit(j).alias("rater_b"), "*")
        rel = r if rel is None else rel.unionByName(r)
    rel = cut(rel, "reliability")
    if rel.isEmpty():
        raise ValueError("the rating tables share no pair")
    rated = cut(agreement.consolidate(files), "rated")
    cosines = cut(agreement.fan_out(models, sample).select("pair_id", "model_name", F.col("cosine_sim")), "cosines")
    out = {"reliability": rel, "reliability_summary": agreement.reliability_summary(rel), "models": agreement.with_interval(rated, cosines, n_boot=n_boot)}
    out["by_quartile"] = agreement.with_interval(rated, cosines.join(sample.select("pair_id", "cosine_quartile"), "pair_id"), ("model_name", "cosine_quartile"), n_boot=n_boot)
    out["by_category"] = agreement.with_interval(rated, cosines, ("model_name", "category"), 15, n_boot)
    first = cosines.agg(F.min("model_name")).first()[0]
    one = cosines.filter(F.col("model_name") == first).groupBy("pair_id").agg(F.first("cosine_sim").alias("cosine_sim"))
    asked, relations = sample.select("pair_id", "target", "response"), None
    if lexicon is not None:
        words = cut(asked.select("target", "response").distinct(), "words")
        out["graph"] = agreement.graph_agreement(rated, asked, graph.pair_similarity(words, lexicon), n_boot)
        relations = graph.relation_summary(words, lexicon).withColumnRenamed("relation", "relation_summary")
    catalog = agreement.ranked_catalog(agreement.divergence_catalog(rated, asked.join(one, "pair_id"), relations=relations))
    known = F.col("relation_summary") if lexicon is not None else F.lit(None).cast("string").alias("relation_summary")
    out["divergence"] = catalog.orderBy("position", "pair_id").select("pair_id", "target", "response", F.col("rating").alias("rater_mean_rating"), F.col("cosine_sim").alias("cosine_sim_primary_model"), "disagreement", F.col("category").alias("rater_category"), "is_compound", known, "is_divergence_case")
    return out


def analysis_report(results: dict[str, DataFrame]) -> str:
    """The small tables of `rating_analysis` as one markdown text, and how many pairs diverge."""
    titles = {"reliability": "Reliability", "reliability_summary": "Reliability, summary", "models": "Agreement of models", "by_quartile": "Agreement by quartile", "by_category": "Agreement by category", "graph": "Agreement with the lexicon's graph"}
    parts = [f"## {t}\n\n{tables.to_markdown(results[k].orderBy(*results[k].columns[:2]))}" for k, t in titles.items() if k in results]
    n, cases = results["divergence"].agg(F.count("*"), F.count_if("is_divergence_case")).first()
    return "\n\n".join(["# Rating analysis", *parts, f"## Divergence\n\n{cases} of {n} pairs diverge."]) + "\n"


def eligibility_report(scored: DataFrame) -> str:
    """Funnel, quartile edges and counts by quartile and diagnosis of a scored table as markdown."""
    eligible = cut(matching.eligible_pairs(scored), "eligible")
    edges = ", ".join(f"{x:.4f}" for x in stats.quartile_cutpoints(eligible, "cosine_sim"))
    counts = summaries.contingency(stats.assign_quartile(eligible, "cosine_sim"), "cosine_quartile", "diagnosis", summaries.DIAGNOSES).orderBy("cosine_quartile")
    return f"# Eligibility\n\n{tables.to_markdown(matching.eligibility_funnel(scored))}\n\nQuartile edges: {edges}\n\n{tables.to_markdown(counts)}\n"


def model_sweep(entries: Sequence[dict], run: Callable[[WordVectors], DataFrame], output: str, skip_existing: bool = False) -> dict[str, str]:
    """`run` (a pipeline that takes word vectors) with each model of a configuration, its table saved under output/label.
    A model that fails does not stop the others. label -> done, skipped or the error; `entries`: label, and what
    `embedding.factory` and `embedding.prefix_of` read."""
    said = {}
    for e in entries:
        path = f"{output}/{e['label']}"
        try:
            if skip_existing and tables.exists(path):
                said[e["label"]] = "skipped"
                continue
            tables.save_csv(run(model_vectors(embedding.factory(e), embedding.prefix_of(e), e.get("batch", 32))), path)
            said[e["label"]] = "done"
        except Exception as x:  # noqa: BLE001
            said[e["label"]] = f"{type(x).__name__}: {x}".splitlines()[0]
    return said


def probe_models(spark: SparkSession, entries: Sequence[dict], words: Sequence[tuple[str, str]]) -> DataFrame:
    """model_name, n, mean, std, min, max, separation and a flag of each model on a few (word, label) probes."""
    probes, out = spark.createDataFrame(list(words), "word string, label string"), None
    for e in entries:
        v = model_vectors(embedding.factory(e), embedding.prefix_of(e))(probes).join(probes, "word")
        one = embedding.health(vectors.similarity_health(cut(v, "probes"), "word", "embedding", "label")).withColumn("model_name", F.lit(e["label"]))
        out = one if out is None else out.unionByName(one)
    return out.select("model_name", "n", "mean", "std", "min", "max", "separation", "flag")


def mmse_regression(scored: DataFrame, features: Sequence[str], seed: int = 0, least: float = 0.3, svr_rows: int = 400) -> dict[str, DataFrame]:
    """correlations of the features with mmse; for those that pass, held-out predictions, errors, confusion and kappa
    of ridge and support vectors. An error if no feature passes or fewer than five rows remain."""
    rows = agreement.check_missing_share(scored, ["mmse"])
    table = regression.correlation_table(rows, features, least=least)
    chosen = regression.select_features(table)
    if not chosen:
        raise NoFeature("no feature correlates with the score")
    if rows.count() < 5:
        raise ValueError("fewer than 5 rows")
    out = {"correlations": table}
    ridge = cut(regression.ridge_cv(rows, chosen, seed=seed), "ridge")
    svr = cut(regression.svr_cv(rows, chosen, seed=seed, fit_rows=svr_rows), "svr").withColumnRenamed("truth", "mmse")
    for name, predicted in (("ridge", ridge), ("svr", svr)):
        out[f"{name}_predictions"] = predicted
        out[f"{name}_mae"], out[f"{name}_confusion"], out[f"{name}_kappa"] = regression.evaluation(predicted)
    return out


def calibrate_threshold(words: DataFrame, meta: DataFrame, vectors_of: WordVectors = mock_vectors, low: float = 0.3, high: float = 0.7, step: float = 0.025, group: str = "diagnosis") -> tuple[DataFrame, DataFrame]:
    """(h and p of three cluster metrics at every threshold, the best threshold of each metric)."""
    dim = cut(vectors_of(words.select("word").distinct()), "vectors")
    sims = cut(vectors.adjacent(words.join(dim, "word"), "participant_id", "pos", "embedding").select("participant_id", "pos", "sim"), "sims")
    grid = [round(low + i * step, 6) for i in range(int(round((high - low) / step)) + 1)]
    m = sequence.threshold_sweep(sims, ["participant_id"], grid).join(meta.select("participant_id", group), "participant_id")
    value: list[Column] = [F.col(c).cast("double").alias(c) for c in ("mean_cluster_size", "switch_count", "cluster_count")]
    h = cut(stats.kruskal(m.unpivot(["threshold", group], value, "metric", "value"), "value", group, ["metric", "threshold"], 2), "kruskal")
    return h.withColumn("p_value", stats.chi2_p(F.col("h"), (F.col("k") - 1).cast("double"))), summaries.best_by(h, ["metric"], "h", "threshold")
