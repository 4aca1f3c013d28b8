"""Queries of the lexical-response operators over the test tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions import text
from lexspark.operators import agreement, embedding, frequency, graph, matching, regression, sampling, sequence, stats, summaries, vectors
from lexspark.operators import strdist
from lexspark.plans import base
from lexspark.plans.base import rounded, rounded_sql
from lexspark.session import cut, table

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- texts and matching


@query
def text_norm(spark: SparkSession, d: str) -> DataFrame:
    n = text.plain(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.char_length(n).cast("bigint").alias("n_chars_plain"), F.md5(n).alias("digest"))


@query
def response_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sq3_pairs").select("response", text.normalize_response(F.col("response")).alias("normalized"))
    return rows.groupBy("response", "normalized").agg(F.count("*").alias("n"))


@query
def response_classify(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.value_counts(base.pool(spark, d).select(text.classify_response(F.col("response"), F.col("target")).alias("response_class")), "response_class"))


@query
def match_rates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matching.match_rates(base.pool(spark, d), "response", "target", ("model_name",)))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """The pool as scored answers: its cosine stands for the similarity of the answer's embedding."""
    p = base.pool(spark, d).withColumnRenamed("target", "gold").withColumnRenamed("response", "raw_response")
    rows = p.withColumn("normalized", text.normalize_response(F.col("raw_response"))).withColumns({"is_exact_match": matching.is_exact(F.col("normalized"), F.col("gold")), "is_non_response": F.col("normalized").isNull()})
    return rows.withColumn("cosine_sim", matching.graded_score(F.col("is_exact_match"), F.col("is_non_response"), F.col("cosine_sim"))).withColumn("binary_score", F.col("is_exact_match").cast("int"))


@query
def graded_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_answers(spark, d).select("pair_id", "gold", "normalized", "is_exact_match", "is_non_response", "cosine_sim", "binary_score"))


@query
def naming_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.naming_summary(_answers(spark, d)))


@query
def eligibility_funnel(spark: SparkSession, d: str) -> DataFrame:
    return matching.eligibility_funnel(_answers(spark, d))


@query
def eligible_pairs(spark: SparkSession, d: str) -> DataFrame:
    return matching.eligible_pairs(_answers(spark, d).select("gold", "normalized", "participant_id", "is_exact_match", "is_non_response")).select("gold", "normalized", "participant_id")


@query
def item_variation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.item_variation(_answers(spark, d), "gold", "cosine_sim", 10), 10)


@query
def fas_triplets(spark: SparkSession, d: str) -> DataFrame:
    """The words of the whole list in cells of three by position, one row per participant and cell; a missing element
    keeps its place."""
    lists = base.participants(spark, d).filter(F.size("responses") > 0).select("participant_id", F.split(F.array_join("responses", ",", ""), ",").alias("words"))
    rows = lists.withColumn("cell_no", F.explode(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / 3).cast("int"))))
    cells = rows.select("participant_id", "cell_no", F.array_join(F.slice("words", F.col("cell_no") * 3 + 1, F.lit(3)), ",").alias("cell"))
    t = text.triplet(F.col("cell"))
    return cells.select("participant_id", "cell_no", *[text.unflagged(F.get(t, F.lit(i))).alias(f"word_{x}") for i, x in enumerate("fas")], F.size(text.triplet_compact(F.col("cell"))).cast("bigint").alias("n_compact"))


@query
def meta_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "meta_entries").groupBy(text.meta_key(F.col("attr_name")).alias("field")).agg(F.count("*").alias("n"), F.count_if(text.is_null_text(F.col("attr_value"))).alias("n_null"))


@query
def unpivot_long(spark: SparkSession, d: str) -> DataFrame:
    return rounded(base.participants(spark, d).select("participant_id", "age", "mmse").unpivot(["participant_id"], ["age", "mmse"], "field", "value").filter("value IS NOT NULL"))


# --- vectors


@query
def consecutive_similarity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vectors.adjacent(table(spark, d, "embeddings"), "label", "vec_id", "embedding", long=True).select("label", "vec_id", "pos", "sim"))


@query
def pairwise_similarity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vectors.pairwise_mean(table(spark, d, "embeddings"), "label", "vec_id", "embedding").select("label", "n", "n_pairs", "mean", "max"))


@query
def similarity_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sequence.similarity_profile(vectors.adjacent(table(spark, d, "embeddings"), "label", "vec_id", "embedding", long=True), ["label"]), 9)


@query
def svf_chain_clusters(spark: SparkSession, d: str) -> DataFrame:
    sims = vectors.adjacent(table(spark, d, "embeddings"), "label", "vec_id", "embedding", long=True).select("label", "pos", "sim")
    return rounded(sequence.cluster_metrics(sequence.detect_clusters(sims, ["label"], 0.05, long=True), ["label"]))


@query
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    sims = vectors.adjacent(table(spark, d, "embeddings"), "label", "vec_id", "embedding", long=True).select("label", "pos", "sim")
    return rounded(sequence.threshold_sweep(sims, ["label"], [i / 1000 for i in range(0, 301, 25)], long=True))


@query
def model_health(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return rounded(embedding.health(vectors.similarity_health(e, "vec_id", "embedding", "label")).select("n", "mean", "std", "min", "max", "separation", "flag"))


# --- fluency


def _word_sims(spark: SparkSession, d: str) -> DataFrame:
    """Words in order with the similarity to the one before: distinct words are embedded once and joined."""
    w = base.words(spark, d)
    dim = w.select("word").distinct().withColumn("embedding", embedding.mock_vector(F.col("word")))
    return vectors.adjacent(w.join(dim, "word"), "participant_id", "pos", "embedding").select("participant_id", "pos", "word", "sim")


@query
def fluency_counts(spark: SparkSession, d: str) -> DataFrame:
    return sequence.count_metrics(base.words(spark, d), ["participant_id"])


@query
def svf_profile(spark: SparkSession, d: str) -> DataFrame:
    sims = cut(_word_sims(spark, d).select("participant_id", "pos", "sim"), "sims")
    c = sequence.cluster_metrics(sequence.detect_clusters(sims, ["participant_id"], 0.1), ["participant_id"])
    p = cut(base.participants(spark, d).select("participant_id", "diagnosis"), "participants")
    out = p.join(sequence.similarity_profile(sims, ["participant_id"]), "participant_id", "left").join(sequence.with_empty(c, p, ["participant_id"]), "participant_id", "left")
    return rounded(out)


@query
def letter_counts(spark: SparkSession, d: str) -> DataFrame:
    w = base.words(spark, d).withColumn("letter", F.substring("word", 1, 1)).filter(F.col("letter").isin("f", "a", "s"))
    return sequence.letter_counts(w, ["participant_id", "letter"])


@query
def fas_totals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sequence.fas_totals(letter_counts(spark, d), ["participant_id"]))


@query
def phonemic_links(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("participant_id").orderBy("pos")
    pairs = base.words(spark, d).select(F.lag("word").over(w).alias("a"), F.col("word").alias("b")).filter("a IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))
    a, b = F.col("a"), F.col("b")
    return pairs.select("a", "b", "n", strdist.same_onset(a, b).alias("same_onset"), strdist.same_rime(a, b).alias("same_rime"), strdist.one_vowel_apart(a, b).alias("one_vowel_apart"), strdist.linked(a, b).alias("linked"))


@query
def phonemic_clusters(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sequence.cluster_metrics(sequence.phonemic_clusters(base.words(spark, d), ["participant_id"]), ["participant_id"]))


@query
def pooled_letter_clusters(spark: SparkSession, d: str) -> DataFrame:
    w = base.words(spark, d).withColumn("letter", F.substring("word", 1, 1)).filter(F.col("letter").isin("f", "a", "s"))
    first = sequence.first_of_each(w, ["participant_id", "letter"])
    return rounded(sequence.pooled_clusters(sequence.phonemic_clusters(first, ["participant_id", "letter"]), ["participant_id"]))


@query
def edit_distance_adjacent(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sequence.adjacent_edit_distance(base.words(spark, d), ["participant_id"]))


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    counts = cut(base.document_tokens(spark, d).groupBy("token").agg(F.count("*").alias("n")), "tokens")
    total = counts.agg(F.sum("n")).first()[0] or 1
    return frequency.frequency_table(counts.select(F.col("token").alias("lemma"), (F.col("n") * 1e6 / F.lit(float(total))).alias("frequency_per_million")))


@query
def word_zipf_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(frequency.mean_word_frequency(base.words(spark, d).select("participant_id", "word").distinct(), _frequencies(spark, d), ["participant_id"]))


@query
def vocab_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(frequency.coverage(base.words(spark, d), base.document_tokens(spark, d).select("token")))


# --- summaries


def _scored(spark: SparkSession, d: str) -> DataFrame:
    p = base.participants(spark, d).select("participant_id", "gender", "age", "diagnosis", "mmse")
    return p.join(sequence.count_metrics(base.words(spark, d), ["participant_id"]), "participant_id").withColumns({c: F.col(c).cast("double") for c in ("total_words", "unique_words", "repetitions")})


@query
def group_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.group_means(_scored(spark, d), "diagnosis", ["total_words", "unique_words", "repetitions"]))


@query
def demographics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.demographics(base.participants(spark, d), "diagnosis"))


@query
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.value_counts(base.words(spark, d), "word"), 9)


@query
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = base.words(spark, d).join(base.participants(spark, d).select("participant_id", "diagnosis"), "participant_id")
    return summaries.top_k_values(w, ["diagnosis"], "word", 3)


@query
def rare_values(spark: SparkSession, d: str) -> DataFrame:
    return summaries.rare_values(base.words(spark, d), [], "word", 2)


@query
def repeated_words(spark: SparkSession, d: str) -> DataFrame:
    return summaries.repeated_values(base.words(spark, d), ["participant_id"], "word")


@query
def response_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.response_rollup(base.pool(spark, d), ["target", "response"], "diagnosis", "cosine_sim", "pair_id"))


@query
def quartile_contingency(spark: SparkSession, d: str) -> DataFrame:
    return summaries.contingency(base.pool(spark, d), "cosine_quartile", "diagnosis", summaries.DIAGNOSES)


@query
def text_lengths(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.text_lengths(table(spark, d, "sq3_pairs"), ["target"], "response"))


@query
def missing_cells(spark: SparkSession, d: str) -> DataFrame:
    return summaries.missing_cells(table(spark, d, "sq3_pairs"), ["target", "response", "cosine_sim", "cosine_quartile", "participant_id", "diagnosis", "model"])


@query
def cross_test_summary(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "meta_entries").groupBy("test_code").agg(F.count("*").alias("n_entries"), F.count_distinct("participant_id").alias("n_participants"))
    return m.unionByName(table(spark, d, "svf_participant").select(F.lit("svf lists").alias("test_code"), "participant_id").groupBy("test_code").agg(F.count("*").alias("n_entries"), F.count_distinct("participant_id").alias("n_participants")))


@query
def quartile_assign(spark: SparkSession, d: str) -> DataFrame:
    return stats.assign_quartile(base.pool(spark, d).select("pair_id", "cosine_sim"), "cosine_sim", "quartile").groupBy("quartile").agg(F.count("*").alias("n"), F.min("cosine_sim").alias("lo"), F.max("cosine_sim").alias("hi"))


@query
def item_by_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.item_by_group(_answers(spark, d), "gold"), 10)


@query
def accuracy_by_category(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.accuracy_by_category(_answers(spark, d).withColumn("near", F.col("cosine_sim") >= 0.5), "gold", "model_name", "near"))


@query
def most_words(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.top_row(_scored(spark, d).select("diagnosis", "total_words", "participant_id"), ["diagnosis"], "total_words", "participant_id"))


@query
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    p = base.pool(spark, d).filter("model_name IS NOT NULL")
    h = stats.kruskal(p, "cosine_sim", "diagnosis", ["model_name"], 2)
    return rounded(h.join(stats.cohens_d(p, "cosine_sim", "diagnosis", [("HC", "AD")], ["model_name"]).select("model_name", "d"), "model_name"))


@query
def users_of_all_tests(spark: SparkSession, d: str) -> DataFrame:
    """Names that occur in all three tests. The same name is not the same person; the count is for exploration."""
    m = table(spark, d, "meta_entries")
    one = [m.filter(F.col("test_code") == t).select("participant_id") for t in ("bnt", "svf", "fas")]
    return one[0].intersect(one[1]).intersect(one[2])


# --- joins


@query
def semi_anti_split(spark: SparkSession, d: str) -> DataFrame:
    p, r = base.pool(spark, d).select("pair_id", "target"), base.current(spark, d).select("pair_id").distinct()
    live, rest = p.join(r, "pair_id", "left_semi").withColumn("part", F.lit("rated")), p.join(r, "pair_id", "left_anti").withColumn("part", F.lit("unrated"))
    return live.unionByName(rest)


@query
def fan_out_join(spark: SparkSession, d: str) -> DataFrame:
    p = base.pool(spark, d)
    sample = table(spark, d, "sq3_anchors").unionByName(p.groupBy("target", "response").agg(F.min("pair_id").alias("pair_id")))
    out = agreement.fan_out(p.withColumnsRenamed({"target": "gold", "response": "raw_response"}), sample)
    return rounded(out.groupBy("pair_id").agg(F.count("*").alias("n"), F.avg("cosine_sim").alias("mean_cosine")), 9)


# --- agreement and statistics


@query
def test_retest(spark: SparkSession, d: str) -> DataFrame:
    c = base.current(spark, d)
    a, b = (c.filter(F.col("rating_round") == r).drop("rating_round") for r in (1, 2))
    return rounded(agreement.reliability(a, b, on=("rater_id", "pair_id")))


@query
def test_retest_by_rater(spark: SparkSession, d: str) -> DataFrame:
    c = base.current(spark, d)
    a, b = (c.filter(F.col("rating_round") == r).drop("rating_round") for r in (1, 2))
    return rounded(agreement.reliability(a, b, by=("rater_id",)).select("rater_id", "n_pairs", "weighted_kappa", "interpretability"))


@query
def confusion_2x2(spark: SparkSession, d: str) -> DataFrame:
    j = base.rated(spark, d).join(base.pool(spark, d), "pair_id")
    return stats.confusion(j, F.col("rating") >= 1.5, F.col("cosine_sim") >= 0.5)


@query
def spearman_by_model(spark: SparkSession, d: str) -> DataFrame:
    return rounded(agreement.model_agreement(base.rated(spark, d), base.pool(spark, d)))


@query
def spearman_by_quartile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(agreement.model_agreement(base.rated(spark, d), base.pool(spark, d), ("model_name", "cosine_quartile")))


@query
def spearman_by_category(spark: SparkSession, d: str) -> DataFrame:
    return rounded(agreement.model_agreement(base.rated(spark, d), base.pool(spark, d), ("model_name", "category"), 15))


@query
def spearman_p(spark: SparkSession, d: str) -> DataFrame:
    return stats.with_rho_p(stats.spearman(base.rated(spark, d).join(base.pool(spark, d), "pair_id"), "rating", "cosine_sim"))


@query
def spearman_ci(spark: SparkSession, d: str) -> DataFrame:
    return stats.bootstrap_spearman(base.rated(spark, d).join(base.pool(spark, d), "pair_id"), "rating", "cosine_sim", ["model_name"], "pair_id")


@query
def kruskal_words(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).unpivot(["participant_id", "diagnosis"], ["total_words", "unique_words", "repetitions"], "metric", "value")
    return rounded(stats.kruskal(rows, "value", "diagnosis", ["metric"]))


@query
def kruskal_p(spark: SparkSession, d: str) -> DataFrame:
    return stats.kruskal(_scored(spark, d), "total_words", "diagnosis").withColumn("p_value", stats.chi2_p(F.col("h"), (F.col("k") - 1).cast("double")))


@query
def threshold_kruskal(spark: SparkSession, d: str) -> DataFrame:
    sims = cut(_word_sims(spark, d), "sims")
    m = sequence.threshold_sweep(sims, ["participant_id"], [i / 1000 for i in range(0, 301, 25)])
    long = m.join(base.participants(spark, d).select("participant_id", "diagnosis"), "participant_id").unpivot(["threshold", "diagnosis"], [F.col("mean_cluster_size").cast("double").alias("mean_cluster_size"), F.col("switch_count").cast("double").alias("switch_count"), F.col("cluster_count").cast("double").alias("cluster_count")], "metric", "value")
    return rounded(summaries.best_by(stats.kruskal(long, "value", "diagnosis", ["metric", "threshold"], 2), ["metric"], "h", "threshold"))


@query
def cohens_d(spark: SparkSession, d: str) -> DataFrame:
    out = stats.cohens_d(_scored(spark, d), "total_words", "diagnosis", [("HC", "MCI"), ("HC", "non-AD"), ("HC", "AD"), ("MCI", "AD")])
    return rounded(out.withColumn("magnitude", text.magnitude(F.col("d"))))


@query
def residual_kruskal(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.kruskal(stats.residuals(_scored(spark, d), "total_words", "age").withColumn("residual", F.round("residual", 9)), "residual", "diagnosis"), 4)


@query
def correlation_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(regression.correlation_table(_scored(spark, d), ["total_words", "unique_words", "repetitions", "age"]).select("feature", "n", "r", "passes"))


@query
def divergence_catalog(spark: SparkSession, d: str) -> DataFrame:
    return rounded(agreement.divergence_catalog(base.rated(spark, d), base.pool(spark, d)).select("pair_id", "target", "response", "rating", "cosine_sim", "disagreement", "category", "is_compound", "is_divergence_case"))


# --- sense graph: a tree over the parts, with a second edge from every fifth


def _graph(spark: SparkSession, d: str) -> graph.SenseGraph:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.element_at(F.split("p_name", " "), -1).alias("form"))
    up = F.expr("(k + 4) div 6")
    first = p.select(F.concat(F.lit("s"), "k").alias("src"), F.when(F.col("k") <= 1, graph.ROOT).otherwise(F.concat(F.lit("s"), up)).alias("dst"), F.lit("primary").alias("label"), F.lit(0).alias("ord"))
    second = p.filter("k > 5 AND k % 5 = 0").select(F.concat(F.lit("s"), "k").alias("src"), F.concat(F.lit("s"), F.expr("k div 3")).alias("dst"), F.lit("secondary").alias("label"), F.lit(1).alias("ord"))
    forms = p.select("form", F.concat(F.lit("s"), "k").alias("sense"), F.col("k").alias("ord"))
    return graph.SenseGraph(first.unionByName(second), forms)


def _graph_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every part with the one of a third its number."""
    return table(spark, d, "part").filter("p_partkey > 1").select(F.concat(F.lit("s"), "p_partkey").alias("s1"), F.concat(F.lit("s"), F.expr("p_partkey div 3 + 1")).alias("s2"))


@query
def graph_depth(spark: SparkSession, d: str) -> DataFrame:
    return graph.depths(_graph(spark, d)).select("sense", "depth")


@query
def graph_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return graph.ancestors(graph.depths(_graph(spark, d)))


@query
def wu_palmer(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graph.wu_palmer(_graph_pairs(spark, d), graph.depths(_graph(spark, d))))


@query
def graph_path(spark: SparkSession, d: str) -> DataFrame:
    return graph.path_lengths(_graph_pairs(spark, d), _graph(spark, d))


@query
def graph_relations(spark: SparkSession, d: str) -> DataFrame:
    """The relation of the same pairs, each word being one sense."""
    g = _graph(spark, d)
    one = graph.SenseGraph(g.edge, g.senses().select(F.col("sense").alias("form"), "sense", F.lit(0).alias("ord")))
    pairs = _graph_pairs(spark, d).select(F.col("s1").alias("target"), F.col("s2").alias("response"))
    return graph.relation_summary(pairs, one).groupBy("relation").agg(F.count("*").alias("n"))


@query
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return graph.graph_stats(g, graph.depths(g))


@query
def graph_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Ratings against graph similarity; a word's sense is the part its md5 points to, of all parts."""
    g, p = _graph(spark, d), base.pool(spark, d)
    w = p.select(F.col("target").alias("form")).union(p.select("response")).filter("form IS NOT NULL").distinct()
    n = table(spark, d, "part").count()
    forms = w.select("form", F.concat(F.lit("s"), F.conv(F.substring(F.md5("form"), 1, 8), 16, 10).cast("bigint") % n).alias("sense"), F.lit(0).alias("ord"))
    one = graph.SenseGraph(g.edge, forms)
    return rounded(agreement.graph_agreement(base.rated(spark, d), p, graph.pair_similarity(p, one)))


# --- samples and regression


@query
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.draw_stratified(base.pool(spark, d).select("pair_id", "target", "response", "cosine_quartile").withColumnRenamed("pair_id", "key"), "cosine_quartile", "key", 20)


@query
def rater_view(spark: SparkSession, d: str) -> DataFrame:
    return sampling.rater_view(stratified_sample(spark, d), sampling.PRIMARY_SEED + 1)


@query
def training_sample(spark: SparkSession, d: str) -> DataFrame:
    live = stratified_sample(spark, d)
    return sampling.draw_training(base.pool(spark, d).select(F.col("pair_id").alias("key"), "target", "response"), live, ["key"], "key", 20)


@query
def ridge_closed_form(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).filter("mmse IS NOT NULL AND age IS NOT NULL").withColumn("all", F.lit(0))
    m = regression._moments(rows, ["age", "total_words"], "mmse", ["all"])[(0,)]
    w = regression.ridge_from_moments(m, 1.0)
    return rounded(spark.createDataFrame([(int(m[0, 0]), *map(float, w))], "n bigint, intercept double, b_age double, b_words double"), 5)


@query
def ridge_cv(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).filter("mmse IS NOT NULL AND age IS NOT NULL AND diagnosis IS NOT NULL")
    return regression.ridge_cv(rows, ["age", "total_words", "unique_words"]).select("participant_id", "mmse", "fold", "alpha", "prediction")


@query
def svr_cv(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).filter("mmse IS NOT NULL AND age IS NOT NULL AND diagnosis IS NOT NULL")
    return regression.svr_cv(rows, ["age", "total_words", "unique_words"])


@query
def regression_mae(spark: SparkSession, d: str) -> DataFrame:
    return regression.evaluation(ridge_cv(spark, d))[0]


_NORMALIZED = r"""low AS (SELECT *, regexp_replace(lower(response), '^[\pZ\s]+|[\pZ\s]+$', '', 'g') AS t FROM src),
s1 AS (SELECT *, regexp_replace(regexp_replace(t, '[\pZ\s]*(kanske|tror jag|eller nåt|är det|va)$', ''), '^[\pZ\s]+|[\pZ\s]+$', '', 'g') AS u FROM low),
s2 AS (SELECT *, trim(regexp_replace(u, '^(det är |det ser ut som |jag tror det är |jag tror |en slags |nån slags |typ |liksom |bild på |säkert )', '')) AS v FROM s1),
s3 AS (SELECT *, trim(regexp_replace(v, '^(en|ett|den|det|de)\s+', '')) AS w FROM s2),
norm AS (SELECT * EXCLUDE (t, u, v, w), CASE WHEN t IS NULL OR t = '' OR t IN {none} OR w IN {none} OR length(w) < 2 THEN NULL ELSE w END AS normalized FROM s3)""".replace("{none}", "('hhhm jag vet inte', 'jag vet inte', 'vet inte', 'pass', 'ingen aning', 'vet ej', 'hmm', 'hm', 'jag kan inte', 'något sånt', 'nåt sånt')")
_ANSWERS = f"""{base.POOL}, src AS (SELECT * FROM pool), {_NORMALIZED},
answers AS (SELECT pair_id, target AS gold, response, participant_id, diagnosis, model_name, cosine_quartile, normalized, e AS is_exact_match, normalized IS NULL AS is_non_response,
  CASE WHEN e THEN 1.0 WHEN normalized IS NULL THEN 0.0 ELSE greatest(coalesce(cosine_sim, 0.0), 0.0) END::DOUBLE AS cosine_sim, e::INT AS binary_score
  FROM (SELECT *, coalesce(normalized = target OR string_split_regex(normalized, '\\s+')[-1] = target, false) AS e FROM norm))"""
_COS = "list_sum(list_transform(list_zip(a, b), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / sqrt(list_sum(list_transform(a, lambda p: p::DOUBLE * p)) * list_sum(list_transform(b, lambda p: p::DOUBLE * p)))"
_SIMS = f"sims AS (SELECT label, vec_id, pos, CASE WHEN a IS NOT NULL THEN greatest({_COS}, 0.0) END AS sim FROM (SELECT label, vec_id, row_number() OVER w - 1 AS pos, lag(embedding) OVER w AS a, embedding AS b FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)))"
_MOCK = "list_transform(range(16), lambda i: ('0x' || substr(md5(word || '#' || i), 1, 6))::BIGINT / 16777216.0::DOUBLE - 0.5::DOUBLE)"
_WORD_SIMS = f"""{base.WORDS}, dim AS (SELECT word, {_MOCK} AS e FROM (SELECT DISTINCT word FROM words)),
wsims AS (SELECT participant_id, pos, word, CASE WHEN a IS NOT NULL THEN greatest({_COS}, 0.0) END AS sim FROM (SELECT participant_id, pos, word, lag(e) OVER (PARTITION BY participant_id ORDER BY pos) AS a, e AS b FROM words JOIN dim USING (word)))"""


def _profile_sql(sims: str, by: str) -> str:
    return f"""SELECT {by}, count(*) AS n_words, avg(sim) AS mean_consecutive_similarity,
  CASE WHEN count(sim) >= 2 THEN avg(sim) FILTER (pos - 1 >= 0 AND pos - 1 < m // 2) - avg(sim) FILTER (pos - 1 >= m // 2) END AS temporal_gradient,
  CASE WHEN count(sim) >= 2 THEN regr_slope(sim, pos - 1) FILTER (pos > 0) END AS similarity_slope
  FROM (SELECT *, count(*) OVER (PARTITION BY {by}) - 1 AS m FROM {sims}) GROUP BY {by}"""


def _clusters_sql(sims: str, by: str, joins: str) -> str:
    return f"""(SELECT {by}, cid, count(*) AS size FROM (SELECT {by}, sum(CASE WHEN pos = 0 OR NOT coalesce({joins}, false) THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY pos) AS cid FROM {sims}) GROUP BY ALL)"""


_METRICS = "count(*) AS cluster_count, count(*) - 1 AS switch_count, avg(size) AS mean_cluster_size, max(size) AS max_cluster_size"
_LETTERS = "letters AS (SELECT *, substr(word, 1, 1) AS letter FROM words WHERE substr(word, 1, 1) IN ('f', 'a', 's'))"
_COUNTS = "SELECT participant_id, letter, count(*) AS total, count(*) FILTER (is_flagged) AS flagged, count(*) - count(DISTINCT word) AS repetitions, greatest(count(DISTINCT word) - count(*) FILTER (is_flagged), 0) AS valid FROM letters GROUP BY ALL"
_V = "[aeiouyåäö]"
_RIME = "regexp_extract({0}, '([aeiouyåäö][^aeiouyåäö]*)$', 1)"
_R1 = "(length(a) >= 2 AND length(b) >= 2 AND substr(a, 1, 2) = substr(b, 1, 2))"
_R2 = f"(length({_RIME.format('a')}) >= 2 AND {_RIME.format('a')} = {_RIME.format('b')})"
_R3 = f"(length(a) = length(b) AND len(list_filter(range(1, length(a) + 1), lambda i: a[i] <> b[i])) = 1 AND len(list_filter(range(1, length(a) + 1), lambda i: a[i] <> b[i] AND regexp_matches(a[i], '{_V}') AND regexp_matches(b[i], '{_V}'))) = 1)"
_ADJACENT = "adj AS (SELECT participant_id, pos, lag(word) OVER (PARTITION BY participant_id ORDER BY pos) AS a, word AS b FROM words)"
_SCORED = f"{base.WORDS}, scored AS (SELECT p.participant_id, gender, age, diagnosis, mmse, total_words, unique_words, repetitions FROM participants p JOIN (SELECT participant_id, count(*)::DOUBLE AS total_words, count(DISTINCT word)::DOUBLE AS unique_words, (count(*) - count(DISTINCT word))::DOUBLE AS repetitions FROM words GROUP BY ALL) USING (participant_id))"
_FREQ = f"{base.TOKENS}, freq AS (SELECT token, log10(n * 1e6 / (SELECT count(*) FROM tokens)) + 3 AS zipf FROM (SELECT token, count(*) AS n FROM tokens GROUP BY token))"
_J = f"{base.RATED}, {base.POOL}, j AS (SELECT * FROM rated JOIN pool USING (pair_id))"


def _spearman_sql(by: str, least: int = 2) -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""WITH {_J}, ok AS (SELECT * FROM j WHERE cosine_sim IS NOT NULL AND rating IS NOT NULL),
r AS (SELECT *, rank() OVER ({part} ORDER BY rating) + (count(*) OVER ({f'PARTITION BY {by}, rating'}) - 1) / 2.0 AS rx, rank() OVER ({part} ORDER BY cosine_sim) + (count(*) OVER ({f'PARTITION BY {by}, cosine_sim'}) - 1) / 2.0 AS ry FROM ok)
SELECT {by}, count(*) AS n, CASE WHEN count(*) >= {least} AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END AS spearman_rho, count(*) < {least} AS below_min_n FROM r GROUP BY {by}"""


def _kruskal_sql(src: str, by: str, least: int = 1) -> str:
    return f"""(WITH kept AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {by}, diagnosis) AS gn FROM {src} WHERE value IS NOT NULL AND diagnosis IS NOT NULL) WHERE gn >= {least}),
ranked AS (SELECT {by}, diagnosis, rank() OVER (PARTITION BY {by} ORDER BY value) + (count(*) OVER (PARTITION BY {by}, value) - 1) / 2.0 AS r FROM kept),
ties AS (SELECT {by}, sum(t * t * t - t) AS ties FROM (SELECT {by}, value, count(*)::DOUBLE AS t FROM kept GROUP BY ALL) GROUP BY ALL),
per AS (SELECT {by}, count(*) AS k, sum(ng)::DOUBLE AS n, sum(rs * rs / ng) AS q FROM (SELECT {by}, diagnosis, count(*) AS ng, sum(r) AS rs FROM ranked GROUP BY ALL) GROUP BY ALL)
SELECT {by}, k, n::BIGINT AS n, CASE WHEN k >= 2 AND n * n * n - n - ties > 0 THEN (12.0 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) END AS h FROM per JOIN ties USING ({by}))"""


_RELIABLE = f"""{base.CURRENT}, ab AS (SELECT rater_id, pair_id, a.rating AS ra, b.rating AS rb, a.category AS ca, b.category AS cb, a.is_compound AS ia, b.is_compound AS ib FROM (SELECT * FROM current WHERE rating_round = 1) a JOIN (SELECT * FROM current WHERE rating_round = 2) b USING (rater_id, pair_id))"""
_KW = "1 - sum((ra - rb) * (ra - rb)) / nullif(sum(ra * ra) + sum(rb * rb) - 2.0 * sum(ra) * sum(rb) / count(*), 0)"
_FLAG = "CASE WHEN weighted_kappa >= 0.6 THEN 'primary' WHEN weighted_kappa >= 0.4 THEN 'cautioned' ELSE 'exploratory' END AS interpretability"


def _kappa_sql(a: str, b: str) -> str:
    return f"""(SELECT (po - pe) / (1 - pe) FROM (SELECT (SELECT avg(({a} = {b})::INT) FROM ab WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS po,
  (SELECT sum(x.n * y.n) FROM (SELECT {a} AS v, count(*) / sum(count(*)) OVER () AS n FROM ab WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1) x JOIN (SELECT {b} AS v, count(*) / sum(count(*)) OVER () AS n FROM ab WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1) y USING (v)) AS pe))"""


_GRAPH = f"""p AS (SELECT p_partkey AS k FROM part),
edge AS (SELECT 's' || k AS src, CASE WHEN k <= 1 THEN '{graph.ROOT}' ELSE 's' || ((k + 4) // 6) END AS dst, 'primary' AS label, 0 AS ord FROM p UNION ALL SELECT 's' || k, 's' || (k // 3), 'secondary', 1 FROM p WHERE k > 5 AND k % 5 = 0),
edges AS (SELECT src, dst, arg_max(label, ord) AS label FROM edge GROUP BY ALL),
walk AS (SELECT '{graph.ROOT}' AS sense, 0 AS depth, ['{graph.ROOT}'] AS path UNION ALL SELECT e.src, w.depth + 1, list_append(w.path, e.src) FROM edges e JOIN walk w ON e.dst = w.sense WHERE e.label = 'primary')"""
_PAIRS = "pairs AS (SELECT DISTINCT 's' || p_partkey AS s1, 's' || (p_partkey // 3 + 1) AS s2 FROM part WHERE p_partkey > 1)"
# breadth first from every s1 of `pairs`; the table is keyed, so each node keeps the first distance it is reached at
_BFS = """twoway AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges)),
hop(source, node, h) USING KEY (source, node) AS (SELECT DISTINCT s1, s1, 0 FROM pairs WHERE s1 IN (SELECT a FROM twoway) UNION SELECT x.source, t.b, min(x.h + 1) FROM hop x JOIN twoway t ON t.a = x.node LEFT JOIN recurring.hop seen ON seen.source = x.source AND seen.node = t.b WHERE seen.node IS NULL GROUP BY x.source, t.b),
len AS (SELECT s1, s2, h AS path_length FROM pairs LEFT JOIN hop ON source = s1 AND node = s2)"""

SQL = {
    "text_norm": r"""SELECT doc_id, length(n)::BIGINT AS n_chars_plain, md5(n) AS digest FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, 'nan')), '^[\pZ\s]+|[\pZ\s]+$', '', 'g'), '[^\p{L}\p{N}_\- ]+', ' ', 'g'), '[\pZ\s]+', ' ', 'g')) AS n FROM documents)""",
    "response_normalize": f"WITH src AS (SELECT response FROM sq3_pairs), {_NORMALIZED} SELECT response, normalized, count(*) AS n FROM norm GROUP BY ALL",
    "response_classify": rounded_sql(f"""WITH {base.POOL}, c AS (SELECT CASE WHEN response IS NULL OR trim(response) = '' THEN 'empty' WHEN lower(trim(response)) = 'pass' THEN 'pass' WHEN lower(trim(response)) = 'sak' THEN 'generic_nonword'
  WHEN regexp_replace(lower(trim(response)), '^(en|ett)\\s+', '') = lower(target) THEN 'correct' WHEN contains(lower(trim(response)), lower(target)) THEN 'contains_target' ELSE 'other_response' END AS response_class FROM pool)
SELECT response_class, count(*) AS n, count(*) / (SELECT count(*) FROM c)::DOUBLE AS share FROM c GROUP BY ALL""", "share", "response_class n"),
    "match_rates": rounded_sql(f"""WITH {base.POOL}, t AS (SELECT model_name, lower(trim(target)) AS g, trim(regexp_replace(regexp_replace(lower(trim(coalesce(response, 'nan'))), '[^\\p{{L}}\\p{{N}}_\\- ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS r FROM pool)
SELECT model_name, count(*) AS n, avg(coalesce(r = g, false)::INT) AS exact_rate, avg(coalesce(list_contains(string_split(r, ' '), g), false)::INT) AS token_rate, avg(coalesce(string_split(r, ' ')[-1] = g, false)::INT) AS last_token_rate, avg(coalesce(contains(r, g), false)::INT) AS substring_rate FROM t GROUP BY ALL""", "exact_rate token_rate last_token_rate substring_rate", "model_name n"),
    "graded_scores": rounded_sql(f"WITH {_ANSWERS}\nSELECT pair_id, gold, normalized, is_exact_match, is_non_response, cosine_sim, binary_score FROM answers", "cosine_sim", "pair_id gold normalized is_exact_match is_non_response binary_score"),
    "naming_summary": rounded_sql(f"""WITH {_ANSWERS}, per AS (SELECT diagnosis, participant_id, count(*) AS n, sum(binary_score) AS b, sum(cosine_sim) AS g, sum(is_non_response::INT) AS nr FROM answers GROUP BY ALL)
SELECT *, graded_mean - binary_mean AS gain, CASE WHEN graded_mean - binary_mean > 0.05 THEN 'graded captures more' ELSE 'similar' END AS gain_label FROM (SELECT diagnosis, count(participant_id) AS n_users, sum(b) / sum(n) AS binary_mean, sum(g) / sum(n) AS graded_mean, stddev_samp(g / n) AS graded_std, sum(nr) / sum(n) AS non_response_rate FROM per GROUP BY diagnosis)""", "binary_mean graded_mean graded_std non_response_rate gain", "diagnosis n_users gain_label"),
    "eligibility_funnel": f"WITH {_ANSWERS} SELECT count(*) AS n_total, count(*) FILTER (is_non_response) AS n_non_response, count(*) FILTER (is_exact_match) AS n_exact, count(*) FILTER (is_non_response AND is_exact_match) AS n_both, count(*) FILTER (NOT is_non_response AND NOT is_exact_match) AS n_eligible FROM answers",
    "eligible_pairs": f"WITH {_ANSWERS} SELECT gold, normalized, arg_min({{'p': participant_id}}, coalesce(participant_id, '')).p AS participant_id FROM answers WHERE NOT is_non_response AND NOT is_exact_match GROUP BY ALL",
    "item_variation": rounded_sql(f"WITH {_ANSWERS}\nSELECT gold, count(*) AS n, avg(cosine_sim) AS value_mean, stddev_samp(cosine_sim) AS value_sd FROM answers GROUP BY gold ORDER BY value_sd DESC NULLS LAST, gold LIMIT 10", "value_mean value_sd", "gold n", 10),
    "fas_triplets": rf"""WITH {base.PARTICIPANTS}, flat AS (SELECT participant_id, string_split(array_to_string(list_transform(responses, lambda x: coalesce(x, '')), ','), ',') AS w FROM participants WHERE len(responses) > 0),
cells AS (SELECT participant_id, c AS cell_no, list_transform(w[3 * c + 1 : 3 * c + 3], lambda x: trim(x, ' ')) AS t FROM flat, range(0, 100000) r(c) WHERE 3 * c < len(w))
SELECT participant_id, cell_no::INT AS cell_no, {', '.join(f"lower(trim(CASE WHEN regexp_matches(coalesce(t[{i}], ''), '^<.*>$') THEN substr(t[{i}], 2, length(t[{i}]) - 2) ELSE coalesce(t[{i}], '') END, ' ')) AS word_{x}" for i, x in enumerate('fas', 1))}, len(list_filter(t, lambda x: x <> '')) AS n_compact FROM cells""",
    "meta_labels": r"""SELECT CASE WHEN k LIKE 'kategori%' OR k LIKE 'categor%' THEN 'Category' WHEN k LIKE 'gender%' THEN 'Gender' WHEN k LIKE 'age%' THEN 'Age' WHEN k LIKE 'mmse%' THEN 'MMSE' END AS field, count(*) AS n, count(*) FILTER (attr_value IS NULL OR lower(trim(attr_value, ' ')) IN ('nan', 'none', '')) AS n_null
FROM (SELECT attr_value, lower(trim(regexp_replace(attr_name, ':+$', ''), ' ')) AS k FROM meta_entries) GROUP BY ALL""",
    "unpivot_long": rounded_sql(f"WITH {base.PARTICIPANTS}\nSELECT participant_id, field, value FROM (SELECT participant_id, 'age' AS field, age AS value FROM participants UNION ALL SELECT participant_id, 'mmse', mmse FROM participants) WHERE value IS NOT NULL", "value", "participant_id field"),
    "consecutive_similarity": rounded_sql(f"WITH {_SIMS}\nSELECT label, vec_id, pos, sim FROM sims", "sim", "label vec_id pos"),
    "pairwise_similarity": rounded_sql(f"""WITH c AS (SELECT label, greatest({_COS}, 0.0) AS c FROM (SELECT x.label, x.embedding AS a, y.embedding AS b FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id)), s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT label, any_value(n) AS n, count(*) AS n_pairs, avg(c) AS mean, max(c) AS max FROM c JOIN s USING (label) GROUP BY label""", "mean max", "label n n_pairs"),
    "similarity_profile": rounded_sql(f"WITH {_SIMS}\n" + _profile_sql("sims", "label"), "mean_consecutive_similarity temporal_gradient similarity_slope", "label n_words", 9),
    "svf_chain_clusters": rounded_sql(f"WITH {_SIMS}\nSELECT label, {_METRICS} FROM {_clusters_sql('sims', 'label', 'sim >= 0.05')} GROUP BY label", "mean_cluster_size", "label cluster_count switch_count max_cluster_size"),
    "threshold_sweep": rounded_sql(f"WITH {_SIMS}, grid AS (SELECT *, t / 1000.0::DOUBLE AS threshold FROM sims, range(0, 301, 25) r(t))\nSELECT label, threshold, {_METRICS} FROM {_clusters_sql('grid', 'label, threshold', 'sim >= threshold')} GROUP BY ALL", "threshold mean_cluster_size", "label cluster_count switch_count max_cluster_size"),
    "model_health": rounded_sql(f"""WITH c AS (SELECT same, {_COS} AS c FROM (SELECT x.label = y.label AS same, x.embedding AS a, y.embedding AS b FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id))
SELECT *, CASE WHEN std < 0.05 THEN 'COLLAPSED' WHEN separation < 0.05 THEN 'POOR-SEP' WHEN mean > 0.95 THEN 'HIGH-MEAN' ELSE 'ok' END AS flag FROM (SELECT (SELECT count(*) FROM embeddings) AS n, avg(c) AS mean, stddev_pop(c) AS std, min(c) AS min, max(c) AS max, avg(c) FILTER (same) - avg(c) FILTER (NOT same) AS separation FROM c)""", "mean std min max separation", "n flag"),
    "fluency_counts": f"WITH {base.WORDS} SELECT participant_id, count(*) AS total_words, count(DISTINCT word) AS unique_words, count(*) - count(DISTINCT word) AS repetitions FROM words GROUP BY ALL",
    "svf_profile": rounded_sql(f"""WITH {_WORD_SIMS}, prof AS ({_profile_sql('wsims', 'participant_id')}), clu AS (SELECT participant_id, {_METRICS} FROM {_clusters_sql('wsims', 'participant_id', 'sim >= 0.1')} GROUP BY ALL)
SELECT participant_id, diagnosis, n_words, mean_consecutive_similarity, temporal_gradient, similarity_slope, coalesce(cluster_count, 0) AS cluster_count, coalesce(switch_count, 0) AS switch_count, mean_cluster_size, coalesce(max_cluster_size, 0) AS max_cluster_size FROM participants LEFT JOIN prof USING (participant_id) LEFT JOIN clu USING (participant_id)""", "mean_consecutive_similarity temporal_gradient similarity_slope mean_cluster_size", "participant_id diagnosis n_words cluster_count switch_count max_cluster_size"),
    "letter_counts": f"WITH {base.WORDS}, {_LETTERS} {_COUNTS}",
    "fas_totals": rounded_sql(f"""WITH {base.WORDS}, {_LETTERS}, counts AS ({_COUNTS}), g AS (SELECT participant_id, {', '.join(f"coalesce(sum({k}) FILTER (letter = '{x}'), 0)::BIGINT AS {k}_{x}" for k in ('total', 'valid') for x in 'fas')}, sum(flagged)::BIGINT AS proper_nouns_count, sum(repetitions)::BIGINT AS repetitions_count FROM counts GROUP BY ALL)
SELECT *, valid_f + valid_a + valid_s AS total_fas_score, list_stddev_pop([valid_f, valid_a, valid_s]) AS letter_asymmetry FROM g""", "letter_asymmetry", "participant_id total_f total_a total_s valid_f valid_a valid_s proper_nouns_count repetitions_count total_fas_score"),
    "phonemic_links": f"WITH {base.WORDS}, {_ADJACENT}, ab AS (SELECT a, b, count(*) AS n FROM adj WHERE a IS NOT NULL GROUP BY ALL) SELECT a, b, n, {_R1} AS same_onset, {_R2} AS same_rime, {_R3} AS one_vowel_apart, {_R1} OR {_R2} OR {_R3} AS linked FROM ab",
    "phonemic_clusters": rounded_sql(f"WITH {base.WORDS}, {_ADJACENT}\nSELECT participant_id, {_METRICS} FROM {_clusters_sql('adj', 'participant_id', f'{_R1} OR {_R2} OR {_R3}')} GROUP BY ALL", "mean_cluster_size", "participant_id cluster_count switch_count max_cluster_size"),
    "pooled_letter_clusters": rounded_sql(f"""WITH {base.WORDS}, {_LETTERS}, firsts AS (SELECT participant_id, letter, word, min(pos) AS place FROM letters WHERE NOT is_flagged GROUP BY ALL),
adj AS (SELECT participant_id, letter, row_number() OVER w - 1 AS pos, lag(word) OVER w AS a, word AS b FROM firsts WINDOW w AS (PARTITION BY participant_id, letter ORDER BY place))
SELECT participant_id, count(*) AS cluster_count_total, count(*) - count(DISTINCT letter) AS switch_count_total, avg(size) AS mean_cluster_size FROM {_clusters_sql('adj', 'participant_id, letter', f'{_R1} OR {_R2} OR {_R3}')} GROUP BY participant_id""", "mean_cluster_size", "participant_id cluster_count_total switch_count_total"),
    # this SQL's levenshtein counts bytes, so the letters beyond ASCII are mapped to single bytes first
    "edit_distance_adjacent": rounded_sql(f"WITH {base.WORDS}, {_ADJACENT}, t AS (SELECT participant_id, length(a) AS la, length(b) AS lb, translate(a, 'åäöé', '1234') AS a, translate(b, 'åäöé', '1234') AS b FROM adj)\nSELECT participant_id, avg(levenshtein(a, b) / greatest(la, lb)::DOUBLE) AS mean_edit_distance FROM t GROUP BY participant_id", "mean_edit_distance", "participant_id"),
    "word_zipf_mean": rounded_sql(f"WITH {base.WORDS}, {_FREQ}\nSELECT participant_id, avg(coalesce(zipf, 0)) AS mean_word_frequency FROM (SELECT DISTINCT participant_id, word FROM words) LEFT JOIN freq ON word = token GROUP BY participant_id", "mean_word_frequency", "participant_id"),
    "vocab_coverage": rounded_sql(f"WITH {base.WORDS}, {base.TOKENS}, h AS (SELECT word, word IN (SELECT token FROM tokens) AS hit FROM (SELECT DISTINCT word FROM words))\nSELECT count(*) AS n_words, count(*) FILTER (hit) AS covered, count(*) FILTER (NOT hit) AS oov, coalesce(avg(hit::INT), 0) AS rate FROM h", "rate", "n_words covered oov"),
    "group_means": rounded_sql(f"WITH {_SCORED}\nSELECT diagnosis, count(*) AS n, " + ", ".join(f"{f}({m}) AS {m}_{k}" for m in ("total_words", "unique_words", "repetitions") for k, f in (("mean", "avg"), ("sd", "stddev_samp"), ("min", "min"), ("max", "max"))) + " FROM scored GROUP BY diagnosis", " ".join(f"{m}_{k}" for m in ("total_words", "unique_words", "repetitions") for k in ("mean", "sd", "min", "max")), "diagnosis n"),
    "demographics": rounded_sql(f"WITH {base.PARTICIPANTS}\nSELECT diagnosis, count(*) AS n, count(*) FILTER (upper(gender) = 'F') AS n_women, avg(age) AS age_mean, stddev_samp(age) AS age_sd, min(age) AS age_min, max(age) AS age_max, count(*) / (SELECT count(*) FROM participants)::DOUBLE AS share FROM participants GROUP BY diagnosis", "age_mean age_sd age_min age_max share", "diagnosis n n_women"),
    "value_counts": rounded_sql(f"WITH {base.WORDS}\nSELECT word, count(*) AS n, count(*) / (SELECT count(*) FROM words)::DOUBLE AS share FROM words GROUP BY word", "share", "word n", 9),
    "topk_per_group": f"WITH {base.WORDS}, c AS (SELECT diagnosis, word, count(*) AS n FROM words JOIN participants USING (participant_id) GROUP BY ALL) SELECT * FROM (SELECT diagnosis, word, n, row_number() OVER (PARTITION BY diagnosis ORDER BY n DESC, word) AS position FROM c) WHERE position <= 3",
    "rare_values": f"WITH {base.WORDS} SELECT word, count(*) AS n FROM words GROUP BY word HAVING count(*) <= 2",
    "repeated_words": f"WITH {base.WORDS} SELECT participant_id, word, count(*) AS n FROM words GROUP BY ALL HAVING count(*) > 1",
    "response_rollup": rounded_sql(f"WITH {base.POOL}\nSELECT target, response, count(*) AS n, arg_min(cosine_sim, pair_id) AS first_value, coalesce(string_agg(DISTINCT diagnosis, ', ' ORDER BY diagnosis), '') AS labels FROM pool GROUP BY ALL", "first_value", "target response n labels"),
    "quartile_contingency": f"WITH {base.POOL} SELECT cosine_quartile, count(*) FILTER (diagnosis = 'HC') AS n_hc, count(*) FILTER (diagnosis = 'MCI') AS n_mci, count(*) FILTER (diagnosis = 'non-AD') AS n_non_ad, count(*) FILTER (diagnosis = 'AD') AS n_ad FROM pool GROUP BY ALL",
    "text_lengths": rounded_sql("WITH x AS (SELECT * FROM sq3_pairs WHERE response IS NOT NULL)\nSELECT target, count(*) AS n, avg(length(response)) AS mean_length, median(length(response)) AS median_length, max(length(response))::BIGINT AS max_length, count(DISTINCT lower(trim(response))) AS n_distinct FROM x GROUP BY target", "mean_length median_length", "target n max_length n_distinct"),
    "missing_cells": "\nUNION ALL\n".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_missing, count(*) AS n_rows FROM sq3_pairs" for c in ("target", "response", "cosine_sim", "cosine_quartile", "participant_id", "diagnosis", "model")),
    "cross_test_summary": "SELECT test_code, count(*) AS n_entries, count(DISTINCT participant_id) AS n_participants FROM meta_entries GROUP BY 1 UNION ALL SELECT 'svf lists', count(*), count(DISTINCT participant_id) FROM svf_participant",
    "item_by_group": rounded_sql(f"WITH {_ANSWERS}\nSELECT gold, diagnosis, count(*) AS n, avg(cosine_sim) AS value_mean, stddev_samp(cosine_sim) AS value_sd, min(cosine_sim) AS value_min, max(cosine_sim) AS value_max FROM answers GROUP BY ALL", "value_mean value_sd value_min value_max", "gold diagnosis n", 10),
    "accuracy_by_category": rounded_sql(f"WITH {_ANSWERS}, per AS (SELECT gold, model_name, avg((cosine_sim >= 0.5)::INT) AS a FROM answers GROUP BY ALL)\nSELECT model_name, count(*) AS n_items, avg(a) AS accuracy_mean, stddev_samp(a) AS accuracy_sd FROM per GROUP BY ALL", "accuracy_mean accuracy_sd", "model_name n_items"),
    "most_words": rounded_sql(f"WITH {_SCORED}\nSELECT diagnosis, total_words, participant_id FROM (SELECT *, row_number() OVER (PARTITION BY diagnosis ORDER BY total_words DESC, participant_id) AS r FROM scored) WHERE r = 1", "total_words", "diagnosis participant_id"),
    "model_comparison": rounded_sql(f"""WITH {base.POOL}, src AS (SELECT model_name, diagnosis, cosine_sim AS value FROM pool WHERE model_name IS NOT NULL), kw AS {_kruskal_sql('src', 'model_name', 2)},
g AS (SELECT model_name, diagnosis, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM src WHERE value IS NOT NULL GROUP BY ALL), dd AS (SELECT model_name, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS d FROM g a JOIN g b USING (model_name) WHERE a.diagnosis = 'HC' AND b.diagnosis = 'AD')
SELECT model_name, k, n, h, d FROM kw JOIN dd USING (model_name)""", "h d", "model_name k n"),
    "users_of_all_tests": "SELECT participant_id FROM meta_entries GROUP BY participant_id HAVING count(DISTINCT test_code) = 3",
    "quartile_assign": f"WITH {base.POOL}, q AS (SELECT quantile_cont(cosine_sim::DOUBLE, [0.25, 0.5, 0.75]) AS e FROM pool) SELECT CASE WHEN cosine_sim <= e[1] THEN 0 WHEN cosine_sim <= e[2] THEN 1 WHEN cosine_sim <= e[3] THEN 2 WHEN cosine_sim IS NOT NULL THEN 3 END AS quartile, count(*) AS n, min(cosine_sim) AS lo, max(cosine_sim) AS hi FROM pool, q GROUP BY 1",
    "semi_anti_split": f"WITH {base.CURRENT}, {base.POOL} SELECT pair_id, target, CASE WHEN pair_id IN (SELECT pair_id FROM current) THEN 'rated' ELSE 'unrated' END AS part FROM pool",
    "fan_out_join": rounded_sql(f"WITH {base.POOL}, s AS (SELECT pair_id, target, response FROM sq3_anchors UNION ALL SELECT min(pair_id), target, response FROM pool GROUP BY target, response)\nSELECT s.pair_id, count(*) AS n, avg(cosine_sim) AS mean_cosine FROM s JOIN pool p ON s.target = p.target AND s.response = p.response GROUP BY s.pair_id", "mean_cosine", "pair_id n", 9),
    "test_retest": rounded_sql(f"""WITH {_RELIABLE}, ok AS (SELECT * FROM ab), r AS (SELECT rank() OVER (ORDER BY ra) + (count(*) OVER (PARTITION BY ra) - 1) / 2.0 AS x, rank() OVER (ORDER BY rb) + (count(*) OVER (PARTITION BY rb) - 1) / 2.0 AS y FROM ok)
SELECT *, {_FLAG} FROM (SELECT count(*) AS n_pairs, {_KW} AS weighted_kappa, (SELECT corr(x, y) FROM r) AS spearman_rho, {_kappa_sql('ca', 'cb')} AS category_kappa, {_kappa_sql('ia', 'ib')} AS compound_kappa FROM ab)""", "weighted_kappa spearman_rho category_kappa compound_kappa", "n_pairs interpretability"),
    "test_retest_by_rater": rounded_sql(f"WITH {_RELIABLE}\nSELECT *, {_FLAG} FROM (SELECT rater_id, count(*) AS n_pairs, {_KW} AS weighted_kappa FROM ab GROUP BY rater_id)", "weighted_kappa", "rater_id n_pairs interpretability"),
    "confusion_2x2": f"WITH {_J} SELECT t AS true_label, p AS predicted_label, count(*) FILTER ((rating >= 1.5)::INT = t AND (cosine_sim >= 0.5)::INT = p) AS n FROM j, (VALUES (0), (1)) a(t), (VALUES (0), (1)) b(p) GROUP BY ALL",
    "spearman_by_model": rounded_sql(_spearman_sql("model_name"), "spearman_rho", "model_name n below_min_n"),
    "spearman_by_quartile": rounded_sql(_spearman_sql("model_name, cosine_quartile"), "spearman_rho", "model_name cosine_quartile n below_min_n"),
    "spearman_by_category": rounded_sql(_spearman_sql("model_name, category", 15), "spearman_rho", "model_name category n below_min_n"),
    "kruskal_words": rounded_sql(f"WITH {_SCORED}, long AS (UNPIVOT (SELECT participant_id, diagnosis, total_words, unique_words, repetitions FROM scored) ON total_words, unique_words, repetitions INTO NAME metric VALUE value), kw AS {_kruskal_sql('long', 'metric')}\nSELECT metric, k, n, h FROM kw", "h", "metric k n"),
    "threshold_kruskal": rounded_sql(f"""WITH {_WORD_SIMS}, grid AS (SELECT *, t / 1000.0::DOUBLE AS threshold FROM wsims, range(0, 301, 25) r(t)), m AS (SELECT participant_id, threshold, {_METRICS} FROM {_clusters_sql('grid', 'participant_id, threshold', 'sim >= threshold')} GROUP BY ALL),
md AS (SELECT threshold, diagnosis, mean_cluster_size::DOUBLE AS mean_cluster_size, switch_count::DOUBLE AS switch_count, cluster_count::DOUBLE AS cluster_count FROM m JOIN participants USING (participant_id)), long AS (UNPIVOT md ON mean_cluster_size, switch_count, cluster_count INTO NAME metric VALUE value), kw AS {_kruskal_sql('long', 'metric, threshold', 2)}
SELECT metric, best.t AS threshold, best.h AS h FROM (SELECT metric, arg_max({{'t': threshold, 'h': h}}, (h, -threshold)) AS best FROM kw WHERE h IS NOT NULL GROUP BY metric)""", "threshold h", "metric"),
    "cohens_d": rounded_sql(f"""WITH {_SCORED}, g AS (SELECT diagnosis, count(*) AS n, avg(total_words) AS m, var_samp(total_words) AS v FROM scored GROUP BY diagnosis), w AS (SELECT * FROM (VALUES ('HC', 'MCI'), ('HC', 'non-AD'), ('HC', 'AD'), ('MCI', 'AD')) x(group_a, group_b))
SELECT *, CASE WHEN d IS NULL THEN 'n/a' WHEN abs(d) >= 0.8 THEN 'large' WHEN abs(d) >= 0.5 THEN 'medium' WHEN abs(d) >= 0.2 THEN 'small' ELSE 'negligible' END AS magnitude FROM (SELECT group_a, group_b, a.n AS n_a, b.n AS n_b, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS d FROM w JOIN g a ON a.diagnosis = group_a JOIN g b ON b.diagnosis = group_b)""", "d", "group_a group_b n_a n_b magnitude"),
    "residual_kruskal": rounded_sql(f"""WITH {_SCORED}, fit AS (SELECT regr_slope(total_words, age) AS s, regr_intercept(total_words, age) AS i FROM scored), long AS (SELECT 'x' AS metric, diagnosis, round(total_words - (s * age + i), 9) AS value FROM scored, fit), kw AS {_kruskal_sql('long', 'metric')}
SELECT k, n, h FROM kw""", "h", "k n", 4),
    "correlation_table": rounded_sql(f"WITH {_SCORED}, long AS (UNPIVOT (SELECT mmse, total_words, unique_words, repetitions, age FROM scored) ON total_words, unique_words, repetitions, age INTO NAME feature VALUE value)\nSELECT feature, count(mmse) AS n, corr(value, mmse) AS r, coalesce(abs(corr(value, mmse)) > 0.3, false) AS passes FROM long GROUP BY feature", "r", "feature n passes"),
    "divergence_catalog": rounded_sql(f"WITH {_J}, e AS (SELECT *, abs(rating / 3 - cosine_sim) AS disagreement FROM j), q AS (SELECT quantile_cont(disagreement, 0.9) AS q FROM e)\nSELECT pair_id, target, response, rating, cosine_sim, disagreement, category, is_compound, coalesce(disagreement > q, false) AS is_divergence_case FROM e, q", "rating cosine_sim disagreement", "pair_id target response category is_compound is_divergence_case"),
    "graph_depth": f"WITH RECURSIVE {_GRAPH} SELECT sense, depth FROM walk",
    "graph_ancestors": f"WITH RECURSIVE {_GRAPH} SELECT sense, path[i] AS ancestor, depth - i + 1 AS hops, i - 1 AS ancestor_depth FROM walk, range(1, 100) r(i) WHERE i <= len(path)",
    "wu_palmer": rounded_sql(f"WITH RECURSIVE {_GRAPH}, {_PAIRS}\nSELECT s1, s2, CASE WHEN a.path IS NULL OR b.path IS NULL THEN NULL WHEN s1 = s2 THEN 1.0 ELSE 2.0 * (len(list_filter(range(1, least(len(a.path), len(b.path)) + 1), lambda i: a.path[i] = b.path[i])) - 1) / nullif(a.depth + b.depth, 0) END::DOUBLE AS wu_palmer FROM pairs LEFT JOIN walk a ON a.sense = s1 LEFT JOIN walk b ON b.sense = s2", "wu_palmer", "s1 s2"),
    "graph_path": f"WITH RECURSIVE {_GRAPH}, {_PAIRS}, {_BFS} SELECT s1, s2, path_length FROM len",
    "graph_relations": f"WITH RECURSIVE {_GRAPH}, {_PAIRS}, {_BFS} SELECT CASE WHEN path_length = 1 THEN 'mother(t→r)' WHEN path_length = 2 THEN 'm-sibling' WHEN path_length <= 3 THEN 'near' ELSE 'far' END AS relation, count(*) AS n FROM len GROUP BY 1",
    "graph_stats": f"WITH RECURSIVE {_GRAPH} SELECT (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS n_senses, (SELECT count(*) FROM edges WHERE label = 'primary') AS n_primary, (SELECT count(*) FROM edges WHERE label = 'secondary') AS n_secondary, count(*) AS n_connected, max(depth) AS max_depth FROM walk",
    "graph_agreement": rounded_sql(f"""WITH RECURSIVE {_GRAPH}, {base.RATED}, {base.POOL}, w AS (SELECT DISTINCT form, 's' || (('0x' || substr(md5(form), 1, 8))::BIGINT % (SELECT count(*) FROM part)) AS sense FROM (SELECT target AS form FROM pool UNION ALL SELECT response FROM pool) WHERE form IS NOT NULL),
tr AS (SELECT DISTINCT target, response, a.sense AS s1, b.sense AS s2 FROM pool LEFT JOIN w a ON a.form = target LEFT JOIN w b ON b.form = response), pairs AS (SELECT DISTINCT s1, s2 FROM tr WHERE s1 IS NOT NULL AND s2 IS NOT NULL), {_BFS},
sim AS (SELECT target, response, 1.0 / (1 + path_length) AS path_similarity, CASE WHEN a.path IS NULL OR b.path IS NULL THEN NULL WHEN s1 = s2 THEN 1.0 ELSE 2.0 * (len(list_filter(range(1, least(len(a.path), len(b.path)) + 1), lambda i: a.path[i] = b.path[i])) - 1) / nullif(a.depth + b.depth, 0) END::DOUBLE AS wu_palmer
  FROM tr LEFT JOIN len USING (s1, s2) LEFT JOIN walk a ON a.sense = s1 LEFT JOIN walk b ON b.sense = s2),
long AS (SELECT 'path_similarity' AS measure, rating, path_similarity::DOUBLE AS value FROM rated JOIN pool USING (pair_id) LEFT JOIN sim USING (target, response) UNION ALL SELECT 'wu_palmer', rating, wu_palmer FROM rated JOIN pool USING (pair_id) LEFT JOIN sim USING (target, response)),
r AS (SELECT measure, rank() OVER (PARTITION BY measure ORDER BY rating) + (count(*) OVER (PARTITION BY measure, rating) - 1) / 2.0 AS x, rank() OVER (PARTITION BY measure ORDER BY value) + (count(*) OVER (PARTITION BY measure, value) - 1) / 2.0 AS y FROM long WHERE value IS NOT NULL)
SELECT measure, any_value(n) AS n, any_value(n_oov) AS n_oov, any_value(oov_rate) AS oov_rate, corr(x, y) AS spearman_rho FROM r JOIN (SELECT measure, count(value) AS n, count(*) - count(value) AS n_oov, 1 - count(value) / count(*)::DOUBLE AS oov_rate FROM long GROUP BY measure) USING (measure) GROUP BY measure""", "oov_rate spearman_rho", "measure n n_oov"),
    "ridge_closed_form": rounded_sql(f"""WITH {_SCORED}, x AS (SELECT age AS a, total_words AS b, mmse AS y FROM scored WHERE mmse IS NOT NULL AND age IS NOT NULL), m AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy FROM x),
s AS (SELECT *, n + 1.0 AS p, n * ab / (sa * sb) AS q, n * ay / sa AS u, n * byy / sb AS v FROM m), w AS (SELECT *, (u * p - q * v) / (p * p - q * q) / sa AS b_age, (v * p - q * u) / (p * p - q * q) / sb AS b_words FROM s)
SELECT n, my - b_age * ma - b_words * mb AS intercept, b_age, b_words FROM w""", "intercept b_age b_words", "n", 5),
}
