"""Human ratings against each other and against models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions.text import interpretability, truthy
from lexspark.operators import stats
from lexspark.operators.ranking import running_offset, spread_key
from lexspark.session import cut

#: The closed lists a rating file is checked against.
RATINGS = (0, 1, 2, 3)
CATEGORIES = ("coordinate", "hypernym", "hyponym", "circumlocution", "phonological", "unrelated", "other")


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}")


def rating_problems(df: DataFrame) -> DataFrame:
    """One row: how many ratings are null or impossible and how many categories unknown."""
    return df.agg(F.count_if(F.col("rating").isNull()).alias("n_null"), F.count_if(~F.col("rating").isin(*RATINGS)).alias("n_impossible"), F.count_if(~F.col("category").isin(*CATEGORIES)).alias("n_unknown"))


def validate_ratings(df: DataFrame) -> None:
    """An error that names what is wrong: null ratings, ratings or categories outside the closed lists."""
    require(df, ("pair_id", "rating", "category", "is_compound"))
    bad = rating_problems(df).first()
    if any(bad):
        raise ValueError(f"{bad[0]} null ratings, {bad[1]} impossible ratings, {bad[2]} unknown categories")


def check_missing_share(df: DataFrame, columns: Sequence[str], most: float = 0.1) -> DataFrame:
    """df without rows where one of the columns is null; an error if they are more than `most` of all."""
    null = F.lit(False)
    for c in columns:
        null = null | F.col(c).isNull()
    n, bad = df.agg(F.count("*"), F.count_if(null)).first()
    if n and bad / n > most:
        raise ValueError(f"{bad} of {n} rows lack {', '.join(columns)}")
    return df.dropna(subset=list(columns))


def current_judgements(ratings: DataFrame) -> DataFrame:
    """(rater_id, pair_id, rating_round, rating, category, is_compound): the last judgement of a rater on a pair in a
    round, with rating 0..3, the category in lower case if known, the flag as boolean."""
    cat = F.lower(F.trim(F.col("category")))
    rows = ratings.filter(F.col("rating").isin(*RATINGS)).select("rater_id", "pair_id", "rating_round", "rated_at", "rating_id", "rating", F.when(cat.isin(*CATEGORIES), cat).alias("category"), F.when(F.col("is_compound").isNotNull(), truthy(F.col("is_compound"))).alias("is_compound"))
    last = rows.groupBy("rater_id", "pair_id", "rating_round").agg(F.max(F.struct("rated_at", "rating_id", "rating", "category", "is_compound")).alias("s"))
    return last.select("rater_id", "pair_id", "rating_round", "s.rating", "s.category", "s.is_compound")


def reliability(a: DataFrame, b: DataFrame, by: Sequence[str] = (), on: Sequence[str] = ("pair_id",)) -> DataFrame:
    """by, n_pairs, weighted_kappa (quadratic), spearman_rho, category_kappa, compound_kappa, interpretability of two
    sets of judgements on the pairs they share."""
    cols = ("rating", "category", "is_compound")
    j = a.select(*by, *on, *[F.col(c).alias(f"{c}_a") for c in cols]).join(b.select(*by, *on, *[F.col(c).alias(f"{c}_b") for c in cols]), [*by, *on])
    out = stats.weighted_kappa(j, "rating_a", "rating_b", by).withColumnRenamed("n", "n_pairs")
    parts = [stats.spearman(j, "rating_a", "rating_b", by).drop("n"), stats.kappa(j, "category_a", "category_b", by).drop("n").withColumnRenamed("kappa", "category_kappa"), stats.kappa(j, "is_compound_a", "is_compound_b", by).drop("n").withColumnRenamed("kappa", "compound_kappa")]
    key = list(by) or ["_k"]
    if not by:
        out, parts = out.withColumn("_k", F.lit(1)), [p.withColumn("_k", F.lit(1)) for p in parts]
    for p in parts:
        out = out.join(p, key, "left")
    return out.withColumn("interpretability", interpretability(F.col("weighted_kappa"))).select(*by, "n_pairs", "weighted_kappa", "spearman_rho", "category_kappa", "compound_kappa", "interpretability")


def reliability_summary(pairs: DataFrame) -> DataFrame:
    """One row of a table of `reliability` results: n_sets of them with a weighted kappa, mean_weighted_kappa and the
    one flag that says how far results may be read."""
    g = pairs.agg(F.count("weighted_kappa").alias("n_sets"), F.avg("weighted_kappa").alias("mean_weighted_kappa"))
    return g.withColumn("interpretability", interpretability(F.col("mean_weighted_kappa")))


def consolidate(files: Sequence[DataFrame]) -> DataFrame:
    """One row per pair that every rater judged: the mean rating; category and flag of the first rater."""
    rated = [f.select("pair_id", "rating", "category", "is_compound", F.lit(i).alias("_i")) for i, f in enumerate(files)]
    rows = rated[0]
    for r in rated[1:]:
        rows = rows.unionByName(r)
    g = rows.groupBy("pair_id").agg(F.count_distinct("_i").alias("_k"), F.avg("rating").alias("rating"), F.min_by("category", "_i").alias("category"), F.min_by("is_compound", "_i").alias("is_compound"))
    return g.filter(F.col("_k") == len(files)).drop("_k")


def missing_pairs(expected: DataFrame, rated: DataFrame) -> DataFrame:
    return expected.select("pair_id").distinct().join(rated.select("pair_id"), "pair_id", "left_anti")


def model_agreement(rated: DataFrame, cosines: DataFrame, by: Sequence[str] = ("model_name",), min_n: int = 2) -> DataFrame:
    """by, n, spearman_rho of mean ratings and cosines joined on pair_id, below_min_n; rho null below min_n."""
    j = rated.join(cosines, "pair_id")
    return stats.spearman(j, "rating", "cosine_sim", by, min_n).withColumn("below_min_n", F.col("n") < min_n)


def fan_out(models: DataFrame, sample: DataFrame) -> DataFrame:
    """Model scores (gold, raw_response, cosine_sim) of sampled pairs (pair_id, target, response): a pair comes once
    per participant who gave that answer."""
    m = models.select(F.col("gold").alias("_g"), F.col("raw_response").alias("_r"), "model_name", "cosine_sim")
    return sample.select("pair_id", "target", "response").join(m, (F.col("target") == F.col("_g")) & (F.col("response") == F.col("_r"))).drop("_g", "_r")


def divergence_catalog(rated: DataFrame, pairs: DataFrame, percentile: float = 0.9, relations: DataFrame | None = None) -> DataFrame:
    """Pairs with their disagreement |rating / 3 - cosine| and whether it exceeds (strictly) its percentile over all.
    The threshold is one number, exact and interpolated."""
    require(rated, ("pair_id", "rating"))
    require(pairs, ("pair_id", "cosine_sim"))
    j = cut(rated.join(pairs, "pair_id").withColumn("disagreement", F.abs(F.col("rating") / 3 - F.col("cosine_sim"))), "disagreement")
    limit = next(iter(stats.exact_percentiles(j, "disagreement", [percentile])), None)
    out = j.withColumns({"is_divergence_case": F.coalesce(F.col("disagreement") > F.lit(limit), F.lit(False)), "threshold_value": F.lit(limit).cast("double"), "threshold_percentile": F.lit(100 * percentile)})
    return out.join(relations, ["target", "response"], "left") if relations is not None else out


def ranked_catalog(catalog: DataFrame) -> DataFrame:
    """The catalog with `position`, from 1: the greatest disagreement first, pair_id deciding ties, null last. The place
    is a bucketed rank, so the order survives however the table is stored and no task sorts all of it."""
    known = cut(catalog.filter(F.col("disagreement").isNotNull()).withColumn("_d", -F.col("disagreement")), "catalog")
    ranked = running_offset(known, [], spread_key(known, "_d"), ties=["_d", "pair_id"], name="position").withColumn("position", F.col("position") + 1).drop("_d")
    return ranked.unionByName(catalog.filter(F.col("disagreement").isNull()).withColumn("position", F.lit(None).cast("bigint")))


def graph_agreement(rated: DataFrame, pairs: DataFrame, similarity: DataFrame, n_boot: int = 0, seed: int = 20260507) -> DataFrame:
    """measure (path_similarity, wu_palmer), n, n_oov, oov_rate, spearman_rho of mean ratings and graph similarities, and
    with `n_boot` resamples ci_low, ci_high. Pairs without a similarity count as out of vocabulary, those in the
    vocabulary but without a path too. `similarity`: target, response, path_similarity, wu_palmer."""
    j = rated.select("pair_id", "rating").join(pairs.select("pair_id", "target", "response"), "pair_id").join(similarity, ["target", "response"], "left")
    long = j.unpivot(["pair_id", "rating"], ["path_similarity", "wu_palmer"], "measure", "value")
    long = cut(long, "measures") if n_boot else long
    counts = long.groupBy("measure").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("value").isNull()).alias("n_oov"))
    rho = stats.spearman(long, "rating", "value", ["measure"])
    out = counts.join(rho, "measure", "left").select("measure", F.coalesce("n", F.lit(0)).alias("n"), "n_oov", (F.col("n_oov") / F.col("n_pairs")).alias("oov_rate"), "spearman_rho")
    return out.join(stats.bootstrap_spearman(long, "rating", "value", ["measure"], "pair_id", n_boot, seed).select("measure", "ci_low", "ci_high"), "measure", "left") if n_boot else out


def with_interval(rated: DataFrame, cosines: DataFrame, by: Sequence[str] = ("model_name",), min_n: int = 3, n_boot: int = 1000, seed: int = 20260507) -> DataFrame:
    """`model_agreement` with the bootstrap interval: by, n, spearman_rho, ci_low, ci_high, below_min_n; all three null
    below min_n."""
    b = stats.bootstrap_spearman(rated.join(cosines, "pair_id"), "rating", "cosine_sim", by, "pair_id", n_boot, seed)
    low = F.col("n") < min_n
    return b.select(*by, "n", *[F.when(~low, F.col(c)).alias(c) for c in ("spearman_rho", "ci_low", "ci_high")], low.alias("below_min_n"))
