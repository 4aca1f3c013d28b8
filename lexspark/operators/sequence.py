"""Ordered-sequence metrics: adjacent similarities, chain clusters, gradients, fluency counts.

A sequence is a participant's answers in order; windows run over (participant[, letter]) and order key, everything else
is a two-level aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.operators.ranking import running_offset, running_offsets, spread_key
from lexspark.operators.strdist import linked, normalized_edit_distance
from lexspark.session import cut


def _first_half(sims: str = "m") -> Column:
    return F.floor(F.col(sims) / 2)


def similarity_profile(sims: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, n_words, mean_consecutive_similarity, temporal_gradient, similarity_slope of rows (by, pos, sim), where sim
    is null at pos 0. Gradient: mean of the first half of the m similarities less the mean of the rest (the odd one
    counts to the second half), null for m < 2. Slope: least squares on the index 0..m-1, null for m < 2. Null
    similarities beyond the first are left out of the means."""
    i = F.col("pos") - 1
    counted = sims.join(sims.groupBy(*by).agg((F.count("*") - 1).alias("m")), list(by))
    first, rest = F.avg(F.when((i >= 0) & (i < _first_half()), F.col("sim"))), F.avg(F.when(i >= _first_half(), F.col("sim")))
    slope = F.regr_slope(F.when(i >= 0, F.col("sim")), F.when(i >= 0, i.cast("double")))
    g = counted.groupBy(*by).agg(F.count("*").alias("n_words"), F.avg("sim").alias("mean_consecutive_similarity"), (first - rest).alias("temporal_gradient"), slope.alias("similarity_slope"), F.count("sim").alias("_m"))
    return g.select(*by, "n_words", "mean_consecutive_similarity", F.when(F.col("_m") >= 2, F.col("temporal_gradient")).alias("temporal_gradient"), F.when(F.col("_m") >= 2, F.col("similarity_slope")).alias("similarity_slope"))


def chain_clusters(rows: DataFrame, by: Sequence[str], order: str, joins: Column, long: bool = False) -> DataFrame:
    """`rows` with cluster_id (from 1): a row for which `joins` is not true opens a cluster. `joins` may look at values
    of the row before only through columns already there. `long` is for sequences of any length, numbered from 0 by
    `order`: the clusters opened so far are a bucketed running sum, no sequence is held in one task."""
    if long:
        rows = cut(rows, "rows")
        opened = rows.withColumn("_new", F.when((F.col(order) == 0) | ~F.coalesce(joins, F.lit(False)), 1).otherwise(0))
        before = running_offset(opened, by, spread_key(rows, order), F.col("_new"), ties=[order], name="_before")
        return before.withColumn("cluster_id", F.col("_before") + F.col("_new")).drop("_new", "_before")
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy(*by).orderBy(order)) == 1
    return rows.withColumn("_new", F.when(first | ~F.coalesce(joins, F.lit(False)), 1).otherwise(0)).withColumn("cluster_id", F.sum("_new").over(w)).drop("_new")


def detect_clusters(sims: DataFrame, by: Sequence[str], threshold: float = 0.45, method: str = "chain", long: bool = False) -> DataFrame:
    """Chain clusters of (by, pos, sim): a word joins the cluster of the one before at sim >= threshold."""
    if method != "chain":
        raise ValueError(f"unknown method {method!r}")
    return chain_clusters(sims, by, "pos", F.col("sim") >= threshold, long)


def cluster_metrics(clustered: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, cluster_count, switch_count, mean_cluster_size, max_cluster_size of non-empty sequences."""
    sizes = clustered.groupBy(*by, "cluster_id").agg(F.count("*").alias("size"))
    return sizes.groupBy(*by).agg(F.count("*").alias("cluster_count"), (F.count("*") - 1).alias("switch_count"), F.avg("size").alias("mean_cluster_size"), F.max("size").alias("max_cluster_size"))


def with_empty(metrics: DataFrame, participants: DataFrame, by: Sequence[str]) -> DataFrame:
    """All participants: those without a word have no cluster, no switch, a null mean and a greatest size of 0."""
    zero = ("cluster_count", "switch_count", "max_cluster_size")
    return participants.select(*by).distinct().join(metrics, list(by), "left").na.fill(0, [c for c in zero if c in metrics.columns])


def count_metrics(words: DataFrame, by: Sequence[str], word: str = "word") -> DataFrame:
    """by, total_words, unique_words, repetitions."""
    return words.groupBy(*by).agg(F.count("*").alias("total_words"), F.count_distinct(word).alias("unique_words")).withColumn("repetitions", F.col("total_words") - F.col("unique_words"))


def phonemic_clusters(words: DataFrame, by: Sequence[str], order: str = "pos", word: str = "word") -> DataFrame:
    """Chain clusters by the sound rules of adjacent words."""
    prev = F.lag(word).over(Window.partitionBy(*by).orderBy(order))
    return chain_clusters(words.withColumn("_p", prev), by, order, linked(F.col("_p"), F.col(word))).drop("_p")


def pooled_clusters(clustered: DataFrame, participant: Sequence[str], letter: str = "letter") -> DataFrame:
    """Over all letters of a participant: cluster_count_total, switch_count_total (within letters) and
    mean_cluster_size over the pooled clusters (not a mean of means)."""
    sizes = clustered.groupBy(*participant, letter, "cluster_id").agg(F.count("*").alias("size"))
    return sizes.groupBy(*participant).agg(F.count("*").alias("cluster_count_total"), (F.count("*") - F.count_distinct(letter)).alias("switch_count_total"), F.avg("size").alias("mean_cluster_size"))


def letter_counts(words: DataFrame, by: Sequence[str], word: str = "word", flagged: str = "is_flagged") -> DataFrame:
    """by, total, flagged, repetitions = total - distinct, valid = max(0, total - flagged - repetitions): a flagged
    word said twice is subtracted twice. Blank words are no words."""
    said = words.filter(F.trim(word) != "")
    g = said.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col(flagged)).alias("flagged"), F.count_distinct(word).alias("_d"))
    return g.select(*by, "total", "flagged", (F.col("total") - F.col("_d")).alias("repetitions"), F.greatest(F.col("_d") - F.col("flagged"), F.lit(0)).alias("valid"))


def fas_totals(counts: DataFrame, participant: Sequence[str], letter: str = "letter", letters: Sequence[str] = ("f", "a", "s")) -> DataFrame:
    """One row per participant: total_x and valid_x of each letter, total_fas_score, proper_nouns_count,
    repetitions_count, letter_asymmetry (population deviation of the valid counts)."""
    g = counts.groupBy(*participant).agg(
        *[F.coalesce(F.sum(F.when(F.col(letter) == x, F.col(k))), F.lit(0)).alias(f"{k}_{x}") for k in ("total", "valid") for x in letters],
        F.sum("flagged").alias("proper_nouns_count"), F.sum("repetitions").alias("repetitions_count"),
    )
    valid = [F.col(f"valid_{x}") for x in letters]
    mean = sum(valid[1:], valid[0]) / len(letters)
    spread = sum(((v - mean) * (v - mean) for v in valid[1:]), (valid[0] - mean) * (valid[0] - mean))
    return g.withColumns({"total_fas_score": sum(valid[1:], valid[0]), "letter_asymmetry": F.sqrt(spread / len(letters))})


def adjacent_edit_distance(words: DataFrame, by: Sequence[str], order: str = "pos", word: str = "word") -> DataFrame:
    """by, mean_edit_distance of adjacent words, flagged and repeated ones included; null below two words."""
    prev = F.lag(word).over(Window.partitionBy(*by).orderBy(order))
    return words.withColumn("_d", normalized_edit_distance(prev, F.col(word))).groupBy(*by).agg(F.avg("_d").alias("mean_edit_distance"))


def first_of_each(words: DataFrame, by: Sequence[str], order: str = "pos", word: str = "word") -> DataFrame:
    """Words without flagged and blank ones, in lower case, the first of each kept: by, word, pos."""
    clean = words.withColumn(word, F.lower(F.trim(word))).filter((F.col(word) != "") & ~F.col("is_flagged"))
    return clean.groupBy(*by, word).agg(F.min(order).alias(order))


def threshold_sweep(sims: DataFrame, by: Sequence[str], thresholds: Sequence[float], long: bool = False) -> DataFrame:
    """Cluster metrics of (by, pos, sim) at every threshold, a short list: the rows are ordered once, with a running
    count of opened clusters per threshold. A cluster is the rows with the same count, so what is repeated per threshold
    are rows on their way into an aggregation that is combined on the map side."""
    names = [f"_c{i}" for i in range(len(thresholds))]
    rows = sims.select(*by, "pos", "sim")
    if long:
        rows = cut(rows, "rows")
        opens = [F.when((F.col("pos") == 0) | ~F.coalesce(F.col("sim") >= t, F.lit(False)), 1).otherwise(0) for t in thresholds]
        counted = running_offsets(rows, by, spread_key(rows, "pos"), dict(zip(names, opens)), ["pos"])
        ids = [F.col(n) + o for n, o in zip(names, opens)]
    else:
        w = Window.partitionBy(*by).orderBy("pos")
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        first = rows.withColumn("_first", F.row_number().over(w) == 1)
        opens = {f"_o{i}": F.when(F.col("_first") | ~F.coalesce(F.col("sim") >= t, F.lit(False)), 1).otherwise(0) for i, t in enumerate(thresholds)}
        opened = first.withColumns(opens)
        counted = opened.select(*by, *[F.sum(f"_o{i}").over(upto).alias(n) for i, n in enumerate(names)])
        ids = [F.col(n) for n in names]
    grid = counted.select(*by, F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), c.cast("bigint").alias("cluster_id")) for t, c in zip(thresholds, ids)])).alias("_t"))
    return cluster_metrics(grid.select(*by, "_t.threshold", "_t.cluster_id"), [*by, "threshold"])
