"""Group summaries: one aggregation each, map-side combined, deterministic order of ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.operators.ranking import running_offset, spread_key

#: The diagnoses in the order reports give them.
DIAGNOSES = ("HC", "MCI", "non-AD", "AD")


def diagnosis_order(c: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in DIAGNOSES]), c), F.lit(len(DIAGNOSES) + 1))


def naming_summary(scored: DataFrame, group: str = "diagnosis", user: str = "participant_id") -> DataFrame:
    """Per group: n_users, binary_mean, graded_mean, graded_std (deviation of the users' means), non_response_rate,
    gain = graded - binary and its label. Two levels of aggregation, users first."""
    per = scored.groupBy(group, user).agg(F.count("*").alias("n"), F.sum(F.col("binary_score").cast("double")).alias("b"), F.sum("cosine_sim").alias("g"), F.count("cosine_sim").alias("ng"), F.sum(F.col("is_non_response").cast("int")).alias("nr"))
    g = per.groupBy(group).agg(F.count(user).alias("n_users"), (F.sum("b") / F.sum("n")).alias("binary_mean"), (F.sum("g") / F.when(F.sum("ng") > 0, F.sum("ng"))).alias("graded_mean"), F.stddev_samp(F.col("g") / F.when(F.col("ng") > 0, F.col("ng"))).alias("graded_std"), (F.sum("nr") / F.sum("n")).alias("non_response_rate"))
    gain = F.col("graded_mean") - F.col("binary_mean")
    return g.withColumns({"gain": gain, "gain_label": F.when(gain > 0.05, "graded captures more").otherwise("similar")})


def group_means(df: DataFrame, group: str, metrics: Sequence[str]) -> DataFrame:
    """Per group: n, and mean, sd (sample), min and max of each metric."""
    return df.groupBy(group).agg(F.count("*").alias("n"), *[f(m).alias(f"{m}_{k}") for m in metrics for k, f in (("mean", F.avg), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max))])


def in_report_order(summary: DataFrame, group: str = "diagnosis") -> DataFrame:
    """A summary by diagnosis with `position`: HC, MCI, non-AD, AD, then others and null."""
    return summary.withColumn("position", diagnosis_order(F.col(group))).orderBy("position", group)


def overall(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """A row per metric over all rows: metric, n, mean, min, max. One aggregation."""
    g = df.agg(*[f(F.col(m).cast("double")).alias(f"{k}{i}") for i, m in enumerate(metrics) for k, f in (("n", F.count), ("mean", F.avg), ("min", F.min), ("max", F.max))])
    return g.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), *[F.col(f"{k}{i}").alias(k) for k in ("n", "mean", "min", "max")]) for i, m in enumerate(metrics)])))


def lowest_positive(df: DataFrame, value: str, key: str, k: int = 10) -> DataFrame:
    """The k rows with the least values above 0, ties by key (a bounded report)."""
    return df.filter(F.col(value) > 0).orderBy(value, key).limit(k)


def item_variation(df: DataFrame, item: str, value: str, k: int | None = 10) -> DataFrame:
    """Items with n, mean and deviation of their values, the most varied first (ties by item), the first k if given."""
    g = df.groupBy(item).agg(F.count("*").alias("n"), F.avg(value).alias("value_mean"), F.stddev_samp(value).alias("value_sd"))
    ordered = g.orderBy(F.col("value_sd").desc_nulls_last(), item)
    return ordered.limit(k) if k is not None else ordered


def _with_share(counts: DataFrame) -> DataFrame:
    """counts with each n as a share of their sum, which is one row joined by a constant; both sides read the same
    aggregation, so the rows are counted once."""
    total = counts.agg(F.sum("n").cast("double").alias("_total"), F.lit(1).alias("_one"))
    return counts.withColumn("_one", F.lit(1)).join(total, "_one").withColumn("share", F.col("n") / F.col("_total")).drop("_one", "_total")


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct values with their count and share of all rows (the counts are summed, not the rows windowed)."""
    return _with_share(df.groupBy(*columns).agg(F.count("*").alias("n")))


def top_k_values(df: DataFrame, by: Sequence[str], value: str, k: int) -> DataFrame:
    """The k most frequent values per group, ties by value. The window runs over counts per distinct value; its rank
    limit is pushed below the shuffle."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), value)
    return counts.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def rare_values(df: DataFrame, by: Sequence[str], value: str, most: int = 2) -> DataFrame:
    return df.groupBy(*by, value).agg(F.count("*").alias("n")).filter(F.col("n") <= most)


def repeated_values(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by, value).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def response_rollup(df: DataFrame, by: Sequence[str], label: str, value: str, order: str) -> DataFrame:
    """Per group: n, first_value (by `order`), and the distinct labels, sorted and joined. The set of labels is small
    by nature (diagnoses, models)."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.min_by(value, order).alias("first_value"), F.array_join(F.array_sort(F.collect_set(label)), ", ").alias("labels"))


def contingency(df: DataFrame, rows: str, columns: str, values: Sequence, prefix: str = "n_") -> DataFrame:
    """Counts by rows and a closed list of column values, absent cells 0."""
    return df.groupBy(rows).agg(*[F.count_if(F.col(columns) == v).alias(f"{prefix}{str(v).replace('-', '_').lower()}") for v in values])


def text_lengths(df: DataFrame, by: Sequence[str], text: str) -> DataFrame:
    """n, mean, median and greatest length in characters, and the number of different trimmed lower-case texts."""
    n = F.char_length(text)
    return df.filter(F.col(text).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(n).alias("mean_length"), F.median(n).alias("median_length"), F.max(n).cast("bigint").alias("max_length"), F.count_distinct(F.lower(F.trim(text))).alias("n_distinct"))


def missing_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, n_missing, n_rows for each column, in one pass."""
    g = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)])
    return g.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("n_missing"), F.col("n").alias("n_rows")) for i, c in enumerate(columns)])))


def demographics(df: DataFrame, group: str) -> DataFrame:
    """Per group: n, share of all, women, age mean, sd, min, max."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.upper(F.col("gender")) == "F").alias("n_women"), F.avg("age").alias("age_mean"), F.stddev_samp("age").alias("age_sd"), F.min("age").alias("age_min"), F.max("age").alias("age_max"))
    return _with_share(g)


def best_by(df: DataFrame, by: Sequence[str], score: str, choice: str) -> DataFrame:
    """by, choice, score: the choice with the greatest score, the least choice if equal; null scores never win."""
    best = df.filter(F.col(score).isNotNull()).groupBy(*by).agg(F.max_by(F.struct(F.col(choice).alias("c"), F.col(score).alias("s")), F.struct(F.col(score), -F.col(choice))).alias("b"))
    return best.select(*by, F.col("b.c").alias(choice), F.col("b.s").alias(score))


def item_by_group(scored: DataFrame, item: str, group: str = "diagnosis", value: str = "cosine_sim") -> DataFrame:
    """Per item and group: n, mean, deviation, least and greatest value."""
    return scored.groupBy(item, group).agg(F.count("*").alias("n"), F.avg(value).alias("value_mean"), F.stddev_samp(value).alias("value_sd"), F.min(value).alias("value_min"), F.max(value).alias("value_max"))


def accuracy_by_category(scored: DataFrame, item: str, category: str, correct: str) -> DataFrame:
    """Accuracy of each item, then mean, deviation and number of items per category."""
    per = scored.groupBy(item, category).agg(F.avg(F.col(correct).cast("double")).alias("a"))
    return per.groupBy(category).agg(F.count("*").alias("n_items"), F.avg("a").alias("accuracy_mean"), F.stddev_samp("a").alias("accuracy_sd"))


def top_row(df: DataFrame, by: Sequence[str], value: str, key: str) -> DataFrame:
    """The row with the greatest value of each group, the least key if equal; combined on the map side."""
    others = [c for c in df.columns if c not in (*by, value, key)]
    best = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.min(F.struct((-F.col(value)).alias("m"), key, *others)).alias("b"))
    return best.select(*by, (-F.col("b.m")).alias(value), F.col(f"b.{key}").alias(key), *[F.col(f"b.{c}").alias(c) for c in others])


def without_empty_rows(df: DataFrame, order: str, name: str = "slot") -> DataFrame:
    """Rows where anything but the order is given, numbered anew from 1 (a sheet's rows; numbered by bucketed rank)."""
    kept = df.dropna("all", subset=[c for c in df.columns if c != order])
    return running_offset(kept, [], spread_key(kept, order), ties=[order], name="_r").withColumn(name, F.col("_r") + 1).drop("_r")


def chosen_models(df: DataFrame, include: Sequence[str] = (), skip: Sequence[str] = (), column: str = "model_name") -> DataFrame:
    """Rows of the models that are asked for (all, if none is named) and not to be skipped."""
    out = df.filter(F.col(column).isin(*include)) if include else df
    return out.filter(~F.col(column).isin(*skip)) if skip else out
