"""Scoring answers against a gold word: exact and graded scores, match rates, eligibility, long tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.text import normalize_response, plain
from lexspark.operators.vectors import cosine


def is_exact(norm: Column, gold: Column) -> Column:
    """The answer, or its last word, is the gold word; a non-response is not."""
    return F.coalesce((norm == gold) | (F.element_at(F.split(norm, r"(?U)\s+"), -1) == gold), F.lit(False))


def long_responses(answers: DataFrame, participants: DataFrame, response: str = "raw_response") -> DataFrame:
    """Answers (gold, participant_id, raw_response) with the participants' metadata, normalized, is_exact_match and
    is_non_response. Answers of unknown participants keep null metadata."""
    n = normalize_response(F.col(response))
    rows = answers.withColumn("normalized", n).withColumns({"is_exact_match": is_exact(F.col("normalized"), F.col("gold")), "is_non_response": F.col("normalized").isNull()})
    return rows.join(participants.select("participant_id", "gender", "age", "diagnosis", "mmse"), "participant_id", "left")


def graded_score(exact: Column, non_response: Column, similarity: Column) -> Column:
    """1 for an exact match, 0 for a non-response, else the similarity not below 0, 0 where there is none."""
    return F.when(exact, 1.0).when(non_response, 0.0).otherwise(F.coalesce(F.greatest(similarity, F.lit(0.0)), F.lit(0.0)))


def score_responses(rows: DataFrame, words: DataFrame) -> DataFrame:
    """`rows` (normalized, gold, is_exact_match, is_non_response) with cosine_sim and binary_score. `words` (word,
    embedding) is a table of distinct words, joined; rows that need no similarity do not look any up."""
    need = ~F.col("is_exact_match") & ~F.col("is_non_response")
    w1, w2 = words.select(F.col("word").alias("_w1"), F.col("embedding").alias("_e1")), words.select(F.col("word").alias("_w2"), F.col("embedding").alias("_e2"))
    j = rows.join(w1, need & (F.col("normalized") == F.col("_w1")), "left").join(w2, need & (F.col("gold") == F.col("_w2")), "left")
    sim = graded_score(F.col("is_exact_match"), F.col("is_non_response"), cosine(F.col("_e1"), F.col("_e2")))
    return j.withColumns({"cosine_sim": sim, "binary_score": F.col("is_exact_match").cast("int")}).drop("_w1", "_w2", "_e1", "_e2")


def score_pairs(spark: SparkSession, responses: Sequence[str], golds: Sequence[str], vectors_of: Callable[[DataFrame], DataFrame]) -> list[float]:
    """Similarities of a few answers with their gold words, in order (a convenience; tables go through
    `score_responses`). An error if the lists differ in length."""
    if len(responses) != len(golds):
        raise ValueError(f"{len(responses)} answers, {len(golds)} gold words")
    rows = spark.createDataFrame(list(enumerate(zip(responses, golds))), "n long, p struct<normalized:string,gold:string>").select("n", "p.*").withColumns({"is_exact_match": F.lit(False), "is_non_response": F.col("normalized").isNull()})
    words = vectors_of(rows.select(F.col("normalized").alias("word")).union(rows.select("gold")).filter("word IS NOT NULL").distinct())
    return [r["cosine_sim"] for r in score_responses(rows, words).orderBy("n").collect()]


def match_rates(df: DataFrame, response: str, gold: str, by: tuple[str, ...] = (), norm: Callable[[Column], Column] = plain) -> DataFrame:
    """by, n, exact_rate, token_rate (gold among the words), last_token_rate, substring_rate of normalised answers; an
    answer that is null takes part as what `norm` makes of it."""
    t, g = norm(F.col(response)), F.lower(F.trim(F.col(gold)))
    tokens = F.split(t, " ")
    hit = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), hit(t == g).alias("exact_rate"), hit(F.array_contains(tokens, g)).alias("token_rate"), hit(F.element_at(tokens, -1) == g).alias("last_token_rate"), hit(F.contains(t, g)).alias("substring_rate"))


def eligibility_funnel(df: DataFrame) -> DataFrame:
    """One row: how many answers there are, fail for either reason, for both, and remain."""
    non, exact = F.col("is_non_response"), F.col("is_exact_match")
    return df.agg(F.count("*").alias("n_total"), F.count_if(non).alias("n_non_response"), F.count_if(exact).alias("n_exact"), F.count_if(non & exact).alias("n_both"), F.count_if(~non & ~exact).alias("n_eligible"))


def eligible_pairs(df: DataFrame, keys: tuple[str, ...] = ("gold", "normalized"), keep: str = "participant_id") -> DataFrame:
    """Answers that are neither exact nor missing, one per (gold, answer): the one with the least participant id. The
    minimum is combined on the map side, so frequent answers do not gather."""
    rows = df.filter(~F.col("is_non_response") & ~F.col("is_exact_match"))
    others = [c for c in df.columns if c not in (*keys, keep)]
    first = rows.groupBy(*keys).agg(F.min(F.struct(keep, *others)).alias("_s"))
    return first.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in (keep, *others)]).select(*df.columns)
