"""Word frequencies: list import, lookup with default, means per participant, vocabulary coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.text import trim_all


def zipf(per_million: Column) -> Column:
    """Zipf value of a frequency per million."""
    return F.log10(per_million) + 3


def frequency_table(raw: DataFrame, lemma: str = "lemma", per_million: str = "frequency_per_million", order: str | None = None) -> DataFrame:
    """(word, zipf): non-numeric, zero and negative frequencies dropped; words in lower case without outer blanks; of
    repeated words the last by `order` holds (the greatest frequency without an order)."""
    missing = {lemma, per_million} - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)}")
    f = F.col(per_million).cast("string").try_cast("double")
    rows = raw.withColumns({"word": trim_all(F.lower(F.col(lemma))), "_f": f}).filter((F.col("_f") > 0) & ~F.isnan("_f"))
    return rows.groupBy("word").agg(F.max_by("_f", order or "_f").alias("_f")).select("word", zipf(F.col("_f")).alias("zipf"))


def with_zipf(words: DataFrame, frequencies: DataFrame, word: str = "word") -> DataFrame:
    """words with zipf, 0 for words not in the list, null and blank words."""
    f = frequencies.select(F.col("word").alias("_w"), F.col("zipf").alias("_z"))
    return words.join(f, trim_all(F.lower(F.col(word))) == F.col("_w"), "left").withColumn("zipf", F.coalesce("_z", F.lit(0.0))).drop("_w", "_z")


def mean_word_frequency(words: DataFrame, frequencies: DataFrame, by: list[str], word: str = "word") -> DataFrame:
    """by, mean_word_frequency over the non-blank words; null for a participant without any."""
    scored = with_zipf(words, frequencies, word)
    return scored.groupBy(*by).agg(F.avg(F.when(F.trim(word) != "", F.col("zipf"))).alias("mean_word_frequency"))


def coverage(words: DataFrame, vocabulary: DataFrame, word: str = "word") -> DataFrame:
    """One row: n_words (distinct), covered, oov, rate (0 for no words)."""
    v = vocabulary.select(F.col(vocabulary.columns[0]).alias("_v")).distinct()
    hit = words.select(word).filter(F.col(word).isNotNull()).distinct().join(v, F.col(word) == F.col("_v"), "left")
    return hit.agg(F.count("*").alias("n_words"), F.count("_v").alias("covered"), (F.count("*") - F.count("_v")).alias("oov"), F.coalesce(F.count("_v") / F.when(F.count("*") > 0, F.count("*")), F.lit(0.0)).alias("rate"))
