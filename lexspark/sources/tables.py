"""CSV sources of ratings, scores and frequency lists, with explicit schemas; rater ids from file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of rating, score and frequency files.
RATINGS = "pair_id string, target string, response string, rating int, category string, is_compound string, notes string"
SCORED = "participant_id string, gender string, age double, diagnosis string, mmse double, gold string, raw_response string, normalized string, is_exact_match boolean, is_non_response boolean, cosine_sim double, binary_score int"
FREQUENCIES = "lemma string, frequency_per_million string"
#: The columns of scored fluency tables, in order.
SVF_COLUMNS = ("participant_id", "diagnosis", "age", "gender", "mmse", "total_words", "unique_words", "repetitions", "mean_consecutive_similarity", "pairwise_similarity_mean", "temporal_gradient", "similarity_slope", "cluster_count", "mean_cluster_size", "switch_count", "max_cluster_size", "mean_word_frequency")
FAS_COLUMNS = ("participant_id", "diagnosis", "age", "gender", "mmse", "total_f", "total_a", "total_s", "valid_f", "valid_a", "valid_s", "total_fas_score", "proper_nouns_count", "repetitions_count", "letter_asymmetry", "cluster_count_f", "mean_cluster_size_f", "switch_count_f", "cluster_count_a", "mean_cluster_size_a", "switch_count_a", "cluster_count_s", "mean_cluster_size_s", "switch_count_s", "cluster_count_total", "switch_count_total", "mean_cluster_size", "mean_word_frequency")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def rater_id(path: Column) -> Column:
    """The stem of a rating file's name, after the prefix ratings_ if it has one."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)\.csv$", 1), r"^(?:.*_)?ratings_", "")


def read_ratings(spark: SparkSession, pattern: str, rounds: bool | None = None) -> DataFrame:
    """All rating files a pattern names, with rater_id and the flag as it was written. `rounds`: only the files with
    "round" in their name (of a retest), or only those without."""
    rows = read_csv(spark, pattern, RATINGS).withColumn("_file", F.input_file_name())
    named = F.regexp_extract("_file", r"([^/]+)$", 1).contains("round")
    rows = rows if rounds is None else rows.filter(named if rounds else ~named)
    return rows.withColumn("rater_id", rater_id(F.col("_file"))).drop("_file")


def save_csv(df: DataFrame, path: str, lead: tuple[str, ...] = (), columns: tuple[str, ...] | None = None, mode: str = "overwrite") -> None:
    """CSV with the named columns, or all with `lead` first; committed as a whole by Spark's commit protocol."""
    chosen = columns or (*lead, *(c for c in df.columns if c not in lead))
    df.select(*chosen).write.mode(mode).option("header", True).csv(path)


def exists(path: str) -> bool:
    """Whether something lies under a path, on whatever file system it names."""
    spark = SparkSession.getActiveSession()
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def save_text(spark: SparkSession, text: str, path: str) -> None:
    """A report as one text file, on whatever file system the path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def to_markdown(df: DataFrame, max_rows: int = 1000) -> str:
    """A small result as a markdown table; an error for more than `max_rows` rows."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows are no report")
    text = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(text(v) for v in r) + " |" for r in rows])


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
