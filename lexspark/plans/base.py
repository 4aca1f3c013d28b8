"""Tables the reference queries start from, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions.values import code_key, compose
from lexspark.operators.agreement import current_judgements
from lexspark.session import table

DIAGNOSIS = {"hc": "HC", "mci": "MCI", "ad": "AD", "nonad": "non-AD"}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded for comparison, -0 as 0."""
    return df.select(*[(F.round(F.col(c), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_sql(sql: str, doubles: str, others: str, places: int = 6) -> str:
    """The same of a query whose double columns are named."""
    cols = [*(f"round({c}, {places}) + 0.0 AS {c}" for c in doubles.split()), *others.split()]
    head, body = (sql[: sql.rindex("\nSELECT ")], sql[sql.rindex("\nSELECT ") :]) if sql.lstrip().startswith("WITH") else ("", sql)
    return f"{head}\nSELECT {', '.join(cols)} FROM ({body})"


def diagnosis(c: Column) -> Column:
    """A diagnosis in its usual spelling; null for placeholders and unknown codes."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in DIAGNOSIS.items() for x in kv]), code_key(c))


def pool(spark: SparkSession, d: str) -> DataFrame:
    """One row per rated pair: the repeated exports say the same in other spellings."""
    p = table(spark, d, "sq3_pairs")
    return p.groupBy("pair_id").agg(F.min("draw_id").alias("draw_id"), F.min("target").alias("target"), F.min("response").alias("response"), F.min("cosine_sim").alias("cosine_sim"), F.max("cosine_quartile").alias("cosine_quartile"), F.min("participant_id").alias("participant_id"), F.min(diagnosis(F.col("diagnosis"))).alias("diagnosis"), F.min(code_key(F.col("model"))).alias("model_name"))


def current(spark: SparkSession, d: str) -> DataFrame:
    return current_judgements(table(spark, d, "sq3_ratings"))


def rated(spark: SparkSession, d: str) -> DataFrame:
    """pair_id, n_ratings, mean rating, and the category and flag of the first rater."""
    first = F.min_by(F.struct("category", "is_compound"), F.struct("rater_id", "rating_round"))
    g = current(spark, d).groupBy("pair_id").agg(F.count("*").alias("n_ratings"), F.avg("rating").alias("rating"), first.alias("f"))
    return g.select("pair_id", "n_ratings", "rating", "f.category", "f.is_compound")


def participants(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of every participant, with the diagnosis in its usual spelling."""
    cols = ("responses", "gender", "age", "diagnosis", "mmse")
    g = table(spark, d, "svf_participant").groupBy("participant_id").agg(F.max_by(F.struct(*cols), F.struct("loaded_at", "source_file")).alias("s"))
    return g.select("participant_id", "s.responses", "s.gender", "s.age", diagnosis(F.col("s.diagnosis")).alias("diagnosis"), "s.mmse")


def words(spark: SparkSession, d: str) -> DataFrame:
    """(participant_id, pos, word, is_flagged) of the last lists: words in lower case without outer punctuation;
    elements in square brackets are flagged."""
    edge = r"[\p{Z}\s\p{P}]"
    rows = participants(spark, d).select("participant_id", F.posexplode("responses").alias("at", "raw"))
    word = F.regexp_replace(F.regexp_replace(F.lower(compose(F.col("raw"))), f"^{edge}+|{edge}+$", ""), r"[\p{Z}\s]+", " ")
    clean = rows.select("participant_id", "at", word.alias("word"), F.col("raw").rlike(r"^\[.*\]$").alias("is_flagged")).filter(~F.col("word").isin("", "nan", "none"))
    return clean.select("participant_id", (F.row_number().over(Window.partitionBy("participant_id").orderBy("at")) - 1).alias("pos"), "word", "is_flagged")


def document_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Every run of letters of every document, in lower case."""
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("token"))


_CODE = r"nullif(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]', '', 'g'), '')"
_DX = "CASE " + _CODE + " WHEN 'hc' THEN 'HC' WHEN 'mci' THEN 'MCI' WHEN 'ad' THEN 'AD' WHEN 'nonad' THEN 'non-AD' END"
_CATS = "'coordinate', 'hypernym', 'hyponym', 'circumlocution', 'phonological', 'unrelated', 'other'"
POOL = f"pool AS (SELECT pair_id, min(draw_id) AS draw_id, min(target) AS target, min(response) AS response, min(cosine_sim) AS cosine_sim, max(cosine_quartile) AS cosine_quartile, min(participant_id) AS participant_id, min({_DX.format('diagnosis')}) AS diagnosis, min({_CODE.format('model')}) AS model_name FROM sq3_pairs GROUP BY pair_id)"
CURRENT = f"""judged AS (SELECT rater_id, pair_id, rating_round, rated_at, rating_id, rating, CASE WHEN lower(trim(category)) IN ({_CATS}) THEN lower(trim(category)) END AS category,
  CASE WHEN is_compound IS NOT NULL THEN lower(trim(is_compound)) IN ('true', '1', 'yes', 'y', 't') END AS is_compound FROM sq3_ratings WHERE rating BETWEEN 0 AND 3),
current AS (SELECT rater_id, pair_id, rating_round, s.r AS rating, s.c AS category, s.b AS is_compound FROM
  (SELECT rater_id, pair_id, rating_round, arg_max({{'r': rating, 'c': category, 'b': is_compound}}, (rated_at, rating_id)) AS s FROM judged GROUP BY ALL))"""
RATED = CURRENT + """,
rated AS (SELECT pair_id, n_ratings, rating, f.c AS category, f.b AS is_compound FROM (SELECT pair_id, count(*) AS n_ratings, avg(rating) AS rating, arg_min({'c': category, 'b': is_compound}, (rater_id, rating_round)) AS f FROM current GROUP BY pair_id))"""
PARTICIPANTS = f"participants AS (SELECT participant_id, s.r AS responses, s.g AS gender, s.a AS age, {_DX.format('s.d')} AS diagnosis, s.m AS mmse FROM (SELECT participant_id, arg_max({{'r': responses, 'g': gender, 'a': age, 'd': diagnosis, 'm': mmse}}, (loaded_at, source_file)) AS s FROM svf_participant GROUP BY participant_id))"
WORDS = PARTICIPANTS + r""",
lists AS (SELECT participant_id, unnest(responses) AS raw, generate_subscripts(responses, 1) AS place FROM participants),
cleaned AS (SELECT participant_id, place, regexp_replace(regexp_replace(lower(nfc_normalize(raw)), '^[\pZ\s\pP]+|[\pZ\s\pP]+$', '', 'g'), '[\pZ\s]+', ' ', 'g') AS word, regexp_matches(raw, '^\[.*\]$') AS is_flagged FROM lists),
words AS (SELECT participant_id, row_number() OVER (PARTITION BY participant_id ORDER BY place) - 1 AS pos, word, is_flagged FROM cleaned WHERE word NOT IN ('', 'nan', 'none'))"""
TOKENS = r"tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS token FROM documents WHERE text IS NOT NULL)"
