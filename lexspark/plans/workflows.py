"""Queries of whole workflows over the test tables: sheets, files, lexicon, scored tables, reports; and the same as SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions import text
from lexspark.operators import agreement, embedding, frequency, graph, matching, regression, stats, summaries
from lexspark.plans import base, pipelines
from lexspark.plans import reference as ref
from lexspark.plans.base import rounded, rounded_sql
from lexspark.session import cut, shared_dir, table
from lexspark.sources import lexicon, sheets, tables

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- sheets: the lists as wide sheets of about a hundred participants each, read as sheets are


def _sheets(spark: SparkSession, d: str, cells: DataFrame, per_sheet: int = 100) -> tuple[DataFrame, DataFrame]:
    """`cells` (participant_id, row_idx, label, value) and the participants' metadata rows as wide sheets: a stack of all of
    them and its header, as `sheets.split_rows` takes them."""
    found = cut(base.participants(spark, d).filter("participant_id IS NOT NULL").drop("responses"), "participants")
    n = max(1, -(-found.count() // per_sheet))
    p = found.withColumn("sheet", F.pmod(F.xxhash64("participant_id"), F.lit(n))).withColumn("place", F.row_number().over(Window.partitionBy("sheet").orderBy("participant_id")) - 1)
    p = cut(p, "placed")
    values = [("Gender:", F.col("gender")), ("Age:", F.col("age").cast("string")), ("Kategori:", F.col("diagnosis")), ("MMSE", F.col("mmse").cast("string"))]
    meta = p.select("sheet", "place", F.inline(F.array(*[F.struct(F.lit(10**6 + i).cast("bigint").alias("row_idx"), F.lit(k).alias("label"), v.alias("value")) for i, (k, v) in enumerate(values)])))
    rows = cells.join(p.select("participant_id", "sheet", "place"), "participant_id").select("sheet", "place", F.col("row_idx").cast("bigint").alias("row_idx"), "label", "value").unionByName(meta)
    width = 1 + (p.agg(F.max("place")).first()[0] or 0)  # the columns of the widest sheet
    cell = F.map_from_entries(F.collect_list(F.struct("place", "value")))  # a pivot costs four times as much with so many columns
    wide = rows.repartition("sheet", "row_idx").groupBy("sheet", "row_idx", "label").agg(cell.alias("c")).select("sheet", "row_idx", "label", *[F.try_element_at("c", F.lit(i)).alias(str(i)) for i in range(width)])
    header = p.groupBy("sheet").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "participant_id"))), lambda u: u["participant_id"]).alias("users"))
    return cut(wide, "sheets"), header


def _lists(spark: SparkSession, d: str) -> DataFrame:
    return base.participants(spark, d).select("participant_id", F.posexplode("responses").alias("row_idx", "value")).withColumn("label", F.col("row_idx").cast("string"))


@query
def sheet_words(spark: SparkSession, d: str) -> DataFrame:
    return sheets.load_svf(*_sheets(spark, d, _lists(spark, d)))[0].drop("sheet").withColumn("pos", F.col("pos").cast("bigint"))


@query
def sheet_meta(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sheets.load_svf(*_sheets(spark, d, _lists(spark, d)))[1].drop("sheet"))


@query
def sheet_triplets(spark: SparkSession, d: str) -> DataFrame:
    """The words of a list in cells of three; every fifth word is marked as a name, a cell of only empty words is empty."""
    w = base.words(spark, d).filter(~F.col("word").contains(",")).withColumn("raw", F.when(F.char_length("word") % 5 == 0, F.concat(F.lit("<"), "word", F.lit(">"))).otherwise(F.col("word")))
    cells = w.groupBy("participant_id", F.expr("pos div 3").alias("row_idx")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), ", ").alias("value")).withColumn("label", F.lit("x"))
    return sheets.load_fas(*_sheets(spark, d, cells))[0].drop("sheet").withColumn("pos", F.col("pos").cast("bigint"))


@query
def sheet_answers(spark: SparkSession, d: str) -> DataFrame:
    """The n-th words of all lists as answers to one item, with an item row that ends in a colon."""
    w = base.words(spark, d).select("participant_id", F.col("pos").alias("row_idx"), F.concat(F.lit(" Item "), F.col("pos").cast("string"), F.when(F.col("pos") == 3, ": ").otherwise(" ")).alias("label"), F.when(F.col("word") == "ko", "nan").otherwise(F.col("word")).alias("value"))
    rows = sheets.load_bnt(*_sheets(spark, d, w))[0]
    return rows.filter("raw_response IS NOT NULL").select("gold", "participant_id", "raw_response", F.col("item_pos").cast("bigint").alias("item_pos"))


# --- files


@query
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Scored answers saved as CSV with the participant's columns first, and read again by their schema."""
    lead = ("participant_id", "gender", "age", "diagnosis", "mmse")
    scored = ref._answers(spark, d).withColumns({"gender": F.lit("F"), "age": F.lit(70.5), "mmse": F.lit(None).cast("double")})
    path = f"{shared_dir(spark)}/lexspark-csv-{uuid.uuid4().hex}"
    columns = [c.split()[0] for c in tables.SCORED.split(", ")]
    tables.save_csv(scored.select(*columns), path, lead)
    back = tables.read_csv(spark, path, tables.SCORED)
    return rounded(back.groupBy("gold", "normalized", "is_exact_match", "diagnosis").agg(F.count("*").alias("n"), F.count("participant_id").alias("n_named"), F.avg("cosine_sim").alias("mean_score"), F.count("mmse").alias("n_mmse"), F.sum("binary_score").alias("n_exact")), 9)


@query
def rating_files(spark: SparkSession, d: str) -> DataFrame:
    """Judgements saved as one CSV table and read as rating files; raters named by the stems of file names."""
    path = f"{shared_dir(spark)}/lexspark-ratings-{uuid.uuid4().hex}"
    rows = table(spark, d, "sq3_ratings").filter("rater_id IS NOT NULL").select("pair_id", "target", "response", "rating", "category", "is_compound", "notes", F.concat(F.lit("/files/main_ratings_"), "rater_id", F.lit(".csv")).alias("file"))
    tables.save_csv(rows, path)
    back = tables.read_csv(spark, path, tables.RATINGS + ", file string").withColumn("rater_id", tables.rater_id(F.col("file")))
    return back.groupBy("rater_id").agg(F.count("*").alias("n"), F.count("rating").alias("n_ratings"), F.count_if(text.truthy(F.col("is_compound"))).alias("n_compound"))


@query
def lexicon_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A lexicon of the parts written as XML, read into a graph, saved and loaded."""
    g, base_dir = ref._graph(spark, d), f"{shared_dir(spark)}/lexspark-lexicon-{uuid.uuid4().hex}"
    feat = lambda att, v: F.struct(F.lit(att).alias("_att"), v.alias("_val"))
    rel = F.struct(F.col("dst").alias("_targets"), F.array(feat("label", F.col("label"))).alias("feat"))
    relations = g.edge.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", rel.alias("x")))), lambda s: s["x"]).alias("relations"))
    form = F.struct(F.array(feat("writtenForm", F.col("form")), feat("partOfSpeech", F.lit("nn"))).alias("feat"))
    entries = g.form_sense.join(relations, F.col("sense") == F.col("src")).select(F.struct(F.array(form).alias("FormRepresentation")).alias("Lemma"), F.array(F.struct(F.col("sense").alias("_id"), F.col("relations").alias("SenseRelation"))).alias("Sense"))
    entries.write.format("xml").option("rowTag", "LexicalEntry").option("rootTag", "LexicalResource").save(f"{base_dir}/xml")
    lexicon.save_graph(lexicon.read_lexicon(spark, f"{base_dir}/xml"), f"{base_dir}/graph")
    back = lexicon.load_graph(spark, f"{base_dir}/graph")
    edges = back.edges().select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("label").alias("c"))
    forms = back.form_sense.select(F.lit("form"), "form", "sense", F.lit(None).cast("string"))
    return edges.union(forms).union(back.sense.select(F.lit("sense"), "sense", "written_form", "pos"))


# --- scored tables


@query
def long_answers(spark: SparkSession, d: str) -> DataFrame:
    answers = base.pool(spark, d).select("pair_id", F.col("target").alias("gold"), "participant_id", F.col("response").alias("raw_response"))
    return rounded(matching.long_responses(answers, base.participants(spark, d)))


@query
def embedded_scores(spark: SparkSession, d: str) -> DataFrame:
    """Graded scores with similarities of vectors that each distinct word gets once."""
    rows = cut(ref._answers(spark, d).select("pair_id", "gold", "normalized", "is_exact_match", "is_non_response"), "rows")
    need = rows.filter(~F.col("is_exact_match") & ~F.col("is_non_response"))
    words = need.select(F.col("normalized").alias("word")).union(need.select("gold")).filter("word IS NOT NULL").distinct()
    return rounded(matching.score_responses(rows, pipelines.mock_vectors(words)).select("pair_id", "cosine_sim", "binary_score"))


@query
def embedded_words(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct word once through a model in the workers, in batches of 32."""
    v = embedding.embed_words(base.words(spark, d), "word", embedding.factory({"kind": "mock"}))
    return rounded(v.select("word", F.size("embedding").cast("bigint").alias("n"), F.get("embedding", F.lit(0)).cast("double").alias("first"), F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x).alias("total")))


def _listed(spark: SparkSession, d: str) -> DataFrame:
    return ref._frequencies(spark, d)


@query
def svf_scored(spark: SparkSession, d: str) -> DataFrame:
    w = cut(base.words(spark, d).select("participant_id", "pos", "word"), "words")
    meta = base.participants(spark, d).select("participant_id", "gender", "age", "diagnosis", "mmse")
    return rounded(pipelines.svf(w, meta, frequencies=_listed(spark, d), threshold=0.1))


@query
def fas_scored(spark: SparkSession, d: str) -> DataFrame:
    w = base.words(spark, d).withColumn("letter", F.substring("word", 1, 1)).filter(F.col("letter").isin("f", "a", "s"))
    meta = base.participants(spark, d).select("participant_id", "gender", "age", "diagnosis", "mmse")
    return rounded(pipelines.fas(cut(w, "words"), meta, _listed(spark, d)))


@query
def text_variants(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("response")
    rows = table(spark, d, "sq3_pairs").select("response", text.normalize_response(c, extended=True).alias("extended"), text.without_hesitation(c).alias("said"), F.size(text.bracketed(F.concat_ws(" ", F.concat(F.lit("<"), "target", F.lit(">")), c))).cast("bigint").alias("n_marked"))
    return rows.groupBy("response", "extended", "said", "n_marked").agg(F.count("*").alias("n"))


# --- summaries


@query
def naming_ordered(spark: SparkSession, d: str) -> DataFrame:
    return summaries.in_report_order(summaries.naming_summary(ref._answers(spark, d))).select("diagnosis", "n_users", F.col("position").cast("bigint").alias("position"))


@query
def overall_fluency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.overall(ref._scored(spark, d), ["total_words", "unique_words", "age", "mmse"]))


@query
def lowest_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.lowest_positive(ref._answers(spark, d), "cosine_sim", "pair_id").select("pair_id", "gold", "cosine_sim"), 9)


@query
def correlations(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.correlation_matrix(ref._scored(spark, d), ["total_words", "unique_words", "age", "mmse"]))


@query
def selected_features(spark: SparkSession, d: str) -> DataFrame:
    chosen = regression.select_features(regression.correlation_table(ref._scored(spark, d), ["total_words", "unique_words", "repetitions", "age"], least=0.1))
    return spark.createDataFrame([(f,) for f in chosen], "feature string")


@query
def model_filter(spark: SparkSession, d: str) -> DataFrame:
    p = base.pool(spark, d)
    names = [r[0] for r in p.filter("model_name IS NOT NULL").select("model_name").distinct().orderBy("model_name").limit(100).collect()]
    return summaries.chosen_models(p, names, names[:1]).groupBy("model_name").agg(F.count("*").alias("n"))


@query
def commonest_model(spark: SparkSession, d: str) -> DataFrame:
    return regression.most_common_setting(base.pool(spark, d).filter("model_name IS NOT NULL").select(F.col("draw_id").alias("fold"), "model_name"), "model_name").select("model_name", "n", "first")


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    return ref._scored(spark, d).filter("mmse IS NOT NULL").select("participant_id", "mmse", (F.col("total_words") / 5 + 22).alias("prediction"))


@query
def cutoff_confusion(spark: SparkSession, d: str) -> DataFrame:
    return regression.evaluation(_predicted(spark, d))[1]


@query
def cutoff_kappa(spark: SparkSession, d: str) -> DataFrame:
    return rounded(regression.evaluation(_predicted(spark, d))[2])


@query
def prediction_error(spark: SparkSession, d: str) -> DataFrame:
    return rounded(regression.evaluation(_predicted(spark, d))[0].select("n", "mean"))


# --- ratings


@query
def rating_problems(spark: SparkSession, d: str) -> DataFrame:
    return agreement.rating_problems(table(spark, d, "sq3_ratings"))


@query
def consolidated_ratings(spark: SparkSession, d: str) -> DataFrame:
    """The pairs judged in both rounds, each round standing for a rating file: its first rater's judgement."""
    c = cut(base.current(spark, d), "current")
    first = F.min_by(F.struct("rating", "category", "is_compound"), "rater_id")
    return rounded(agreement.consolidate([c.filter(F.col("rating_round") == r).groupBy("pair_id").agg(first.alias("f")).select("pair_id", "f.*") for r in (1, 2)]))


@query
def unrated_pairs(spark: SparkSession, d: str) -> DataFrame:
    return agreement.missing_pairs(base.pool(spark, d), base.current(spark, d))


@query
def retest_summary(spark: SparkSession, d: str) -> DataFrame:
    a, b = (base.current(spark, d).filter(F.col("rating_round") == r).drop("rating_round") for r in (1, 2))
    return rounded(agreement.reliability_summary(agreement.reliability(a, b, by=("rater_id",))))


@query
def divergence_ranked(spark: SparkSession, d: str) -> DataFrame:
    c = agreement.divergence_catalog(base.rated(spark, d), base.pool(spark, d)).withColumn("disagreement", F.round("disagreement", 9))
    return agreement.ranked_catalog(c).select("pair_id", "position", "disagreement")


# --- sense graph


@query
def graph_lookup(spark: SparkSession, d: str) -> DataFrame:
    g = ref._graph(spark, d)
    words = g.form_sense.select("form").distinct().union(spark.createDataFrame([("NOWHERE",), (None,)], "form string"))
    return g.lookup(words).select("form", "sense")


@query
def graph_children(spark: SparkSession, d: str) -> DataFrame:
    return ref._graph(spark, d).children()


@query
def graph_descriptors(spark: SparkSession, d: str) -> DataFrame:
    g = ref._graph(spark, d)
    return g.descriptor().withColumnRenamed("parent", "primary_parent").join(g.descriptor("secondary").withColumnRenamed("parent", "secondary_parent"), "sense", "left")


@query
def graph_depth_histogram(spark: SparkSession, d: str) -> DataFrame:
    return graph.depth_histogram(graph.depths(ref._graph(spark, d)))


@query
def graph_best_sense(spark: SparkSession, d: str) -> DataFrame:
    """The nearest senses of two words, three parts being the senses of a word."""
    word = lambda k: F.concat(F.lit("w"), F.expr(f"({k}) div 3"))
    parts = table(spark, d, "part")
    g = graph.SenseGraph(ref._graph(spark, d).edge, parts.select(word("p_partkey").alias("form"), F.concat(F.lit("s"), "p_partkey").alias("sense"), F.lit(0).alias("ord")))
    return rounded(graph.best_sense(parts.select(word("p_partkey").alias("target"), word("p_partkey div 3 + 1").alias("response")).distinct(), g))


_META = "participant_id, gender, age, diagnosis, mmse"
_SAID = r"said AS (SELECT participant_id, place, raw FROM lists WHERE raw IS NOT NULL AND lower(trim(raw, ' ')) NOT IN ('', 'nan', 'none'))"
_RATED_ROUND = "SELECT pair_id, arg_min({'r': rating, 'c': category, 'b': is_compound}, rater_id) AS f FROM current WHERE rating_round = "
_EXTENDED = ref._NORMALIZED.replace("'nåt sånt')", "'nåt sånt', 'nan', '')")
_PREDICTED = f"{ref._SCORED}, q AS (SELECT mmse AS y, total_words / 5 + 22 AS p FROM scored WHERE mmse IS NOT NULL)"
_FOUR = ("total_words", "unique_words", "age", "mmse")

SQL = {
    "sheet_words": f"WITH {base.WORDS}, {_SAID} SELECT participant_id, row_number() OVER (PARTITION BY participant_id ORDER BY place) - 1 AS pos, lower(trim(raw, ' ')) AS word FROM said",
    "sheet_meta": rounded_sql(f"WITH {base.PARTICIPANTS}\nSELECT {_META} FROM participants", "age mmse", "participant_id gender diagnosis"),
    "sheet_triplets": f"""WITH {base.WORDS}, w AS (SELECT participant_id, pos // 3 AS c, row_number() OVER (PARTITION BY participant_id, pos // 3 ORDER BY pos) AS i, word, length(word) % 5 = 0 AS f FROM words WHERE NOT contains(word, ',')),
ends AS (SELECT participant_id, c - row_number() OVER (PARTITION BY participant_id ORDER BY c) + 1 AS gap, c FROM (SELECT DISTINCT participant_id, c FROM w)),
grid AS (SELECT e.participant_id, e.c, i.i FROM ends e, (VALUES (1), (2), (3)) i(i) WHERE e.gap = 0 OR NOT EXISTS (SELECT 1 FROM words)),
filled AS (SELECT g.participant_id, g.c, g.i, coalesce(w.word, '') AS word, coalesce(w.f, false) AS f FROM grid g LEFT JOIN w USING (participant_id, c, i))
SELECT participant_id, ['f', 'a', 's'][i] AS letter, c AS pos, word, word <> '' AND bool_or(f) OVER (PARTITION BY participant_id, word) AS is_flagged FROM filled""",
    "sheet_answers": f"WITH {base.WORDS} SELECT 'item ' || pos AS gold, participant_id, word AS raw_response, pos AS item_pos FROM words WHERE pos <> 3 AND word <> 'ko'",
    "csv_round_trip": rounded_sql(f"WITH {ref._ANSWERS}\nSELECT nullif(gold, '') AS gold, normalized, is_exact_match, diagnosis, count(*) AS n, count(nullif(participant_id, '')) AS n_named, avg(cosine_sim) AS mean_score, 0::BIGINT AS n_mmse, sum(binary_score)::BIGINT AS n_exact FROM answers GROUP BY 1, 2, 3, 4", "mean_score", "gold normalized is_exact_match diagnosis n n_named n_mmse n_exact", 9),
    "rating_files": "SELECT rater_id, count(*) AS n, count(rating) AS n_ratings, count(*) FILTER (lower(trim(is_compound)) IN ('true', '1', 'yes', 'y', 't')) AS n_compound FROM sq3_ratings WHERE rater_id IS NOT NULL GROUP BY rater_id",
    "lexicon_round_trip": f"WITH {ref._GRAPH.split('walk AS')[0].rstrip().rstrip(',')} SELECT 'edge' AS kind, src AS a, dst AS b, label AS c FROM edges UNION ALL SELECT 'form', string_split(p_name, ' ')[-1], 's' || p_partkey, NULL FROM part UNION ALL SELECT 'sense', 's' || p_partkey, string_split(p_name, ' ')[-1], 'nn' FROM part",
    "long_answers": rounded_sql(f"WITH {base.PARTICIPANTS}, {ref._ANSWERS}\nSELECT pair_id, gold, participant_id, response AS raw_response, normalized, is_exact_match, is_non_response, p.gender, p.age, p.diagnosis, p.mmse FROM answers LEFT JOIN participants p USING (participant_id)", "age mmse", "pair_id gold participant_id raw_response normalized is_exact_match is_non_response gender diagnosis"),
    "embedded_scores": rounded_sql(f"""WITH {ref._ANSWERS}, need AS (SELECT normalized AS word FROM answers WHERE NOT is_exact_match AND NOT is_non_response UNION SELECT gold FROM answers WHERE NOT is_exact_match AND NOT is_non_response), dim AS (SELECT word, {ref._MOCK} AS e FROM need WHERE word IS NOT NULL),
j AS (SELECT pair_id, is_exact_match, is_non_response, binary_score, x.e AS a, y.e AS b FROM answers LEFT JOIN dim x ON x.word = normalized LEFT JOIN dim y ON y.word = gold)
SELECT pair_id, binary_score, CASE WHEN is_exact_match THEN 1.0 WHEN is_non_response THEN 0.0 ELSE coalesce(greatest({ref._COS}, 0.0), 0.0) END::DOUBLE AS cosine_sim FROM j""", "cosine_sim", "pair_id binary_score"),
    "embedded_words": rounded_sql(f"WITH {base.WORDS}, dim AS (SELECT word, {ref._MOCK} AS e FROM (SELECT DISTINCT word FROM words))\nSELECT word, len(e) AS n, e[1] AS first, list_sum(e) AS total FROM dim", "first total", "word n"),
    "svf_scored": rounded_sql(f"""WITH {ref._WORD_SIMS}, {ref._FREQ}, prof AS ({ref._profile_sql('wsims', 'participant_id')}), clu AS (SELECT participant_id, {ref._METRICS} FROM {ref._clusters_sql('wsims', 'participant_id', 'sim >= 0.1')} GROUP BY ALL),
counts AS (SELECT participant_id, count(*) AS total_words, count(DISTINCT word) AS unique_words, count(*) - count(DISTINCT word) AS repetitions FROM words GROUP BY ALL), u AS (SELECT DISTINCT participant_id, word FROM words),
pairs AS (SELECT participant_id, avg(greatest({ref._COS}, 0.0)) AS pairwise_similarity_mean FROM (SELECT x.participant_id, p.e AS a, q.e AS b FROM u x JOIN u y ON x.participant_id = y.participant_id AND x.word < y.word JOIN dim p ON p.word = x.word JOIN dim q ON q.word = y.word) GROUP BY participant_id),
zipfs AS (SELECT participant_id, avg(coalesce(zipf, 0)) AS mean_word_frequency FROM u LEFT JOIN freq ON word = token GROUP BY participant_id)
SELECT {_META}, coalesce(total_words, 0) AS total_words, coalesce(unique_words, 0) AS unique_words, coalesce(repetitions, 0) AS repetitions, mean_consecutive_similarity, pairwise_similarity_mean, temporal_gradient, similarity_slope, coalesce(cluster_count, 0) AS cluster_count, mean_cluster_size, coalesce(switch_count, 0) AS switch_count, coalesce(max_cluster_size, 0) AS max_cluster_size, mean_word_frequency
FROM participants LEFT JOIN counts USING (participant_id) LEFT JOIN prof USING (participant_id) LEFT JOIN clu USING (participant_id) LEFT JOIN pairs USING (participant_id) LEFT JOIN zipfs USING (participant_id)""", "age mmse mean_consecutive_similarity pairwise_similarity_mean temporal_gradient similarity_slope mean_cluster_size mean_word_frequency", "participant_id gender diagnosis total_words unique_words repetitions cluster_count switch_count max_cluster_size"),
    "fas_scored": rounded_sql(f"""WITH {base.WORDS}, {ref._FREQ}, {ref._LETTERS}, counts AS ({ref._COUNTS}), tot AS (SELECT participant_id, {', '.join(f"coalesce(sum({k}) FILTER (letter = '{x}'), 0)::BIGINT AS {k}_{x}" for k in ('total', 'valid') for x in 'fas')}, sum(flagged)::BIGINT AS proper_nouns_count, sum(repetitions)::BIGINT AS repetitions_count FROM counts GROUP BY ALL),
firsts AS (SELECT participant_id, letter, word, min(pos) AS place FROM letters WHERE NOT is_flagged GROUP BY ALL), adj AS (SELECT participant_id, letter, row_number() OVER w - 1 AS pos, lag(word) OVER w AS a, word AS b FROM firsts WINDOW w AS (PARTITION BY participant_id, letter ORDER BY place)),
sizes AS (SELECT * FROM {ref._clusters_sql('adj', 'participant_id, letter', f'{ref._R1} OR {ref._R2} OR {ref._R3}')}), clu AS (SELECT participant_id, {', '.join(f"count(*) FILTER (letter = '{x}') AS cluster_count_{x}, avg(size) FILTER (letter = '{x}') AS mean_cluster_size_{x}, greatest(count(*) FILTER (letter = '{x}') - 1, 0) AS switch_count_{x}" for x in 'fas')}, count(*) AS cluster_count_total, count(*) - count(DISTINCT letter) AS switch_count_total, avg(size) AS mean_cluster_size FROM sizes GROUP BY participant_id),
zipfs AS (SELECT participant_id, avg(coalesce(zipf, 0)) AS mean_word_frequency FROM firsts LEFT JOIN freq ON word = token GROUP BY participant_id)
SELECT {_META}, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('total_f', 'total_a', 'total_s', 'valid_f', 'valid_a', 'valid_s', 'proper_nouns_count', 'repetitions_count', 'cluster_count_f', 'switch_count_f', 'cluster_count_a', 'switch_count_a', 'cluster_count_s', 'switch_count_s', 'cluster_count_total', 'switch_count_total'))}, coalesce(valid_f + valid_a + valid_s, 0) AS total_fas_score, coalesce(list_stddev_pop([valid_f, valid_a, valid_s]), 0) AS letter_asymmetry, mean_cluster_size_f, mean_cluster_size_a, mean_cluster_size_s, mean_cluster_size, mean_word_frequency
FROM participants LEFT JOIN tot USING (participant_id) LEFT JOIN clu USING (participant_id) LEFT JOIN zipfs USING (participant_id)""", "age mmse letter_asymmetry mean_cluster_size_f mean_cluster_size_a mean_cluster_size_s mean_cluster_size mean_word_frequency", "participant_id gender diagnosis total_f total_a total_s valid_f valid_a valid_s proper_nouns_count repetitions_count cluster_count_f switch_count_f cluster_count_a switch_count_a cluster_count_s switch_count_s cluster_count_total switch_count_total total_fas_score"),
    "text_variants": f"WITH src AS (SELECT response, target FROM sq3_pairs), {_EXTENDED} SELECT response, normalized AS extended, regexp_replace(response, '^(och|eee|kanske en?)[\\pZ\\s]+', '') AS said, len(regexp_extract_all(concat_ws(' ', '<' || target || '>', response), '<([^>]+)>', 1)) AS n_marked, count(*) AS n FROM norm GROUP BY ALL",
    "naming_ordered": f"WITH {ref._ANSWERS} SELECT diagnosis, count(DISTINCT participant_id) AS n_users, CASE diagnosis WHEN 'HC' THEN 1 WHEN 'MCI' THEN 2 WHEN 'non-AD' THEN 3 WHEN 'AD' THEN 4 ELSE 5 END::BIGINT AS position FROM answers GROUP BY diagnosis",
    "overall_fluency": rounded_sql(f"WITH {ref._SCORED}\n" + " UNION ALL ".join(f"SELECT '{c}' AS metric, count({c}) AS n, avg({c}) AS mean, min({c}) AS min, max({c}) AS max FROM scored" for c in _FOUR), "mean min max", "metric n"),
    "lowest_scores": rounded_sql(f"WITH {ref._ANSWERS}\nSELECT pair_id, gold, cosine_sim FROM answers WHERE cosine_sim > 0 ORDER BY cosine_sim, pair_id LIMIT 10", "cosine_sim", "pair_id gold", 9),
    "correlations": rounded_sql(f"WITH {ref._SCORED}\n" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, corr({a}, {b}) AS r FROM scored" for a in _FOUR for b in _FOUR), "r", "a b n"),
    "selected_features": f"WITH {ref._SCORED}, r AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, mmse) AS r FROM scored" for c in ("total_words", "unique_words", "repetitions", "age")) + ") SELECT feature FROM r WHERE abs(r) > 0.1",
    "model_filter": f"WITH {base.POOL} SELECT model_name, count(*) AS n FROM pool WHERE model_name > (SELECT min(model_name) FROM pool) GROUP BY model_name",
    "commonest_model": f"WITH {base.POOL} SELECT model_name, count(DISTINCT draw_id) AS n, min(draw_id) AS first FROM pool WHERE model_name IS NOT NULL AND draw_id IS NOT NULL GROUP BY model_name ORDER BY n DESC, first LIMIT 1",
    "cutoff_confusion": f"WITH {_PREDICTED} SELECT t AS true_label, p AS predicted_label, count(*) FILTER ((q.y >= 24)::INT = t AND (q.p >= 24)::INT = pp.p) AS n FROM q, (VALUES (0), (1)) a(t), (VALUES (0), (1)) pp(p) GROUP BY t, pp.p".replace("SELECT t AS true_label, p AS", "SELECT t AS true_label, pp.p AS"),
    "cutoff_kappa": rounded_sql(f"WITH {_PREDICTED}, c AS (SELECT count(*)::DOUBLE AS n, avg(((y >= 24) = (p >= 24))::INT) AS po, avg((y >= 24)::INT) AS a, avg((p >= 24)::INT) AS b FROM q)\nSELECT n::BIGINT AS n, (po - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))) AS kappa FROM c", "kappa", "n"),
    "prediction_error": rounded_sql(f"WITH {_PREDICTED}\nSELECT count(*) AS n, avg(abs(y - p)) AS mean FROM q", "mean", "n"),
    "rating_problems": "SELECT count(*) FILTER (rating IS NULL) AS n_null, count(*) FILTER (rating NOT BETWEEN 0 AND 3) AS n_impossible, count(*) FILTER (category NOT IN ('coordinate', 'hypernym', 'hyponym', 'circumlocution', 'phonological', 'unrelated', 'other')) AS n_unknown FROM sq3_ratings",
    "consolidated_ratings": rounded_sql(f"WITH {base.CURRENT}, a AS ({_RATED_ROUND}1 GROUP BY pair_id), b AS ({_RATED_ROUND}2 GROUP BY pair_id)\nSELECT pair_id, (a.f.r + b.f.r) / 2.0::DOUBLE AS rating, coalesce(a.f.c, NULL) AS category, a.f.b AS is_compound FROM a JOIN b USING (pair_id)", "rating", "pair_id category is_compound"),
    "unrated_pairs": f"WITH {base.CURRENT}, {base.POOL} SELECT DISTINCT pair_id FROM pool WHERE pair_id NOT IN (SELECT pair_id FROM current WHERE pair_id IS NOT NULL)",
    "retest_summary": rounded_sql(f"WITH {ref._RELIABLE}\nSELECT n_sets, mean_weighted_kappa, CASE WHEN mean_weighted_kappa >= 0.6 THEN 'primary' WHEN mean_weighted_kappa >= 0.4 THEN 'cautioned' ELSE 'exploratory' END AS interpretability FROM (SELECT count(k) AS n_sets, avg(k) AS mean_weighted_kappa FROM (SELECT rater_id, {ref._KW} AS k FROM ab GROUP BY rater_id))", "mean_weighted_kappa", "n_sets interpretability"),
    "divergence_ranked": f"WITH {ref._J}, e AS (SELECT pair_id, round(abs(rating / 3 - cosine_sim), 9) AS disagreement FROM j) SELECT pair_id, CASE WHEN disagreement IS NOT NULL THEN row_number() OVER (ORDER BY disagreement DESC NULLS LAST, pair_id) END AS position, disagreement FROM e",
    "graph_lookup": "SELECT string_split(p_name, ' ')[-1] AS form, 's' || p_partkey AS sense FROM part",
    "graph_children": f"WITH RECURSIVE {ref._GRAPH} SELECT dst AS sense, src AS child FROM edges WHERE label = 'primary'",
    "graph_descriptors": f"WITH RECURSIVE {ref._GRAPH} SELECT a.src AS sense, a.dst AS primary_parent, b.dst AS secondary_parent FROM edges a LEFT JOIN edges b ON a.src = b.src AND b.label = 'secondary' WHERE a.label = 'primary'",
    "graph_depth_histogram": f"WITH RECURSIVE {ref._GRAPH} SELECT depth, count(*) AS n FROM walk GROUP BY depth",
    "graph_best_sense": rounded_sql(f"""WITH RECURSIVE {ref._GRAPH}, f AS (SELECT 'w' || (p_partkey // 3) AS form, 's' || p_partkey AS sense FROM part), t AS (SELECT DISTINCT 'w' || (p_partkey // 3) AS target, 'w' || ((p_partkey // 3 + 1) // 3) AS response FROM part),
c AS (SELECT target, response, x.sense AS s1, y.sense AS s2, CASE WHEN x.sense = y.sense THEN 1.0 ELSE 2.0 * (len(list_filter(range(1, least(len(a.path), len(b.path)) + 1), lambda i: a.path[i] = b.path[i])) - 1) / nullif(a.depth + b.depth, 0) END::DOUBLE AS wu_palmer FROM t JOIN f x ON x.form = target JOIN f y ON y.form = response JOIN walk a ON a.sense = x.sense JOIN walk b ON b.sense = y.sense)
SELECT target, response, s.s1 AS s1, s.s2 AS s2, s.w AS wu_palmer FROM (SELECT target, response, arg_min({{'s1': s1, 's2': s2, 'w': wu_palmer}}, (-wu_palmer, s1, s2)) AS s FROM c WHERE wu_palmer IS NOT NULL GROUP BY ALL)""", "wu_palmer", "target response s1 s2"),
}
