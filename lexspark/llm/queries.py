"""Queries of the training-data operators and, where SQL can express them, the same rows as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import consensus, dedup, mixing, packing, quota, splitting, terms
from lexspark.session import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = quota.quota_sample(table(spark, d, "sq3_pairs"), table(spark, d, "sq3_targets"))
    return report.filter("shortfall > 0").select("target_id").distinct()


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return quota.quota_sample(table(spark, d, "sq3_pairs"), table(spark, d, "sq3_targets"))[0]


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    _, report = quota.quota_sample(table(spark, d, "sq3_pairs"), table(spark, d, "sq3_targets"))
    return report.select("target_id", "draw_id", "needed", "available", "quota", "drawn", "shortfall", "floor_excess")


_TASKS = (consensus.RATING, consensus.CATEGORY, consensus.COMPOUND)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    _, raters = consensus.community_consensus(table(spark, d, "sq3_ratings"), consensus.RATING, watch=0.45)
    return consensus.unrelated_raters(raters, 0.45).select(F.col("rater").alias("rater_id"))


def _each_task(spark: SparkSession, d: str, which: int) -> DataFrame:
    judgements, out = cut(consensus.clean_judgements(table(spark, d, "sq3_ratings"), _TASKS), "judgements"), None
    for task, parts in zip(_TASKS, consensus.community_models(judgements, _TASKS)):
        part = parts[which].withColumn("task", F.lit(task.name))
        out = part if out is None else out.unionByName(part)
    return out


def p3_consensus(spark: SparkSession, d: str) -> DataFrame:
    return _each_task(spark, d, 0).withColumnRenamed("item", "pair_id")


def p3_raters(spark: SparkSession, d: str) -> DataFrame:
    return _each_task(spark, d, 1).withColumnRenamed("rater", "rater_id")


def p3_agreement(spark: SparkSession, d: str) -> DataFrame:
    out = consensus.overall_agreement(consensus.clean_judgements(table(spark, d, "sq3_ratings"), _TASKS), _TASKS)
    return out.select("task", "n_items", "n_labels", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "coefficient")])


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequency(table(spark, d, "svf_participant"), "participant_id", "responses")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).filter("term_mark IS NOT NULL").select("term", "term_mark")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select("term", "occurrences", "records", "term_mark")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.collapse(table(spark, d, "response_exports"), "record_id", "payload")


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "response_exports")
    return dedup.distinct_records(rows, "record_id", "payload", dedup.collapse(rows, "record_id", "payload")).select("record_id", "n_copies")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(packing.pack_documents(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return mixing.unreachable(report).select("mix_id", "source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.cut_kinds(splitting.split_oversized(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {
    "p1_found": p1_found, "p1_sample": p1_sample, "p1_report": p1_report, "p3_found": p3_found, "p3_consensus": p3_consensus, "p3_raters": p3_raters, "p3_agreement": p3_agreement,
    "p4_found": p4_found, "p4_terms": p4_terms, "p5_found": p5_found, "p5_records": p5_records,
    "p7_containers": p7_containers, "p8_found": p8_found, "p8_mix": p8_mix, "p8_report": p8_report, "p9_found": p9_found, "p9_pieces": p9_pieces,
}

_P1 = r"""
WITH RECURSIVE coded AS (SELECT DISTINCT draw_id, pair_id, cosine_quartile AS q, regexp_replace(lower(diagnosis), '[^\p{L}\p{N}]', '', 'g') AS dx, regexp_replace(lower(model), '[^\p{L}\p{N}]', '', 'g') AS m FROM sq3_pairs),
wanted AS (SELECT *, regexp_replace(lower(diagnosis), '[^\p{L}\p{N}]', '', 'g') AS dx, regexp_replace(lower(model), '[^\p{L}\p{N}]', '', 'g') AS m,
  greatest(min_pairs, floor(target_share * sample_size + 0.5))::BIGINT AS needed FROM sq3_targets),
report AS (SELECT t.target_id, any_value(t.draw_id) AS draw_id, any_value(t.needed) AS needed, any_value(target_share) AS share, any_value(min_pairs) AS floor_, any_value(sample_size) AS size, count(DISTINCT p.pair_id) AS available FROM wanted t LEFT JOIN coded p
  ON p.draw_id = t.draw_id AND (t.cosine_quartile IS NULL OR p.q = t.cosine_quartile) AND (t.dx IS NULL OR p.dx = t.dx) AND (t.m IS NULL OR p.m = t.m) GROUP BY t.target_id)
"""
# the level at which shares clipped to floors and availability add up to the size is found by halving an interval
_P1_QUOTAS = _P1 + r""", t AS (SELECT *, least(floor_, available) AS low FROM report),
g AS (SELECT draw_id, least(greatest(max(size), sum(low)), sum(available)) AS total, sum(low) AS lows, max(CASE WHEN share > 0 THEN available / share END) + 1 AS top, greatest(sum(low) - max(size), 0) AS floor_excess FROM t GROUP BY draw_id),
halves AS (SELECT draw_id, 0 AS i, 0.0::DOUBLE AS a, top::DOUBLE AS b FROM g
  UNION ALL SELECT h.draw_id, any_value(h.i) + 1, CASE WHEN sum(least(greatest((h.a + h.b) / 2 * share, low), available)) < any_value(total) THEN any_value((h.a + h.b) / 2) ELSE any_value(h.a) END,
    CASE WHEN sum(least(greatest((h.a + h.b) / 2 * share, low), available)) < any_value(total) THEN any_value(h.b) ELSE any_value((h.a + h.b) / 2) END
  FROM halves h JOIN t USING (draw_id) JOIN g USING (draw_id) WHERE h.i < 90 GROUP BY h.draw_id),
ideal AS (SELECT t.*, total, lows, floor_excess, CASE WHEN total > lows THEN least(greatest(h.b * share, low), available) ELSE low END AS x FROM t JOIN g USING (draw_id) JOIN halves h ON h.draw_id = t.draw_id AND h.i = 90),
whole AS (SELECT *, greatest(least(floor(x + 1e-9), available), low)::BIGINT AS q0 FROM ideal),
ranked AS (SELECT *, total - sum(q0) OVER (PARTITION BY draw_id) AS open, row_number() OVER (PARTITION BY draw_id, q0 < available AND share > 0 ORDER BY -round(x - q0, 9), target_id) AS place FROM whole)
"""
_P3_LABELS = r"""
WITH said AS (SELECT pair_id, rater_id, rating_id, loaded_at, CASE WHEN rating BETWEEN 0 AND 3 THEN rating END AS r,
  list_position(['coordinate', 'hypernym', 'hyponym', 'circumlocution', 'phonological', 'unrelated', 'other'], regexp_replace(lower(category), '[\pZ\s]', '', 'g')) AS c,
  CASE WHEN regexp_replace(lower(is_compound), '[\pZ\s]', '', 'g') IN ('true', '1', 'yes', 'y', 't') THEN 1 WHEN regexp_replace(lower(is_compound), '[\pZ\s]', '', 'g') IN ('false', '0', 'no', 'n', 'f') THEN 0 END AS f
  FROM sq3_ratings WHERE pair_id IS NOT NULL AND rater_id IS NOT NULL),
last AS (SELECT pair_id, rater_id, arg_max({'r': r, 'c': c, 'f': f}, (loaded_at, coalesce(r, -1), coalesce(c, 0), coalesce(f, -1))) AS s FROM said GROUP BY pair_id, rater_id, rating_id),
labels AS (SELECT 'rating' AS task, pair_id, s.r AS l FROM last UNION ALL SELECT 'category', pair_id, s.c FROM last UNION ALL SELECT 'is_compound', pair_id, s.f FROM last)
"""
_P4 = r"""
WITH raw AS (SELECT participant_id, unnest(responses) AS x FROM svf_participant),
clean AS (SELECT participant_id, regexp_replace(regexp_replace(nfc_normalize(lower(nfc_normalize(x))), '[\pZ\s]+', ' ', 'g'), '^[\pZ\s\pP\pS]+|[\pZ\s\pP\pS]+$', '', 'g') AS term FROM raw),
counts AS (SELECT term, count(*) AS occurrences, count(DISTINCT participant_id) AS records FROM clean WHERE term NOT IN ('', 'nan', 'none') GROUP BY term),
marked AS (SELECT *, CASE WHEN records > 0.3 * (SELECT count(DISTINCT participant_id) FROM svf_participant) THEN 'common' WHEN records < 3 THEN 'rare' END AS term_mark FROM counts)
"""
_P5 = r"""
WITH words AS (SELECT record_id, regexp_extract_all(lower(nfc_normalize(payload)), '[\p{L}\p{N}\p{M}]+') AS w FROM response_exports WHERE payload IS NOT NULL),
places AS (SELECT record_id, w, list_position(w, 'test') AS a, list_position(w, 'participant') AS b, list_position(w, 'session') AS c, list_position(w, 'responses') AS d FROM words),
parts AS (SELECT record_id, list_transform([a, b, c, d], lambda x: array_to_string(list_slice(w, x + 1, coalesce(list_min(list_filter([a, b, c, d], lambda y: y > x)) - 1, len(w))), ' ')) AS k FROM places),
sets AS (SELECT record_id, min(record_id) OVER (PARTITION BY k) AS kept_id, count(*) OVER (PARTITION BY k) AS n FROM parts)
"""
SQL = {
    "p1_found": _P1 + "SELECT target_id FROM report WHERE available < needed",
    "p1_report": _P1_QUOTAS + "SELECT target_id, draw_id, needed, available, q0 + (q0 < available AND share > 0 AND place <= open)::BIGINT AS quota, q0 + (q0 < available AND share > 0 AND place <= open)::BIGINT AS drawn, greatest(needed - available, 0) AS shortfall, floor_excess FROM ranked",
    "p3_agreement": _P3_LABELS + """, votes AS (SELECT task, pair_id, l, count(*)::DOUBLE AS v FROM labels WHERE l IS NOT NULL GROUP BY ALL), items AS (SELECT task, pair_id, sum(v) AS n, sum(v * (v - 1)) AS same FROM votes GROUP BY ALL),
o AS (SELECT task, count(*) AS n_items, sum(n)::BIGINT AS n_labels, sum(n * same / (n * (n - 1))) FILTER (n > 1) / sum(n) FILTER (n > 1) AS observed FROM items GROUP BY task),
e AS (SELECT task, sum((t / a) * (t / a)) AS expected FROM (SELECT task, sum(v) AS t, sum(sum(v)) OVER (PARTITION BY task) AS a FROM votes GROUP BY task, l) GROUP BY task)
SELECT task, n_items, n_labels, round(observed, 6) AS observed, round(expected, 6) AS expected, round((observed - expected) / (1 - expected), 6) AS coefficient FROM o JOIN e USING (task)""",
    "p4_found": _P4 + "SELECT term, term_mark FROM marked WHERE term_mark IS NOT NULL",
    "p4_terms": _P4 + "SELECT term, occurrences, records, term_mark FROM marked",
    "p5_found": _P5 + "SELECT kept_id, record_id AS copy_id FROM sets WHERE record_id > kept_id",
    "p5_records": _P5 + "SELECT record_id, n AS n_copies FROM sets WHERE record_id = kept_id",
    # no case is near a border, so characters stand for tokens
    "p8_found": r"""
WITH coded AS (SELECT regexp_replace(lower(source), '[^\p{L}\p{N}]', '', 'g') AS k, length(text) AS n FROM documents WHERE text IS NOT NULL),
have AS (SELECT k, sum(n) AS n FROM coded GROUP BY k), whole AS (SELECT sum(n) AS n FROM coded)
SELECT m.mix_id, m.source FROM mix_targets m CROSS JOIN whole w LEFT JOIN have h ON h.k = regexp_replace(lower(m.source), '[^\p{L}\p{N}]', '', 'g')
WHERE m.max_repeats * coalesce(h.n, 0) < m.target_share * m.size_ratio * w.n
""",
    # words and marks stand for tokens
    "p9_found": r"""
WITH sized AS (SELECT doc_id, text, len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')) AS n FROM documents WHERE length(text) > 2048),
big AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '([.!?…])\s', '\1' || chr(10), 'g'), '[\n\r]+')) AS part FROM sized WHERE n > 1600)
SELECT doc_id, CASE WHEN max(len(regexp_extract_all(part, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]'))) > 1600 THEN 'forced' ELSE 'natural' END AS cut_kind FROM big GROUP BY doc_id
""",
}
