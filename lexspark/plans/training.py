"""Queries of the general data-preparation operators: drifting schemas, attribute-value rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators import drift, eav
from lexspark.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "sheet_records")).select("file_id", "field_label", "change_kind")


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent_table(table(spark, d, "sheet_records"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    three = [a for a in eav.PARTICIPANT_ATTRIBUTES if a.name in ("Gender", "Age", "MMSE")]
    wide = eav.pivot_wide(table(spark, d, "meta_entries"), three, discover=False)
    return eav.null_cells(wide, ["Gender", "Age", "MMSE"])


def p6_wide(spark: SparkSession, d: str) -> DataFrame:
    return eav.pivot_wide(table(spark, d, "meta_entries"))


QUERIES = {"p2_found": p2_found, "p2_records": p2_records, "p6_found": p6_found, "p6_wide": p6_wide}

# written out, so that the SQL does not depend on the lists of the code it checks
_P2_FIELDS = (
    "CASE"
    " WHEN lab IN ('gender', 'kön', 'sex') THEN 'Gender'"
    " WHEN lab IN ('age', 'ålder', 'age_years', 'age (years)', 'ålder (år)') THEN 'Age'"
    " WHEN lab IN ('category', 'categories', 'kategori', 'diagnos', 'diagnosis', 'diagnosgrupp', 'dx_group') THEN 'Category'"
    " WHEN lab IN ('mmse', 'mmse_score', 'mmse score', 'mmse_total', 'mmse total', 'mmse poäng', 'mmse-poäng', 'mmt', 'mmse (0-30)') THEN 'MMSE'"
    " WHEN lab IN ('education_years', 'utbildningsår', 'education') THEN 'EducationYears'"
    " WHEN lab IN ('firstlanguage', 'first_language', 'modersmål') THEN 'FirstLanguage'"
    " WHEN lab IN ('hearingaid', 'hearing_aid', 'hörapparat') THEN 'HearingAid'"
    " WHEN lab IN ('ageatonset') THEN 'AgeAtOnset'"
    " WHEN lab IN ('moca') THEN 'MoCA'"
    " WHEN lab IN ('sessionminutes') THEN 'SessionMinutes'"
    " WHEN lab IN ('site') THEN 'Site'"
    " ELSE lab END"
)
_BLANK = "'', 'nan', 'none', 'null', '?', '-', 'n/a', 'na', '#ref!', 'okänd', 'okänt', 'saknas', 'ej angivet', 'ej angiven'"
SQL = {
    "p2_found": rf"""
WITH recs AS (SELECT DISTINCT series_id, file_seq, file_id, record_no, payload::JSON AS p FROM sheet_records),
raw AS (SELECT series_id, file_seq, file_id, p, unnest(json_keys(p)) AS k FROM recs),
cells AS (SELECT series_id, file_seq, file_id, trim(regexp_replace(lower(trim(k)), ':$', '')) AS lab,
  CASE json_type(json_extract(p, '$."' || k || '"')) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind FROM raw),
named AS (SELECT *, {_P2_FIELDS} AS field FROM cells),
files AS (SELECT *, lag(file_id) OVER (PARTITION BY series_id ORDER BY file_seq) AS prev_id FROM (SELECT DISTINCT series_id, file_seq, file_id FROM sheet_records)),
present AS (SELECT file_id, field, min(lab) AS lab FROM named GROUP BY ALL),
cur AS (SELECT f.file_id, p.field, p.lab FROM files f JOIN present p ON p.file_id = f.file_id WHERE f.prev_id IS NOT NULL),
bef AS (SELECT f.file_id, p.field, p.lab FROM files f JOIN present p ON p.file_id = f.prev_id),
kinds AS (SELECT series_id, file_seq, file_id, field, max_by(kind, (n, kind)) AS kind FROM (SELECT series_id, file_seq, file_id, field, kind, count(*) AS n FROM named WHERE kind IS NOT NULL GROUP BY ALL) GROUP BY ALL),
typed AS (SELECT *, lag(kind) OVER (PARTITION BY series_id, field ORDER BY file_seq) AS before FROM kinds)
SELECT coalesce(c.file_id, b.file_id) AS file_id, coalesce(c.lab, b.lab) AS field_label,
  CASE WHEN b.lab IS NULL THEN 'added' WHEN c.lab IS NULL THEN 'removed' ELSE 'renamed' END AS change_kind
FROM cur c FULL JOIN bef b ON c.file_id = b.file_id AND c.field = b.field WHERE c.lab IS DISTINCT FROM b.lab
UNION ALL
SELECT t.file_id, p.lab, 'retyped' FROM typed t JOIN present p ON p.file_id = t.file_id AND p.field = t.field WHERE t.before <> t.kind
""",
    "p6_found": r"""
WITH named AS (SELECT test_code, participant_id, row_id, entered_at, attr_value,
  CASE WHEN k IN ('gender', 'kön', 'sex') THEN 'Gender' WHEN k IN ('age', 'ålder', 'age_years', 'age (years)', 'ålder (år)') THEN 'Age' WHEN k IN ('mmse', 'mmse-poäng', 'mmse poäng', 'mmse_score', 'mmse score', 'mmse_total', 'mmse total', 'mmt', 'mmse (0-30)') THEN 'MMSE' END AS attr_name
  FROM (SELECT *, trim(regexp_replace(lower(trim(attr_name)), ':$', '')) AS k FROM meta_entries)),
last AS (SELECT test_code, participant_id, attr_name, arg_max(coalesce(attr_value, ''), (entered_at, row_id)) AS v FROM named WHERE attr_name IS NOT NULL GROUP BY ALL),
wanted AS (SELECT DISTINCT test_code, participant_id, a.attr_name FROM meta_entries, (VALUES ('Gender'), ('Age'), ('MMSE')) a(attr_name)),
said AS (SELECT w.*, CASE w.attr_name
  WHEN 'Gender' THEN lower(trim(v)) IN ('m', 'man', 'male', 'f', 'k', 'kvinna', 'female')
  WHEN 'Age' THEN len(regexp_extract_all(v, '\d+([.,]\d+)?')) = 1
  ELSE len(regexp_extract_all(regexp_replace(v, '(/|av)\s*30\b', ''), '\d+([.,]\d+)?')) = 1 END AS good
  FROM wanted w LEFT JOIN last l ON w.test_code = l.test_code AND w.participant_id = l.participant_id AND w.attr_name = l.attr_name)
SELECT test_code, participant_id, attr_name FROM said WHERE good IS NOT TRUE
""",
    "p2_records": rf"""
WITH last AS (SELECT file_id, record_no, arg_max({{'s': series_id, 'q': file_seq, 't': test_code, 'u': participant_id, 'p': payload}}, (arrived_at, payload)) AS r FROM sheet_records GROUP BY ALL),
raw AS (SELECT file_id, record_no, r.p::JSON AS p, unnest(json_keys(r.p::JSON)) AS k FROM last),
cells AS (SELECT file_id, record_no, {_P2_FIELDS} AS field, v FROM (SELECT file_id, record_no, trim(regexp_replace(lower(trim(k)), ':$', '')) AS lab, json_extract_string(p, '$."' || k || '"') AS v FROM raw) WHERE v IS NOT NULL),
scalars AS (SELECT file_id, record_no, field, v, CASE WHEN v[1] = '{{' THEN coalesce(json_extract_string(v, '$.score'), json_extract_string(v, '$.code')) WHEN v[1] = '[' THEN json_extract_string(v, '$[0]') ELSE v END AS x FROM cells),
typed AS (SELECT *, CASE WHEN lower(trim(v)) NOT IN ({_BLANK}) THEN v END AS txt, CASE WHEN lower(trim(x)) IN ('m', 'man', 'male', '1') THEN 'M' WHEN lower(trim(x)) IN ('f', 'k', 'kvinna', 'female', 'woman', '2') THEN 'F' END AS sex,
  regexp_extract_all(CASE WHEN field = 'MMSE' THEN regexp_replace(x, '(/|av)\s*30\b', '') ELSE x END, '\d+([.,]\d+)?') AS nums,
  CASE regexp_replace(lower(regexp_replace(x, '\.0+$', '')), '[^\p{{L}}\p{{N}}]', '', 'g') WHEN '1' THEN 'HC' WHEN '2' THEN 'MCI' WHEN '3' THEN 'AD' WHEN '4' THEN 'non-AD' WHEN 'hc' THEN 'HC' WHEN 'mci' THEN 'MCI' WHEN 'ad' THEN 'AD' WHEN 'nonad' THEN 'non-AD' END AS code,
  CASE WHEN lower(trim(x)) IN ('true', 'ja', 'yes', '1') THEN true WHEN lower(trim(x)) IN ('false', 'nej', 'no', '0') THEN false END AS flag FROM scalars),
wide AS (SELECT file_id, record_no, max(sex) FILTER (field = 'Gender') AS "Gender", max(code) FILTER (field = 'Category') AS "Category", max(txt) FILTER (field = 'FirstLanguage') AS "FirstLanguage", bool_or(flag) FILTER (field = 'HearingAid') AS "HearingAid", max(txt) FILTER (field = 'Site') AS "Site",
  {', '.join(f"""max(replace(nums[1], ',', '.')::DOUBLE) FILTER (field = '{f}' AND len(nums) = 1) AS "{f}" """ for f in ("Age", "MMSE", "EducationYears", "AgeAtOnset", "MoCA", "SessionMinutes"))} FROM typed GROUP BY ALL)
SELECT r.s AS series_id, r.q AS file_seq, file_id, record_no, r.t AS test_code, r.u AS participant_id, "Gender", "Age", "Category", "MMSE", "EducationYears", "FirstLanguage", "HearingAid", "AgeAtOnset", "MoCA", "SessionMinutes", "Site" FROM last LEFT JOIN wide USING (file_id, record_no)
""",
    "p6_wide": rf"""
WITH named AS (SELECT *, CASE WHEN k IN ('gender', 'kön', 'sex') THEN 'Gender' WHEN k IN ('age', 'ålder', 'age_years', 'age (years)', 'ålder (år)') THEN 'Age' WHEN k IN ('mmse', 'mmse-poäng', 'mmse poäng', 'mmse_score', 'mmse score', 'mmse_total', 'mmse total', 'mmt', 'mmse (0-30)') THEN 'MMSE' WHEN k IN ('category', 'kategori', 'diagnos', 'diagnosis') THEN 'Category' ELSE k END AS attr
  FROM (SELECT *, trim(regexp_replace(lower(trim(attr_name)), ':$', '')) AS k FROM meta_entries)),
last AS (SELECT test_code, participant_id, attr, arg_max(coalesce(attr_value, ''), (entered_at, row_id)) AS v FROM named GROUP BY ALL),
typed AS (SELECT *, CASE WHEN lower(trim(v)) NOT IN ({_BLANK}) THEN v END AS txt, CASE WHEN lower(trim(v)) IN ('m', 'man', 'male', '1') THEN 'M' WHEN lower(trim(v)) IN ('f', 'k', 'kvinna', 'female', 'woman', '2') THEN 'F' END AS sex,
  regexp_extract_all(CASE WHEN attr = 'MMSE' THEN regexp_replace(v, '(/|av)\s*30\b', '') ELSE v END, '\d+([.,]\d+)?') AS nums FROM last)
SELECT test_code, participant_id, max(sex) FILTER (attr = 'Gender') AS "Gender", {', '.join(f"""max(replace(nums[1], ',', '.')::DOUBLE) FILTER (attr = '{a}' AND len(nums) = 1) AS "{a}" """ for a in ("Age", "MMSE"))},
  {', '.join(f"""max(try_cast(trim(v) AS DOUBLE)) FILTER (attr = '{a}') AS "{a}" """ for a in ("ageatonset", "education", "mmse version"))}, {', '.join(f"""max(txt) FILTER (attr = '{a}') AS "{a}" """ for a in ("Category", "age group", "comment", "firstlanguage", "genderofrater", "handedness", "hearingaid", "interpreter", "mmse_date", "site"))}
FROM typed GROUP BY test_code, participant_id
""",
}
