import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexspark.operators import eav

SCHEMA = "row_id bigint, test_code string, participant_id string, attr_name string, attr_value string, entered_at timestamp"


def entries(spark, rows):
    return spark.createDataFrame([(i, t, p, a, v, None if d is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=d)) for i, t, p, a, v, d in rows], SCHEMA)


def test_wide_table(spark):
    df = entries(spark, [
        (1, "svf", "u1", " Kön:", "kvinna", 1), (2, "svf", "u1", "AGE :", "70,5 år", 1), (3, "svf", "u1", "MMSE (0-30)", "27 av 30", 1), (4, "svf", "u1", "mmse", "", 2), (5, "bnt", "u1", "MMSE", "26/30", 1),
        (6, "bnt", "u1", "Site", "syd", 1), (7, "bnt", "u1", "Education", "9", 1), (8, "svf", "u2", "Education", "12", 1), (9, "svf", "u2", None, "x", 1), (10, "svf", "u1", "GenderOfRater", "M", 9), (11, "svf", "u3", None, None, None),
    ])
    got = {(r.test_code, r.participant_id): r for r in eav.pivot_wide(df).collect()}
    assert len(got) == 4
    a, b, c = got[("svf", "u1")], got[("bnt", "u1")], got[("svf", "u2")]
    assert (a.Gender, a.Age, a.MMSE, a.genderofrater) == ("F", 70.5, None, "M")  # the later, blank entry holds
    assert (b.MMSE, b.site, b.education) == (26.0, "syd", 9.0) and c.education == 12.0 and got[("svf", "u3")].Gender is None


def test_equal_times_go_by_row_id_and_repeats_do_not_matter(spark):
    df = entries(spark, [(1, "s", "u", "Age", "1", 5), (2, "s", "u", "Age", "2", 5), (3, "s", "u", "Age", "3", None), (2, "s", "u", "Age", "2", 5)])
    assert [r.Age for r in eav.pivot_wide(df, discover=False).collect()] == [2.0]


def test_null_cells_and_entities_across_batches(spark):
    n = 5000
    df = spark.range(n).selectExpr("id AS row_id", "'s' AS test_code", "concat('u', id div 3) AS participant_id", "element_at(array('Gender', 'Age', 'Other'), cast(id % 3 + 1 AS int)) AS attr_name", "CASE WHEN id % 3 = 0 THEN 'M' ELSE cast(id % 90 AS string) END AS attr_value", "timestamp'2024-01-01' AS entered_at")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        wide = eav.pivot_wide(df, eav.PARTICIPANT_ATTRIBUTES[:3], discover=False)
        rows = wide.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == len({r.participant_id for r in rows}) == (n + 2) // 3 and all(r.Gender == "M" and r.MMSE is None for r in rows)
    assert eav.null_cells(wide, ["Gender", "Age", "MMSE"]).filter("attr_name = 'MMSE'").count() == len(rows)


def test_nulls_empty_tables_and_clashing_names(spark):
    df = entries(spark, [(1, None, None, "Age", "5", None), (2, None, None, "Participant_ID", "x", None), (3, "s", "u", "age group", "70-79", 1), (4, "s", "u", "AGE group", "80+", 2)]).withColumns({"attr": F.lit(1), "text": F.lit("t")})
    got = {r.test_code: r for r in eav.pivot_wide(df).collect()}
    assert got[None].Age == 5.0 and got[None].participant_id_attr == "x" and got["s"]["age group"] == "80+"
    assert eav.pivot_wide(df.limit(0)).count() == 0 and "Age" in eav.pivot_wide(df.limit(0)).columns
    with pytest.raises(ValueError):
        eav.attribute_dictionary(eav.current_cells(df, [], ("test_code", "participant_id"), ("entered_at", "row_id")), [], 1)
