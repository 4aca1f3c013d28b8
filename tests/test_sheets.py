import zipfile
from datetime import datetime

import pytest
from compare import same_rows
from pyspark.sql import functions as F

from lexspark.__main__ import main
from lexspark.plans import pipelines, workflows
from lexspark.sources import sheets, tables, xlsx


def write_xlsx(path, rows):
    """A minimal workbook: texts shared, numbers plain, None absent."""
    shared, body = [], []
    for i, row in enumerate(rows, 1):
        cells = []
        for j, v in enumerate(row):
            ref = f"{chr(65 + j)}{i}"
            if v is None:
                continue
            if isinstance(v, str):
                shared.append(v)
                cells.append(f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>')
            else:
                cells.append(f'<c r="{ref}"><v>{v}</v></c>')
        body.append(f'<row r="{i}">{"".join(cells)}</row>')
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Blad1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><t>{esc(s)}</t></si>' for s in shared)}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(body)}</sheetData></worksheet>")


META = [["Gender:", "M", "F"], ["Age:", 70.0, "x"], ["Category:", "HC", "AD"], ["Kategori:", "HC", "MCI"], ["MMSE", 29, None]]


@pytest.fixture
def sheet(spark, tmp_path):
    def make(rows, first=None):
        write_xlsx(tmp_path / "t.xlsx", [[first, "User-1", "User-2.1"], *rows, *META])
        return sheets.read_sheet(spark, str(tmp_path / "t.xlsx"))

    return make


def test_xlsx_rows(tmp_path):
    write_xlsx(tmp_path / "a.xlsx", [["h", None, "k"], [1.0, "å & b", None], [None, 2.5]])
    assert list(xlsx.read_rows(str(tmp_path / "a.xlsx"))) == [["h", None, "k"], ["1", "å & b"], [None, "2.5"]]
    assert list(xlsx.read_rows(str(tmp_path / "a.xlsx"), "Blad1"))[0][0] == "h"


def test_bnt(sheet, spark, tmp_path):
    answers, meta = sheets.load_bnt(sheet([["Kamel", "en kamel", "häst"], [None, "x", "y"], ["Sol", "nan", None], ["Total:", 1, 2]], "Gold"))
    got = {(r.gold, r.participant_id): r.raw_response for r in answers.collect()}
    assert got == {("kamel", "User-1"): "en kamel", ("kamel", "User-2.1"): "häst", ("sol", "User-1"): None, ("sol", "User-2.1"): None}
    m = {r.participant_id: r for r in meta.collect()}
    assert (m["User-1"].age, m["User-1"].mmse, m["User-2.1"].diagnosis, m["User-2.1"].age) == (70.0, 29.0, "MCI", None)
    scored = pipelines.bnt(spark, str(tmp_path / "t.xlsx"))
    assert {(r.gold, r.participant_id): r.cosine_sim for r in scored.collect()}[("kamel", "User-1")] == 1.0


def test_svf_skips_nulls(sheet, spark, tmp_path):
    words, _ = sheets.load_svf(sheet([["1", "Hund", "katt"], ["2", None, "KO "], ["3", "mus", "none"]]))
    assert [(r.participant_id, r.pos, r.word) for r in words.orderBy("participant_id", "pos").collect()] == [("User-1", 0, "hund"), ("User-1", 1, "mus"), ("User-2.1", 0, "katt"), ("User-2.1", 1, "ko")]
    out = pipelines.sheet_svf(spark, str(tmp_path / "t.xlsx"))
    assert tuple(out.columns) == tables.SVF_COLUMNS and {r.participant_id: r.total_words for r in out.collect()} == {"User-1": 2, "User-2.1": 2}


def test_fas_stops_at_the_first_null(sheet, spark, tmp_path):
    words, _ = sheets.load_fas(sheet([["1", "fil, apa, sol", "<Fia>, ,sak, extra"], ["2", None, "Fia, al, <Sven>"], ["3", "fel, ark, syn", None]]))
    rows = {(r.participant_id, r.letter, r.pos): (r.word, r.is_flagged) for r in words.collect()}
    assert rows[("User-1", "a", 0)] == ("apa", False) and ("User-1", "f", 1) not in rows
    assert rows[("User-2.1", "f", 0)] == ("fia", True) and rows[("User-2.1", "f", 1)] == ("fia", True)  # flagged once, flagged everywhere
    assert rows[("User-2.1", "a", 0)] == ("", False) and rows[("User-2.1", "s", 1)] == ("sven", True)
    out = pipelines.sheet_fas(spark, str(tmp_path / "t.xlsx"))
    r = {x.participant_id: x for x in out.collect()}
    assert tuple(out.columns) == tables.FAS_COLUMNS and r["User-1"].total_fas_score == 3 and r["User-2.1"].proper_nouns_count == 3


def test_a_stack_of_sheets_is_read_as_each_of_them(spark):
    """Two sheets of different widths that share a name, with their metadata at different rows."""
    meta = lambda at, n: [(at + i, k, *([v] * n)) for i, (k, v) in enumerate((("Gender:", "F"), ("Age:", str(at)), ("Category:", "HC"), ("MMSE", "29")))]
    one = [(1, "a", "Hund", "nan", "ko"), (2, "b", "<Fia>, al", "x", None), *meta(3, 3)]
    two = [(1, "a", "katt"), (2, "b", "Fia,,s"), (3, "c:", "häst"), *meta(5, 1)]
    names = ["User-1", "note", "User-2"], ["User-1"]
    each = [spark.createDataFrame(rows, f"row_idx long, label string, {', '.join(f'`{u}` string' for u in users)}") for rows, users in zip((one, two), names)]
    stack = spark.createDataFrame([(i, *r, *[None] * (5 - len(r))) for i, rows in enumerate((one, two)) for r in rows], "sheet long, row_idx long, label string, `0` string, `1` string, `2` string")
    header = spark.createDataFrame(list(enumerate(names)), "sheet long, users array<string>")
    rows = lambda df: sorted(map(str, df.collect()))
    for load in (sheets.load_bnt, sheets.load_svf, sheets.load_fas):
        for k in (0, 1):
            got, want = load(stack, header)[k], [load(s)[k].withColumn("sheet", F.lit(i).cast("long")) for i, s in enumerate(each)]
            assert rows(got.select(want[0].columns)) == rows(want[0].union(want[1])) != []
    with pytest.raises(ValueError, match="metadata"):
        sheets.load_svf(stack.filter("sheet = 0 OR row_idx < 4"), header)
    with pytest.raises(ValueError, match="User"):
        sheets.load_svf(stack, header.filter("sheet = 0").union(spark.createDataFrame([(1, ["note"])], header.schema)))
    with pytest.raises(ValueError, match="columns"):
        sheets.load_svf(stack.drop("2"), header)


@pytest.mark.parametrize("name", ["sheet_words", "sheet_meta"])
def test_steps_do_not_grow_with_the_sheets(spark, tmp_path, name):
    """One sheet of 90 participants or eleven of a hundred: as many jobs, the rows of the SQL."""
    jobs = []
    for k, n in enumerate((90, 1100)):
        rows = [(f"User-{i}", [f"Ord {i % 7}", None, "nan", f" ko{i % 3} "], "F", 60.0 + i % 9, "hc", None, "a", datetime(2024, 1, 1)) for i in range(n)]
        spark.createDataFrame(rows, "participant_id string, responses array<string>, gender string, age double, diagnosis string, mmse double, source_file string, loaded_at timestamp").write.parquet(f"{tmp_path}/{k}/svf_participant.parquet")
        spark.sparkContext.setJobGroup(f"{name}-{n}", name)
        try:
            same_rows(spark, f"{tmp_path}/{k}", workflows.QUERIES[name], workflows.SQL[name])
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{name}-{n}")))
    assert 0 < jobs[1] <= jobs[0] + 3
    plan = workflows.QUERIES[name](spark, f"{tmp_path}/1")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan.split("ShuffledHashJoin")[0]


def test_no_user_columns_or_metadata(spark):
    with pytest.raises(ValueError):
        sheets.user_columns(spark.createDataFrame([(1, "a")], "row_idx long, x string"))
    with pytest.raises(ValueError):
        sheets.split_rows(spark.createDataFrame([(1, "a", "b")], "row_idx long, x string, `User-1` string"))
    assert sheets.resolve([sheets.Dataset("bnt", "p")], "bnt").path == "p"
    with pytest.raises(KeyError):
        sheets.resolve([], "bnt")


def test_rating_files_and_reports(spark, tmp_path):
    (tmp_path / "ratings_anna.csv").write_text('pair_id,target,response,rating,category,is_compound,notes\n1,a,b,2,other,True,"x, ""y"""\n', encoding="utf-8")
    r = tables.read_ratings(spark, str(tmp_path / "*.csv")).first()
    assert (r.rater_id, r.rating, r.notes) == ("anna", 2, 'x, "y"')
    df = spark.createDataFrame([("a", 1.5, None)], "x string, y double, z int")
    assert tables.to_markdown(df) == "| x | y | z |\n| --- | --- | --- |\n| a | 1.500 |  |"
    with pytest.raises(ValueError):
        tables.to_markdown(df.union(df), 1)
    tables.save_csv(df, str(tmp_path / "out"), ("z",))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["z", "x", "y"]


def test_rater_samples_and_analysis(spark):
    rows = [(f"u{i}", "F", 70.0, "HC", 28.0, f"g{i % 7}", f"r{i}", f"r{i}", False, False, i / 100) for i in range(100)]
    scored = spark.createDataFrame(rows, "participant_id string, gender string, age double, diagnosis string, mmse double, gold string, raw_response string, normalized string, is_exact_match boolean, is_non_response boolean, cosine_sim double")
    s = pipelines.rater_samples(scored, "m", 2, 10, 5)
    assert s["master"].count() == 40 and s["rater1"].count() == 40 and s["training2"].count() == 5
    assert not {(r.target, r.response) for r in s["training1"].collect()} & {(r.target, r.response) for r in s["master"].collect()}
    files = [s["rater1"].selectExpr("pair_id", f"CAST(order_idx % {k} AS int) AS rating", "'other' AS category", "true AS is_compound") for k in (4, 3)]
    models = scored.selectExpr("gold", "raw_response", "'m' AS model_name", "cosine_sim")
    out = pipelines.rating_analysis(files, s["master"], models)
    assert out["reliability"].count() == 1 and out["models"].first().n == 40 and out["divergence"].count() == 40 and out["by_category"].count() == 1
    with pytest.raises(ValueError):
        pipelines.rating_analysis(files[:1], s["master"], models)


def test_calibration_and_command_line(sheet, spark, tmp_path):
    s = sheet([["1", "hund", "katt"], ["2", "get", "ko"], ["3", "mus", "val"]])
    words, meta = sheets.load_svf(s)
    sweep, best = pipelines.calibrate_threshold(words, meta, low=0.0, high=0.1, step=0.05)
    assert sweep.count() == 0 and best.count() == 0  # each diagnosis has one participant only
    meta = meta.withColumn("diagnosis", F.lit("HC")).union(meta.withColumns({"participant_id": F.concat("participant_id", F.lit("b")), "diagnosis": F.lit("AD")}))
    words = words.union(words.withColumn("participant_id", F.concat("participant_id", F.lit("b"))))
    sweep, best = pipelines.calibrate_threshold(words, meta, low=0.0, high=0.1, step=0.05)
    assert sweep.count() == 9 and best.count() <= 3
    with pytest.raises(SystemExit):
        main(["nothing"])


def test_registered_sheets(sheet, spark, tmp_path):
    sheet([["1", "hund", "katt"]])
    (tmp_path / "tests.json").write_text('{"svf": {"path": "t.xlsx"}, "bnt": {"path": "s3://b/x.xlsx", "sheet": 1}}', encoding="utf-8")
    known = sheets.registry(str(tmp_path / "tests.json"))
    assert sheets.resolve(known, "bnt") == sheets.Dataset("bnt", "s3://b/x.xlsx", "1")
    d = sheets.resolve(known, "svf")
    assert {r.word for r in sheets.load_svf(sheets.read_sheet(spark, d.path, d.sheet))[0].collect()} == {"hund", "katt"}
