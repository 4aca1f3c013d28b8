"""Wide test sheets -> long tables. A sheet has row_idx, a label column and one column per participant (User-N); its
metadata rows are known by their labels, wherever they stand. Many sheets are read at once as a stack (`split_rows`)."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions.text import META_LABEL, is_flagged, is_null_text, meta_key, triplet, unflagged
from lexspark.sources import xlsx


@dataclass(frozen=True)
class Dataset:
    """A registered test: its kind and where its sheet lies."""

    test: str
    path: str
    sheet: str = "0"


def registry(path: str) -> list[Dataset]:
    """The registered tests of a JSON file: {"bnt": {"path": .., "sheet": ..}, ..}; paths that are not absolute lie beside
    the file."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    here = os.path.dirname(os.path.abspath(path))
    return [Dataset(test, d["path"] if "://" in d["path"] else os.path.join(here, d["path"]), str(d.get("sheet", "0"))) for test, d in found.items()]


def resolve(registry: list[Dataset], test: str) -> Dataset:
    for d in registry:
        if d.test == test:
            return d
    raise KeyError(f"no dataset for {test!r}")


def read_sheet(spark: SparkSession, path: str, sheet: str = "0") -> DataFrame:
    """A sheet from .xlsx or .csv, all cells texts, with row_idx."""
    if path.lower().rstrip("/").endswith(".csv"):
        df = spark.read.option("header", True).csv(path)
        return df.select(F.monotonically_increasing_id().alias("row_idx"), *[F.col(f"`{c}`") for c in df.columns])
    xlsx.register(spark)
    return spark.read.format("xlsx").option("sheet", sheet).load(path)


def user_columns(sheet: DataFrame) -> list[str]:
    users = [c for c in sheet.columns if c.startswith("User")]
    if not users:
        raise ValueError("no column begins with User")
    return users


def _label_column(sheet: DataFrame) -> str:
    return next(c for c in sheet.columns if c != "row_idx")


def long_cells(sheet: DataFrame) -> DataFrame:
    """(row_idx, label, participant_id, value); cells that stand for null are null. No shuffle."""
    users = user_columns(sheet)
    rows = sheet.select("row_idx", F.col(f"`{_label_column(sheet)}`").cast("string").alias("label"), *[F.col(f"`{u}`").cast("string") for u in users])
    out = rows.unpivot(["row_idx", "label"], [f"`{u}`" for u in users], "participant_id", "value")
    return _nulled(out)


def _nulled(cells: DataFrame) -> DataFrame:
    return cells.withColumn("value", F.when(~is_null_text(F.col("value")), F.col("value")))


def split_rows(sheet: DataFrame, header: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells above the first metadata row, metadata cells with their `field`). An error without a metadata row.

    With a `header` (sheet, users: the names of the columns in their order), `sheet` is a stack of any number of sheets:
    sheet, row_idx, the label column and as many columns as the widest has. The cells have `sheet` too, and no step is
    taken for each sheet."""
    if header is not None:
        return _split_stack(sheet, header)
    cells = long_cells(sheet)
    first = sheet.filter(F.col(f"`{_label_column(sheet)}`").rlike(META_LABEL)).agg(F.min("row_idx")).first()[0]
    if first is None:
        raise ValueError("no metadata row")
    return cells.filter(F.col("row_idx") < first), cells.filter(F.col("label").rlike(META_LABEL)).withColumn("field", meta_key(F.col("label")))


def _split_stack(stack: DataFrame, header: DataFrame) -> tuple[DataFrame, DataFrame]:
    label, *places = [c for c in stack.columns if c not in ("sheet", "row_idx")]
    rows = stack.select("sheet", "row_idx", F.col(f"`{label}`").cast("string").alias("label"), F.array(*[F.col(f"`{c}`").cast("string") for c in places]).alias("value"))
    first = rows.filter(F.col("label").rlike(META_LABEL)).groupBy("sheet").agg(F.min("row_idx").alias("_first"))
    heads = header.select("sheet", F.col("users").alias("participant_id")).join(first, "sheet", "left")
    users = F.exists("participant_id", lambda u: F.coalesce(u.startswith("User"), F.lit(False)))
    faults = heads.agg(F.count_if(~users).alias("users"), F.count_if(F.col("_first").isNull()).alias("rows"), F.max(F.size("participant_id")).alias("width")).first()
    if faults["users"]:
        raise ValueError("no column begins with User")
    if faults["rows"]:
        raise ValueError("no metadata row")
    if (faults["width"] or 0) > len(places):
        raise ValueError("a header has more names than the stack has columns")
    # without the hint the stack, small as a file, is broadcast; hashed is the header
    cells = rows.join(heads.hint("shuffle_hash"), "sheet").select("sheet", "row_idx", "label", "_first", F.inline(F.arrays_zip("participant_id", "value")))
    cells = _nulled(cells.filter(F.col("participant_id").startswith("User")))
    meta = cells.drop("_first").filter(F.col("label").rlike(META_LABEL)).withColumn("field", meta_key(F.col("label")))
    return cells.filter(F.col("row_idx") < F.col("_first")).drop("_first"), meta


def _by(header: DataFrame | None) -> list[str]:
    return [] if header is None else ["sheet"]


def user_meta(meta: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, participant_id, gender, age, diagnosis, mmse): of rows with the same label the last holds; numbers that cannot
    be read are null."""
    value = {f: F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("row_idx"))) for f in ("Gender", "Age", "Category", "MMSE")}
    return meta.groupBy(*by, "participant_id").agg(value["Gender"].alias("gender"), value["Age"].try_cast("double").alias("age"), value["Category"].alias("diagnosis"), value["MMSE"].try_cast("double").alias("mmse"))


def load_bnt(sheet: DataFrame, header: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers: item_pos, gold, participant_id, raw_response; user_meta). Items without a gold word, or with one that
    ends in a colon, are left out; gold in lower case."""
    by, (cells, meta) = _by(header), split_rows(sheet, header)
    rows = cells.filter(F.col("label").isNotNull() & ~F.col("label").rlike(r":\s*$"))
    return rows.select(*by, F.col("row_idx").alias("item_pos"), F.lower(F.trim("label")).alias("gold"), "participant_id", F.col("value").alias("raw_response")), user_meta(meta, by)


def load_svf(sheet: DataFrame, header: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(words: participant_id, pos, word; user_meta). Null cells are skipped, words in lower case."""
    by, (cells, meta) = _by(header), split_rows(sheet, header)
    w = Window.partitionBy(*by, "participant_id").orderBy("row_idx")
    rows = cells.filter(F.col("value").isNotNull())
    return rows.select(*by, "participant_id", (F.row_number().over(w) - 1).alias("pos"), F.lower(F.trim("value")).alias("word")), user_meta(meta, by)


def load_fas(sheet: DataFrame, header: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(words: participant_id, letter, pos, word, is_flagged; user_meta). A participant's list ends at the first null
    cell; a cell holds three words, by position; <marked> words are flagged, in every place the participant says them."""
    by, (cells, meta) = _by(header), split_rows(sheet, header)
    per = Window.partitionBy(*by, "participant_id")
    end = F.min(F.when(F.col("value").isNull(), F.col("row_idx"))).over(per)
    rows = cells.withColumn("_end", end).filter(F.col("_end").isNull() | (F.col("row_idx") < F.col("_end")))
    w = per.orderBy("row_idx")
    said = rows.withColumn("pos", F.row_number().over(w) - 1).select(*by, "participant_id", "pos", F.posexplode(triplet(F.col("value"))).alias("_i", "_raw"))
    words = said.select(*by, "participant_id", F.get(F.array(F.lit("f"), F.lit("a"), F.lit("s")), F.col("_i")).alias("letter"), "pos", unflagged(F.col("_raw")).alias("word"), is_flagged(F.col("_raw")).alias("_f"))
    return words.withColumn("is_flagged", F.max("_f").over(Window.partitionBy(*by, "participant_id", "word")) & (F.col("word") != "")).drop("_f"), user_meta(meta, by)
