import pytest
from pyspark.sql import functions as F

from lexspark.functions import values as V


def read(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("t"))).collect()]


@pytest.mark.parametrize(("text", "want"), [("27/30", 27.0), ("30 av 30", 30.0), ("30 / 30", 30.0), ("/30", None), ("?/30", None), ("27,5", 27.5), ("24-26", None), ("21 el 23", None), (" 25 p", 25.0), ("28.0", 28.0), ("72.", 72.0), ("", None), (None, None), ("#REF!", None), ("-3", -3.0), ("30", 30.0), ("2023-07-12", None)])
def test_stated_number_with_maximum(spark, text, want):
    assert read(spark, [text], lambda c: V.stated_number(c, 30)) == [want]


def test_stated_number_without_maximum(spark):
    assert read(spark, ["62/72", "55.5år", "64 years", "68 eller 78", "minns inte", "71,2 "], V.stated_number) == [None, 55.5, 64.0, None, None, 71.2]


def test_stated_gender(spark):
    texts = ["M", " f ", "KVINNA", "Man", "M eller F", "M/F", "0", "", None, "male "]
    assert read(spark, texts, V.stated_gender) == ["M", "F", "F", "M", None, None, None, None, None, "M"]


def test_labels_and_codes(spark):
    assert read(spark, [" MMSE poäng: ", "AGE :", "Ålder", " Kön:", None], V.label_key) == ["mmse poäng", "age", "ålder", "kön", None]
    assert read(spark, ["non–AD", "H.C.", " Mci ", "?", "", None, "sbert-sv"], V.code_key) == ["nonad", "hc", "mci", None, None, None, "sbertsv"]
