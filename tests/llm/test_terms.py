import unicodedata
from collections import Counter, defaultdict

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexspark.llm import terms as T


def plain(x):
    if x is None:
        return None
    t = unicodedata.normalize("NFC", unicodedata.normalize("NFC", x).lower())
    out, gap = "", False
    for ch in t:
        if ch.isspace() or unicodedata.category(ch)[0] == "Z":
            gap = True
        else:
            out, gap = out + (" " if gap else "") + ch, False
    edge = lambda c: c == " " or unicodedata.category(c)[0] in "PS"
    while out and edge(out[0]):
        out = out[1:]
    while out and edge(out[-1]):
        out = out[:-1]
    return None if out in ("", "nan", "none") else out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aÅå̊ö  \t.\"!?()[]”-'Nne", max_size=8)), max_size=6))
def test_terms_are_normalised(texts):
    assert T.normalize_terms(pa.array(texts, pa.string())).to_pylist() == [plain(x) for x in texts]


def test_counts_equal_brute_force(spark):
    rows = [(f"p{i % 40}" if i % 11 else None, ["Gås", "gås.", "GÅS", None, "nan", " ", f"w{i % 7}", "vit  haj", f"only{i}"] if i % 5 else None) for i in range(200)] + [("alone", []), ("p0", ["gås"] * 1000)]
    df = spark.createDataFrame(rows, "participant_id string, responses array<string>").withColumns({"term": F.lit("x"), "record": F.lit(1), "n": F.lit(2)})
    occ, rec = Counter(), defaultdict(set)
    for p, ws in rows:
        for w in ws or ():
            if (t := plain(w)) is not None:
                occ[t] += 1
                rec[t] |= {p} - {None}
    total = len({p for p, _ in rows} - {None})
    want = {t: (n, len(rec[t]), "common" if len(rec[t]) > 0.3 * total else "rare" if len(rec[t]) < 3 else None) for t, n in occ.items()}
    for batch in (10_000, 3):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = {r.term: (r.occurrences, r.records, r.term_mark) for r in T.term_frequency(df, "participant_id", "responses").collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == want


def test_empty_and_null_tables(spark):
    df = spark.createDataFrame([(None, None), (None, [None, ""])], "participant_id string, responses array<string>")
    assert T.term_frequency(df, "participant_id", "responses").count() == 0
    assert T.term_frequency(df.limit(0), "participant_id", "responses").count() == 0
