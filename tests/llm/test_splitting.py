import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexspark.llm import splitting as S
from lexspark.llm.tokens import TOKENIZER, encoding, token_ends


def check(text, limit, overlap):
    pieces = S.split_text(text, limit, overlap)
    data, enc = text.encode(), encoding(TOKENIZER)
    assert b"".join(data[p.byte_own : p.byte_stop] for p in pieces) == data
    for a, b in zip(pieces, pieces[1:]):
        assert b.byte_own == a.byte_stop and a.byte_start <= b.byte_start <= b.byte_own
    for p in pieces:
        assert len(enc.encode_ordinary(data[p.byte_start : p.byte_stop].decode())) == p.n_tokens <= limit
    return pieces


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="abc åö.!?…\n\r\t 1,😀漢", min_size=0, max_size=900), st.integers(24, 80), st.integers(0, 8))
def test_round_trip_and_limit(text, limit, overlap):
    check(text, limit, overlap)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="a \n\t.漢😀é'", min_size=30, max_size=400), st.integers(8, 16))
def test_small_limits_hold_too(text, limit):
    check(text, limit, 0)


def test_natural_and_forced():
    natural = check("Det här är en mening. " * 300, 128, 16)
    assert {p.cut for p in natural} == {"natural", "end"} and all(p.start - p.overlap_start == 16 for p in natural[1:])
    ids = encoding(TOKENIZER).encode_ordinary("Det här är en mening. " * 300)
    assert len(natural) < 2.5 * len(ids) / (128 - 16)
    forced = check("gås, " * 2000, 128, 16)
    assert "forced" in {p.cut for p in forced}
    mixed = check("En rad.\n" * 20 + "gås, " * 400 + "\nSlut. " * 30, 128, 16)
    assert {"forced", "natural"} <= {p.cut for p in mixed}
    assert len(check("kort", 128, 16)) == 1
    with pytest.raises(ValueError):
        S.split_text("x", 10, 10)


def test_line_ends_are_stronger_than_sentences():
    text = ("Ett två tre. " * 8).strip() + "\n" + ("Ett två tre. " * 9).strip()
    p = check(text, 60, 4)
    assert any(text.encode()[: x.byte_stop].endswith(b"\n") for x in p)
    pos, strength = S.boundaries(text.encode(), token_ends(text))
    assert (strength == 2).sum() == 1 and (strength == 1).sum() >= 14


def test_table(spark):
    rows = [(1, None), (2, ""), (3, "kort text"), (4, "En mening till. " * 2000), (5, "ord, " * 3000), (5, "ord, " * 3000), (None, "Rad\r\n" * 4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"id": F.lit("x"), "piece": F.lit("y")})
    out = S.split_oversized(df, "doc_id", "text", 512, 32).collect()
    for key, text in ((4, rows[3][1]), (None, rows[6][1])):
        mine = sorted((r for r in out if r.doc_id == key), key=lambda r: r.piece_no)
        assert "".join(r.piece[r.overlap_chars :] for r in mine) == text and [r.piece_no for r in mine] == list(range(mine[0].n_pieces))
        assert all(r.n_tokens <= 512 for r in mine) and all(b.piece[: b.overlap_chars] == a.piece[-b.overlap_chars :] for a, b in zip(mine, mine[1:]))
    assert {r.doc_id for r in out} == {4, 5, None}
    assert {(r.doc_id, r.cut_kind) for r in S.cut_kinds(S.split_oversized(df, "doc_id", "text", 512, 32), "doc_id").collect()} == {(4, "natural"), (5, "forced"), (None, "natural")}
    assert S.split_oversized(df.limit(0), "doc_id", "text").count() == 0
