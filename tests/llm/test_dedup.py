import json
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexspark.llm import dedup as D


def render(rng, rec):
    """A record in a random guise."""
    items = list(rec.items())
    rng.shuffle(items)
    if rng.random() < 0.4:
        out = json.dumps(dict(items), ensure_ascii=rng.random() < 0.3, indent=rng.choice([None, 1]))
    else:
        sep, eq, comma = rng.choice(["\n", " | ", "; ", " ", " "]), rng.choice([": ", "=", " "]), rng.choice([", ", " ", " / ", ";"])
        out = sep.join(f"{k}{eq}{'[' + comma.join(v) + ']' if isinstance(v, list) else v.replace('-', rng.choice(['-', ' ', '/', ': ']))}" for k, v in items)
    out = rng.choice([str, str.upper, str.title, str.lower])(out) if "\\u" not in out else out
    return unicodedata.normalize(rng.choice(["NFC", "NFD"]), out)


@pytest.fixture(scope="module")
def guises():
    rng = random.Random(5)
    words = ["gås", "björn", "ål", "vit haj", "större hackspett", "räka", "allé", "ko"]
    rows = []
    for g in range(60):
        rec = {"test": rng.choice(["svf", "fas"]), "participant": f"User-{g}", "session": str(rng.randint(1, 4)), "responses": rng.choices(words, k=rng.randint(1, 9))}
        rows += [(g, render(rng, rec)) for _ in range(rng.randint(1, 6))]
    rng.shuffle(rows)
    return [(i, g, p) for i, (g, p) in enumerate(rows)]


def pairs_of(guises):
    first = {}
    for i, g, _ in guises:
        first.setdefault(g, i)
    return {(first[g], i) for i, g, _ in guises if first[g] != i}


@pytest.mark.parametrize("bits", [128, 3])
def test_groups_are_found_even_if_hashes_collide(spark, guises, bits):
    df = spark.createDataFrame([(i, p) for i, _, p in guises], "record_id bigint, payload string").withColumns({"h1": F.lit(1), "id": F.lit("x"), "kept_id": F.lit(2)})
    got = {tuple(r) for r in D.collapse(df, "record_id", "payload", bits=bits, max_rounds=200).collect()}
    assert got == pairs_of(guises)


def test_near_copies_differ():
    base = "test=svf participant=User-1 session=1 responses=gås, vit haj, ko"
    same = ['{"responses": ["GÅS", "vit haj", "ko"], "session": "1", "participant": "User 1", "test": "svf"}', "SESSION 1 | RESPONSES (gås / vit-haj / ko) | TEST: svf | participant: user/1 !", '{"test": "svf", "participant": "User-1", "session": "1", "responses": ["g\\u00e5s", "vit\\nhaj", "ko"]}']
    other = [base.replace("vit haj", "vithaj"), base.replace("gås", "gas"), base.replace("ko", "ko, ko"), base.replace("session=1", "session=2"), base.replace("gås, vit haj", "vit haj, gås"), base.replace("User-1", "User-11"), base.replace("User-1", "User1"), "test=svf participant=User-1 session=1 responses=gås vit haj", "test=svf participant=User-1 responses=gås, vit haj, ko session=11"]
    n = len(same) + len(other)
    left, right = pa.array([base] * n), pa.array(same + other)
    want = [True] * len(same) + [False] * len(other)
    assert D.same_records(left, right).tolist() == want
    h = D.record_hashes(pa.array([base, *same, *other]))[0]
    assert (h[1:] == h[0]).tolist() == want


def test_a_response_may_read_like_a_label():
    a = pa.array(["test=fas participant=u responses=test, session, sol session=1", "session: 1; responses: [test session sol]; participant: u; test: fas"])
    assert D.same_records(a.slice(0, 1), a.slice(1, 1)).tolist() == [True] and len(set(D.record_hashes(a)[0].tolist())) == 1


def test_marks_in_any_order_and_slices():
    a = pa.array(["x", "responses ạ̈", None, "responses ạ̈"])
    h1, _, ok = D.record_hashes(a.slice(1))
    assert h1[0] == h1[2] and ok.tolist() == [True, False, True]
    assert D.record_hashes(pa.array([], pa.string()))[0].tolist() == []
    assert D._words(pa.array(["å😀ß"]))[0].tolist() == [ord("a"), 0x30A, ord("s"), ord("s")]


def test_nulls_empties_repeats_long_texts(spark):
    long = "test svf participant u session 1 responses " + "gås " * 100_000
    df = spark.createDataFrame([(1, None), (2, None), (3, ""), (4, " .;"), (5, long), (6, long.upper().replace(" ", "\n")), (6, long.upper().replace(" ", "\n")), (7, "hej"), (8, "Hej!")], "record_id bigint, payload string")
    pairs = D.collapse(df, "record_id", "payload")
    assert {tuple(r) for r in pairs.collect()} == {(5, 6), (7, 8)}
    kept = {r.record_id: r.n_copies for r in D.distinct_records(df, "record_id", "payload", pairs).collect()}
    assert kept == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 7: 2}
    assert D.collapse(df.limit(0), "record_id", "payload").count() == 0


def test_permuted_polynomials_differ():
    h = D._poly(np.array([1, 2, 2, 1, 1, 2], dtype=np.uint64), np.array([0, 2, 4]), np.array([2, 2, 2]), 1)
    assert h[0] != h[1] and h[0] == h[2]


def test_letters_beyond_the_first_plane():
    a, b = "responses ab\U0001109a", "responses ab\U0001109c"  # letters of two code points when decomposed
    assert unicodedata.normalize("NFD", a)[-1] == unicodedata.normalize("NFD", b)[-1]
    texts = pa.array([a, b, unicodedata.normalize("NFD", a), "responses \U0001134b", unicodedata.normalize("NFD", "responses \U0001134b")])
    h = D.record_hashes(texts)[0]
    assert h[0] == h[2] != h[1] and h[3] == h[4]
    assert D.same_records(texts.take([0, 0, 3]), texts.take([1, 2, 4])).tolist() == [False, True, True]


def test_hash_and_comparison_agree_on_every_letter():
    chars = [chr(c) for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] in "LNMSC" and unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")]
    rng = random.Random(1)
    chars = rng.sample(chars, 6000) + [c for c in chars if unicodedata.normalize("NFD", c) != c and ord(c) > 0xFFFF]
    one = pa.array([f"responses a{c}b x" for c in chars])
    for change in (lambda t: unicodedata.normalize("NFD", t), lambda t: unicodedata.normalize("NFC", t), lambda t: t.upper(), lambda t: t.replace("a", "a\u00ad")):
        two = pa.array([change(t) for t in one.to_pylist()])
        hashes = (D.record_hashes(one)[0] == D.record_hashes(two)[0]).tolist()
        assert hashes == D.same_records(one, two).tolist()
    assert hashes == [True] * len(hashes)


def test_windows_do_not_change_hashes(monkeypatch):
    texts = pa.array([f"test svf session {i} responses gås {'ö' * i}" for i in range(50)] + [None, ""])
    whole = D.record_hashes(texts)
    monkeypatch.setattr(D, "_WINDOW", 64)
    assert all((x == y).all() for x, y in zip(whole, D.record_hashes(texts))) and len(list(D._windows(texts))) > 20


def test_hot_group_is_spread(spark):
    df = spark.createDataFrame([(i, f"test svf responses ko{' ' * (i % 7)} get") for i in range(300)], "record_id bigint, payload string")
    assert {tuple(r) for r in D.collapse(df, "record_id", "payload", part_rows=20).collect()} == {(0, i) for i in range(1, 300)}
