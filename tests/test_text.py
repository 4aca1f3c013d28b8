from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.operators import frequency, matching, strdist


def one(spark, c, **cols):
    names = list(cols)
    return spark.createDataFrame([tuple(cols[n] for n in names)], ", ".join(f"{n} string" for n in names)).select(c).first()[0]


def test_normalize_response(spark):
    n = lambda t, **k: one(spark, X.normalize_response(F.col("t"), **k), t=t)
    assert n("  Det är en Kamel kanske ") == "kamel"
    assert n("jag vet inte") is None and n("") is None and n(None) is None and n("a") is None
    assert n("gradskiva") == "gradski" and n("gradskiva", hedge_after_blank=True) == "gradskiva"
    assert n("typ liksom ett hus") == "liksom ett hus"  # one filler, then one article
    assert n("nan") == "nan" and n("nan", extended=True) is None


def test_classify_plain_and_parse(spark):
    k = lambda r: one(spark, X.classify_response(F.col("r"), F.col("g")), r=r, g="Kamel")
    assert [k(x) for x in (None, " ", "Pass", "sak", "en kamel", "en kamel till", "häst")] == ["empty", "empty", "pass", "generic_nonword", "correct", "contains_target", "other_response"]
    assert one(spark, X.plain(F.col("t")), t="  Hej,  på-dig! Å ") == "hej på-dig å" and one(spark, X.plain(F.col("t")), t=None) == "nan"
    assert one(spark, X.triplet(F.col("t")), t="fil, ,<Sven>,x") == ["fil", "", "<Sven>"] and one(spark, X.triplet_compact(F.col("t")), t="fil, ,sol") == ["fil", "sol"]
    assert one(spark, X.unflagged(F.col("t")), t="<Fredrik>") == "fredrik" and one(spark, X.is_flagged(F.col("t")), t="<Fredrik>")
    assert one(spark, X.bracketed(F.col("t")), t="a <b> <c d>") == ["b", "c d"] and one(spark, X.without_hesitation(F.col("t")), t="kanske en katt") == "katt"
    assert [one(spark, X.meta_key(F.col("t")), t=t) for t in ("Kategori:", "AGE", "Genderx", "mmse:", "hund")] == ["Category", "Age", "Gender", "MMSE", None]
    assert one(spark, X.truthy(F.col("t")), t=" Y ") and not one(spark, X.truthy(F.col("t"), strict=True), t="y")


def test_sound_rules(spark):
    def rule(f, a, b):
        return one(spark, f(F.col("a"), F.col("b")), a=a, b=b)

    assert [rule(strdist.same_rime, *p) for p in (("saga", "vaga"), ("sand", "stand"), ("fågel", "tagel"), ("bcd", "bcd"))] == [False, True, True, False]
    assert rule(strdist.same_onset, "frukt", "frid") and not rule(strdist.same_onset, "f", "frid")
    assert rule(strdist.one_vowel_apart, "fil", "fal") and not rule(strdist.one_vowel_apart, "fil", "fall") and not rule(strdist.one_vowel_apart, "fil", "fis")
    assert rule(strdist.normalized_edit_distance, "", "") == 0.0 and rule(strdist.normalized_edit_distance, "fisk", "disk") == 0.25 and rule(strdist.normalized_edit_distance, "åäö", "åä") == 1 / 3


def test_matching(spark):
    rows = spark.createDataFrame([("kamel", "kamel", "u1"), ("en stor kamel", "kamel", "u2"), ("häst", "kamel", "u3"), ("häst", "kamel", "u2"), (None, "kamel", "u4")], "raw_response string, gold string, participant_id string")
    people = spark.createDataFrame([("u1", "F", 70.0, "HC", 29.0)], "participant_id string, gender string, age double, diagnosis string, mmse double")
    long = matching.long_responses(rows, people).cache()
    assert long.count() == 5 and long.filter("is_exact_match").count() == 2 and long.filter("is_non_response").count() == 1
    assert [tuple(r) for r in matching.eligible_pairs(long).select("gold", "normalized", "participant_id").collect()] == [("kamel", "häst", "u2")]
    assert tuple(matching.eligibility_funnel(long).first()) == (5, 1, 2, 0, 2)
    vec = spark.createDataFrame([("häst", [1.0, 0.0]), ("kamel", [1.0, 1.0])], "word string, embedding array<double>")
    assert sorted(round(r[0], 4) for r in matching.score_responses(long, vec).select("cosine_sim").collect()) == [0.0, 0.7071, 0.7071, 1.0, 1.0]
    r = matching.match_rates(rows, "raw_response", "gold").first()
    assert (r.n, r.exact_rate, r.token_rate, r.last_token_rate) == (5, 0.2, 0.4, 0.4)


def test_frequencies(spark):
    raw = spark.createDataFrame([("Hund ", "100"), ("katt", "x"), ("ko", "-1"), ("hund", "10")], "lemma string, frequency_per_million string")
    t = frequency.frequency_table(raw)
    assert [tuple(r) for r in t.collect()] == [("hund", 5.0)]
    words = spark.createDataFrame([("p", "HUND"), ("p", "katt"), ("p", " "), ("q", None)], "participant_id string, word string")
    assert {r[0]: r[1] for r in frequency.mean_word_frequency(words, t, ["participant_id"]).collect()} == {"p": 2.5, "q": None}
    assert tuple(frequency.coverage(words.filter("word is null"), t).first()) == (0, 0, 0, 0.0)
