"""Column functions that normalise, classify and parse free-text answers. JVM-side only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Answers that mean "no answer".
NON_RESPONSES = ("hhhm jag vet inte", "jag vet inte", "vet inte", "pass", "ingen aning", "vet ej", "hmm", "hm", "jag kan inte", "något sånt", "nåt sånt")
#: Hedges at the end, fillers at the start, articles.
HEDGES = ("kanske", "tror jag", "eller nåt", "är det", "va")
FILLERS = ("det är ", "det ser ut som ", "jag tror det är ", "jag tror ", "en slags ", "nån slags ", "typ ", "liksom ", "bild på ", "säkert ")
ARTICLES = ("en", "ett", "den", "det", "de")
#: Fixed value: labels that open a metadata row.
META_LABEL = r"(?i)^(gender|age|categor|kategori|mmse)"

_WS = r"(?U)\s"


def trim_all(c: Column) -> Column:
    """Without outer blanks of any kind."""
    return F.regexp_replace(c, rf"{_WS}*$|^\s*", "")


def plain(c: Column) -> Column:
    """Lower case, punctuation but the hyphen as a blank, blanks collapsed. A null is read as the text "nan" first."""
    t = trim_all(F.lower(F.coalesce(c, F.lit("nan"))))
    return trim_all(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}_\- ]+", " "), rf"{_WS}+", " "))


def normalize_response(c: Column, extended: bool = False, hedge_after_blank: bool = False) -> Column:
    """An answer ready for comparison, null for a non-response: lower case; one trailing hedge, then one leading
    filler, then one leading article removed; nothing shorter than two characters.

    A hedge is cut even off the end of a word ("gradskiva" -> "gradski"), as the established scores have it;
    `hedge_after_blank` asks for a blank before it. `extended` adds "nan" and "" to the non-responses.
    """
    none = [*NON_RESPONSES, *(("nan", "") if extended else ())]
    text = trim_all(F.lower(c))
    gap = "+" if hedge_after_blank else "*"
    cleaned = trim_all(F.regexp_replace(text, rf"{_WS}{gap}({'|'.join(HEDGES)})$", ""))
    cleaned = trim_all(F.regexp_replace(cleaned, f"^({'|'.join(FILLERS)})", ""))
    cleaned = trim_all(F.regexp_replace(cleaned, rf"(?U)^({'|'.join(ARTICLES)})\s+", ""))
    bad = text.isNull() | (text == "") | text.isin(none) | cleaned.isin(none) | (F.char_length(cleaned) < 2)
    return F.when(~bad, cleaned)


def classify_response(response: Column, gold: Column) -> Column:
    """empty, pass, generic_nonword, correct, contains_target or other_response, the first that applies."""
    t, g = trim_all(F.lower(response)), F.lower(gold)
    return (
        F.when(t.isNull() | (t == ""), "empty").when(t == "pass", "pass").when(t == "sak", "generic_nonword")
        .when(F.regexp_replace(t, r"(?U)^(en|ett)\s+", "") == g, "correct").when(F.contains(t, g), "contains_target").otherwise("other_response")
    )


def without_hesitation(c: Column) -> Column:
    """Without one leading hesitation."""
    return F.regexp_replace(c, r"(?U)^(och|eee|kanske en?)\s+", "")


def bracketed(c: Column) -> Column:
    """Everything that stands in angle brackets."""
    return F.regexp_extract_all(c, F.lit("<([^>]+)>"), 1)


def triplet(c: Column) -> Column:
    """A cell's three words by position: padded with empty texts, parts beyond the third ignored."""
    parts = F.split(F.coalesce(c, F.lit("")), ",")
    return F.transform(F.array(*[F.coalesce(F.get(parts, F.lit(i)), F.lit("")) for i in range(3)]), lambda x: F.trim(x))


def triplet_compact(c: Column) -> Column:
    """A cell's words with blanks dropped before positions are counted, so later words move up."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def is_flagged(word: Column) -> Column:
    """Whether a word is marked <so> as a proper noun."""
    return F.coalesce(word.rlike("^<.*>$"), F.lit(False))


def unflagged(word: Column) -> Column:
    """The word in lower case, without its mark."""
    return F.lower(F.trim(F.when(word.rlike("^<.*>$"), F.substr(word, F.lit(2), F.greatest(F.char_length(word) - 2, F.lit(0)))).otherwise(word)))


def truthy(c: Column, strict: bool = False) -> Column:
    """Whether a flag says yes: true, 1, yes - and y, t unless `strict`. Everything else, null too, says no."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", *(() if strict else ("y", "t"))), F.lit(False))


def meta_key(label: Column) -> Column:
    """The metadata field a row label opens: Category, Gender, Age or MMSE, else null."""
    t = F.lower(F.trim(F.regexp_replace(label, ":+$", "")))
    return F.when(t.rlike("^(kategori|categor)"), "Category").when(t.startswith("gender"), "Gender").when(t.startswith("age"), "Age").when(t.startswith("mmse"), "MMSE")


def is_null_text(c: Column) -> Column:
    """Null, or one of the texts that stand for it."""
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin("nan", "none", "")


def magnitude(d: Column) -> Column:
    """Name of an effect size."""
    a = F.abs(d)
    return F.when(a.isNull() | F.isnan(a), "n/a").when(a >= 0.8, "large").when(a >= 0.5, "medium").when(a >= 0.2, "small").otherwise("negligible")


def interpretability(kappa: Column) -> Column:
    """How far results may be read at a given agreement."""
    return F.when(kappa >= 0.6, "primary").when(kappa >= 0.4, "cautioned").otherwise("exploratory")
