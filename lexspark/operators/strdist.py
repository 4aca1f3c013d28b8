"""Edit distance and the rules that link two words by sound."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the vowels of Swedish.
VOWELS = "aeiouyåäö"


def normalized_edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over the greater length; 0 for two empty words."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(a, b) / F.when(longest > 0, longest))


def same_onset(a: Column, b: Column) -> Column:
    """The first two letters agree."""
    return (F.char_length(a) >= 2) & (F.char_length(b) >= 2) & (F.substring(a, 1, 2) == F.substring(b, 1, 2))


def rime(word: Column) -> Column:
    """From the last vowel to the end; empty without a vowel."""
    return F.regexp_extract(word, f"([{VOWELS}][^{VOWELS}]*)$", 1)


def same_rime(a: Column, b: Column, least: int = 2) -> Column:
    """Both end in the same rime of `least` letters or more."""
    return (F.char_length(rime(a)) >= least) & (rime(a) == rime(b))


def one_vowel_apart(a: Column, b: Column) -> Column:
    """Equal lengths, and exactly one letter differs, being a vowel in both."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    apart = F.filter(pairs, lambda p: p["x"] != p["y"])
    vowel = F.array(*[F.lit(v) for v in VOWELS])
    return (F.char_length(a) == F.char_length(b)) & (F.size(apart) == 1) & (F.size(F.filter(apart, lambda p: F.array_contains(vowel, p["x"]) & F.array_contains(vowel, p["y"]))) == 1)


def linked(a: Column, b: Column) -> Column:
    """Any of the rules holds; no link where a word is missing. Words are compared in lower case."""
    x, y = F.lower(a), F.lower(b)
    return F.coalesce(same_onset(x, y) | same_rime(x, y) | one_vowel_apart(x, y), F.lit(False))
