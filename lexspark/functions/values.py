"""Column functions that read hand-entered values: blanks, codes, stated numbers, stated gender. JVM-side only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for "no value".
PLACEHOLDERS = ("", "nan", "none", "null", "?", "-", "n/a", "na", "#ref!", "okänd", "okänt", "saknas", "ej angivet", "ej angiven")
#: Words that state a gender.
MALE = ("m", "man", "male", "1")
FEMALE = ("f", "k", "kvinna", "female", "woman", "2")

_BLANKS = r"[\p{Z}\s\u200B\uFEFF]"
#: The same, one by one: separators, control blanks, zero-width space and byte order mark.
_BLANK_CHARS = "".join(map(chr, (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x200B, 0xFEFF)))
_NUMBER = r"[-+−]?\d+(?:[.,]\d+)?"


def compose(c: Column) -> Column:
    """Composed form of the letters Swedish sources use (å ä ö é, either case); other marks stay as they are."""
    for base, mark, out in (("a", "\u030a", "å"), ("a", "\u0308", "ä"), ("o", "\u0308", "ö"), ("e", "\u0301", "é"), ("u", "\u0308", "ü")):
        c = F.replace(F.replace(c, F.lit(base + mark), F.lit(out)), F.lit(base.upper() + mark), F.lit(out.upper()))
    return c


def strip(c: Column) -> Column:
    """Without outer blanks of any kind (SQL trim removes spaces only)."""
    return F.btrim(c, F.lit(_BLANK_CHARS))


def label_key(c: Column) -> Column:
    """A label as it is compared: lower case, without outer blanks and a final colon."""
    return strip(F.regexp_replace(strip(F.lower(compose(c))), ":$", ""))


def code_key(c: Column) -> Column:
    """A code as it is compared: letters and digits in lower case; null where nothing is left."""
    k = F.regexp_replace(F.lower(compose(c)), r"[^\p{L}\p{N}]", "")
    return F.when(k != "", k)


def is_blank(c: Column) -> Column:
    """Null or one of PLACEHOLDERS."""
    return c.isNull() | strip(F.lower(c)).isin(*PLACEHOLDERS)


def stated_number(c: Column, maximum: int | None = None) -> Column:
    """The one number a text states, as double; null where it states none or several. Units do not matter, nor does
    the stated maximum ("/30", "av 30", "of 30") if `maximum` is given."""
    t = strip(F.lower(c))
    if maximum is not None:
        t = F.regexp_replace(t, rf"(?:/|\bav\b|\bof\b|\bout of\b|\bmax\b){_BLANKS}*{maximum}(?:[.,]0+)?(?!\d)", " ")
    found = F.regexp_extract_all(t, F.lit(f"({_NUMBER})"), 1)
    # a minus between digits is a range, not a sign: the digits after it are another number
    several = F.size(F.regexp_extract_all(t, F.lit(r"(\d+(?:[.,]\d+)?)"), 1)) != 1
    value = F.replace(F.replace(F.get(found, F.lit(0)), F.lit(","), F.lit(".")), F.lit("−"), F.lit("-"))
    return F.when(~several & (F.size(found) == 1), value.try_cast("double"))


def stated_gender(c: Column) -> Column:
    """M or F; null where a text states neither or both."""
    t = strip(F.lower(compose(c)))
    return F.when(t.isin(*MALE), "M").when(t.isin(*FEMALE), "F")
