"""Names, clocks, counts and lengths in text, as column expressions."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def collapsed(s: Column) -> Column:
    """Lower case, white space as one blank."""
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def letters_only(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), "[^a-z ]", "")


@F.pandas_udf(StringType())
def name_key(names: pd.Series) -> pd.Series:
    """Accents stripped by decomposition, then letters and blanks alone."""

    def key(name: str | None) -> str | None:
        if name is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower()
        return " ".join("".join(c for c in plain if "a" <= c <= "z" or c == " ").split())

    return names.map(key, na_action=None)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matching-blocks ratio of two strings; for candidate pairs, not for whole tables."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def without_suffix(key: Column) -> Column:
    return F.trim(F.regexp_replace(key, r"\s(jr|sr|ii|iii|iv)$", ""))


def surname(key: Column) -> Column:
    """The last token of more than one letter."""
    return F.element_at(F.filter(F.split(key, " "), lambda t: F.length(t) > 1), -1)


def of_pair(s: Column) -> tuple[Column, Column]:
    """``"34 of 78"`` as two numbers, 0 where missing."""
    part = lambda i: F.coalesce(F.regexp_extract(s, r"^\s*(\d+)\s+of\s+(\d+)", i).try_cast("double"), F.lit(0.0))
    return part(1), part(2)


def clock_seconds(s: Column) -> Column:
    """``"4:31"`` as seconds; 0 where it is not a clock."""
    part = lambda i: F.regexp_extract(s, r"^\s*(\d+):(\d+)", i).try_cast("double")
    return F.coalesce(part(1) * 60 + part(2), F.lit(0.0))


def height_inches(s: Column) -> Column:
    """``5' 11"`` as inches; null where it is none."""
    part = lambda i: F.regexp_extract(s, r"(\d+)'\s*(\d+)", i).try_cast("double")
    return part(1) * 12 + part(2)


def round_lengths(s: Column) -> Column:
    """``"3 Rnd (5-5-5)"`` as seconds of each round; null where there are none."""
    inner = F.regexp_extract(s, r"\(([\d\-\s]+)\)", 1)
    return F.when(inner != "", F.transform(F.split(inner, "-"), lambda x: F.trim(x).try_cast("int") * 60))


def elapsed_seconds(rnd: Column, clock: Column, lengths: Column) -> Column:
    """Completed rounds and the clock; rounds of 300 seconds where the lengths are unknown."""
    known = F.aggregate(F.slice(lengths, F.lit(1), F.greatest(rnd - 1, F.lit(0))), F.lit(0), lambda a, x: a + x)
    return F.coalesce(known, 300 * (rnd - 1)) + clock


def mixed_date(s: Column) -> Column:
    """A date in one of several notations; null where it is none."""
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in ("yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "M/d/yyyy", "d MMMM yyyy")]).cast("date")


def age_years(day: Column, born: Column) -> Column:
    return F.coalesce(F.datediff(day, born) / 365.25, F.lit(30.0))


def slug(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-|-$", "")


def url_tail(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def clean_name(s: Column) -> Column:
    """A name without footnote marks, champion's marks and dots or blanks at its ends."""
    plain = F.regexp_replace(F.regexp_replace(s, r"\[[^\]]*\]", ""), r"(?i)\((?:c|ic)\)", "")
    return F.regexp_replace(F.regexp_replace(plain, r"\s+", " "), r"^[ .\u00a0]+|[ .\u00a0]+$", "")


def titles(name: Column) -> Column:
    """The titles that a page about a name may have, each once, in the order to try them."""
    joined = lambda s: F.replace(s, F.lit(" "), F.lit("_"))
    return F.array_distinct(F.array(joined(name), F.concat(joined(name), F.lit("_(fighter)")), joined(F.regexp_replace(name, r" No\. .*$", ""))))


# How texts name the ways to end a bout.
WAYS = {"ko": r"(?i)\b(?:ko|tko|knockout)\b", "sub": r"(?i)\b(?:sub|submission)\b", "dec": r"(?i)\b(?:dec|decision)\b"}


def methods_in(s: Column) -> Column:
    """How many ways to end a bout a text names."""
    return sum((s.rlike(p).cast("int") for p in WAYS.values()), F.lit(0))

# Letters that decomposition leaves whole.
HARD = {"ł": "l", "đ": "d", "ø": "o", "ı": "i", "æ": "ae", "œ": "oe", "ß": "ss"}


def folded(name: Column) -> Column:
    """A key that spelling does not change; built on ``name_key``, which takes accents off."""
    out = F.lower(name)
    for letter, plain in HARD.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    out = F.regexp_replace(F.regexp_replace(out, r"\bst\b\.?", "saint"), r"\b(?:jr|sr|ii|iii|iv)\b", " ")
    return name_key(F.regexp_replace(out, r"[.\-']", " "))


# Patterns that tell the class of a market from its question; the first that fits holds.
CLASSES = {
    "distance": r"(?i)\b(?:go(?:es)? the distance|decision)\b", "method": r"(?i)\b(?:tko|ko|knockout|submission)\b", "total": r"(?i)\b(?:over|under)\s+\d\.5\b",
    "round": r"(?i)\bround\s+\d\b", "winner": r"(?i)\b(?:wins?|beats?)\b|\svs\.?\s",
}


def market_class(question: Column) -> Column:
    out = F.lit("other")
    for kind, pattern in reversed(CLASSES.items()):
        out = F.when(question.rlike(pattern), kind).otherwise(out)
    return out


def market_key(question: Column) -> Column:
    """The market that a question is about, null where there is none for it."""
    kind = market_class(question)
    line, rnd = F.regexp_extract(question, r"(?i)\b(?:over|under)\s+(\d)\.5", 1), F.regexp_extract(question, r"(?i)\bround\s+(\d)", 1)
    return (
        F.when(kind == "distance", "decision").when(kind == "method", F.when(question.rlike(r"(?i)\bsubmission\b"), "method_sub").otherwise("method_ko"))
        .when(kind == "total", F.concat(F.lit("total_over_"), line, F.lit("_5")))
        .when(kind == "round", F.when(question.rlike(r"(?i)\bbefore\b"), F.concat(F.lit("ends_before_r"), rnd)).otherwise(F.concat(F.lit("end_r"), rnd))).when(kind == "winner", "winner_a")
    )
