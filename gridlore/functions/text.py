"""Scalar functions on headers and cells, as Column builders. They stay inside code generation."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Python's str.strip and \s see it.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
# Text that stands for a missing cell.
MISSING = ("", "na", "n/a", "nan", "none", "null", "-", "--")
# Date forms.
DATES = (r"^\d{1,2}/\d{1,2}/\d{2,4}$", r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{1,2}-\d{1,2}-\d{2,4}$", r"^\d{1,2}\s+[a-z]{3,9}\s+\d{2,4}$")
_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{WS}+", ""), f"{WS}+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{WS}+", " "))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def mapping_header(c: Column, nfkc: bool = True) -> Column:
    """FN1: NFKC, lower case, underscores and hyphens as spaces, other signs as spaces. Python only runs for NFKC, so
    callers whose headers are ASCII pass nfkc=False and keep the plan in the JVM."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    c = F.lower(strip(_nfkc(c) if nfkc else c))
    return collapse(F.regexp_replace(F.regexp_replace(c, "[_-]", " "), r"(?U)[^\w\s]", " "))


def discovery_header(c: Column) -> Column:
    """FN2: as FN1 without NFKC; slashes are spaces too."""
    c = F.lower(strip(F.coalesce(c.cast("string"), F.lit(""))))
    return collapse(F.regexp_replace(F.regexp_replace(c, "[-_/]", " "), r"(?U)[^\w\s]", " "))


def alias_key(c: Column) -> Column:
    """FN3: letters and digits in lower case, all else as spaces."""
    return collapse(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]", " "))


def detector_text(c: Column) -> Column:
    """FN4 and FN6: null as empty, stripped, lower case, white space collapsed."""
    return collapse(F.lower(F.coalesce(c.cast("string"), F.lit(""))))


def classifier_text(c: Column) -> Column:
    """FN5: as FN4, but null reads 'nan'."""
    return collapse(F.lower(F.coalesce(c.cast("string"), F.lit("nan"))))


def named(norm: Column, pos: Column) -> Column:
    """FN7: an empty normalised header is unnamed_<position>."""
    return F.when(norm == "", F.concat(F.lit("unnamed_"), pos.cast("string"))).otherwise(norm)


def clean_string(c: Column) -> Column:
    """FN8. Text that begins and ends with a plain character, as most does, is passed without a pattern."""
    t = c.cast("string")
    bare = F.substring(t, 1, 1).between("!", "~") & F.right(t, F.lit(1)).between("!", "~")
    return F.when(bare, t).otherwise(strip(t))


def stands_for_missing(t: Column) -> Column:
    """FN16, of stripped text."""
    return t.isNull() | F.lower(t).isin(*MISSING)


def is_missing(c: Column) -> Column:
    """FN16: null or a text that stands for a missing cell."""
    return stands_for_missing(clean_string(c))


def number_of(text: Column) -> Column:
    """FN9, of stripped text."""
    t = F.lower(F.regexp_replace(text, "[$€£₹,]", ""))
    last = F.right(t, F.lit(1))
    times = F.when(last == "k", F.lit(1e3)).when(last == "m", F.lit(1e6)).when(last == "b", F.lit(1e9))
    body = strip(F.when(times.isNotNull(), F.regexp_replace(t, "[kmb]$", "")).otherwise(t))
    value = F.when(body.rlike(_FLOAT), body.try_cast("double")) * F.coalesce(times, F.lit(1.0))
    plain = F.when(text.rlike(_FLOAT), text.try_cast("double"))  # most numbers; the rest is for other texts only
    value = F.when(plain.isNotNull(), plain).otherwise(value)
    return F.when(~stands_for_missing(text) & (F.abs(value) < F.lit(float("inf"))), value)


def parse_numeric(c: Column) -> Column:
    """FN9: currency signs and commas dropped, a last k, m or b multiplies; null if it isn't a finite number."""
    return number_of(strip(c.cast("string")))


def is_numeric(c: Column) -> Column:
    """FN10: text that reads as a number without commas, dollar and percent signs; nan and inf count."""
    t = strip(F.regexp_replace(c.cast("string"), "[,$%]", ""))
    return F.coalesce(t.rlike(_FLOAT) | F.lower(t).rlike(r"^[+-]?(nan|inf|infinity)$"), F.lit(False))


def _one_of(t: Column, *values: str) -> Column:
    return F.coalesce(F.upper(t).isin(*values), F.lit(False))


def _year(t: Column) -> Column:
    return F.exists(F.array(number_of(t)), lambda x: F.coalesce((x == F.floor(x)) & x.between(1700, 2100), F.lit(False)))  # the number is read once


# The forms that the detectors know.
BOOLEANS = ("Y", "N", "YES", "NO", "TRUE", "FALSE", "T", "F")
SPRINKLERS = ("Y", "N", "Y13", "Y(13R)")
ZIP = r"\A\d{5}(-\d{4})?\z"
CURRENCY = ("[$€£₹]", r"\d[\d,]*\.\d+", r"\A\d[\d,]*\z", r"\d+(\.\d+)?\s*[KMB]\z")

#: Detectors by name, of stripped text; profiles take these or a caller's own.
DETECTORS: dict[str, Callable[[Column], Column]] = {
    "currency": lambda t: F.coalesce(F.upper(t).rlike("|".join(f"({p})" for p in CURRENCY)), F.lit(False)),
    "year": _year,
    "boolean": lambda t: _one_of(t, *BOOLEANS),
    "sprinkler": lambda t: _one_of(t, *SPRINKLERS),
    "zip": lambda t: F.coalesce(t.rlike(ZIP), F.lit(False)),
}


def is_year(c: Column) -> Column:
    """FN11."""
    return DETECTORS["year"](clean_string(c))


def is_boolean(c: Column) -> Column:
    """FN12."""
    return DETECTORS["boolean"](clean_string(c))


def is_sprinkler(c: Column) -> Column:
    """FN13."""
    return DETECTORS["sprinkler"](clean_string(c))


def is_zip(c: Column) -> Column:
    """FN14."""
    return DETECTORS["zip"](clean_string(c))


def is_currency(c: Column) -> Column:
    """FN15: a currency sign, a decimal point between digits, digits and commas alone, or a last K, M or B."""
    return DETECTORS["currency"](clean_string(c))


def is_date(c: Column) -> Column:
    """FN17."""
    t = detector_text(c)
    return F.coalesce(t.rlike("|".join(f"({p})" for p in DATES)), F.lit(False))


def has_letter_and_digit(t: Column) -> Column:
    return t.rlike("[a-z]") & t.rlike(r"\d")


def is_code(t: Column) -> Column:
    """FN18, of normalised text: four characters or more with letters and digits."""
    return (F.length(t) >= 4) & has_letter_and_digit(t)


def is_long_id(t: Column) -> Column:
    return F.length(t) >= 8


def word_count(t: Column) -> Column:
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def is_long_text(t: Column) -> Column:
    return (word_count(t) >= 3) | (F.length(t) >= 25)


def clip(c: Column) -> Column:
    """FN19 and FN26: to 0..1; null is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.cast("double"), F.lit(0.0))))


def sigmoid(c: Column) -> Column:
    """FN20: from the side that doesn't overflow."""
    e = F.exp(-F.abs(c))
    return F.when(c >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


# The weights of the two scores.
def rerank_score(ce: Column, embedding: Column, value: Column) -> Column:
    """FN21."""
    return F.round(clip(0.60 * ce + 0.25 * embedding + 0.15 * value), 6)


def retrieval_score(embedding: Column, value: Column) -> Column:
    """FN22."""
    return clip(0.75 * embedding + 0.25 * value)


def cosine(a: Column, b: Column) -> Column:
    """FN25: of unit vectors, the dot product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def target_text(name: Column, description: Column, aliases: Column) -> Column:
    """FN28."""
    return F.concat(F.lit("Field: "), name, F.lit(". Description: "), description, F.lit(" Aliases: "), F.array_join(aliases, ", "), F.lit("."))


def contains_term(text: Column, terms: list[str], least: int = 0) -> Column:
    """FL2 and FL3: the text is a term, or holds one of `least` characters or more."""
    return text.isin(*terms) | F.exists(F.array(*[F.lit(t) for t in terms if len(t) >= least]), lambda t: F.contains(text, t))


def count_terms(text: Column, terms: list[str]) -> Column:
    """FL4: how many of the terms the text holds."""
    return F.size(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t)))
