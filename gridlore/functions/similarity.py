"""Indel similarity 2 * LCS / (len a + len b), as one expression without Python.

Two ways: for any two strings by rows of the table, and for many strings against forms of a fixed vocabulary by bits, a
column of the table as a 64-bit number. Forms are kept with their letters' bit masks, and both sides with their letters'
counts, which bound the similarity before any table is made.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Characters of a form whose column fits a number without overflow; letters of a word of counts, and copies it counts.
MOST_BITS, LETTERS, COPIES = 61, 15, 4


def characters(s: Column) -> Column:
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(s, ""))


def _shifted(x: Column, by: Column) -> Column:
    return F.call_function("shiftleft", x, by.cast("int"))


_ONE = lambda: F.lit(1).cast("long")
_ZERO = lambda: F.lit(0).cast("long")


def places(s: Column, alphabet: Column) -> Column:
    """A string as places of its letters in an alphabet (an array), from 1; 0 stands for others."""
    return F.transform(characters(s), lambda ch: F.array_position(alphabet, ch).cast("int"))


def masks(form: Column, alphabet: Column) -> Column:
    """For each letter of the alphabet, from place 1 on, the bits of the form's characters that are it; none at 0."""
    own = lambda a: F.aggregate(F.sequence(F.lit(1), F.length(form)), _ZERO(), lambda m, i: F.when(F.substring(form, i, F.lit(1)) == a, m.bitwiseOR(_shifted(_ONE(), i - 1))).otherwise(m))
    return F.concat(F.array(_ZERO()), F.transform(alphabet, own))


def letter_counts(at: Column, alphabet: Column) -> Column:
    """Of places(): the letters' counts up to COPIES as that many bits each, in numbers of LETTERS letters."""
    count = lambda p: F.least(F.lit(COPIES), F.size(F.filter(at, lambda i: i == p)))
    word = lambda w: F.aggregate(F.sequence(F.lit(1), F.lit(LETTERS)), _ZERO(), lambda m, k: m.bitwiseOR(_shifted(_shifted(_ONE(), count(w * LETTERS + k)) - 1, COPIES * (k - 1))))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(alphabet) - 1) / LETTERS).cast("int")), word)


def _bits(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda n, x: n + F.bit_count(x))


def uncounted(at: Column, counts: Column) -> Column:
    """The letters of the alphabet in a string that its counts leave out."""
    return F.size(F.filter(at, lambda i: i > 0)) - _bits(counts)


def lcs_bits(at: Column, form_masks: Column, length: Column) -> Column:
    """Length of the longest common subsequence of places() and a form of at most MOST_BITS characters."""
    full = _shifted(_ONE(), length) - 1

    def step(v: Column, i: Column) -> Column:
        u = v.bitwiseAND(F.get(form_masks, i))
        return (v + u).bitwiseOR(v - u).bitwiseAND(full)

    return length - F.bit_count(F.aggregate(at, full, step))


def indexed(text: str, alphabet: str) -> dict[str, Column]:
    """What best_form() needs of a string in a column text: places, counts, rest."""
    at = places(F.col(text), F.col(alphabet))
    return {"places": at, "counts": letter_counts(at, F.col(alphabet)), "rest": uncounted(at, letter_counts(at, F.col(alphabet)))}


def best_form(text: Column, own: Column, forms: Column) -> Column:
    """The form that is most similar to the text, of equal ones the first: a struct of similarity, text and target. own: a
    struct of indexed(); forms: an array of structs of norm, target, masks, counts and rest. Forms that can't be more
    similar than the best so far, by their length or their letters, are passed over."""
    start = F.struct(F.lit(-1.0).alias("similarity"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("target"))

    def step(best: Column, f: Column) -> Column:
        a, b = F.length(text), F.length(f["norm"])
        shared = F.aggregate(F.zip_with(own["counts"], f["counts"], lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda n, x: n + x) + F.least(own["rest"], f["rest"])
        most = F.lit(2.0) * F.least(a, b, shared) / (a + b)
        lcs = F.when(b <= MOST_BITS, lcs_bits(own["places"], f["masks"], b)).otherwise(lcs_length(text, f["norm"]))
        found = F.transform(F.array(F.lit(2.0) * lcs / (a + b)), lambda s: F.when(s > best["similarity"], F.struct(s.alias("similarity"), f["norm"].alias("text"), f["target"].alias("target"))).otherwise(best))
        return F.when(most <= best["similarity"], best).otherwise(F.element_at(found, 1))

    return F.aggregate(forms, start, step)


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: a fold over a's characters of the row of b's prefixes."""
    zero = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def step(row: Column, ch: Column) -> Column:
        # cell j: same character -> diagonal + 1, else the larger of left (just made) and above
        def cell(made: Column, j: Column) -> Column:
            same = F.substring(b, j, F.lit(1)) == ch
            best = F.when(same, F.element_at(row, j) + 1).otherwise(F.greatest(F.element_at(made, -1), F.element_at(row, j + 1)))
            return F.concat(made, F.array(best))

        return F.when(F.length(b) == 0, row).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(b), F.lit(1))), F.array(F.lit(0)), cell))

    return F.element_at(F.aggregate(characters(a), zero, step), -1)


def indel_ratio(a: Column, b: Column) -> Column:
    """FN24; two empty strings are equal."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(2.0) * lcs_length(a, b) / total)


def squeezed(c: Column) -> Column:
    """FN23's form of a header: ASCII letters and digits in lower case."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def header_similarity(a: Column, b: Column) -> Column:
    """FN23."""
    return indel_ratio(squeezed(a), squeezed(b))
