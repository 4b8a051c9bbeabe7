"""Marks and blanks of scansion strings, as expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _places(text: Column, keep) -> Column:
    at = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: keep(F.substring(text, i + 1, F.lit(1))))


def mark_places(text: Column) -> Column:
    """Places (from 0) of what is not blank."""
    return _places(text, lambda c: c != " ")


def blank_places(text: Column) -> Column:
    return _places(text, lambda c: c == " ")


def stress_places(text: Column, mark: str) -> Column:
    """Places of a mark among what is not blank."""
    return _places(F.replace(text, F.lit(" "), F.lit("")), lambda c: c == mark)


def unstressed(stresses: Column, count: Column) -> Column:
    """Numbers below count that are not in stresses."""
    every = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_except(every, stresses)


def differences(a: Column, b: Column) -> Column:
    """Places where two texts of equal length differ; null if the lengths differ."""
    at = F.when(F.length(a) > 0, F.sequence(F.lit(0), F.length(a) - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(F.length(a) == F.length(b), F.filter(at, lambda i: F.substring(a, i + 1, F.lit(1)) != F.substring(b, i + 1, F.lit(1))))


def punctuation_to_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"[!-/:-@\[-`{-~]", " ")


def has_qu(text: Column) -> Column:
    return text.rlike("[qQ][uU]")


def overwrite(text: Column, pattern: str, to: str) -> Column:
    """text with each match of a pattern replaced."""
    return F.regexp_replace(text, pattern, to)


def with_trailing_blanks(line: Column, syllables: Column) -> Column:
    """Each syllable with the blanks that follow it in the line (syllables in order make up the line without its blanks)."""
    marks = mark_places(line)
    starts = F.aggregate(syllables, F.array(F.lit(0)), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + F.length(s))))
    at = lambda k: F.when(k < F.size(syllables), F.get(marks, F.get(starts, k))).otherwise(F.length(line))
    return F.transform(syllables, lambda s, k: F.substring(line, at(k) + 1, at(k + 1) - at(k)))
