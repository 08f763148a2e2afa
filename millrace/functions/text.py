"""Text by Unicode's rules, in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.limits import DEFAULT


def fields(text: Column) -> Column:
    """What stands between runs of Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def lower_each(text: Column) -> Column:
    """Each character by itself: no final sigma, and one character for the capital I with a dot. Only texts that hold one
    of these two are taken apart; for all others the built-in function does the same."""
    each = F.array_join(F.transform(F.split(F.translate(text, "İ", "i"), ""), lambda c: F.lower(c)), "")
    return F.when(F.contains(text, F.lit("Σ")) | F.contains(text, F.lit("İ")), each).otherwise(F.lower(text))


def chunks(text: Column, words: int = DEFAULT.words_per_line) -> Column:
    """Lines of at most words words, joined by one space. The words are bound once, as the one element of an array."""
    line = lambda own: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(own) - 1) / words).cast("int")),
        lambda k: F.array_join(F.slice(own, k * words + 1, words), " "),
    )
    return F.transform(F.array(fields(text)), lambda own: F.when(F.size(own) > 0, line(own)).otherwise(F.array().cast("array<string>")))[0]


def words_of(line: Column, most: int = DEFAULT.operator_outputs) -> Column:
    """The words of a line; more than most of them is an error, which is part of the value so that it can't be pruned."""
    found = F.array(fields(lower_each(F.regexp_replace(line, r"(?U)[^\p{L}\s]", ""))))  # letters and white space only
    bounded = F.transform(found, lambda own: F.when(F.size(own) > most, F.raise_error(F.lit(f"split_words: a line has more than {most} words"))).otherwise(own))
    return bounded[0]
