"""Line handling and text similarity as native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's str.strip removes, as a regex class body.
WHITESPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# A whole line holding a triple quote. Anchored by the look-behind so that the
# engine tries it once per line and not once per character.
_TRIPLE_LINE = "(?<![^\\n])[^\\n]*(?:\"\"\"|''')[^\\n]*"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{WHITESPACE}]+|(?<![{WHITESPACE}])[{WHITESPACE}]+\z", "")


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def numbered_lines(text: Column) -> Column:
    """Array of (line_number, text): 0-based numbers, stripped lines."""
    return F.transform(
        F.split(text, "\n"),
        lambda line, i: F.struct(i.alias("line_number"), strip(line).alias("text")),
    )


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


def strip_comments(text: Column) -> Column:
    """Source without comments, blank lines and triple-quoted regions.

    A line with a triple quote flips the state and is dropped itself, so cutting
    the text at such lines leaves pieces that are outside and inside in turn.
    """
    pieces = F.filter(F.split(text, _TRIPLE_LINE), lambda _, i: i % 2 == 0)
    lines = F.flatten(F.transform(pieces, lambda piece: F.split(piece, "\n")))
    kept = F.filter(F.transform(lines, strip), lambda s: (s != "") & ~s.startswith("#"))
    return F.array_join(kept, "\n")


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    Lambdas of higher-order functions evaluate what they enclose at every step.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_method_ratio(old: Column, new: Column, tie_self: bool = False) -> Column:
    """Share of the shorter name list that the longer one also has.

    Duplicates count in the denominator only. ``tie_self=True`` compares the old
    list with itself when both have the same length.
    """
    shorter = F.least(F.size(old), F.size(new))
    ratio = F.size(F.array_intersect(old, new)) / F.when(shorter > 0, shorter)
    if not tie_self:
        return ratio
    own = F.size(F.array_distinct(old)) / F.when(shorter > 0, shorter)
    return F.when(F.size(old) == F.size(new), own).otherwise(ratio)
