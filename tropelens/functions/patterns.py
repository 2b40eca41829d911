"""The pattern registry and column expressions that count or test patterns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Pattern(NamedTuple):
    pattern_id: str
    tier: int
    regex: str
    gate: str
    """A literal that every match contains, lower-cased: a cheap test before the regular expression runs."""
    lower: str = ""
    """The same expression for lower-cased text, with a literal in front where there is one: the engine then searches for
    the literal and looks back for the word boundary. Empty: the expression is used as it is, ignoring case."""


# Identifiers, tiers and regular expressions of the nine patterns.
PATTERNS = [
    Pattern("rather_than", 1, r"\brather than\b", "rather than", r"rather than(?<=\brather than)\b"),
    Pattern("instead_of", 1, r"\binstead of\b", "instead of", r"instead of(?<=\binstead of)\b"),
    Pattern("as_opposed_to", 1, r"\bas opposed to\b", "as opposed to", r"as opposed to(?<=\bas opposed to)\b"),
    Pattern("in_contrast", 1, r"\bin contrast\b", "in contrast", r"in contrast(?<=\bin contrast)\b"),
    Pattern("not_but", 2, r"\bnot\b(?!\s+(?:only|just|merely)\b)[^.!?]{0,60}?\bbut\b", "but", r"not(?<=\bnot)\b(?!\s+(?:only|just|merely)\b)[^.!?]{0,60}?but(?<=\bbut)\b"),
    Pattern("x_not_y", 2, r",\s*not\b(?!\s+(?:only|just|merely)\b)", "not", r",\s*not\b(?!\s+(?:only|just|merely)\b)"),
    Pattern("cleft_pivot", 3, r"\bit'?s\s+not\b[^.!?]{0,60}?\bit'?s\b|\bit\s+is\s+not\b[^.!?]{0,60}?\bit\s+is\b", "not", r"it(?<=\bit)(?:'?s\s+not\b[^.!?]{0,60}?\bit'?s\b|\s+is\s+not\b[^.!?]{0,60}?\bit\s+is\b)"),
    Pattern("not_only_just_merely_but", 3, r"\bnot\s+(?:only|just|merely)\b[^.!?]{0,60}?\bbut\b", "but", r"not(?<=\bnot)\s+(?:only|just|merely)\b[^.!?]{0,60}?but(?<=\bbut)\b"),
    Pattern("not_to_say", 3, r"\bthis is not to say\b", "this is not to say", r"this is not to say(?<=\bthis is not to say)\b"),
]

WORD = r"[\p{L}\p{N}_]+"


def registry(spark, patterns: list[Pattern] | None = None):
    """The registry as a table (pattern_id, tier, regex)."""
    return spark.createDataFrame([p[:3] for p in (PATTERNS if patterns is None else patterns)], "pattern_id string, tier int, regex string")


def flagged(regex: str) -> str:
    """Case-insensitive, with Unicode word boundaries."""
    return f"(?iU){regex}"


def lowered(text: Column) -> Column:
    """Lower case; the long s counts as s, as it does when case is ignored."""
    return F.lower(F.replace(text, F.lit("\u017f"), F.lit("s")))


def match_count(text: Column, pattern: Pattern) -> Column:
    """Non-overlapping matches from left to right; null texts have none."""
    body = lowered(text)
    found = F.regexp_count(body, F.lit(f"(?U){pattern.lower}")) if pattern.lower else F.regexp_count(text, F.lit(flagged(pattern.regex)))
    return F.when(F.contains(body, F.lit(pattern.gate)), found).otherwise(0).cast("long")


def has_match(text: Column, pattern: Pattern) -> Column:
    body = lowered(text)
    found = body.rlike(f"(?U){pattern.lower}") if pattern.lower else text.rlike(flagged(pattern.regex))
    return F.coalesce(F.contains(body, F.lit(pattern.gate)) & found, F.lit(False))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"{WORD}+")), F.lit(0)).cast("long")  # without backing off


def space_word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def per_thousand(count: Column, words: Column) -> Column:
    """Null where there are no words, so that averages leave the document out."""
    return F.when(words > 0, 1000.0 * count / words)
