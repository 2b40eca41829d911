"""Reviews: text under chosen headings, cues in it, and what the revision then added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tropelens.functions.patterns import per_thousand, word_count

# The headings of a review, and cues of missing evidence.
HEADINGS = ["Summary", "Strengths", "Weaknesses", "Suggestions for Improvement", "Questions for the Authors", "Overall Assessment"]
CUES = (
    r"(?i)overstat|overclaim|over-claim|unsupported|not (?:well[- ])?supported|unsubstantiated|speculative"
    r"|lack(?:s|ing)? (?:of )?(?:[\p{L}\p{N}_]+ )?(?:evidence|results|validation|experiments|support)"
    r"|insufficient (?:[\p{L}\p{N}_]+ )?(?:evidence|support|detail)|no (?:quantitative|empirical|experimental) "
    r"|does not (?:report|provide|establish|demonstrate|support|justify|show)"
    r"|(?:claims?|conclusions?) (?:are|is|seem|appear) (?:not|too|overly)"
)
PHRASE = r"(?iU)\brather than\b"


def section(text: Column, wanted: list[str], headings: list[str] | None = None) -> Column:
    """The lines under the wanted headings, up to the next heading. Marks around a heading (#, *, :) don't matter."""
    line = lambda names: r"[#*: \t]*(?:" + "|".join(names) + r")[#*: \t]*"
    rx = rf"(?ms)^{line(wanted)}$(.*?)(?=^{line(headings or HEADINGS)}$|\z)"
    parts = F.transform(F.regexp_extract_all(text, F.lit(rx), F.lit(1)), lambda p: F.regexp_replace(p, r"^\n|\n\z", ""))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n")


def cue_columns(review: Column) -> list[Column]:
    """critique_words and cues of a review's Weaknesses and Suggestions for Improvement."""
    critique = F.coalesce(section(review, ["Weaknesses", "Suggestions for Improvement"]), F.lit(""))
    return [word_count(critique).alias("critique_words"), F.regexp_count(critique, F.lit(CUES)).cast("long").alias("cues")]


def revision_effects(papers: DataFrame, key: str = "doc_id", phrase: str = PHRASE) -> DataFrame:
    """(key, generated, review, revised) -> cues of the review, occurrences added, change of the rate and of the log length.
    A missing text has no words."""
    n = {c: F.coalesce(F.regexp_count(c, F.lit(phrase)), F.lit(0)).cast("long") for c in ("generated", "revised")}
    w = {c: F.greatest(word_count(F.col(c)), F.lit(1)) for c in ("generated", "revised")}
    return papers.select(
        key,
        *cue_columns(F.col("review")),
        (n["revised"] - n["generated"]).alias("added"),
        (per_thousand(n["revised"], w["revised"]) - per_thousand(n["generated"], w["generated"])).alias("rate_change"),
        F.log(w["revised"] / w["generated"]).alias("length_change"),
    )
