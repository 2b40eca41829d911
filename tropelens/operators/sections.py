"""Sections of papers and Markdown files: a lossless split, cuts, rates by section."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tropelens.functions.patterns import PATTERNS, match_count, word_count
from tropelens.functions.text import SECTIONS

ALIASES = {alias: category for category, names in SECTIONS.items() for alias in names}
NUMBER = re.compile(r"^(?:\d+(?:\.\d+)*\.?|[A-Z]\.)\s+")
SECTION = "pos int, category string, heading string, text string"
# Categories that end a paper's own text.
BACK_MATTER = ("limitations", "ethics", "acknowledgments", "author_contributions", "references", "appendix", "conclusion")


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, line) of lines shaped like a heading: alone between blank lines, short, no final mark."""
    lines, at = text.split("\n"), 0
    for k, line in enumerate(lines):
        plain = line.strip()
        alone = (k == 0 or not lines[k - 1].strip()) and (k + 1 == len(lines) or not lines[k + 1].strip())
        if plain and alone and len(plain) <= 80 and plain[-1] not in ".,:;":
            yield at, at + len(line), plain
        at += len(line) + 1


def split(text: str, least_abstract: int = 300, aliases: dict[str, str] = ALIASES) -> list[tuple[str, str, str]]:
    """(category, heading, text) whose texts put together are the whole text. What stands before the first heading is front
    matter, and its last paragraph the abstract if it is long enough."""
    heads = [(a, aliases[name], line) for a, _, line in candidates(text) if (name := NUMBER.sub("", line).strip().lower()) in aliases]
    first = heads[0][0] if heads else len(text)
    front, out = text[:first], []
    cut = None
    for m in re.finditer(r"\S(?:.*\S)?(?:\n(?!\s*\n).*)*", front):
        if len(m[0].strip()) >= least_abstract:
            cut = m.start()
    if cut is None:
        out.append(("front_matter", "", front))
    else:
        out += [("front_matter", "", front[:cut]), ("abstract", "", front[cut:])]
    for k, (a, category, line) in enumerate(heads):
        out.append((category, line, text[a : heads[k + 1][0] if k + 1 < len(heads) else len(text)]))
    return [s for s in out if s[2]]


def section_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", aliases: dict[str, str] = ALIASES) -> DataFrame:
    """A row per section: key, pos, category, heading, text. aliases: lower-cased headings without their number -> category."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(d, k, *s) for d, t in zip(batch[key], batch["__t"], strict=True) for k, s in enumerate(split(t, aliases=aliases))], columns=[key, "pos", "category", "heading", "text"])

    return docs.select(key, F.col(text).alias("__t")).where("__t is not null").mapInPandas(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {SECTION}")


def unmatched_headings(docs: DataFrame, n: int = 50, text: str = "text", aliases: dict[str, str] = ALIASES) -> DataFrame:
    """The most common heading-shaped lines that no category knows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = [NUMBER.sub("", line).strip().lower() for t in batch["__t"] for _, _, line in candidates(t)]
            yield pd.DataFrame({"heading": [x for x in names if x not in aliases]})

    rows = docs.select(F.col(text).alias("__t")).where("__t is not null").mapInPandas(run, "heading string")
    return rows.groupBy("heading").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "heading").limit(n)


def without_back_matter(sections: DataFrame, key: str = "doc_id", back: tuple[str, ...] = BACK_MATTER) -> DataFrame:
    """(key, body, truncated): text up to the end of the last section of a back-matter category; else all of it."""
    s = F.array_sort(F.collect_list(F.struct("pos", "category", "text")))
    rows = sections.groupBy(key).agg(s.alias("__s"))
    last = F.array_max(F.transform(F.filter("__s", lambda x: x["category"].isin(*back)), lambda x: x["pos"]))
    kept = F.when(last.isNull(), F.col("__s")).otherwise(F.filter("__s", lambda x: x["pos"] <= last))
    return rows.select(key, F.array_join(F.transform(kept, lambda x: x["text"]), "").alias("body"), last.isNotNull().alias("truncated"))


def rates_by_section(sections: DataFrame) -> DataFrame:
    """Per category: occurrences of the first pattern, words, and their ratio per 1,000 words (of sums)."""
    rows = sections.select("category", match_count(F.col("text"), PATTERNS[0]).alias("n"), word_count(F.col("text")).alias("words"))
    out = rows.groupBy("category").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    return out.withColumn("rate", F.when(F.col("words") > 0, 1000.0 * F.col("n") / F.col("words")))


def markdown_sections(text: str, default: str = "body") -> list[tuple[str, str]]:
    """(group, text) by level-2 headings; deeper headings stay with the one above; title and references are left out."""
    group, out = default, []
    for line in text.split("\n"):
        m = re.match(r"^(#+)\s+(.*)", line)
        if m and len(m[1]) == 1:
            group = None
        elif m and len(m[1]) == 2:
            name = NUMBER.sub("", m[2]).strip().lower()
            group = None if ALIASES.get(name) == "references" else ALIASES.get(name, default)
        elif m is None and line.strip():
            group = default if group is None and not out else group
            if group is not None:
                out.append((group, line))
    merged: dict[str, list[str]] = {}
    for g, line in out:
        merged.setdefault(g, []).append(line)
    return [(g, "\n".join(lines)) for g, lines in merged.items()]
