"""Where in a paper a phrase stands: Markdown headings to groups, rates and shares by group, what a revision adds; cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tropelens.functions.patterns import PATTERNS, Pattern, has_match, match_count, word_count
from tropelens.functions.text import let
from tropelens.operators.repositories import settled

# Groups, those that scope a claim, expressions of headings in the order in which they are tried, and the groups of
# section categories.
GROUPS = ["abstract", "introduction", "related", "body", "conclusion", "limitations"]
SCOPING = ["abstract", "conclusion", "limitations"]
RULES = [
    ("abstract", "abstract"),
    ("limitations", "limitation|ethic|broader impact"),
    ("related", "related|background|prior work|previous work"),
    ("introduction", "introduction"),
    ("conclusion", "conclusion|future work|summary"),
    ("drop", "^references?$|bibliography|acknowledg|appendix"),
]
CATEGORY_GROUPS = {
    "abstract": "abstract", "introduction": "introduction", "related_work": "related", "method": "body", "experiments": "body", "preliminaries": "body",
    "results": "body", "analysis": "body", "other": "body", "discussion": "body", "conclusion": "conclusion", "limitations": "limitations", "ethics": "limitations",
}


def heading_group(heading: Column) -> Column:
    """The group of a heading, its number aside; null if no rule knows it."""
    name = F.trim(F.regexp_replace(F.lower(heading), r"^[\d.\s]+", ""))
    out = F.when(name.rlike(RULES[0][1]), RULES[0][0])
    for group, rule in RULES[1:]:
        out = out.when(name.rlike(rule), group)
    return out


def markdown_groups(text: Column) -> Column:
    """array<struct<grp, text>> of a Markdown paper's sections without their headings, dropped ones left out.

    A heading of the first two levels sets the group for what follows (unknown ones: nothing at the first level, the title's,
    and body at the second); a deeper heading has its own group if a rule knows it, else that of the heading above.
    """
    parts = F.split(text, r"(?m)^(?=#{1,6}\s)", -1)

    def read(x: Column) -> Column:
        mark = F.regexp_extract(x, r"^(#{1,6})\s+([^\n]*)", 1)
        own = F.when(mark != "", heading_group(F.regexp_extract(x, r"^(#{1,6})\s+([^\n]*)", 2)))
        level = F.length(mark)
        top = F.when(level == 0, "drop").when(level == 1, F.coalesce(own, F.lit("drop"))).when(level == 2, F.coalesce(own, F.lit("body")))
        body = F.when(level > 0, F.regexp_replace(x, r"^#{1,6}\s[^\n]*\n?", "")).otherwise(x)
        return F.struct(top.alias("top"), own.alias("own"), body.alias("body"))

    def carried(sections: Column) -> Column:
        def placed(s: Column, i: Column) -> Column:
            above = F.filter(F.transform(F.slice(sections, 1, i + 1), lambda p: p["top"]), lambda t: t.isNotNull())
            group = F.coalesce(s["top"], s["own"], F.element_at(above, -1))
            return F.struct(group.alias("grp"), s["body"].alias("text"))

        return F.filter(F.transform(sections, placed), lambda s: s["grp"] != "drop")

    return let(F.transform(parts, read), carried)


def group_counts(rows: DataFrame, by: list[str], grp: str = "grp", text: str = "text", phrase: Pattern = PATTERNS[0]) -> DataFrame:
    """(by, grp, uses, words) of the known groups."""
    known = rows.where(F.col(grp).isin(*GROUPS))
    return known.groupBy(*by, F.col(grp).alias("grp")).agg(F.sum(match_count(F.col(text), phrase)).alias("uses"), F.sum(word_count(F.col(text))).alias("words"))


def location_table(counts: DataFrame, by: list[str]) -> DataFrame:
    """counts with rate (per 1,000 words of the group), share (percentage of all uses), and word_share; and for each `by` two more
    rows, `all` and `scoping` (abstract, conclusion and limitations together). Ratios of sums; null where there is nothing. The counts
    are used four times and computed once."""
    counts = settled(counts)
    total = counts.groupBy(*by).agg(F.sum("uses").alias("__u"), F.sum("words").alias("__w"))
    more = [counts.withColumn("grp", F.lit("all")), counts.where(F.col("grp").isin(*SCOPING)).withColumn("grp", F.lit("scoping"))]
    rows = counts
    for x in more:
        rows = rows.unionByName(x.groupBy(*by, "grp").agg(F.sum("uses").alias("uses"), F.sum("words").alias("words")).select(counts.columns))
    on = [rows[c].eqNullSafe(total[c]) for c in by]
    out = rows.join(total, on).drop(*(total[c] for c in by))
    ratio = lambda a, b, k: F.when(F.col(b) > 0, k * F.col(a) / F.col(b))
    return out.withColumns({"rate": ratio("uses", "words", 1000.0), "share": ratio("uses", "__u", 100.0), "word_share": ratio("words", "__w", 100.0)}).drop("__u", "__w")


def added_by_revision(counts: DataFrame, by: list[str], stage: str, first: str, second: str) -> DataFrame:
    """(by, grp, added): uses in the second stage less those in the first, by group."""
    sign = F.when(F.col(stage) == second, F.col("uses")).when(F.col(stage) == first, -F.col("uses")).otherwise(0)
    return counts.groupBy(*by, "grp").agg(F.sum(sign).alias("added"))


def cut_rates(rows: DataFrame, full: str, body: str, cut: str, phrase: Pattern = PATTERNS[0]) -> DataFrame:
    """Whether a cut of back matter matters: for the documents that were cut, those kept whole, and all: documents, mean words and
    mean rate per 1,000 words of the full text and of the body. Texts without words have no rate."""
    rate = lambda c: F.when(word_count(F.col(c)) > 0, 1000.0 * match_count(F.col(c), phrase) / word_count(F.col(c)))
    measured = rows.select(F.when(F.col(cut), "cut").otherwise("whole").alias("kind"), *(x for c, n in ((full, "full"), (body, "body")) for x in (word_count(F.col(c)).alias(f"{n}_words"), rate(c).alias(f"{n}_rate"))))
    means = [F.avg(c).alias(c) for c in measured.columns[1:]]
    out = measured.rollup("kind").agg(F.count(F.lit(1)).alias("docs"), *means)
    return out.withColumn("kind", F.coalesce("kind", F.lit("all")))


def shown_density(rows: DataFrame, before: str = "before", sentence: str = "sentence", after: str = "after", phrase: Pattern = PATTERNS[0], besides: tuple[str, ...] = ("in_contrast",)) -> DataFrame:
    """rows with `again` (the phrase stands more than once in what is shown: the sentence and its context) and `other` (another
    pattern does, those named in `besides` left out)."""
    shown = F.concat_ws(" ", F.coalesce(before, F.lit("")), F.coalesce(sentence, F.lit("")), F.coalesce(after, F.lit("")))
    rows = rows.withColumn("__shown", shown)
    other = F.lit(False)
    for p in PATTERNS:
        if p.pattern_id != phrase.pattern_id and p.pattern_id not in besides:
            other = other | has_match(F.col("__shown"), p)
    return rows.withColumn("again", match_count(F.col("__shown"), phrase) > 1).withColumn("other", other).drop("__shown")


def dropped_documents(sources: dict[str, DataFrame], assess, listed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, reason) for every document that all sources have: null if it is kept, `excluded list`, or `source: reason` of the first
    source in which assess(text) gives one. Keys are unique in a source and not null."""
    names = list(sources)
    out = None
    for name, rows in sources.items():
        one = rows.select(key, assess(F.col(text)).alias(f"__{names.index(name)}"))
        out = one if out is None else out.join(one, key)
    out = out.join(listed.select(key, F.lit(True).alias("__out")).distinct(), key, "left")
    first = F.coalesce(*(F.concat(F.lit(f"{n}: "), F.col(f"__{k}")) for k, n in enumerate(names)))
    return out.select(key, F.when(F.col("__out"), "excluded list").otherwise(first).alias("reason"))
