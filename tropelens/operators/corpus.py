"""Pattern counts over corpora: per document, per corpus, per pair of versions."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tropelens.functions.batches import pieces
from tropelens.functions.patterns import PATTERNS, Pattern, has_match, match_count, per_thousand, space_word_count, word_count
from tropelens.functions.text import SENTENCE_END, sentences


def doc_counts(docs: DataFrame, text: str = "text", patterns: list[Pattern] | None = None) -> DataFrame:
    """docs without its text, with `words` and one count per pattern: one pass, no shuffle."""
    counts = {p.pattern_id: match_count(F.col(text), p) for p in patterns or PATTERNS}
    return docs.withColumns({"words": word_count(F.col(text)), **counts}).drop(text)


def by_pattern(counts: DataFrame, patterns: list[Pattern] | None = None) -> DataFrame:
    """The counts as rows (..., words, pattern_id, tier, n)."""
    patterns = patterns or PATTERNS
    keep = [c for c in counts.columns if c not in {p.pattern_id for p in patterns}]
    pairs = F.array(*(F.struct(F.lit(p.pattern_id).alias("pattern_id"), F.lit(p.tier).alias("tier"), F.col(p.pattern_id).alias("n")) for p in patterns))
    return counts.select(*keep, F.inline(pairs))


def summary(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per pattern: total, files with a hit, their percentage of all files, mean and exact median rate per 1,000 words.

    Files without words count as files but have no rate.
    """
    rate = per_thousand(F.col("n"), F.col("words"))
    return (
        by_pattern(counts)
        .groupBy(*(by or []), "pattern_id", "tier")
        .agg(
            F.sum("n").alias("total"),
            F.sum((F.col("n") > 0).cast("long")).alias("files_with_hit"),
            (100.0 * F.sum((F.col("n") > 0).cast("long")) / F.count(F.lit(1))).alias("hit_percent"),
            F.avg(rate).alias("mean_rate"),
            F.median(rate).alias("median_rate"),
        )
    )


def presence(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with a boolean per pattern."""
    return docs.withColumns({p.pattern_id: has_match(F.col(text), p) for p in PATTERNS}).drop(text)


def phrase_counts(docs: DataFrame, phrase: str = "rather than", text: str = "text") -> DataFrame:
    """docs without its text, with phrase_n (literal, no word boundaries, any case), space_words and rate."""
    body = F.lower(F.col(text))
    n = ((F.length(body) - F.length(F.replace(body, F.lit(phrase), F.lit("")))) / len(phrase)).cast("long")
    out = docs.withColumns({"phrase_n": F.coalesce(n, F.lit(0)).cast("long"), "space_words": space_word_count(F.col(text))}).drop(text)
    return out.withColumn("rate", per_thousand(F.col("phrase_n"), F.col("space_words")))


def at_least(counts: DataFrame, column: str, thresholds: list[int]) -> DataFrame:
    """(threshold, n): rows that reach each threshold, in one aggregate."""
    sums = counts.agg(*(F.sum((F.col(column) >= t).cast("long")).alias(f"t{t}") for t in thresholds))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("n")) for t in thresholds))))


def sentence_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", end: str = SENTENCE_END) -> DataFrame:
    """A row per sentence: key, pos, start (characters), sentence as split. Starts add up along a text, so each text is cut
    in its own row of an Arrow batch, and batches are worked on in pieces of bounded size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rx = re.compile(end)
        for batch in (p for b in batches for p in pieces(b, ["__t"])):
            out = []
            for k, t in zip(batch[key], batch["__t"], strict=True):
                gaps = [m.span() for m in rx.finditer(t)]
                starts, ends = [0, *(b for _, b in gaps)], [*(a for a, _ in gaps), len(t)]
                out += [(k, i, a, t[a:b]) for i, (a, b) in enumerate(zip(starts, ends, strict=True))]
            yield pd.DataFrame(out, columns=[key, "pos", "start", "sentence"])

    return docs.select(key, F.col(text).alias("__t")).where("__t is not null").mapInPandas(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, pos int, start long, sentence string")


def sentence_lists(docs: DataFrame, key: str = "doc_id", text: str = "text", end: str = SENTENCE_END) -> DataFrame:
    """(key, sentences): the sentences of sentence_rows() as an array a document, in their order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rx = re.compile(end)
        for batch in (p for b in batches for p in pieces(b, ["__t"])):
            yield pd.DataFrame({key: batch[key], "sentences": [rx.split(t) for t in batch["__t"]]})

    return docs.select(key, F.col(text).alias("__t")).where("__t is not null").mapInPandas(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, sentences array<string>")


def sentences_with(docs: DataFrame, phrase: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, sentence, before, after of the sentences with a phrase (any case): neighbours come from the same array, so
    nothing is shuffled and other sentences aren't made into rows."""
    rows = docs.select(key, sentences(F.col(text)).alias("__s")).where(F.lower(F.array_join("__s", " ")).contains(phrase))
    hits = F.filter(F.transform("__s", lambda x, i: F.struct(i.alias("pos"), x.alias("sentence"))), lambda x: F.contains(F.lower(x["sentence"]), F.lit(phrase)))
    rows = rows.withColumn("__h", F.explode(hits))
    near = lambda k: F.coalesce(F.get("__s", F.col("__h.pos") + k), F.lit(""))
    return rows.select(key, "__h.pos", "__h.sentence", near(-1).alias("before"), near(1).alias("after"))


INSTANCE = "pattern_id string, tier int, match_text string, char_start long, char_end long, sentence string, local_start long, local_end long, context_before string, context_after string"


def instances_of(text: str, compiled: list[tuple[Pattern, re.Pattern]]) -> list[tuple]:
    """All matches of a text, pattern by pattern, with sentence and neighbours; offsets in characters."""
    gaps = [m.span() for m in re.finditer(SENTENCE_END, text)]
    starts, ends = [0, *(b for _, b in gaps)], [*(a for a, _ in gaps), len(text)]
    out = []
    for p, rx in compiled:
        for m in rx.finditer(text):
            k = bisect.bisect_right(starts, m.start()) - 1
            last = bisect.bisect_left(ends, m.end())
            raw = text[starts[k] : ends[last]]
            local = m.start() - starts[k] - (len(raw) - len(raw.lstrip()))
            before = text[starts[k - 1] : ends[k - 1]].strip() if k else ""
            after = text[starts[last + 1] : ends[last + 1]].strip() if last + 1 < len(starts) else ""
            out.append((p.pattern_id, p.tier, m[0], m.start(), m.end(), raw.strip(), local, local + len(m[0]), before, after))
    return out


def instances(docs: DataFrame, key: str = "doc_id", text: str = "text", patterns: list[Pattern] | None = None) -> DataFrame:
    """Every match as a row: key, pattern_id, tier, match_text, char_start, char_end, sentence (trimmed), local_start,
    local_end, context_before and context_after (neighbouring sentences, empty at a document's ends).

    Matches need running offsets within a text, which columns can only fold step by step: this is Arrow batches in, rows
    out. Texts without any gate word never leave the JVM, and nothing is shuffled. Null texts have no instances.
    """
    patterns = patterns or PATTERNS
    gates = "|".join(sorted({re.escape(p.gate) for p in patterns}))
    rows = docs.select(key, F.col(text).alias("__t")).where(F.lower("__t").rlike(gates))
    names = [key, *(x.split()[0] for x in INSTANCE.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(p, re.compile(p.regex, re.I)) for p in patterns]
        for batch in (p for b in batches for p in pieces(b, ["__t"])):
            yield pd.DataFrame([(k, *i) for k, t in zip(batch[key], batch["__t"], strict=True) for i in instances_of(t, compiled)], columns=names)

    return rows.mapInPandas(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {INSTANCE}")


def excluded(docs: DataFrame, least_words: int = 200) -> DataFrame:
    """(doc_id, reason) of documents left out: not English, or too short."""
    words = F.regexp_count("text", F.lit(r"\p{L}{2,}"))
    reason = F.when(F.coalesce(words, F.lit(0)) < least_words, F.lit("no_text")).when(F.col("lang") != "en", F.lit("non_english"))
    return docs.select("doc_id", reason.alias("reason")).where("reason is not null")


def without(docs: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """docs that the list doesn't name; Spark broadcasts the list if it is small."""
    return docs.join(listed.select(*keys).distinct(), keys, "left_anti")


def version_pairs(versions: DataFrame, paper: str, version: str, values: list[str]) -> DataFrame:
    """First and latest version of each paper side by side, in one aggregate; papers with version 1 and a later one only."""
    firsts = [F.max(F.when(F.col(version) == 1, F.col(v))).alias(f"first_{v}") for v in values]
    lasts = [F.max_by(F.col(v), F.col(version)).alias(f"last_{v}") for v in values]
    out = versions.groupBy(paper).agg(F.min(version).alias("__lo"), F.max(version).alias("latest"), *firsts, *lasts)
    return out.where("__lo = 1 and latest > 1").drop("__lo")


def in_all(sources: list[DataFrame], key: str) -> DataFrame:
    """Keys that every source has."""
    out = sources[0].select(key).distinct()
    for s in sources[1:]:
        out = out.join(s.select(key).distinct(), key, "left_semi")
    return out


def neighbours(rows: DataFrame, doc: str, pos: str, value: str, k: int = 1) -> DataFrame:
    """rows with up to k earlier and later values of the same document as arrays, nearest last and first."""
    w = Window.partitionBy(doc).orderBy(pos)
    before = F.collect_list(value).over(w.rowsBetween(-k, -1))
    after = F.collect_list(value).over(w.rowsBetween(1, k))
    return rows.withColumns({"before": before, "after": after})
