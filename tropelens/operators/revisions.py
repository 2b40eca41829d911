"""What became of a sentence in another version: its closest sentence there, and which patterns took a phrase's place."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tropelens.functions.batches import MOST_CHARS
from tropelens.functions.patterns import PATTERNS, Pattern, lowered, match_count, word_count
from tropelens.functions.text import sentences
from tropelens.operators import ranking
from tropelens.operators.repositories import settled

#: Characters are counted in so many classes; folding them together can only raise a bound.
CLASSES = 64


@F.pandas_udf(BinaryType())
def character_counts(texts: pd.Series) -> pd.Series:
    """How often each class of characters stands in a text, as bytes of 16-bit numbers; counts that don't fit are at the top."""
    out = []
    for text in texts:
        points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out.append(np.minimum(np.bincount(points % CLASSES, minlength=CLASSES), 65_535).astype("<u2").tobytes())
    return pd.Series(out)


def similarity(candidate: str, sentence: str) -> float:
    """Share of characters in matching blocks, taken with the candidate as the first side (the measure isn't symmetric)."""
    import difflib

    return difflib.SequenceMatcher(None, candidate, sentence, autojunk=False).ratio()


def letter_places(text: str) -> dict[str, int]:
    """Where each character stands in a text, as the bits of a number."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def most_similar(candidate: str, size: int, places: dict[str, int]) -> float:
    """The ratio that `similarity` can't exceed, by the longest common subsequence with a sentence of `size` characters: matching
    blocks stand in the same order on both sides. All places of the sentence are worked on together, as bits."""
    full = rest = (1 << size) - 1
    for c in candidate:
        hit = rest & places.get(c, 0)
        rest = ((rest + hit) | (rest - hit)) & full
    total = size + len(candidate)
    return 2.0 * (size - rest.bit_count()) / total if total else 1.0


def length_band(n: Column, least: float) -> Column:
    """Texts whose lengths allow a ratio of `least` are in the same band or in neighbouring ones."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / math.log((2 - least) / least)).cast("int")


def candidates(sources: DataFrame, targets: DataFrame, key: str, least: float = 0.6, slices: int = 8) -> DataFrame:
    """(key, pos, sentence, other, text, bound) pairs of a document's sources (key, pos, sentence) and targets (key, pos, sentence)
    that could reach the ratio `least`.

    The ratio is at most 2 * common / (a + b), where common is the size of what both bags of characters share, and that is at
    most the shorter length. So lengths are matched in bands first, and counts of characters decide before any text is
    compared. A document's targets are dealt in slices: a document with a third of all sentences isn't one task.
    """
    bands = F.sequence(length_band(F.length("sentence"), least) - 1, length_band(F.length("sentence"), least) + 1)
    left = sources.select(key, "pos", "sentence", character_counts("sentence").alias("bag"), F.explode(bands).alias("band"))
    left = left.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    right = targets.select(key, F.col("pos").alias("other"), F.col("sentence").alias("text"), character_counts("sentence").alias("other_bag"), length_band(F.length("sentence"), least).alias("band"), (F.col("pos") % slices).cast("int").alias("slice"))
    a, b = F.length("sentence"), F.length("text")
    pairs = left.join(right, [key, "band", "slice"]).where((a + b > 0) & (2.0 * F.least(a, b) >= least * (a + b)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(key, "pos", "sentence", "other", "text").schema) + ", bound double"

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = (np.frombuffer(b"".join(batch[c]), dtype="<u2").reshape(-1, CLASSES).astype(np.int64) for c in ("bag", "other_bag"))
            full = (x == 65_535) | (y == 65_535)  # the count may be larger
            common = np.where(full, 1 << 40, np.minimum(x, y)).sum(1)
            sizes = batch["sentence"].str.len().to_numpy() + batch["text"].str.len().to_numpy()
            batch["bound"] = np.minimum(1.0, 2.0 * common / sizes)
            yield batch.loc[batch["bound"] >= least, [key, "pos", "sentence", "other", "text", "bound"]]

    return pairs.mapInPandas(bounded, schema)


def closest(sources: DataFrame, targets: DataFrame, key: str, least: float = 0.6, slices: int = 8) -> DataFrame:
    """sources (key, pos, sentence) with match (null if none reaches `least`), match_pos and ratio: the target of the same document
    with the highest ratio; of equals the one that stands later.

    A target equal to the source has ratio 1 and needs no comparison, which settles most sentences. For the others, pairs are
    compared in the order of their bounds, until no bound reaches the best ratio of the source's slice; a pair whose longest common
    subsequence can't reach it isn't compared either.
    """
    sources = settled(sources.where("sentence is not null").select(key, "pos", "sentence"))
    targets = settled(targets.where("sentence is not null").select(key, "pos", "sentence"))
    asked = sources.select(key, "sentence").distinct()
    same = asked.join(targets, [key, "sentence"]).groupBy(key, "sentence").agg(F.max("pos").alias("match_pos"))
    same = settled(same)
    open_ones = sources.join(same, [key, "sentence"], "left_anti")
    pairs = candidates(open_ones, targets, key, least, slices)
    pair_schema = pairs.select(key, "pos").schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pair_schema) + ", ratio double, match_pos long, match string"

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, top, found, places = None, least, None, {}
        for batch in batches:
            rows = []
            for k, pos, sentence, other, text, bound in batch[[key, "pos", "sentence", "other", "text", "bound"]].itertuples(index=False):
                if (k, pos) != now:
                    if found:
                        rows.append((*now, *found))
                    now, top, found = (k, pos), least, None
                    places = letter_places(sentence)
                if bound < top or most_similar(text, len(sentence), places) < top:
                    continue
                r = similarity(text, sentence)
                if r >= least and (found is None or (r, other) > found[:2]):
                    top, found = r, (r, other, text)
            if rows:
                yield pd.DataFrame(rows, columns=[key, "pos", "ratio", "match_pos", "match"])
        if found:
            yield pd.DataFrame([(*now, *found)], columns=[key, "pos", "ratio", "match_pos", "match"])

    dealt = pairs.withColumn("slice", (F.col("other") % slices).cast("int")).repartition(F.col(key), F.col("pos"), F.col("slice"))
    scored = dealt.sortWithinPartitions(key, "pos", "slice", F.desc("bound"), F.desc("other")).mapInPandas(best, schema)
    scored = scored.groupBy(key, "pos").agg(F.max(F.struct("ratio", "match_pos", "match")).alias("b")).select(key, "pos", "b.*")
    equal = sources.join(same, [key, "sentence"]).select(key, "pos", F.lit(1.0).alias("ratio"), F.col("match_pos").cast("long"), F.col("sentence").alias("match"))
    return sources.join(scored.unionByName(equal), [key, "pos"], "left")


def best_of_texts(sentence: str, texts: list[str], counts: np.ndarray, sizes: np.ndarray, least: float) -> tuple[float, int] | None:
    """(ratio, place) of the text closest to the sentence, of equals the last; None if none reaches `least`. counts has the texts'
    character counts. Texts are compared in the order of their bounds, and only if their longest common subsequence can win."""
    import difflib

    points = np.frombuffer(sentence.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    bounds = 2.0 * np.minimum(counts, np.bincount(points % CLASSES, minlength=CLASSES)).sum(1) / np.maximum(sizes + len(points), 1)
    order = np.flatnonzero(bounds >= least)
    top, found, places = least, None, letter_places(sentence)
    matcher = difflib.SequenceMatcher(None, "", sentence, autojunk=False)  # indexes the sentence once
    for k in order[np.lexsort((-order, -bounds[order]))].tolist():
        if bounds[k] < top:
            break
        if most_similar(texts[k], len(sentence), places) < top:
            continue
        matcher.set_seq1(texts[k])
        r = matcher.ratio()
        if r >= least and (found is None or (r, k) > found):
            top, found = r, (r, k)
    return found


def matched_in_row(pairs: DataFrame, old: str, new: str, phrase: Pattern, least: float = 0.6, asked: int = 64, texts: int = 1_024) -> DataFrame:
    """(match): for each sentence of `old` with the phrase the closest sentence of `new` in the same row, or null.

    Sentences that stand in both versions are settled where their texts are. Those of the others are dealt by rows of at most
    `asked` sentences and `texts` targets, so a long text is several tasks' work; nothing else is moved, and no pair is a row.
    """
    sources = F.filter(F.coalesce(sentences(F.col(old)), F.array().cast("array<string>")), lambda x: match_count(x, phrase) > 0)
    rows = pairs.where(F.contains(lowered(F.col(old)), F.lit(phrase.gate))).select(sources.alias("s"), F.coalesce(sentences(F.col(new)), F.array().cast("array<string>")).alias("t"))

    columns = ["row", "first", "asked", "at", "texts", "match"]

    def same(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, chars = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            for s, t in zip(batch["s"], batch["t"], strict=True):
                known, number = set(t), number + 1
                held += [(number, 0, None, 0, None, x) for x in s if x in known]
                rest = [x for x in s if x not in known]
                for i in range(0, len(rest), asked):
                    for j in range(0, len(t) or 1, texts):
                        held.append((number, i, rest[i : i + asked], j, list(t[j : j + texts]), None))
                        chars += sum(map(len, held[-1][4]))
                        if chars > MOST_CHARS:
                            yield pd.DataFrame(held, columns=columns)
                            held, chars = [], 0
                if len(held) > 10_000:
                    yield pd.DataFrame(held, columns=columns)
                    held, chars = [], 0
        if held:
            yield pd.DataFrame(held, columns=columns)

    found = settled(rows.mapInPandas(same, "row long, first long, asked array<string>, at long, texts array<string>, match string"))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, first, wanted, at, among in batch[["row", "first", "asked", "at", "texts"]].itertuples(index=False):
                among = list(among)
                points = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for x in among]
                counts = np.array([np.bincount(x % CLASSES, minlength=CLASSES) for x in points]).reshape(-1, CLASSES)
                sizes = np.array([len(x) for x in points], dtype=np.int64)
                for k, x in enumerate(wanted):
                    got = best_of_texts(x, among, counts, sizes, least)
                    out.append((row, first + k, None, None, None) if got is None else (row, first + k, got[0], at + got[1], among[got[1]]))
            yield pd.DataFrame(out, columns=["row", "pos", "ratio", "other", "match"]).astype({"other": "Int64"})

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    open_ones = found.where("asked is not null").repartition(parts).mapInPandas(best, "row long, pos long, ratio double, other long, match string")
    top = F.max(F.when(F.col("ratio").isNotNull(), F.struct("ratio", "other", "match")))
    return found.where("asked is null").select("match").unionByName(open_ones.groupBy("row", "pos").agg(top.alias("b")).select("b.match"))


def substitutions(pairs: DataFrame, key: str, old: str, new: str, phrase: Pattern = PATTERNS[0], least: float = 0.6) -> DataFrame:
    """(direction, outcome, n): what became of the sentences with a phrase, from old to new (removed) and back (added).

    Outcomes: sentences (all with the phrase), kept (the closest sentence has it, too), unmatched, changed, and for the changed
    ones `form:<pattern>` for each other pattern in the closest sentence, or form:none.
    """
    out = []
    for direction, (a, b) in (("removed", (old, new)), ("added", (new, old))):
        has = lambda c: match_count(F.col(c), phrase) > 0
        rows = settled(matched_in_row(pairs, a, b, phrase, least))
        fate = F.when(F.col("match").isNull(), "unmatched").when(has("match"), "kept").otherwise("changed")
        forms = F.array_compact(F.array(*(F.when(match_count(F.col("match"), p) > 0, f"form:{p.pattern_id}") for p in PATTERNS)))
        forms = F.when(F.size(forms) > 0, forms).otherwise(F.array(F.lit("form:none")))
        told = F.when(fate == "changed", F.concat(F.array(F.lit("sentences"), fate), forms)).otherwise(F.array(F.lit("sentences"), fate))
        out.append(rows.select(F.lit(direction).alias("direction"), F.explode(told).alias("outcome")))
    return reduce(DataFrame.unionByName, out).groupBy("direction", "outcome").agg(F.count(F.lit(1)).alias("n"))


def rate_changes(pairs: DataFrame, old: str, new: str, anchor: str = PATTERNS[0].pattern_id) -> DataFrame:
    """Per pattern: documents, mean rate per 1,000 words in the old and the new version, mean change, p of the change (signed
    ranks, from six changed documents on), and rank correlation of the change with the anchor's change."""
    rate = lambda c, p: 1000.0 * match_count(F.col(c), p) / F.greatest(word_count(F.col(c)), F.lit(1))
    stack = F.array(*(F.struct(F.lit(p.pattern_id).alias("pattern_id"), rate(old, p).alias("a"), rate(new, p).alias("b")) for p in PATTERNS))
    stacks = settled(pairs.where(F.col(old).isNotNull() & F.col(new).isNotNull()).select(stack.alias("s")))  # else texts are searched again for every use of s
    base = F.filter("s", lambda x: x["pattern_id"] == anchor)[0]
    rows = settled(stacks.select(F.explode("s").alias("x"), F.round(base["b"] - base["a"], 9).alias("anchor")).select("x.*", "anchor").withColumn("d", F.round(F.col("b") - F.col("a"), 9)))
    means = rows.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("docs"), F.avg("a").alias("old_rate"), F.avg("b").alias("new_rate"), F.avg("d").alias("change"))
    signed = ranking.signed_ranks(rows, "d", ["pattern_id"]).select("pattern_id", F.col("n").alias("changed"), F.when(F.col("n") > 5, F.col("p")).alias("p"))
    rho = ranking.spearman(rows.where(F.col("pattern_id") != anchor), "anchor", "d", ["pattern_id"]).select("pattern_id", "rho")
    out = means.join(F.broadcast(settled(signed)), "pattern_id", "left").join(F.broadcast(settled(rho)), "pattern_id", "left")  # a row a pattern
    return out.withColumn("changed", F.coalesce("changed", F.lit(0)))
