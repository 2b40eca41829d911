"""Measures of an over-polished style in short texts, and their regression on a label."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tropelens.functions.text import az_tokens
from tropelens.operators import models
from tropelens.operators.repositories import settled

# Phrases by kind, emphatic adverbs at the beginning of a sentence, dashes.
PHRASES = {
    "marketing": ["payoff", "unlock", "elevate", "amplify", "streamline", "boost", "leverage", "wins", "tangible"],
    "hype": ["groundbreaking", "paramount", "unprecedented", "revolutionary", "invaluable", "profound", "exceptional"],
    "intensifiers": ["absolutely", "entirely", "highly", "incredibly"],
    "precision": ["exactly", "precisely", "specifically"],
    "evaluative": ["dependable", "practical", "meaningful", "deliberate", "measured", "steady", "immense"],
    "transitions": ["another dimension", "together these", "what comes next", "looking ahead the", "furthermore the", "ultimately this", "additionally the"],
    "tradeoffs": ["without requiring", "without losing", "without sacrificing", "without compromising"],
    "importance": ["distinction matters", "matters because", "matters more than", "absolutely essential", "remarkably", "single most", "arguably the most", "every single", "enormously"],
}
ADVERBS = ["crucially", "notably", "importantly", "ultimately", "critically", "fundamentally", "additionally", "furthermore", "moreover", "remarkably", "interestingly"]
DASH = "—|---"


def phrase_expression(phrases: list[str]) -> str:
    """Any of the phrases as whole words, case and kind of white space aside; of two that begin at one place the earlier listed."""
    return r"(?iU)\b(?:" + "|".join(r"\s+".join(map(re.escape, p.split(" "))) for p in phrases) + r")\b"


def shown_text(before: Column, sentence: Column, after: Column) -> Column:
    """What a reader was shown: the parts that are there, a space between."""
    parts = F.filter(F.array(before, sentence, after), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(parts, " ")


def measures(text: Column, listed: list[str], phrases: list[str] | None = None, adverbs: list[str] = ADVERBS) -> Column:
    """struct: listed (listed words per 100), phrases (number of matches), initial (a sentence begins with an adverb and a comma),
    dashes, length (words, at least 1). A null text measures as an empty one."""
    phrases = [p for group in PHRASES.values() for p in group] if phrases is None else phrases
    body = F.coalesce(text, F.lit(""))
    words = az_tokens(body)
    n = F.greatest(F.size(words), F.lit(1))
    in_list = F.size(F.filter(words, lambda w: w.isin(*listed))) if listed else F.lit(0)
    opening = r"(?i)(?:\A|[.!?]\s+)(?:" + "|".join(map(re.escape, adverbs)) + "),"
    return F.struct(
        (100.0 * in_list / n).alias("listed"),
        F.regexp_count(body, F.lit(phrase_expression(phrases))).cast("long").alias("phrases"),
        body.rlike(opening).alias("initial"),
        F.regexp_count(body, F.lit(DASH)).cast("long").alias("dashes"),
        n.cast("long").alias("length"),
    )


def label_model(rows: DataFrame, label: str, stratum: str, measured: str = "m", most_strata: int = 100) -> DataFrame:
    """(term, coefficient, error, mean_true, mean_false): logistic regression of a boolean label on the listed rate, log(1 + phrases)
    and initial adverbs, with log length and strata as controls. The most common stratum is the base; strata without a true
    label are left out as columns, as they have no finite effect. Rows without label or stratum don't count.
    """
    m = F.col(measured)
    rows = rows.where(F.col(label).isNotNull() & F.col(stratum).isNotNull())
    cols = {"listed": m["listed"], "phrases": F.log1p(m["phrases"].cast("double")), "initial": m["initial"].cast("double"), "length": F.log(m["length"].cast("double"))}
    data = settled(rows.select(F.col(label).cast("int").alias("y"), F.col(stratum).cast("string").alias("s"), *(c.alias(k) for k, c in cols.items())))
    levels = data.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k")).orderBy(F.desc("n"), "s").limit(most_strata).collect()
    used = [r["s"] for r in levels[1:] if r["k"] > 0]
    wide = data.select("y", *cols, *((F.col("s") == s).cast("double").alias(f"s{k}") for k, s in enumerate(used)))
    names = [*cols, *(f"s{k}" for k in range(len(used)))]
    w, se = models.logistic(wide, "y", names)
    means = wide.agg(*(F.avg(F.when(F.col("y") == v, F.col(c))).alias(f"{c}_{v}") for c in cols for v in (1, 0))).first()
    shown = [*cols, *(f"stratum {s}" for s in used)]
    finite = lambda x: float(x) if x is not None and np.isfinite(x) else None
    out = [(t, finite(w[k + 1]), finite(se[k + 1]), finite(means[f"{t}_1"]) if t in cols else None, finite(means[f"{t}_0"]) if t in cols else None) for k, t in enumerate(shown)]
    return rows.sparkSession.createDataFrame(out, "term string, coefficient double, error double, mean_true double, mean_false double")
