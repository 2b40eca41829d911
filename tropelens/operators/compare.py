"""Text comparison between versions."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tropelens.functions.batches import pieces

HUNK = "tag string, old_start int, removed array<string>, added array<string>, context_before array<string>, context_after array<string>"


def hunks_of(old: str, new: str, context: int = 2) -> list[tuple]:
    """Non-equal opcodes of the line diff, with lines of the old version around them."""
    a, b = (old or "").split("\n"), (new or "").split("\n")
    found = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    return [(tag, i, a[i:j], b[k:m], a[max(0, i - context) : i], a[j : j + context]) for tag, i, j, k, m in found if tag != "equal"]


def diff_hunks(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """A row per hunk. Each pair is compared in its own row; equal texts are dropped before they reach Python."""
    names = [x.split()[0] for x in HUNK.split(", ")]
    rows = pairs.where(~F.col(old).eqNullSafe(F.col(new))).select(key, F.col(old).alias("__old"), F.col(new).alias("__new"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (p for b in batches for p in pieces(b, ["__old", "__new"])):
            out = [(k, *h) for k, a, b in zip(batch[key], batch["__old"], batch["__new"], strict=True) for h in hunks_of(a, b)]
            yield pd.DataFrame(out, columns=[key, *names])

    return rows.mapInPandas(run, f"`{key}` {pairs.schema[key].dataType.simpleString()}, {HUNK}")


def classify_change(old: Column, new: Column, phrase: str = r"(?iU)\brather than\b") -> Column:
    """added, removed, removed_surgical, reworded or none.

    A removal is surgical if five successive words of the last 15 before the phrase still stand in the new text, case and
    the marks at the run's ends aside; with fewer words before the phrase, all of them.
    """
    had, has = old.rlike(phrase), new.rlike(phrase)
    before = F.regexp_extract(old, phrase.replace("(?iU)", "(?isU)^(.*?)"), 1)
    words = F.filter(F.split(before, r"(?U)\s+"), lambda w: w != "")
    tail, text = F.slice(words, F.greatest(F.size(words) - 14, F.lit(1)), 15), F.lower(new)
    least = F.least(F.lit(5), F.size(tail))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tail) - least + 1, F.lit(1))), lambda i: F.lower(F.btrim(F.array_join(F.slice(tail, i, least), " "), F.lit(",.;:()"))))
    surgical = (F.size(tail) > 0) & F.exists(runs, lambda r: (r != "") & F.contains(text, r))
    return (
        F.when(had & ~has, F.when(surgical, "removed_surgical").otherwise("removed"))
        .when(~had & has, "added")
        .when(had & has & (old != new), "reworded")
        .otherwise("none")
    )


def git_hunks(diff: Column) -> Column:
    """array<struct<hunk, old_text, new_text>> of a unified diff; context lines are on both sides."""
    parts = F.filter(F.split(diff, r"(?m)^(?=@@ )"), lambda h: h.startswith("@@ "))

    def side(h: Column, mark: str) -> Column:
        lines = F.split(h, "\n")
        lines = F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: x.startswith(mark) | x.startswith(" "))
        return F.array_join(F.transform(lines, lambda x: F.right(x, F.length(x) - 1)), "\n")

    return F.transform(parts, lambda h, i: F.struct(i.alias("hunk"), side(h, "-").alias("old_text"), side(h, "+").alias("new_text")))
