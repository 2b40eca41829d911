"""Preference pairs, minimal pairs and reward contrasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tropelens.functions.patterns import PATTERNS, Pattern, has_match
from tropelens.functions.stats import sign_test


def oriented(rows: DataFrame, first: str = "response1", second: str = "response2", strength: str = "strength") -> DataFrame:
    """chosen and rejected from a signed strength (negative: the first is better); ties are left out."""
    s = F.col(strength)
    return rows.where(s != 0).select(
        *[c for c in rows.columns if c not in (first, second, strength)],
        F.when(s < 0, F.col(first)).otherwise(F.col(second)).alias("chosen"),
        F.when(s < 0, F.col(second)).otherwise(F.col(first)).alias("rejected"),
        F.abs(s).alias("strength"),
    )


def discordance(pairs: DataFrame, patterns: list[Pattern] | None = None) -> DataFrame:
    """Per pattern: pairs with it only in the chosen and only in the rejected text. Equal and empty texts are left out."""
    pairs = pairs.where("chosen <> '' and rejected <> '' and chosen <> rejected")
    sums: list[Column] = []
    patterns = patterns or PATTERNS
    for p in patterns:
        c, r = has_match(F.col("chosen"), p), has_match(F.col("rejected"), p)
        sums += [F.sum((c & ~r).cast("long")).alias(f"c_{p.pattern_id}"), F.sum((r & ~c).cast("long")).alias(f"r_{p.pattern_id}")]
    out = pairs.agg(*sums)
    return out.select(F.inline(F.array(*(F.struct(F.lit(p.pattern_id).alias("pattern_id"), F.coalesce(f"c_{p.pattern_id}", F.lit(0)).alias("only_chosen"), F.coalesce(f"r_{p.pattern_id}", F.lit(0)).alias("only_rejected")) for p in patterns))))


def sign_tests(table: DataFrame) -> DataFrame:
    """discordance() with exact p-values: a row a pattern goes through the driver."""
    rows = [(r["pattern_id"], r["only_chosen"], r["only_rejected"], sign_test(r["only_chosen"], r["only_chosen"] + r["only_rejected"])) for r in table.collect()]
    return table.sparkSession.createDataFrame(rows, "pattern_id string, only_chosen long, only_rejected long, p double")


def contrasts(scores: DataFrame) -> DataFrame:
    """(model, item_id, original, deleted[, control]) -> per model n and mean of the differences original - deleted, original -
    control and control - deleted."""
    o, d, c = F.col("original"), F.col("deleted"), F.col("control") if "control" in scores.columns else F.lit(None).cast("double")
    return scores.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg(o - d).alias("original_deleted"), F.avg(o - c).alias("original_control"), F.avg(c - d).alias("control_deleted"))


def rated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """completions array<struct<response, annotations map<string, struct<Rating string>>>> -> a row a completion that has all
    the ratings as numbers."""
    out = rows.select("*", F.posexplode("completions").alias("at", "c")).drop("completions")
    out = out.withColumns({k: F.col("c.annotations")[k]["Rating"].try_cast("double") for k in keys}).withColumn("response", F.col("c.response")).drop("c")
    for k in keys:
        out = out.where(F.col(k).isNotNull())
    return out
