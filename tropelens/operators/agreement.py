"""Two annotators' labels side by side, and chance-corrected agreement over any number of classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_pairs(labels: DataFrame, rater: str, item: str, label: str, first: str, second: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """(item, a, b) for the items that both raters labelled, without those to which either gave a label of `drop`. A rater has one
    label an item; raters are told apart in one aggregate, so labels are moved once."""
    both = labels.where(F.col(rater).isin(first, second) & F.col(item).isNotNull() & F.col(label).isNotNull())
    one = lambda who: F.max(F.when(F.col(rater) == who, F.col(label)))
    out = both.groupBy(item).agg(one(first).alias("a"), one(second).alias("b")).where("a is not null and b is not null")
    return out.where(~F.col("a").isin(*drop) & ~F.col("b").isin(*drop)) if drop else out


def agreement(pairs: DataFrame, by: list[str] | None = None, a: str = "a", b: str = "b") -> DataFrame:
    """Per group: n, classes, observed (share of equal labels), kappa (Cohen) and ac1 (Gwet), over all classes that either uses.

    Everything follows from the counts of pairs of labels. Chance agreement is sum(pa * pb) for kappa and
    sum(q * (1 - q)) / (classes - 1), with q the mean of pa and pb, for AC1. Where chance agreement is 1, kappa is null; with one
    class only, AC1 is null, too. Pairs with a null label don't count.
    """
    keys = by or ["__all"]
    pairs = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = pairs if by else pairs.withColumn("__all", F.lit(0))
    cells = pairs.groupBy(*keys, F.col(a).alias("__a"), F.col(b).alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    zero = F.lit(0).cast("long")
    side = lambda c, x, y: F.struct(F.col(c).alias("c"), x.alias("x"), y.alias("y"))
    sides = F.array(side("__a", F.col("__n"), zero), side("__b", zero, F.col("__n")))
    margins = cells.select(*keys, F.explode(sides).alias("m")).groupBy(*keys, "m.c").agg(F.sum("m.x").cast("double").alias("x"), F.sum("m.y").cast("double").alias("y"))
    total = F.sum("x")
    q = (F.col("x") + F.col("y")) / 2
    chance = margins.groupBy(*keys).agg(total.alias("__t"), F.count(F.lit(1)).alias("classes"), F.sum(F.col("x") * F.col("y")).alias("__xy"), F.sum(q).alias("__q"), F.sum(q * q).alias("__qq"))
    seen = cells.groupBy(*keys).agg(F.sum("__n").alias("n"), F.sum(F.when(F.col("__a") == F.col("__b"), F.col("__n")).otherwise(0)).alias("__same"))
    chance = chance.select(*(F.col(k).alias(f"__k_{k}") for k in keys), "classes", "__t", "__xy", "__q", "__qq")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    out = seen.join(chance, on)
    n = F.col("__t")
    po, pe = F.col("__same") / n, F.col("__xy") / (n * n)
    pg = F.when(F.col("classes") > 1, (F.col("__q") / n - F.col("__qq") / (n * n)) / (F.col("classes") - 1))
    return out.select(*(by or []), "n", "classes", po.alias("observed"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"), F.when(pg < 1, (po - pg) / (1 - pg)).alias("ac1"))
