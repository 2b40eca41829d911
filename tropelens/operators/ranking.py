"""Ranks, windows, latest-wins, order slices and the rank statistics built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tropelens.functions.stats import student_tail, upper_tail
from tropelens.operators.order import least_from, running_sum
from tropelens.operators.repositories import settled


def average_rank(value: str | Column, by: list[str] | None = None) -> Column:
    """Rank with ties sharing the mean of their places."""
    value = F.col(value) if isinstance(value, str) else value
    parts = [F.col(c) for c in by or []]
    return F.rank().over(Window.partitionBy(*parts).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*parts, value)) - 1) / 2.0


def rows_below(counts: DataFrame, value: str, n: str, by: list[str] | None = None) -> DataFrame:
    """counts (a row a value) with __below: the sum of n over smaller values of the group. counts is computed once, and no
    window holds more than a range of the values."""
    return running_sum(counts, by or [], [value], n, "__below")


def mann_whitney(rows: DataFrame, value: str, positive: str, by: list[str] | None = None) -> DataFrame:
    """Per group: n1, n0, U of the positives, AUC (ties count a half), the tie term sum(t^3 - t), and p two-sided, greater and
    less by the normal approximation with tie and continuity correction.

    Counts per value are all that is needed, so raw rows are only pre-aggregated, never ranked. Rows without a value or a
    class don't count.
    """
    keys = by or []
    rows = rows.where(F.col(value).isNotNull() & F.col(positive).isNotNull())
    v = rows.groupBy(*keys, value).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.count(F.lit(1)).alias("t"))
    v = rows_below(v.withColumn("__n", F.col("t") - F.col("p")), value, "__n", keys)
    p, t = F.col("p").cast("double"), F.col("t").cast("double")
    out = v.groupBy(*keys).agg(
        F.sum("p").alias("n1"),
        F.sum(F.col("t") - F.col("p")).alias("n0"),
        F.sum(p * (F.col("__below") + (t - p) / 2.0)).alias("u"),
        F.sum(t * t * t - t).alias("ties"),
    )
    n1, n0, u = F.col("n1").cast("double"), F.col("n0").cast("double"), F.col("u")
    n, both = n1 + n0, (n1 > 0) & (n0 > 0)
    spread = F.sqrt(n1 * n0 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    ok, off = both & (spread > 0), u - n1 * n0 / 2
    return out.withColumns(
        {
            "auc": F.when(both, u / (n1 * n0)),
            "p": F.when(ok, F.least(F.lit(1.0), 2 * upper_tail((F.abs(off) - 0.5) / spread))),
            "p_greater": F.when(ok, upper_tail((off - 0.5) / spread)),
            "p_less": F.when(ok, upper_tail((-off - 0.5) / spread)),
        }
    )


def signed_ranks(rows: DataFrame, difference: str, by: list[str] | None = None) -> DataFrame:
    """Per group n (non-zero differences), W+, W- and the two-sided p without continuity correction. Rows are counted by the
    size of their difference; ranks are never joined back to them. Without groups an empty table gives a row of zeros."""
    keys = by or []
    d = rows.where(F.col(difference) != 0).groupBy(*keys, F.abs(difference).alias("__abs")).agg(F.count(F.lit(1)).alias("t"), F.sum((F.col(difference) > 0).cast("long")).alias("up"))
    rank, t = F.col("__below") + (F.col("t") + 1) / 2.0, F.col("t").cast("double")
    below = rows_below(d, "__abs", "t", keys)
    out = (below.groupBy(*keys) if keys else below).agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("up") * rank), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum((F.col("t") - F.col("up")) * rank), F.lit(0.0)).alias("w_minus"),
        F.coalesce(F.sum(t * t * t - t), F.lit(0.0)).alias("__ties"),
    )
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("__ties") / 48)
    p = F.when(spread > 0, F.least(F.lit(1.0), 2 * upper_tail(F.abs(F.col("w_plus") - n * (n + 1) / 4) / spread)))
    return out.withColumn("p", p).drop("__ties")


def sized_join(left: DataFrame, right: DataFrame, keys: list[str], most_rows: int = 500_000, how: str = "inner") -> DataFrame:
    """Joins on keys where nulls match; right, a small table per key that is already computed, is broadcast only while it has few rows."""
    right = right.toDF(*(f"__r_{c}" for c in right.columns))
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    out = left.join(F.broadcast(right) if right.count() <= most_rows else right, on, how).drop(*(f"__r_{k}" for k in keys))
    return out.withColumnsRenamed({c: c[4:] for c in out.columns if c.startswith("__r_")})


def spearman(rows: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Per group n, rho and the two-sided p (Student's t with n - 2 degrees of freedom) of two columns, over rows that have
    both. Rows are counted by pair of values; ranks meet those counts."""
    keys = by or []
    pairs = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).alias("__x"), F.col(y).alias("__y")).agg(F.count(F.lit(1)).alias("__c"))
    pairs = settled(pairs)
    for c in ("__x", "__y"):
        one = rows_below(pairs.groupBy(*keys, c).agg(F.sum("__c").alias("__n")), c, "__n", keys)
        pairs = sized_join(pairs, settled(one.select(*keys, c, (F.col("__below") + (F.col("__n") + 1) / 2.0).alias(f"{c}r"))), [*keys, c])
    # ranks lie around (n + 1) / 2: sums of the products of their distances from it give rho
    w, a, b = F.col("__c").cast("double"), F.col("__xr"), F.col("__yr")
    grouped = pairs.groupBy(*keys) if keys else pairs
    sums = grouped.agg(F.coalesce(F.sum("__c"), F.lit(0)).alias("n"), F.sum(w * a * b).alias("__ab"), F.sum(w * a * a).alias("__aa"), F.sum(w * b * b).alias("__bb"))
    n = F.col("n").cast("double")
    middle = n * (n + 1) * (n + 1) / 4
    cross, one, two = F.col("__ab") - middle, F.col("__aa") - middle, F.col("__bb") - middle
    rho = F.when((one > 0) & (two > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cross / F.sqrt(one * two))))
    out = sums.withColumn("rho", rho).select(*keys, "n", "rho")
    t2 = F.col("rho") * F.col("rho") * (n - 2) / (1 - F.col("rho") * F.col("rho"))
    p = F.when((F.col("n") > 2) & (F.abs("rho") < 1), student_tail(t2, n - 2)).when((F.col("n") > 2) & (F.abs("rho") >= 1), 0.0)
    return out.withColumn("p", p)


def benjamini_hochberg(rows: DataFrame, p: str, by: list[str] | None = None) -> DataFrame:
    """rows with q: the least p * m / rank of its own and larger p. Equal p share the largest rank. Rows without p have no q
    and don't count as tests. Ranks and minima are taken over distinct p, in ranges."""
    keys = by or []
    rows = settled(rows)
    counts = running_sum(rows.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count(F.lit(1)).alias("__n")), keys, [p], "__n", "__below")
    counts = settled(counts)
    m = settled((counts.groupBy(*keys) if keys else counts).agg(F.sum("__n").alias("__m")))
    counts = sized_join(counts, m, keys) if keys else counts.join(F.broadcast(m))
    ratio = F.col(p) * F.col("__m") / (F.col("__below") + F.col("__n"))
    least = least_from(counts, keys, [p], ratio, "__q")
    least = settled(least.select(*keys, p, F.least(F.lit(1.0), "__q").alias("q")))
    return sized_join(rows, least, [*keys, p], how="left")


def latest(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The latest row's values for each key: an aggregate, so tasks reduce before the shuffle."""
    best = F.max_by(F.struct(*values), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("__v")).select(*keys, "__v.*")


def order_slices(rows: DataFrame, by: list[str], order: list[str], slices: int = 5) -> DataFrame:
    """rows with `slice`: slice q has the places q*n//slices up to (q+1)*n//slices."""
    w = Window.partitionBy(*by)
    pos, n = F.row_number().over(w.orderBy(*order)), F.count(F.lit(1)).over(w)
    return rows.withColumn("slice", (F.ceil(slices * pos / n) - 1).cast("long"))


def any_before(rows: DataFrame, by: list[str], order: list[str], flag: str, width: int) -> DataFrame:
    """rows with `before`: whether the flag holds in one of the `width` rows before."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-width, -1)
    return rows.withColumn("before", F.coalesce(F.max(F.col(flag).cast("int")).over(w), F.lit(0)))


def longest_runs(rows: DataFrame, by: list[str], pos: str) -> DataFrame:
    """Per group the longest run of consecutive positions (gaps and islands)."""
    w = Window.partitionBy(*by).orderBy(pos)
    islands = rows.withColumn("__g", F.col(pos) - F.row_number().over(w)).groupBy(*by, "__g").agg(F.count(F.lit(1)).alias("run"))
    return islands.groupBy(*by).agg(F.max("run").alias("longest"))


def within_budget(rows: DataFrame, by: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """rows taken while the total before them is under the budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__before", F.coalesce(F.sum(size).over(w), F.lit(0))).where(F.col("__before") < budget).drop("__before")
