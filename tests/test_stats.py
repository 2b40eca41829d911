"""Statistics against textbook values."""

import math

import numpy as np
import plain_stats
import pytest
from pyspark.sql import functions as F

from tropelens.functions import stats
from tropelens.operators import order, ranking, replicates


def test_closed_forms():
    assert stats.fisher_two_sided(3, 1, 1, 3) == pytest.approx(0.485714, abs=1e-6)
    assert stats.fisher_two_sided(1, 9, 11, 3) == pytest.approx(0.002759, abs=1e-6)
    assert stats.sign_test(8, 10) == pytest.approx(0.109375)
    assert plain_stats.bh([0.01, 0.04, 0.03, 0.2]) == pytest.approx([0.04, 0.053333, 0.053333, 0.2], abs=1e-6)
    assert plain_stats.student_p(2.0, 10) == pytest.approx(0.073388, abs=1e-6)
    assert plain_stats.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-9)
    assert plain_stats.mann_whitney_p(0, 3, 3) == pytest.approx(0.1)
    assert plain_stats.chi2_1_sf(3.841459) == pytest.approx(0.05, abs=1e-6)


def test_intervals_and_agreement(spark):
    rows = spark.createDataFrame([(3, 10), (87, 685), (0, 20), (0, 0)], "k long, n long")
    lower, upper = stats.wilson(F.col("k"), F.col("n"))
    got = rows.select(lower.alias("a"), upper.alias("b")).collect()
    assert got[0]["a"] == pytest.approx(0.107789, abs=1e-6) and got[0]["b"] == pytest.approx(0.603227, abs=1e-6)
    assert got[1]["a"] == pytest.approx(0.104134, abs=1e-6) and got[2]["b"] == pytest.approx(0.161130, abs=1e-6) and got[3]["a"] is None
    a, b = [int(c) for c in "1100100010"], [int(c) for c in "1000110010"]
    c = spark.createDataFrame([(sum(x * y for x, y in zip(a, b, strict=True)), sum(a), sum(b), 10)], "both long, a long, b long, n long")
    args = [F.col(x) for x in ("both", "a", "b", "n")]
    r = c.select(stats.kappa(*args).alias("k"), stats.gwet_ac1(*args).alias("g"), stats.positive_agreement(*args[:3]).alias("p")).first()
    assert tuple(r) == pytest.approx((0.583333, 0.615385, 0.75), abs=1e-6)


def test_ranks(spark):
    rows = spark.createDataFrame([(x, True) for x in (3, 4, 4, 6)] + [(x, False) for x in (1, 2, 4, 5, 2)], "v int, y boolean")
    r = ranking.mann_whitney(rows, "v", "y").first()
    assert (r["u"], r["auc"]) == (15, 0.75)
    flipped = ranking.mann_whitney(rows.withColumn("v", -F.col("v")), "v", "y").first()
    assert flipped["auc"] == pytest.approx(1 - r["auc"])
    d = spark.createDataFrame([(x,) for x in (2, -1, 0, 3, -1, 4)], "d int")
    assert tuple(ranking.signed_ranks(d, "d").first())[:3] == (5, 12.0, 3.0)
    n = spark.range(12)
    assert [r["slice"] for r in ranking.order_slices(n.withColumn("g", F.lit(1)), ["g"], ["id"]).orderBy("id").collect()] == [0, 0, 1, 1, 2, 2, 2, 3, 3, 4, 4, 4]
    assert [r["run"] for r in spark.createDataFrame([(1, x) for x in (1, 2, 3, 7, 8, 20)], "g int, at int").transform(lambda t: ranking.longest_runs(t, ["g"], "at")).select(F.col("longest").alias("run")).collect()] == [3]
    p = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.2,)], "p double")
    assert sorted(r["q"] for r in ranking.benjamini_hochberg(p, "p").collect()) == pytest.approx([0.04, 0.053333, 0.053333, 0.2], abs=1e-6)
    line = spark.createDataFrame([(1, 2), (2, 4), (3, 9), (4, 9)], "x int, y int")
    assert ranking.spearman(line, "x", "y").first()["rho"] == pytest.approx(0.948683, abs=1e-6)


def test_regressions():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(4000), rng.normal(size=4000)])
    y = (rng.random(4000) < 1 / (1 + np.exp(-(x @ [0.3, -0.8])))).astype(float)
    w, se = plain_stats.logistic(x, y)
    assert w == pytest.approx([0.3, -0.8], abs=0.12) and (se < 0.06).all()
    _, clustered = plain_stats.logistic(x, y, np.arange(4000))
    assert clustered == pytest.approx(se, rel=0.1)
    diff = rng.normal(size=(3000, 1)) + 0.5
    w, _ = plain_stats.conditional_logit(diff)
    assert w[0] > 0
    t = x @ [1.0, 2.0] + rng.normal(size=4000)
    w, se, p = plain_stats.ols(x.T @ x, x.T @ t, float(t @ t), 4000)
    assert w == pytest.approx([1, 2], abs=0.1) and p[1] < 1e-6


def test_nulls_are_no_values(spark):
    rows = spark.createDataFrame([(1.0, True), (2.0, True), (None, True), (None, True), (3.0, False), (4.0, False), (9.0, None)], "v double, y boolean")
    r = ranking.mann_whitney(rows, "v", "y").first()
    assert (r["n1"], r["n0"], r["u"], r["ties"]) == (2, 2, 0.0, 0.0) and r["p"] == pytest.approx(0.2453, abs=1e-3)
    p = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.04), (3, None), (4, 0.2), (5, 0.04)], "k int, p double")
    got = {r["k"]: r["q"] for r in ranking.benjamini_hochberg(p, "p").collect()}
    assert got.pop(3) is None and [got[k] for k in sorted(got)] == pytest.approx(plain_stats.bh([0.01, 0.04, 0.04, 0.2, 0.04]))


@pytest.mark.parametrize("few", [0, 10**6])
def test_orders_in_ranges(spark, few):
    rng = np.random.default_rng(3)
    rows = [(int(g), int(k), int(v)) for k, (g, v) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(0, 50, 400)))]
    rows += [(None, 1000 + k, 1) for k in range(5)]
    table = spark.createDataFrame(rows, "g int, k int, v int").repartition(5)
    for by in ([], ["g"]):
        got = {r["k"]: r for r in order.numbered(order.running_sum(table, by, ["v", "k"], "v", "s", few), by, [F.desc("v"), "k"], "n", few).collect()}
        low = {r["k"]: r["m"] for r in order.least_from(table, by, ["k"], F.col("v"), "m", few).collect()}
        for g, k, v in rows:
            mine = [r for r in rows if not by or r[0] == g]
            assert got[k]["s"] == sum(r[2] for r in mine if (r[2], r[1]) < (v, k))
            assert got[k]["n"] == 1 + sum((-r[2], r[1]) < (-v, k) for r in mine)
            assert low[k] == min(r[2] for r in mine if r[1] >= k)


def test_rank_statistics_by_group(spark):
    rng = np.random.default_rng(7)
    rows = [(g, float(a), float(b)) for g, n in (("a", 30), ("b", 11), ("c", 2), ("d", 300)) for a, b in zip(rng.integers(0, 9, n), rng.integers(0, 9, n))] + [("a", None, 1.0)]
    table = spark.createDataFrame(rows, "g string, x double, y double")
    rho = {r["g"]: r for r in ranking.spearman(table, "x", "y", ["g"]).collect()}
    signed = {r["g"]: r for r in ranking.signed_ranks(table.withColumn("d", F.col("x") - F.col("y")), "d", ["g"]).collect()}
    for g in "abcd":
        one = table.where(F.col("g") == g)
        alone = ranking.spearman(one, "x", "y").first()
        assert (rho[g]["n"], rho[g]["rho"], rho[g]["p"]) == pytest.approx((alone["n"], alone["rho"], alone["p"]), nan_ok=True) or rho[g]["rho"] is None
        if rho[g]["n"] > 2:
            assert rho[g]["p"] == pytest.approx(plain_stats.spearman_p(rho[g]["rho"], rho[g]["n"]), abs=1e-9)
        assert tuple(signed[g])[1:] == pytest.approx(tuple(ranking.signed_ranks(one.withColumn("d", F.col("x") - F.col("y")), "d").first()))


def test_students_tail(spark):
    cases = [(t, df) for t in (0.0, 0.1, 1.0, 2.5, 8.0) for df in (1, 2, 5, 30, 400, 9_999)]
    table = spark.createDataFrame([(t * t, float(df)) for t, df in cases], "t double, df double")
    for (t, df), r in zip(cases, table.select(stats.student_tail(F.col("t"), F.col("df")).alias("p")).collect(), strict=True):
        assert r["p"] == pytest.approx(plain_stats.student_p(t, df), rel=1e-6, abs=1e-12)


def test_resampling(spark):
    rows = spark.range(400).select("id", (F.col("id") % 10).cast("double").alias("v"), (F.col("id") % 10 >= 5).alias("f"))
    a = replicates.bootstrap_mean(rows, "v", "id", 200).first()
    assert a["lower"] < 4.5 < a["upper"] and a["upper"] - a["lower"] < 1
    assert a == replicates.bootstrap_mean(rows.repartition(7), "v", "id", 200).first()
    r = replicates.permutation_difference(rows, "v", "f", "id", 99).first()
    assert r["observed"] == 5 and r["p"] == pytest.approx(0.01)


def test_reach():
    k = [0, 0, 1, 3]
    assert sum(1 - 0.9**x for x in k) / 4 == pytest.approx(0.09275)
    assert math.isclose(stats.normal_sf(0), 0.5)
