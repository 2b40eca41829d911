"""Queries over labels, events and the star tables: agreement, order, ranks, rollups, joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tropelens.functions import stats
from tropelens.operators import models, ranking, sampling
from tropelens.plans.base import query, rounded
from tropelens.plans.demo import table

WILSON = "round((k / n + 3.8416 / (2 * n) {s} 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6)"


def labelled(spark, d):
    """Labels with their documents' strata: rater A finds toxic = 1, rater B finds quality = 0."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, d, "labels").join(docs, "doc_id").withColumns({"a": (F.col("toxic") == 1).cast("long"), "b": (F.col("quality") == 0).cast("long")})


LABELLED = "l AS (SELECT l.doc_id, lang, source, n_chars, (toxic = 1)::BIGINT AS a, (quality = 0)::BIGINT AS b FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


@query("label_rates_wilson", f"WITH {LABELLED}, c AS (SELECT source, count(*)::DOUBLE AS n, sum(a)::DOUBLE AS k FROM l GROUP BY source) SELECT source, n::BIGINT AS n, k::BIGINT AS k, {WILSON.format(s='-')} AS lower, {WILSON.format(s='+')} AS upper FROM c")
def label_rates_wilson(spark, d):
    out = labelled(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("k"))
    lower, upper = stats.wilson(F.col("k"), F.col("n"))
    return rounded(out.select("source", "n", "k", lower.alias("lower"), upper.alias("upper")))


@query("label_rates_rollup", f"WITH {LABELLED} SELECT lang, count(*)::BIGINT AS n, sum(a)::BIGINT AS k, round(avg(a), 6) AS rate FROM l GROUP BY ROLLUP (lang)")
def label_rates_rollup(spark, d):
    return rounded(labelled(spark, d).rollup("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("k"), F.avg("a").alias("rate")))


@query("label_crosstab", f"WITH {LABELLED} SELECT a, sum((b = 0)::INT)::BIGINT AS b0, sum((b = 1)::INT)::BIGINT AS b1 FROM l GROUP BY a")
def label_crosstab(spark, d):
    out = labelled(spark, d).groupBy("a").pivot("b", [0, 1]).count()
    return out.select("a", F.coalesce("0", F.lit(0)).alias("b0"), F.coalesce("1", F.lit(0)).alias("b1"))


AGREE = f"""WITH {LABELLED}, c AS (SELECT lang, count(*)::DOUBLE AS n, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b, sum(a * b)::DOUBLE AS ab FROM l GROUP BY lang),
p AS (SELECT *, (n - a - b + 2 * ab) / n AS po, (a * b + (n - a) * (n - b)) / (n * n) AS pe, 2 * ((a + b) / (2 * n)) * (1 - (a + b) / (2 * n)) AS pg FROM c)
SELECT lang, n::BIGINT AS n, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa, round(CASE WHEN pg < 1 THEN (po - pg) / (1 - pg) END, 6) AS ac1, round(CASE WHEN a + b > 0 THEN 2 * ab / (a + b) END, 6) AS positive_agreement FROM p"""


@query("kappa_ac1", AGREE)
def kappa_ac1(spark, d):
    c = labelled(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("a") * F.col("b")).alias("both"))
    both, a, b, n = (F.col(x) for x in ("both", "a", "b", "n"))
    return rounded(c.select("lang", "n", stats.kappa(both, a, b, n).alias("kappa"), stats.gwet_ac1(both, a, b, n).alias("ac1"), stats.positive_agreement(both, a, b).alias("positive_agreement")))


@query("either_band", f"WITH {LABELLED} SELECT source, count(*)::BIGINT AS n, round(avg((a = 1 AND b = 1)::INT), 6) AS lower, round(avg((a = 1 OR b = 1)::INT), 6) AS upper FROM l GROUP BY source")
def either_band(spark, d):
    both, either = (F.col("a") * F.col("b")), F.greatest("a", "b")
    return rounded(labelled(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg(both).alias("lower"), F.avg(either).alias("upper")))


@query("label_precision_recall", f"WITH {LABELLED} SELECT source, round(sum(a * b)::DOUBLE / nullif(sum(b), 0), 6) AS precision_share, round(sum(a * b)::DOUBLE / nullif(sum(a), 0), 6) AS recall FROM l GROUP BY source")
def label_precision_recall(spark, d):
    hit = F.sum(F.col("a") * F.col("b"))
    return rounded(labelled(spark, d).groupBy("source").agg(F.try_divide(hit.cast("double"), F.sum("b")).alias("precision_share"), F.try_divide(hit.cast("double"), F.sum("a")).alias("recall")))


@query(
    "label_overlap_groups",
    f"""WITH {LABELLED} SELECT grp, count(*)::BIGINT AS n, sum(a)::BIGINT AS k FROM (SELECT unnest(list_filter(['all', lang, source, CASE WHEN n_chars > 3500 THEN 'long' END], lambda x: x IS NOT NULL)) AS grp, a FROM l) GROUP BY grp""",
)
def label_overlap_groups(spark, d):
    """A document counts in each of its overlapping groups."""
    groups = F.array_compact(F.array(F.lit("all"), "lang", "source", F.when(F.col("n_chars") > 3500, "long")))
    return labelled(spark, d).select(F.explode(groups).alias("grp"), "a").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("k"))


@query("discordant_pairs", f"WITH {LABELLED} SELECT sum((a = 1 AND b = 0)::INT)::BIGINT AS only_a, sum((a = 0 AND b = 1)::INT)::BIGINT AS only_b FROM l")
def discordant_pairs(spark, d):
    return labelled(spark, d).agg(F.sum(F.col("a") * (1 - F.col("b"))).alias("only_a"), F.sum((1 - F.col("a")) * F.col("b")).alias("only_b"))


@query(
    "cmh_statistic",
    f"""WITH {LABELLED}, s AS (SELECT lang, count(*)::DOUBLE AS n, sum(a)::DOUBLE AS r, sum(b)::DOUBLE AS c, sum(a * b)::DOUBLE AS x FROM l GROUP BY lang HAVING count(*) > 1),
    t AS (SELECT sum(x - r * c / n) AS num, sum(r * (n - r) * c * (n - c) / (n * n * (n - 1))) AS var FROM s) SELECT round(pow(greatest(abs(num) - 0.5, 0), 2) / var, 6) AS chi2 FROM t""",
)
def cmh_statistic(spark, d):
    s = labelled(spark, d).groupBy("lang").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("a").alias("r"), F.sum("b").alias("c"), F.sum(F.col("a") * F.col("b")).alias("x")).where("n > 1")
    t = s.agg(F.sum(F.expr("x - r * c / n")).alias("num"), F.sum(F.expr("r * (n - r) * c * (n - c) / (n * n * (n - 1))")).alias("var"))
    return rounded(t.select((F.pow(F.greatest(F.abs("num") - 0.5, F.lit(0.0)), 2) / F.col("var")).alias("chi2")))


@query(
    "label_fisher",
)
def label_fisher(spark, d):
    """Fisher's exact test of A against B per language: counts in Spark, p from four numbers."""
    c = labelled(spark, d).groupBy("lang").agg(*(F.sum(x.cast("long")).alias(n) for n, x in (("w", (F.col("a") == 1) & (F.col("b") == 1)), ("x", (F.col("a") == 1) & (F.col("b") == 0)), ("y", (F.col("a") == 0) & (F.col("b") == 1)), ("z", (F.col("a") == 0) & (F.col("b") == 0)))))
    rows = [(r["lang"], r["w"], r["x"], r["y"], r["z"], round(stats.fisher_two_sided(r["w"], r["x"], r["y"], r["z"]), 6)) for r in c.orderBy("lang").collect()]
    return spark.createDataFrame(rows, "lang string, a_and_b long, only_a long, only_b long, neither long, p double")


def terms(spark, names, fit):
    return spark.createDataFrame([(n, round(float(a), 6), round(float(b), 6)) for n, a, b in zip(names, *fit, strict=True)], "term string, coefficient double, error double")


@query("label_logistic")
def label_logistic(spark, d):
    """Logistic regression of A on length and B, errors clustered by source. Spark adds up gradient and Hessian each step."""
    rows = labelled(spark, d).select("a", "b", (F.log1p("n_chars") / 10).alias("size"), "source")
    return terms(spark, ("intercept", "b", "size"), models.logistic(rows, "a", ["b", "size"], "source", ridge=1e-8))


@query("label_interaction")
def label_interaction(spark, d):
    """The same with the product of length and B: does one effect depend on the other?"""
    rows = labelled(spark, d).select("a", "b", (F.log1p("n_chars") / 10).alias("size")).withColumn("both", F.col("b") * F.col("size"))
    return terms(spark, ("intercept", "b", "size", "both"), models.logistic(rows, "a", ["b", "size", "both"], ridge=1e-8))


@query("preference_logit")
def preference_logit(spark, d):
    """Conditional logit: what a conversation's chosen (later) answer has more of than the rejected one before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").where("role = 'assistant'").withColumn("nxt", F.lead("text").over(w)).where("nxt is not null and text is not null")
    rows = t.select(((F.length("nxt") - F.length("text")) / 100.0).alias("length"), (F.regexp_count("nxt", F.lit(",")) - F.regexp_count("text", F.lit(","))).alias("commas"))
    return terms(spark, ("length", "commas"), models.conditional_logit(rows, ["length", "commas"]))


@query(
    "label_quintiles",
    """WITH e AS (SELECT user_id, event_type, row_number() OVER q AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW q AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT (ceil(5 * pos / n::DOUBLE) - 1)::BIGINT AS slice, count(*)::BIGINT AS n, sum((event_type = 'error')::INT)::BIGINT AS k FROM e GROUP BY 1""",
)
def label_quintiles(spark, d):
    rows = ranking.order_slices(table(spark, d, "events"), ["user_id"], ["ts", "event_id"])
    return rows.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("event_type") == "error").cast("long")).alias("k"))


@query(
    "label_prev_window",
    """WITH e AS (SELECT user_id, (event_type = 'error')::INT AS err, coalesce(max((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS before FROM events)
    SELECT before::BIGINT AS before, count(*)::BIGINT AS n, sum(err)::BIGINT AS k FROM e GROUP BY before""",
)
def label_prev_window(spark, d):
    rows = ranking.any_before(table(spark, d, "events").withColumn("err", F.col("event_type") == "error"), ["user_id"], ["ts", "event_id"], "err", 5)
    return rounded(rows.groupBy("before").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("err").cast("long")).alias("k")))


@query("latest_wins", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, round(arg_max(value, (ts, event_id)), 6) AS value FROM events GROUP BY ALL")
def latest_wins(spark, d):
    return rounded(ranking.latest(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"]))


@query("label_repeats", "WITH e AS (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) SELECT event_type, nxt, count(*)::BIGINT AS n FROM e WHERE nxt IS NOT NULL GROUP BY ALL")
def label_repeats(spark, d):
    """Transitions from each label to the same rater's next."""
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").withColumn("nxt", nxt).where("nxt is not null").groupBy("event_type", "nxt").agg(F.count(F.lit(1)).alias("n"))


@query(
    "mwu_auc",
    f"""WITH {LABELLED}, v AS (SELECT n_chars, sum(a)::DOUBLE AS p, count(*)::DOUBLE AS t FROM l GROUP BY n_chars), b AS (SELECT *, coalesce(sum(t - p) OVER (ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v)
    , s AS (SELECT sum(p) AS n1, sum(t - p) AS n0, sum(p * (below + (t - p) / 2)) AS u, sum(t * t * t - t) AS ties FROM b),
    z AS (SELECT *, u - n1 * n0 / 2 AS o, sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS sd FROM s),
    k AS (SELECT *, (abs(o) - 0.5) / sd AS z2, (o - 0.5) / sd AS zg, (-o - 0.5) / sd AS zl FROM z)
    SELECT n1::BIGINT AS n1, n0::BIGINT AS n0, round(u, 6) AS u, round(ties, 6) AS ties, round(u / (n1 * n0), 6) AS auc, round(least(1.0::DOUBLE, 2 * {stats.tail_sql("z2")}), 6) AS p, round({stats.tail_sql("zg")}, 6) AS p_greater, round({stats.tail_sql("zl")}, 6) AS p_less FROM k""",
)
def mwu_auc(spark, d):
    return rounded(ranking.mann_whitney(labelled(spark, d), "n_chars", "a"))


@query(
    "wilcoxon_wplus",
    """WITH x AS (SELECT l_extendedprice / l_quantity - 900 - l_partkey % 100 AS d FROM lineitem), y AS (SELECT round(d, 4) AS d, abs(round(d, 4)) AS m FROM x WHERE round(d, 4) <> 0),
    r AS (SELECT d, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0::DOUBLE AS rk FROM y)
    , g AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT count(*)::DOUBLE AS t FROM y GROUP BY m)),
    w AS (SELECT count(*)::DOUBLE AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN rk ELSE 0 END) AS w_minus FROM r),
    z AS (SELECT w.*, abs(w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM w, g)
    SELECT n::BIGINT AS n, round(w_plus, 6) AS w_plus, round(w_minus, 6) AS w_minus, round(least(1.0::DOUBLE, 2 * """ + stats.tail_sql("z") + """), 6) AS p FROM z""",
)
def wilcoxon_wplus(spark, d):
    rows = table(spark, d, "lineitem").select(F.expr("round(l_extendedprice / l_quantity - 900 - l_partkey % 100, 4)").alias("d"))
    return rounded(ranking.signed_ranks(rows, "d"))


RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"


@query("spearman_rho", f"""WITH r AS (SELECT {RANK.format(c='l_quantity')} AS x, {RANK.format(c='l_extendedprice')} AS y FROM lineitem), c AS (SELECT count(*) AS n, corr(x, y) AS rho FROM r), t AS (SELECT n, rho, rho * rho * (n - 2) / (1 - rho * rho) AS t2 FROM c)
    SELECT n::BIGINT AS n, round(rho, 6) AS rho, round(2 * {stats.tail_sql('((1 - 1 / (4.0::DOUBLE * (n - 2))) * sqrt(t2 / (1 + t2 / (2.0::DOUBLE * (n - 2)))))')}, 6) AS p FROM t""")
def spearman_rho(spark, d):
    return rounded(ranking.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


@query(
    "bh_qvalues",
    """WITH p AS (SELECT p_partkey, (p_retailprice % 100) / 100 AS p FROM part), r AS (SELECT *, row_number() OVER (ORDER BY p, p_partkey) AS rk, count(*) OVER () AS m FROM p)
    SELECT p_partkey, round(p, 6) AS p, round(least(1.0::DOUBLE, min(p * m / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r""",
)
def bh_qvalues(spark, d):
    return rounded(ranking.benjamini_hochberg(table(spark, d, "part").select("p_partkey", F.expr("(p_retailprice % 100) / 100").alias("p")), "p"))


@query(
    "reach_model",
    """WITH k AS (SELECT d.source, d.doc_id, count(l.doc_id) AS k FROM documents d LEFT JOIN labels l ON l.toxic = 1 AND d.doc_id = l.doc_id GROUP BY ALL)
    SELECT source, round(avg(1 - pow(0.9::DOUBLE, k)), 6) AS reach, round(0.1::DOUBLE * avg(k), 6) AS expected FROM k GROUP BY source""",
)
def reach_model(spark, d):
    """Chance to meet at least one annoying use in a document, documents without any included."""
    k = table(spark, d, "labels").where("toxic = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
    rows = table(spark, d, "documents").select("doc_id", "source").join(k, "doc_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return rounded(rows.groupBy("source").agg(F.avg(1 - F.pow(F.lit(0.9), F.col("k"))).alias("reach"), (0.1 * F.avg("k")).alias("expected")))


@query(
    "cluster_pairs",
    "WITH s AS (SELECT l_suppkey, sum((l_returnflag = 'R')::INT) AS s FROM lineitem GROUP BY l_suppkey) SELECT (sum(s * (s - 1)) / 2)::BIGINT AS pairs FROM s",
)
def cluster_pairs(spark, d):
    """Pairs of flagged rows of the same group: the observed statistic of the clustering test."""
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum((F.col("l_returnflag") == "R").cast("long")).alias("s"))
    return s.agg((F.sum(F.col("s") * (F.col("s") - 1)) / 2).cast("long").alias("pairs"))


@query(
    "same_group_other",
    "WITH x AS (SELECT o_custkey, o_orderkey, (o_orderstatus = 'F')::INT AS f FROM orders), w AS (SELECT o_orderkey, sum(f) OVER (PARTITION BY o_custkey) - f > 0 AS other FROM x) SELECT other, count(*)::BIGINT AS n FROM w GROUP BY other",
)
def same_group_other(spark, d):
    """Whether another row of the same group has the property: a window, no self join."""
    flag = (F.col("o_orderstatus") == "F").cast("int")
    other = (F.sum(flag).over(Window.partitionBy("o_custkey")) - flag) > 0
    return table(spark, d, "orders").select(other.alias("other")).groupBy("other").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fe_ols",
    """WITH x AS (SELECT l_quantity - avg(l_quantity) OVER (PARTITION BY l_orderkey) AS x, l_discount - avg(l_discount) OVER (PARTITION BY l_orderkey) AS y FROM lineitem) SELECT count(*)::BIGINT AS n, round(sum(x * y) / sum(x * x), 6) AS slope FROM x""",
)
def fe_ols(spark, d):
    """One-regressor regression within groups."""
    w = Window.partitionBy("l_orderkey")
    rows = table(spark, d, "lineitem").select((F.col("l_quantity") - F.avg("l_quantity").over(w)).alias("x"), (F.col("l_discount") - F.avg("l_discount").over(w)).alias("y"))
    return rounded(rows.agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))).alias("slope")))


@query("ols_slope", "SELECT count(*)::BIGINT AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem")
def ols_slope(spark, d):
    out = table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("l_extendedprice", "l_quantity").alias("slope"), F.regr_intercept("l_extendedprice", "l_quantity").alias("intercept"))
    return out.select("n", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query("hist_round", "SELECT round_even(l_quantity / 4, 0)::BIGINT AS bucket, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def hist_round(spark, d):
    """Halves go to the even number."""
    return table(spark, d, "lineitem").groupBy(F.bround(F.col("l_quantity") / 4).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("min_group", "SELECT l_shipdate::DATE::VARCHAR AS day, count(*)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 20")
def min_group(spark, d):
    return table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n")).where("n >= 20")


@query("length_bands", "SELECT lang, sum((n_chars BETWEEN 500 AND 3500)::INT)::BIGINT AS short, sum((n_chars > 3500)::INT)::BIGINT AS long, sum((n_chars >= 3000)::INT)::BIGINT AS large FROM documents GROUP BY lang")
def length_bands(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").groupBy("lang").agg(*(F.sum(x.cast("long")).alias(k) for k, x in (("short", n.between(500, 3500)), ("long", n > 3500), ("large", n >= 3000))))


@query("numeric_try", "SELECT count(*)::BIGINT AS n, count(TRY_CAST(props->>'$.k' AS INT))::BIGINT AS usable, sum(TRY_CAST(props->>'$.k' AS INT))::BIGINT AS total FROM events")
def numeric_try(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, d, "events").agg(F.count(F.lit(1)).alias("n"), F.count(k).alias("usable"), F.sum(k).alias("total"))


@query("cost_table", "WITH p AS (SELECT * FROM (VALUES ('click', 0.5::DOUBLE), ('view', 0.1::DOUBLE)) t(event_type, price)) SELECT e.event_type, count(*)::BIGINT AS n, round(sum(value * coalesce(price, 0)), 4) AS cost FROM events e LEFT JOIN p ON e.event_type = p.event_type GROUP BY e.event_type")
def cost_table(spark, d):
    """Usage times price; unknown kinds cost nothing."""
    prices = spark.createDataFrame([("click", 0.5), ("view", 0.1)], "event_type string, price double")
    rows = table(spark, d, "events").join(prices, "event_type", "left")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value") * F.coalesce("price", F.lit(0.0))), 4).alias("cost"))


@query("cross_coders", "WITH x AS (SELECT DISTINCT event_type FROM events) SELECT a.event_type AS first, b.event_type AS second FROM x a JOIN x b ON a.event_type < b.event_type")
def cross_coders(spark, d):
    kinds = table(spark, d, "events").select("event_type").distinct()
    return kinds.select(F.col("event_type").alias("first")).join(kinds.select(F.col("event_type").alias("second")), F.col("first") < F.col("second"))


ORDER = "md5('13:' || {k}::VARCHAR)"


@query("sample_stratified", f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {ORDER.format(k='doc_id')}, doc_id) AS r FROM documents) WHERE r <= 25")
def sample_stratified(spark, d):
    return sampling.stratified(table(spark, d, "documents").select("doc_id", "lang"), "lang", ["doc_id"], 25)


@query("sample_folds", f"SELECT doc_id, toxic::BIGINT AS toxic, ((row_number() OVER (PARTITION BY toxic ORDER BY {ORDER.format(k='doc_id')}, doc_id) - 1) % 5)::BIGINT AS fold FROM labels")
def sample_folds(spark, d):
    return rounded(sampling.folds(table(spark, d, "labels").select("doc_id", "toxic"), "toxic", ["doc_id"], 5))


@query("sample_capped", f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {ORDER.format(k='doc_id')}, doc_id) AS r FROM documents) WHERE r <= 3 ORDER BY r, {ORDER.format(k='source')}, source LIMIT 45")
def sample_capped(spark, d):
    return sampling.capped(table(spark, d, "documents").select("doc_id", "source"), "source", ["doc_id"], 3, 45)


@query(
    "sample_spaced",
    "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id, source FROM r WHERE n <= 7 OR p IN (SELECT floor(i * n / 7.0::DOUBLE)::BIGINT FROM (SELECT unnest(range(7)) AS i))",
)
def sample_spaced(spark, d):
    return sampling.spaced(table(spark, d, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 7)


@query("sample_even_split", f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {ORDER.format(k='doc_id')}, doc_id) AS r FROM documents WHERE lang IN ('en', 'fr', 'de')) WHERE r <= CASE lang WHEN 'en' THEN 11 WHEN 'fr' THEN 11 ELSE 10 END")
def sample_even_split(spark, d):
    return sampling.even_split(table(spark, d, "documents").select("doc_id", "lang"), "lang", ["doc_id"], 32, ["en", "fr", "de"])


@query("budget_stop", "WITH r AS (SELECT doc_id, source, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) SELECT doc_id, source FROM r WHERE before < 20000")
def budget_stop(spark, d):
    return ranking.within_budget(table(spark, d, "documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], "n_chars", 20_000).select("doc_id", "source")


@query("first_wins", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def first_wins(spark, d):
    return sampling.first_of_key(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query(
    "star_revenue",
    """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*)::BIGINT AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def star_revenue(spark, d):
    """Joins along the star, only the columns used; the small tables are broadcast by Spark."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))
