"""Queries of the pattern engine over the demo corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from tropelens.functions.patterns import PATTERNS, match_count, per_thousand, word_count
from tropelens.functions.stats import tail_sql, wilson
from tropelens.operators import corpus, ranking
from tropelens.plans.base import query, rounded
from tropelens.plans.demo import count_sql, demo, demo_sql, words_sql

IDS = [p.pattern_id for p in PATTERNS]
COUNTS = f"{demo_sql()}, counts AS (SELECT doc_id, lang, source, {words_sql()} AS words, " + ", ".join(f"{count_sql(i)} AS {i}" for i in IDS) + " FROM demo)"
LONG = f"{COUNTS}, long AS (" + " UNION ALL ".join(f"SELECT doc_id, lang, source, words, '{p.pattern_id}' AS pattern_id, {p.tier} AS tier, {p.pattern_id} AS n FROM counts" for p in PATTERNS) + ")"
AGG = """sum(n)::BIGINT AS total, sum((n > 0)::INT)::BIGINT AS files_with_hit, round(100.0::DOUBLE * sum((n > 0)::INT) / count(*), 6) AS hit_percent,
round(avg(CASE WHEN words > 0 THEN 1000.0::DOUBLE * n / words END), 6) AS mean_rate, round(median(CASE WHEN words > 0 THEN 1000.0::DOUBLE * n / words END), 6) AS median_rate"""


def counts(spark, d):
    return corpus.doc_counts(demo(spark, d).drop("v1"))


@query("pat_doc_counts", f"WITH {COUNTS} SELECT doc_id, words::BIGINT AS words, " + ", ".join(f"{i}::BIGINT AS {i}" for i in IDS) + " FROM counts")
def pat_doc_counts(spark, d):
    return counts(spark, d).drop("lang", "source")


@query("pat_summary", f"WITH {LONG} SELECT pattern_id, tier::BIGINT AS tier, {AGG} FROM long GROUP BY ALL")
def pat_summary(spark, d):
    return rounded(corpus.summary(counts(spark, d)))


@query("pat_summary_by_source", f"WITH {LONG} SELECT source, pattern_id, tier::BIGINT AS tier, {AGG} FROM long GROUP BY ALL")
def pat_summary_by_source(spark, d):
    return rounded(corpus.summary(counts(spark, d), ["source"]))


@query(
    "pat_compare",
    f"""WITH {LONG}, r AS (SELECT pattern_id, lang = 'en' AS en, 1000.0::DOUBLE * n / words AS rate FROM long WHERE words > 0),
    v AS (SELECT pattern_id, rate, sum(en::INT)::DOUBLE AS p, count(*)::DOUBLE AS t FROM r GROUP BY ALL),
    b AS (SELECT *, coalesce(sum(t - p) OVER (PARTITION BY pattern_id ORDER BY rate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v)
    , s AS (SELECT pattern_id, sum(p) AS n1, sum(t - p) AS n0, sum(p * (below + (t - p) / 2)) AS u, sum(t * t * t - t) AS ties FROM b GROUP BY pattern_id),
    z AS (SELECT *, sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS sd FROM s),
    k AS (SELECT *, CASE WHEN sd > 0 THEN (abs(u - n1 * n0 / 2) - 0.5) / sd END AS z2 FROM z)
    SELECT pattern_id, n1::BIGINT AS n1, n0::BIGINT AS n0, round(u, 6) AS u, round(u / (n1 * n0), 6) AS auc, round(CASE WHEN sd > 0 THEN least(1.0::DOUBLE, 2 * {tail_sql("z2")}) END, 6) AS p FROM k""",
)
def pat_compare(spark, d):
    """English against other documents: U, AUC and two-sided p of the rates, per pattern."""
    rows = corpus.by_pattern(counts(spark, d)).where("words > 0")
    rows = rows.select("pattern_id", per_thousand(F.col("n"), F.col("words")).alias("rate"), (F.col("lang") == "en").alias("en"))
    return rounded(ranking.mann_whitney(rows, "rate", "en", ["pattern_id"]).drop("ties", "p_greater", "p_less"))


@query("pat_presence_share", f"WITH {LONG} SELECT lang, pattern_id, count(*)::BIGINT AS docs, sum((n > 0)::INT)::BIGINT AS present FROM long GROUP BY ALL")
def pat_presence_share(spark, d):
    found = corpus.presence(demo(spark, d).drop("v1"))
    rows = found.select("lang", F.inline(F.array(*(F.struct(F.lit(i).alias("pattern_id"), F.col(i).alias("hit")) for i in IDS))))
    return rows.groupBy("lang", "pattern_id").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("hit").cast("long")).alias("present"))


PHRASE = f"{demo_sql()}, ph AS (SELECT doc_id, source, ((length(lower(text)) - length(replace(lower(text), 'rather than', ''))) / 11)::BIGINT AS phrase_n, len(regexp_extract_all(text, '\\S+'))::BIGINT AS space_words FROM demo)"


@query("pat_high_count", f"WITH {PHRASE} SELECT max(phrase_n) AS most, sum((phrase_n >= 5)::INT)::BIGINT AS at_least_5, sum((phrase_n >= 10)::INT)::BIGINT AS at_least_10, sum(space_words)::BIGINT AS words FROM ph")
def pat_high_count(spark, d):
    rows = corpus.phrase_counts(demo(spark, d).drop("v1"))
    n = F.col("phrase_n")
    return rows.agg(F.max(n).alias("most"), F.sum((n >= 5).cast("long")).alias("at_least_5"), F.sum((n >= 10).cast("long")).alias("at_least_10"), F.sum("space_words").alias("words"))


@query("pat_threshold_counts", f"WITH {PHRASE} SELECT t::BIGINT AS threshold, sum((phrase_n >= t)::INT)::BIGINT AS n FROM ph, (SELECT unnest([1, 2, 5, 10, 20]) AS t) GROUP BY t")
def pat_threshold_counts(spark, d):
    return rounded(corpus.at_least(corpus.phrase_counts(demo(spark, d).drop("v1")), "phrase_n", [1, 2, 5, 10, 20]))


@query("pat_top_docs", f"WITH {PHRASE} SELECT doc_id, phrase_n, round(1000.0::DOUBLE * phrase_n / space_words, 6) AS rate FROM ph ORDER BY phrase_n DESC, doc_id LIMIT 20")
def pat_top_docs(spark, d):
    rows = corpus.phrase_counts(demo(spark, d).drop("v1"))
    return rounded(rows.orderBy(F.desc("phrase_n"), "doc_id").limit(20).select("doc_id", "phrase_n", "rate"))


@query(
    "pat_rate_pair",
    f"""WITH {demo_sql()}, p AS (SELECT doc_id, {count_sql('rather_than', 'v1')}::BIGINT AS n_first, {count_sql('rather_than')}::BIGINT AS n_last, {words_sql('v1')}::BIGINT AS w_first, {words_sql()}::BIGINT AS w_last FROM demo)
    SELECT doc_id, n_first, n_last, w_first, w_last, round(1000.0::DOUBLE * n_last / w_last - 1000.0::DOUBLE * n_first / w_first, 6) AS difference FROM p WHERE w_first > 0 AND w_last > 0""",
)
def pat_rate_pair(spark, d):
    """Two versions of each document side by side: raw text first, demo text last."""
    both = demo(spark, d)
    rows = both.select(
        "doc_id",
        F.inline(F.array(F.struct(F.lit(1).alias("version"), F.col("v1").alias("body")), F.struct(F.lit(2).alias("version"), F.col("text").alias("body")))),
    )
    rows = rows.select("doc_id", "version", match_count(F.col("body"), PATTERNS[0]).alias("n"), word_count(F.col("body")).alias("w"))
    out = corpus.version_pairs(rows, "doc_id", "version", ["n", "w"]).where("first_w > 0 and last_w > 0")
    change = per_thousand(F.col("last_n"), F.col("last_w")) - per_thousand(F.col("first_n"), F.col("first_w"))
    return rounded(out.select("doc_id", F.col("first_n").alias("n_first"), F.col("last_n").alias("n_last"), F.col("first_w").alias("w_first"), F.col("last_w").alias("w_last"), change.alias("difference")))


@query(
    "pat_pair_direction",
    f"""WITH {demo_sql()}, c AS (SELECT lang, {count_sql('rather_than')} - {count_sql('instead_of')} AS diff FROM demo)
    SELECT lang, sum((diff > 0)::INT)::BIGINT AS up, sum((diff < 0)::INT)::BIGINT AS down, sum((diff = 0)::INT)::BIGINT AS same FROM c GROUP BY lang""",
)
def pat_pair_direction(spark, d):
    diff = F.col("rather_than") - F.col("instead_of")
    return counts(spark, d).groupBy("lang").agg(*(F.sum(x.cast("long")).alias(n) for n, x in (("up", diff > 0), ("down", diff < 0), ("same", diff == 0))))


@query(
    "pat_rate_gen",
    f"""WITH {COUNTS}, ids AS (SELECT c.doc_id FROM counts c JOIN labels l ON c.doc_id = l.doc_id JOIN (SELECT DISTINCT conv_id FROM conversations) v ON c.doc_id = v.conv_id WHERE words > 0 GROUP BY c.doc_id)
    SELECT c.doc_id, round(1000.0::DOUBLE * rather_than / words, 6) AS rate, source FROM counts c JOIN ids USING (doc_id)""",
)
def pat_rate_gen(spark, d):
    """Rates of the documents that every source of ids has."""
    c = counts(spark, d).where("words > 0")
    ids = corpus.in_all([c, spark.read.parquet(f"{d}/labels.parquet"), spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("doc_id"))], "doc_id")
    return rounded(c.join(ids, "doc_id", "left_semi").select("doc_id", per_thousand(F.col("rather_than"), F.col("words")).alias("rate"), "source"))


@query(
    "pat_density_other",
    f"""WITH {COUNTS} SELECT source, count(*)::BIGINT AS docs, sum((rather_than > 1)::INT)::BIGINT AS again, sum((rather_than > 0 AND instead_of + as_opposed_to + not_but + x_not_y + cleft_pivot + not_only_just_merely_but + not_to_say > 0)::INT)::BIGINT AS other
    FROM counts WHERE rather_than > 0 GROUP BY source""",
)
def pat_density_other(spark, d):
    """Of the documents with the phrase: those with it again, and those with another pattern (in_contrast is no such pattern)."""
    other = sum(F.col(i) for i in IDS if i not in ("rather_than", "in_contrast")) > 0
    return counts(spark, d).where("rather_than > 0").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum((F.col("rather_than") > 1).cast("long")).alias("again"), F.sum(other.cast("long")).alias("other"))


@query(
    "pat_precision_wilson",
    f"""WITH {LONG}, c AS (SELECT pattern_id, count(*)::DOUBLE AS n, sum((toxic = 0)::INT)::DOUBLE AS k FROM long JOIN labels USING (doc_id) WHERE n > 0 GROUP BY pattern_id)
    SELECT pattern_id, n::BIGINT AS n, k::BIGINT AS k, round(k / n, 6) AS precision_share,
    round((k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS lower, round((k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS upper FROM c""",
)
def pat_precision_wilson(spark, d):
    rows = corpus.by_pattern(counts(spark, d)).where("n > 0").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    out = rows.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("toxic") == 0).cast("long")).alias("k"))
    lower, upper = wilson(F.col("k"), F.col("n"))
    return rounded(out.select("pattern_id", "n", "k", (F.col("k") / F.col("n")).alias("precision_share"), lower.alias("lower"), upper.alias("upper")))


@query("pat_instances_counts", f"WITH {LONG} SELECT doc_id, pattern_id, n::BIGINT AS n FROM long WHERE n > 0")
def pat_instances_counts(spark, d):
    """Instances, extracted one by one, counted again by document and pattern."""
    return corpus.instances(demo(spark, d)).groupBy("doc_id", "pattern_id").agg(F.count(F.lit(1)).alias("n"))


@query("pat_instances")
def pat_instances(spark, d):
    return corpus.instances(demo(spark, d))


@query(
    "pat_substitution",
    f"""WITH {demo_sql()}, c AS (SELECT doc_id, {count_sql('rather_than')} - {count_sql('rather_than', 'v1')} AS rt, {count_sql('instead_of')} - {count_sql('instead_of', 'v1')} AS io FROM demo),
    r AS (SELECT rank() OVER (ORDER BY rt) + (count(*) OVER (PARTITION BY rt) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY io) + (count(*) OVER (PARTITION BY io) - 1) / 2.0::DOUBLE AS y FROM c)
    SELECT count(*)::BIGINT AS n, round(corr(x, y), 6) AS rho FROM r""",
)
def pat_substitution(spark, d):
    """Rank correlation of the changes of two phrases between versions."""
    rows = demo(spark, d).select(*((match_count(F.col("text"), p) - match_count(F.col("v1"), p)).alias(p.pattern_id) for p in PATTERNS[:2]))
    return rounded(ranking.spearman(rows, "rather_than", "instead_of").drop("p"))


@query("pat_registry", "SELECT * FROM (VALUES " + ", ".join(f"('{p.pattern_id}', {p.tier}::BIGINT)" for p in PATTERNS) + ") t(pattern_id, tier)")
def pat_registry(spark, d):
    from tropelens.functions.patterns import registry

    return registry(spark).select("pattern_id", F.col("tier").cast("long").alias("tier"))


@query(
    "pat_included",
    f"""WITH {LONG}, w AS (SELECT doc_id FROM documents WHERE lang = 'en' AND len(regexp_extract_all(text, '\\p{{L}}{{2,}}')) >= 200)
    SELECT pattern_id, count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM long JOIN w USING (doc_id) GROUP BY pattern_id""",
)
def pat_included(spark, d):
    """Totals over the corpus without excluded documents."""
    out = spark.read.parquet(f"{d}/documents.parquet")
    rows = corpus.by_pattern(corpus.without(counts(spark, d), corpus.excluded(out), ["doc_id"]))
    return rows.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total"))
