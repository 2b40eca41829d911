"""Host-level quality rules: DataFrame functions only.

Each text is measured inside its own row, with array functions, so whole texts never move. What does move
is a narrow row per document, and of that only sums per host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tropelens.llm.common import WHITE, site_key, white_words, written

SYMBOLS = "#*$%&|<>"


def with_measures(docs: DataFrame, text: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words to rows that have a text column.

    The words of repeated 3-word windows are found by sorting a text's windows together with their positions:
    equal windows are then neighbours, whatever the length of the text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    docs = docs.withColumns(
        {
            "__words": white_words(F.col(text)),
            "__lines": lines,
            "word_chars": F.length(F.translate(body, WHITE, "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        }
    )
    words, n = F.col("__words"), F.size("__words")
    trios = F.slice(
        F.arrays_zip(
            words.alias("a"), F.slice(words, F.lit(2), n).alias("b"), F.slice(words, F.lit(3), n).alias("c"), F.sequence(F.lit(0), n - 1).alias("at")
        ),
        F.lit(1),
        n - 2,
    )
    docs = docs.withColumns(
        {
            "n_words": n.cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__trios": F.when(n >= 3, F.sort_array(trios)),
        }
    )
    trios = F.col("__trios")

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["c"] == y["c"]) & (x["b"] == y["b"]) & (x["a"] == y["a"]), F.lit(False))

    docs = docs.withColumn("__twice", F.filter(trios, lambda x, k: same(x, F.get(trios, k - 1)) | same(x, F.get(trios, k + 1))))
    docs = docs.withColumn("__at", F.col("__twice").getField("at"))
    at = F.col("__at")
    covered = F.array_distinct(F.concat(at, F.transform(at, lambda i: i + 1), F.transform(at, lambda i: i + 2)))
    docs = docs.withColumn("n_repeat_words", F.coalesce(F.size(covered), F.lit(0)).cast("long"))
    return docs.drop("__words", "__lines", "__trios", "__twice", "__at")


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_symbol_percent: int = 25,
    max_dup_line_percent: int = 30,
    min_dup_lines: int = 3,
    blocked_rate: float = 0.5,
    watched_rate: float = 0.05,
) -> DataFrame:
    """One row per document: measures, rule failures, the host's shrunk failure rate and the verdict.

    A document fails a rule of its own (few words, repeated windows, symbols, repeated lines). Failures are counted
    per host; a beta distribution fitted to all hosts' rates by moments is the prior, and the posterior mean is the
    host's rate, so a host with two pages isn't condemned for one of them. Hosts over blocked_rate lose every page;
    hosts over watched_rate lose the pages that fail; elsewhere only the base rules decide.

    Null text: no words. Null host: a host of its own. Repeated rows: each is judged and returned. An empty table
    gives an empty result. Other columns of docs are ignored, so their names can't clash.
    """
    base = docs.select(F.col(id_col).alias(id_col), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("__text"))
    measured = with_measures(base, "__text").drop("__text")
    n = F.col("n_words")
    few, repeats = n < min_words, 100 * F.col("n_repeat_words") > max_repeat_percent * n
    symbols, dup = 100 * F.col("n_symbols") > max_symbol_percent * n, (F.col("n_dup_lines") >= min_dup_lines) & (100 * F.col("n_dup_lines") > max_dup_line_percent * F.col("n_lines"))
    measured = measured.withColumns({"base_failed": few | repeats, "n_failed": sum(x.cast("int") for x in (few, repeats, symbols, dup))})
    measured = written(measured.withColumn("__host", site_key(F.col("host"))), "quality")

    hosts = measured.groupBy("__host").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("n_failed") > 0).cast("long")).alias("k"))
    p = F.col("k") / F.col("n")
    got = hosts.agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.avg(p).alias("mean"), F.var_pop(p).alias("var")).first()
    alpha, beta = beta_prior(got["k"], got["n"], got["mean"], got["var"])
    verdicts = hosts.select("__host", F.col("n").alias("host_docs"), F.col("k").alias("host_failures"), ((F.col("k") + alpha) / (F.col("n") + (alpha + beta))).alias("host_rate"))
    out = measured.join(verdicts, "__host", "left").drop("__host")
    rate = F.col("host_rate")
    kept = ~F.col("base_failed") & (rate <= blocked_rate) & ((F.col("n_failed") == 0) | (rate <= watched_rate))
    return out.withColumn("kept", kept)


def beta_prior(k: int | None, n: int | None, mean: float | None, var: float | None, least: float = 2.0, most: float = 1000.0) -> tuple[float, float]:
    """alpha and beta of the hosts' failure rates by moments; the strength alpha + beta stays within least and most."""
    if not n:
        return 1.0, 1.0
    rate = (k + 1.0) / (n + 2.0)
    spread = mean * (1 - mean)
    strength = most if not var or spread <= 0 else min(most, max(least, spread / var - 1))
    return rate * strength, (1 - rate) * strength


def query(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w0 AS (SELECT rid, doc_id, source, t, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM d),
tok AS (SELECT rid, unnest(w) AS w, unnest(range(len(w))) AS i FROM w0),
tri AS (SELECT rid, i, w AS a, lead(w) OVER q AS b, lead(w, 2) OVER q AS c FROM tok WINDOW q AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri WHERE c IS NOT NULL) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + s) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS s) GROUP BY rid),
l AS (SELECT rid, count(*) AS n, count(DISTINCT line) AS m FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]') GROUP BY rid),
m AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[ \t\n\x0B\f\r]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(l.n, 0) AS n_lines,
  coalesce(l.n - l.m, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w0 LEFT JOIN l USING (rid) LEFT JOIN rep USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  (n_words < 50)::INT + (100 * n_repeat_words > 50 * n_words)::INT + (100 * n_symbols > 25 * n_words)::INT + (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)::INT AS n_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (n_failed > 0)::DOUBLE AS k FROM f GROUP BY source),
p AS (SELECT (sum(k) + 1) / (sum(n) + 2) AS rate, avg(k / n) * (1 - avg(k / n)) AS spread, var_pop(k / n) AS v FROM h),
s AS (SELECT rate, CASE WHEN v = 0 OR spread <= 0 THEN 1000.0::DOUBLE ELSE least(1000.0::DOUBLE, greatest(2.0::DOUBLE, spread / v - 1)) END AS strength FROM p),
r AS (SELECT source, (k + rate * strength) / (n + rate * strength + (1 - rate) * strength) AS host_rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND host_rate <= 0.5 AND (n_failed = 0 OR host_rate <= 0.05) AS kept
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""
