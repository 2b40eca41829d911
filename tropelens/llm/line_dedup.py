"""Line deduplication by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tropelens.llm.common import BROADCAST_BYTES, WHITE, site_key, written


def boilerplate_lines(docs: DataFrame, ratio: float, least_pages: int) -> DataFrame:
    """(__site, __text) -> (__site, bad array<string>): each site's lines that stand on more than `ratio` of its pages.

    Pages with the same text count as one page, in the line's count and in the site's total: else a group of copies
    would make all its own lines look like boilerplate. Counting goes page -> (site, line, page) -> (site, line), each
    step summed before it is dealt out again, so a line that a third of all pages carry never meets in one task.
    Lines are counted under a 64-bit hash, and only those found frequent are brought back as text; a site has at most
    (lines per page) / ratio of them, whatever its size.
    """
    pages = docs.select("__site", F.xxhash64("__text", F.length("__text")).alias("__page"), "__text")
    totals = pages.groupBy("__site", "__page").agg(F.lit(1).alias("one")).groupBy("__site").agg(F.count(F.lit(1)).alias("__pages"))
    lines = pages.select("__site", "__page", F.explode(F.array_distinct(F.transform(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(WHITE))))).alias("__line"))
    lines = lines.where(F.col("__line") != "")
    counts = (
        lines.groupBy("__site", F.xxhash64("__line").alias("__hash"), "__page")
        .agg(F.lit(1).alias("one"))
        .groupBy("__site", "__hash")
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") >= least_pages)
    )
    bad = counts.join(totals, "__site").where(F.col("__n") > ratio * F.col("__pages")).select("__site", "__hash")
    return bad.groupBy("__site").agg(F.collect_set("__hash").alias("__bad"))


def line_dedup(docs: DataFrame, text_col: str = "text", site_col: str = "source", ratio: float = 0.02, least_pages: int = 5) -> DataFrame:
    """docs with its text freed of boilerplate lines, and n_lines, n_dropped and share_dropped added.

    A line is boilerplate on its site if more than `ratio` of the site's pages, and at least `least_pages`, carry it. The
    ratio stands between the two kinds of lines there are: a line that belongs to its page stands on one page of a site (98 %
    of the pairs of line and site in the sample corpora do), one that the site repeats on a share of it. Lines are compared without white space at their ends. Blank lines are neither counted nor dropped. Every row stays,
    even with all lines dropped (its text is then empty). Null text stays null with zero lines; a null site is a site of
    its own; repeated rows each stay and count as one page. Columns of docs are kept; n_lines, n_dropped and
    share_dropped replace columns of these names.

    Equal shares: a line at exactly the ratio stays. Very long texts and lines are handled whole.

    The sites' line lists are broadcast if their summed size is proven small, else joined by site: both sides are then plain
    scans, so that Spark splits a site that holds a large share of the pages.
    """
    spark = docs.sparkSession
    keyed = docs.withColumn("__site", site_key(F.col(site_col)))
    bad = written(boilerplate_lines(keyed.select("__site", F.col(text_col).cast("string").alias("__text")).where(F.col("__text").isNotNull()), ratio, least_pages), "boilerplate")
    got = bad.agg(F.sum(F.size("__bad") * 8 + F.length("__site") + 32).alias("bytes")).first()["bytes"] or 0
    out = keyed.join(F.broadcast(bad) if got <= BROADCAST_BYTES else bad, "__site", "left")
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    out = out.withColumn("__lines", F.transform(lines, lambda x: F.struct(x.alias("x"), F.btrim(x, F.lit(WHITE)).alias("t"))))
    out = out.withColumn("__full", F.filter("__lines", lambda s: s["t"] != ""))
    out = out.withColumn("__kept", F.when(F.col("__bad").isNull(), F.col("__lines")).otherwise(F.filter("__lines", lambda s: (s["t"] == "") | ~F.array_contains(F.col("__bad"), F.xxhash64(s["t"])))))
    n, drop = F.size("__full").cast("long"), (F.size("__lines") - F.size("__kept")).cast("long")
    out = out.withColumns(
        {
            "n_lines": n,
            "n_dropped": drop,
            "share_dropped": F.when(n > 0, drop / n).otherwise(0.0),
            text_col: F.when(F.col(text_col).isNotNull(), F.when(drop == 0, F.col(text_col)).otherwise(F.array_join(F.col("__kept").getField("x"), "\n"))),
        }
    )
    return out.drop("__site", "__bad", "__lines", "__full", "__kept")


def query(spark, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_lines", "n_dropped", "text")


SQL = r"""
WITH d AS (SELECT doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
p AS (SELECT DISTINCT source, text FROM d WHERE text IS NOT NULL),
t AS (SELECT source, count(*) AS pages FROM p GROUP BY source),
c AS (SELECT source, line, count(DISTINCT text) AS n FROM (SELECT source, text, trim(unnest(string_split(text, chr(10))), E' \t\n\x0B\f\r') AS line FROM p) WHERE line <> '' GROUP BY source, line),
b AS (SELECT source, list(line) AS bad FROM c JOIN t USING (source) WHERE n >= 5 AND n > 0.02 * pages GROUP BY source),
k AS (SELECT doc_id, text, ls, list_filter(ls, lambda x: trim(x, E' \t\n\x0B\f\r') = '' OR NOT list_contains(coalesce(bad, []), trim(x, E' \t\n\x0B\f\r'))) AS kept FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, len(list_filter(ls, lambda x: trim(x, E' \t\n\x0B\f\r') <> ''))::BIGINT AS n_lines, (len(ls) - len(kept))::BIGINT AS n_dropped,
  CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text FROM k
"""
