"""Mixing sources to target weights by systematic sampling: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tropelens.llm.common import partitions, site_key, white_words, written


def size_class(size: Column) -> Column:
    """Grows with size in steps of about an eighth; integers only, so that any engine gets the same."""
    bits = F.length(F.bin(size))
    return bits * 16 + F.floor(size / F.pow(F.lit(2.0), F.greatest(bits - 4, F.lit(0)))).cast("int")


def targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """(source_key, source, source_size) -> the same with target; one row per source.

    Targets share the whole size by weight and stop at `most` times the source's size; the excess goes to the others
    by weight. That ends where target = min(most * size, level * weight), with one level for all: sources are taken
    in the order of size to weight, the first ones are full, and the level is what is left over the weights left.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    full = Window.orderBy("__ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = sizes.withColumn("__weight", weight).withColumn("__cap", most * F.col("source_size"))
    rows = rows.withColumn("__ratio", F.col("__cap") / F.col("__weight")).withColumn("__total", F.sum("source_size").over(all_rows).cast("double"))
    left = F.col("__total") - F.coalesce(F.sum("__cap").over(full), F.lit(0.0))
    rows = rows.withColumn("__level", left / (F.sum("__weight").over(all_rows) - F.coalesce(F.sum("__weight").over(full), F.lit(0.0))))
    rows = rows.withColumn("__level", F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__level"))).over(all_rows)["__level"])
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("__cap"), F.coalesce(F.col("__level") * F.col("__weight"), F.col("__cap"))))
    return rows.select("source_key", "source", "source_size", target.alias("target"))


def unit(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the seed and a key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    most: float = 3.0,
    seed: int = 7,
    bin_rows: int = 1_000_000,
) -> DataFrame:
    """One row per document: id, source, size (words), source_size, target, copies and taken = copies * size.

    Within a source a document's expected copies are target / source_size. Documents stand in the order of size class,
    hash of the id, size, hash of the text and id; with the prefix sums c of the expected copies and a random offset u of
    the source, a document is emitted once for each integer that c + u passes. The order keeps every stretch of sizes near
    its share, and leaves only rows apart that are equal in id, size and text: which of those is taken makes no difference.

    No window ever holds a whole source: rows are dealt in ranges of that order, of about bin_rows each, and numbered
    within their range; the ranges' counts are summed up beside that. A row number is the last part of the order, so that
    ranges split repeated rows and rows with null or equal ids as well.

    Null text: size 0. Null source: a source of its own, named last. Null ids hash as an empty string. Repeated rows
    each count. A source without words has target 0. Extra columns are ignored. Reruns agree: the seed fixes all.
    """
    text = F.col(text_col).cast("string")
    narrow = docs.select(
        F.col(id_col).alias("__id"),
        F.col(source_col).cast("string").alias("source"),
        F.size(white_words(text)).cast("long").alias("size"),
        F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 16).alias("__text"),
    )
    narrow = narrow.withColumns(
        {"source_key": site_key(F.col("source")), "__class": size_class(F.col("size")), "__hash": F.md5(F.coalesce(F.col("__id").cast("string"), F.lit("")).cast("binary"))}
    )
    narrow = written(narrow, "sizes")
    order = ["__class", "__hash", "size", "__text", F.col("__id").asc_nulls_first(), "__row"]
    ranges = max(partitions(docs.sparkSession), -(-narrow.count() // bin_rows))
    dealt = narrow.withColumn("__row", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(ranges, "source_key", *order)
    dealt = written(dealt.withColumn("__bin", F.spark_partition_id()), "dealt")

    bins = dealt.groupBy("source_key", "source", "__bin").agg(F.count(F.lit(1)).alias("__n"), F.sum("size").alias("__size"))
    sizes = bins.groupBy("source_key", "source").agg(F.sum("__size").alias("source_size"))
    plan = targets(sizes, weights, most).select(
        "source_key", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("__rate"), unit(F.col("source_key"), seed).alias("__u")
    )
    before = Window.partitionBy("source_key").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("source_key", "__bin", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")).join(plan, "source_key")

    keys = ["source_key", "__bin"]
    ranked = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = ranked.join(bins, keys)
    c = (F.col("__before") + F.col("__rank")).cast("double")
    copies = F.floor(c * F.col("__rate") + F.col("__u")) - F.floor((c - 1) * F.col("__rate") + F.col("__u"))
    out = out.withColumn("copies", copies.cast("long"))
    return out.select(F.col("__id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), F.col("__text").alias("text_hash"))


def query(spark, sf_dir: str) -> DataFrame:
    return mix_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, substr(md5(coalesce(text, '')), 1, 16) AS th, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / w AS ratio, sum(source_size) OVER ()::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER q, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER q, 0)) AS level FROM r
  WINDOW q AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(level, ratio) AS level FROM l WHERE level <= ratio),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0 ELSE least(cap, coalesce((SELECT level FROM v) * w, cap)) END AS target,
  ('0x' || substr(md5('7:' || coalesce('1' || source, '0')), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM l),
o AS (SELECT doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  row_number() OVER (PARTITION BY d.source ORDER BY length(bin(size)) * 16 + floor(size / pow(2.0, greatest(length(bin(size)) - 4, 0))), md5(coalesce(doc_id::VARCHAR, '')), size, th, doc_id NULLS FIRST)::DOUBLE AS c
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(c * rate + u) - floor((c - 1) * rate + u)))::BIGINT AS taken FROM o
"""
