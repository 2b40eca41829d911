"""Validating readers of JSON-lines files: true line numbers, ids reserved by their first record, rejects with reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tropelens.functions.names import safe_stem
from tropelens.operators.repositories import settled

MOST_SPLITS = 500_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): every line of text files (gzip by suffix) with its number from 1 in its file.

    Files are read in splits, by Spark's own reader, from any store. Rows are numbered as they are read, so what a split adds
    to is the number of lines in the splits before it: a table of a row a split. Lines aren't moved for it.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    splits = settled(rows.groupBy("file", "__block").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("__first")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "__block", "__first", before.alias("__before"))
    if splits.count() <= MOST_SPLITS:
        splits = F.broadcast(splits)
    return rows.join(splits, ["file", "__block"]).select("file", (F.col("__before") + F.col("__at") - F.col("__first") + 1).alias("line"), "value")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def text_field(value: Column, path: str) -> Column:
    """A field of a variant if it is a string that isn't blank, else null."""
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    text = F.try_variant_get(value, path, "string")
    return F.when((kind == "STRING") & (stripped(text) != ""), text)


def judged(lines: DataFrame, checks: list[tuple[Column, str]], id_field: str = "doc_id", exclude: DataFrame | None = None, only: list[str] | None = None) -> DataFrame:
    """lines (file, line, v: a variant or null) with id, stem, reason and skipped.

    In the order of file and line, the first record that names an id takes it, whatever else is wrong with it. Excluded ids and
    ids not asked for are skipped without a reason. checks are conditions that hold for a bad record, with reasons; of records
    that pass them and whose file names differ in case only, the first keeps the name. reason is null for valid records.
    """
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    rows = lines.withColumn("id", F.when(is_object, text_field(F.col("v"), f"$.{id_field}")))
    place = F.struct("file", "line")
    first = rows.where("id is not null").groupBy("id").agg(F.min(place).alias("__first"))
    rows = rows.join(first, "id", "left").withColumn("stem", F.lower(safe_stem(F.col("id"))))
    rows = rows.withColumn("skipped", F.lit(False) if only is None else F.coalesce(~F.col("id").isin(*only), F.lit(False)) if only else F.col("id").isNotNull())
    if exclude is not None:
        out = exclude.select(F.col(exclude.columns[0]).alias("id"), F.lit(True).alias("__out")).where("id is not null").distinct()
        rows = rows.join(out, "id", "left").withColumn("skipped", F.col("skipped") | F.coalesce("__out", F.lit(False))).drop("__out")
    repeated = F.col("id").isNotNull() & (F.col("__first") != place)
    reason = F.when(~is_object, "not a JSON object").when(F.col("id").isNull(), "missing id").when(repeated, "repeated id").when(F.col("skipped"), None).when(F.col("stem").isNull(), "id too long for a file name")
    bad = reduce(lambda when, c: when.when(c[0], c[1]), checks[1:], F.when(*checks[0])) if checks else F.lit(None)
    rows = rows.withColumn("__early", reason).withColumn("__late", bad).withColumn("skipped", F.col("skipped") & F.col("__early").isNull())
    rows = settled(rows.drop("__first"))
    names = rows.where("__early is null and __late is null and not skipped").groupBy("stem").agg(F.min(place).alias("__keeper"))
    rows = rows.join(names, "stem", "left")
    taken = F.col("__early").isNull() & ~F.col("skipped") & (F.col("__keeper") < place)
    return rows.withColumn("reason", F.coalesce("__early", F.when(taken, "repeated file name"), F.when(~F.col("skipped"), F.col("__late")))).drop("__early", "__late", "__keeper")


def seed_records(spark: SparkSession, path: str, exclude: DataFrame | None = None, only: list[str] | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid: doc_id, title, abstract in the order of the lines; rejected: file, line, doc_id, reason).

    A record is an object with a non-blank string doc_id that no earlier record named, a title, and sections of which one or
    more of category abstract have text; these are joined. exclude has a column of ids that are skipped; with only, all other
    ids are skipped, and asking for an excluded one is an error. limit counts valid records.
    """
    if limit is not None and limit < 1:
        raise ValueError("the limit must be positive")
    if only is not None and exclude is not None:
        clash = [r[0] for r in exclude.select(exclude.columns[0]).where(F.col(exclude.columns[0]).isin(*only)).distinct().limit(5).collect()] if only else []
        if clash:
            raise ValueError(f"excluded ids asked for: {', '.join(sorted(clash))}")
    lines = numbered_lines(spark, path).withColumn("v", F.try_parse_json("value")).drop("value")
    sections = F.try_variant_get("v", "$.sections", "array<variant>")
    is_list = F.coalesce(F.schema_of_variant(F.try_variant_get("v", "$.sections", "variant")).startswith("ARRAY"), F.lit(False))
    text = lambda s: F.when(F.schema_of_variant(s).startswith("OBJECT") & (text_field(s, "$.category") == "abstract"), stripped(text_field(s, "$.text")))
    abstracts = F.array_compact(F.transform(sections, text))
    checks = [(text_field(F.col("v"), "$.title").isNull(), "missing title"), (~is_list, "sections are no list"), (F.coalesce(F.size(abstracts), F.lit(0)) < 1, "missing abstract")]
    rows = judged(lines, checks, "doc_id", exclude, only)
    valid = rows.where("reason is null and not skipped").select("file", "line", F.col("id").alias("doc_id"), stripped(text_field(F.col("v"), "$.title")).alias("title"), F.array_join(abstracts, "\n\n").alias("abstract")).orderBy("file", "line")
    valid = valid.limit(limit) if limit is not None else valid
    return valid.drop("file", "line"), rows.where("reason is not null").select("file", "line", F.col("id").alias("doc_id"), "reason")
