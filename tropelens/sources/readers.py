"""Readers with explicit schemas. Everything is a DataFrame; rejects go to a table of their own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tropelens.operators.bundles import is_generated
from tropelens.sources.records import judged, numbered_lines, text_field

RECORD = "doc_id string, title string, n_references int, total_chars long, chars_covered long, sections array<struct<category string, heading string, text string>>"
REGISTRY = "batch string, corpus string, doc_id string"


def stem(path: Column) -> Column:
    """File name without folder and last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")


def text_files(spark: SparkSession, path: str, corpus: str) -> DataFrame:
    """(corpus, doc_id, text): one row a file; bytes that aren't UTF-8 are replaced. No files: an error."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    if rows.limit(1).count() == 0:
        raise FileNotFoundError(f"no .txt files in {path}")
    return rows.select(F.lit(corpus).alias("corpus"), stem(F.col("path")).alias("doc_id"), decoded(F.col("content")).alias("text"))


def decoded(content: Column) -> Column:
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.make_valid_utf8(content.cast("string")))


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(model, stage, doc_id, text) from <path>/<model>/<stage>/<id>.md."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    return rows.select(F.element_at(parts, -3).alias("model"), F.element_at(parts, -2).alias("stage"), stem(F.col("path")).alias("doc_id"), decoded(F.col("content")).alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines, gzip included (by suffix)."""
    return spark.read.schema(schema).json(path)


def valid_records(spark: SparkSession, path: str, schema: str = RECORD, required: tuple[str, ...] = ("doc_id", "title")) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): rejected rows have file, line, doc_id and reason. Lines that aren't JSON objects, rows without a required
    string, ids that an earlier row took (valid or not) and file names that differ from an earlier one in case only are
    rejected. Valid rows have the schema's columns, in the order of the lines."""
    lines = numbered_lines(spark, path).withColumn("v", F.try_parse_json("value"))
    checks = [(text_field(F.col("v"), f"$.{c}").isNull(), f"missing {c}") for c in required[1:]]
    rows = judged(lines, checks, required[0])
    valid = rows.where("reason is null").withColumn("r", F.from_json("value", schema)).orderBy("file", "line").select("r.*")
    return valid, rows.where("reason is not null").select("file", "line", F.col("id").alias("doc_id"), "reason")


def by_ids(spark: SparkSession, path: str, ids: list[str], key: str = "doc_id") -> DataFrame:
    """Rows of a Parquet corpus in the caller's order: the filter reaches the row groups. A missing id is an error."""
    wanted = spark.createDataFrame(list(enumerate(ids)), "pos int, id string")
    found = spark.read.parquet(path).where(F.col(key).isin(ids)).join(F.broadcast(wanted), F.col(key) == F.col("id"))
    got = {r[key] for r in found.select(key).distinct().collect()}
    if lost := [i for i in ids if i not in got]:
        raise KeyError(f"not in the corpus: {', '.join(lost[:5])}")
    return found.orderBy("pos").drop("pos", "id")


def tab_separated(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Tabs, no quoting."""
    return spark.read.csv(path, sep="\t", header=header, schema=schema, quote="")


def id_list(spark: SparkSession, path: str, corpus: str | None = None) -> DataFrame:
    """(corpus, doc_id) from lines "id" or "corpus<tab>id"; # comments and blank lines are skipped."""
    parts = F.split(F.trim("value"), "\t")
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    return rows.select(F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit(corpus)).alias("corpus"), F.element_at(parts, -1).alias("doc_id"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", schema=REGISTRY).where("batch <> 'batch'")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')


def parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def xml_papers(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, title, first_page, last_page, pages) from metadata in XML."""
    rows = spark.read.format("xml").option("rowTag", "paper").schema("_id string, title string, pages string, url string").load(path)
    span = F.split("pages", "[–-]+")
    first, last = span[0].try_cast("int"), F.element_at(span, -1).try_cast("int")
    return rows.select(F.col("_id").alias("paper_id"), "title", first.alias("first_page"), last.alias("last_page"), (last - first + 1).alias("pages"))


def bibtex(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """(key, year, title, pages) of each entry; front matter is left out."""
    rows = spark.read.option("lineSep", "\n@").text(path)

    def value(name: str) -> Column:
        found = F.regexp_extract("value", rf'(?is)\b{name}\s*=\s*[{{"]?(.*?)[}}"]?\s*,?\s*(?:\n|$)', 1)
        return F.nullif(found, F.lit(""))

    out = rows.select(F.nullif(F.regexp_extract("value", r"^@?\w+\{([^,\s]+)", 1), F.lit("")).alias("key"), value("year").try_cast("int").alias("year"), value("title").alias("title"), value("pages").alias("pages")).where("key is not null")
    out = out.where(~F.coalesce(F.lower("title").startswith("proceedings of"), F.lit(False)))
    return out if year is None else out.where(F.col("year") == year)


def union_view(parts: list[DataFrame], key: str) -> DataFrame:
    """One view of several runs; a key in two of them is an error."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    twice = out.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0][key]} is in more than one run")
    return out


def repository_files(spark: SparkSession, path: str, most_bytes: int = 500_000, skip: str = r"/(?:\.git|node_modules|__pycache__|venv|build|dist)/") -> DataFrame:
    """(path, sha1, bytes, text) of text files; folders to skip, large, binary (with a zero byte near the beginning), generated (lines
    of over 300 characters on average) and repeated contents are left out; of equal contents the first path stays."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(~F.col("path").rlike(skip) & (F.col("length") <= most_bytes))
    rows = rows.where(~F.contains(F.substring("content", 1, 8192), F.lit(b"\x00"))).withColumn("sha1", F.sha1("content"))
    rows = rows.withColumn("text", decoded(F.col("content"))).where(~is_generated(F.col("text")))
    first = rows.groupBy("sha1").agg(F.min("path").alias("path"))
    return rows.join(first, ["sha1", "path"], "left_semi").select("path", "sha1", F.col("length").alias("bytes"), "text")
