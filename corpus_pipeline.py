"""The corpus pipeline: documents -> a deduplicated, decontaminated mix. Each stage's result is written before the next reads it.

Stages run their operator on columns with names of their own and give the caller's columns back as they were, so an input may
have columns of any other names. Every stage takes null, empty and very long texts, null and repeated ids, and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from tropelens.llm.common import written
from tropelens.llm.decontaminate import contamination
from tropelens.llm.line_dedup import line_dedup
from tropelens.llm.mixing import mix_counts
from tropelens.llm.ngram_join import near_duplicates
from tropelens.llm.quality_classifier import quality
from tropelens.session import ship


class Shield:
    """docs under names that no operator uses."""

    def __init__(self, docs: DataFrame):
        self.columns = docs.columns
        self.own = {c: f"in_{k}__" for k, c in enumerate(docs.columns)}
        self.docs = docs.toDF(*self.own.values())

    def __getitem__(self, column: str) -> str:
        return self.own[column]

    def back(self, rows: DataFrame, *more) -> DataFrame:
        return rows.select(*(F.col(v).alias(c) for c, v in self.own.items()), *more)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null texts are judged as empty ones, repeated rows each."""
    ship(spark)
    s = Shield(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias(s["doc_id"]), "quality")
    return s.back(quality(s.docs, labels, s["doc_id"], s["text"], s["lang"], s["source"]).where("kept"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; every row stays, null texts stay null, and n_chars, if there is such a column, is
    brought up to date where a line went."""
    s = Shield(docs)
    out = line_dedup(s.docs, s["text"], s["source"])
    if "n_chars" in docs.columns:
        n = F.col(s["n_chars"])
        out = out.withColumn(s["n_chars"], F.when(F.col("n_dropped") > 0, F.length(s["text"])).otherwise(n).cast(docs.schema["n_chars"].dataType))
    return s.back(out)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; rows that repeat an id and a text go, rows
    without an id stay. Rows that share an id stay or go together.

    Ids alone are counted and joined: texts are moved once at most, by the anti join, and only repeated ids' texts compared.
    """
    ship(spark)
    ids = near_duplicates(docs.select("doc_id", "text")).where("doc_id is not null")
    ids = ids.groupBy("doc_id").agg(F.max((F.col("doc_id") != F.col("component_id")).cast("int")).alias("gone"), F.count(F.lit(1)).alias("rows")).where("gone = 1 or rows > 1")
    ids = written(ids, "copies")
    once = docs.join(ids.select("doc_id"), "doc_id", "left_anti")  # null ids match nothing and stay
    again = docs.join(ids.where("gone = 0").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.select(*docs.columns).union(again.select(*docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; null texts hold none."""
    ship(spark)
    s = Shield(docs)
    return s.back(contamination(s.docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), s["text"]).where("not contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes: the document's columns and the copy's number, as `copy` (`copy_1` and so on if
    the documents have such a column). Rows equal in id, source and text get the copies that the mix takes of them, evenly."""
    s = Shield(docs)
    key = F.md5(F.concat_ws("\x1f", F.col("id").isNull().cast("string"), "id", F.col("source").isNull().cast("string"), "source", "text_hash").cast("binary"))
    counts = mix_counts(s.docs, s["doc_id"], s["text"], s["source"]).withColumnRenamed(s["doc_id"], "id")
    groups = counts.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("copies")).where("copies > 0")
    groups = written(groups, "groups")
    text_hash = F.substring(F.md5(F.coalesce(F.col(s["text"]).cast("string"), F.lit("")).cast("binary")), 1, 16)
    keyed = s.docs.withColumns({"id": F.col(s["doc_id"]), "source": F.col(s["source"]).cast("string"), "text_hash": text_hash})
    keyed = keyed.withColumn("key", key).drop("id", "source", "text_hash")
    single = keyed.join(groups.where("rows = 1").select("key", F.col("copies").alias("n")), "key")
    several = keyed.join(groups.where("rows > 1"), "key")
    plain = [v for c, v in s.own.items() if not isinstance(docs.schema[c].dataType, (MapType, VariantType))]
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64(*plain)))
    several = several.withColumn("place", place).withColumn("n", F.expr("copies div rows + if(place <= copies % rows, 1, 0)")).drop("rows", "copies", "place")
    out = single.unionByName(several).where("n > 0")
    name = next(x for x in ("copy", *(f"copy_{k}" for k in range(1, len(docs.columns) + 2))) if x not in docs.columns)
    return s.back(out, F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias(name))


STAGES = [("quality", classify), ("lines", drop_lines), ("copies", drop_copies), ("leaks", drop_leaks), ("mix", mix)]

#: The first stage learns a classifier: no SQL for it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
