"""Tables that are replaced as a whole: a new version is written beside the old, and a pointer moves to it when it is complete."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


def _hadoop(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(conf), conf


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the version that the pointer names, or None before the first."""
    _, p, fs, _ = _hadoop(spark, f"{root}/{POINTER}")
    if not fs.exists(p):
        return None
    return f"{root}/{spark.read.text(f'{root}/{POINTER}').first()['value']}"


def read(spark: SparkSession, root: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """The table's current version. A reader that has begun goes on reading its version while a new one is published."""
    where = current(spark, root)
    if where is None:
        raise FileNotFoundError(f"no version in {root}")
    reader = spark.read.format(kind)
    return (reader.schema(schema) if schema else reader).load(where)


def point(spark: SparkSession, root: str, version: str) -> None:
    """Moves the pointer by one rename that replaces it."""
    jvm, p, fs, conf = _hadoop(spark, f"{root}/.{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(p, True)
    out.write(bytearray(f"{version}\n".encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), conf).rename(p, jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}"), options)


def publish(rows: DataFrame, root: str, kind: str = "parquet", keep: int = 2, **options: str) -> str:
    """Writes rows as the next version and makes it current. rows may be read from the version that is current. If anything
    fails before the pointer moves, readers see the old version. The last `keep` versions stay. One writer at a time.

    With kind json and compression gzip this rewrites a table of gzip files in place.
    """
    spark = rows.sparkSession
    jvm, p, fs, _ = _hadoop(spark, root)

    def versions() -> list[str]:
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("v=")) if fs.exists(p) else []

    last = versions()
    version = f"v={int(last[-1][2:10]) + 1 if last else 1:08d}-{uuid.uuid4().hex}"
    rows.write.options(**options).format(kind).save(f"{root}/{version}")
    point(spark, root, version)
    path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    complete = [v for v in versions() if fs.exists(path(f"{v}/_SUCCESS"))]
    for name in set(versions()) - set(complete[-max(keep, 1) :]) - {version}:  # old ones, and what a failed writer has left
        fs.delete(path(name), True)
    return version


def replace_texts(new: DataFrame, root: str, key: str = "doc_id", text: str = "text", keep: int = 2) -> dict[str, int]:
    """Publishes the table with new texts, for instance of an extraction that was run again: counts of added, changed, unchanged,
    failed and untouched rows. A row whose new text is null or blank has failed and keeps what it had (a failed new key isn't
    added); rows that new doesn't name stay. Texts are compared by hash, so old texts move once, and only to be written.

    Keys are unique on either side; a key that new repeats is an error.
    """
    spark = new.sparkSession
    if new.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} is repeated")
    fresh = new.select(key, F.col(text).alias("__text")).withColumn("__new", F.lit(True))
    if current(spark, root) is None:
        old = spark.createDataFrame([], new.select(key, text).schema).withColumn("__old", F.lit(True))
    else:
        old = read(spark, root).withColumn("__old", F.lit(True))
    failed = F.coalesce(F.trim("__text"), F.lit("")) == ""
    state = (
        F.when(F.col("__new").isNull(), "untouched")
        .when(failed, F.when(F.col("__old"), "failed").otherwise("failed_new"))
        .when(F.col("__old").isNull(), "added")
        .when(F.xxhash64(text, F.octet_length(text)) == F.xxhash64("__text", F.octet_length("__text")), "unchanged")
        .otherwise("changed")
    )
    both = old.join(fresh, key, "full_outer").withColumn("__state", state)
    both = both.withColumn(text, F.when(F.col("__state").isin("added", "changed"), F.col("__text")).otherwise(F.col(text)))
    counts = dict.fromkeys(("added", "changed", "unchanged", "failed", "untouched"), 0)
    for r in both.groupBy("__state").count().collect():
        name = "failed" if r["__state"] == "failed_new" else r["__state"]
        counts[name] += r["count"]
    if counts["added"] or counts["changed"]:
        publish(both.where("__state <> 'failed_new'").drop("__text", "__new", "__old", "__state"), root, keep=keep)
    return counts
