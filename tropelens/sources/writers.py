"""Sinks: files, resumable appends, upserts, registries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(rows: DataFrame, path: str, compression: str = "none") -> None:
    rows.write.mode("overwrite").json(path, compression=compression, ignoreNullFields=True)


def tab_separated(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="")


def parquet(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def text_files(rows: DataFrame, path: str, stem: str = "stem", text: str = "text") -> None:
    """One file for each document in a folder `stem=...`; the stems must be safe names. Null texts are empty files, and
    Spark ends each file with a line end."""
    out = rows.select(F.col(stem).alias("stem"), F.coalesce(F.col(text), F.lit("")).alias("value"))
    out.repartition("stem").write.mode("overwrite").partitionBy("stem").text(path)


def markdown_table(rows: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; more than `most` rows are an error, not a cut."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [rows.columns, ["---"] * len(rows.columns), *([cell(v) for v in r] for r in found)]
    return "".join("| " + " | ".join(x) + " |\n" for x in lines)


def exists(rows: DataFrame, path: str) -> bool:
    jvm, conf = rows.sparkSession.sparkContext._jvm, rows.sparkSession.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def resume(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows whose key the output doesn't have yet; returns how many."""
    if exists(rows, path):
        rows = rows.join(rows.sparkSession.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    rows = rows.dropDuplicates(keys)
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    return n


def upsert(old: DataFrame, new: DataFrame, owner: str, keys: list[str], value: str, stamp: str) -> DataFrame:
    """old with all rows of new's owners replaced by new; a null stamp takes the old one if the value hasn't changed."""
    mine = new.select(owner).distinct()
    before = old.select(*keys, F.col(value).alias("__v"), F.col(stamp).alias("__t"))
    filled = new.join(before, keys, "left").withColumn(stamp, F.when(F.col(stamp).isNull() & F.col(value).eqNullSafe(F.col("__v")), F.col("__t")).otherwise(F.col(stamp)))
    return old.join(mine, owner, "left_anti").unionByName(filled.drop("__v", "__t"))


def redraw(pool: DataFrame, retired: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The pool without retired rows, with fresh ones."""
    return pool.join(retired.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def split_private(rows: DataFrame, private: list[str], folder: str) -> None:
    """The same rows twice: in full, and without the private columns."""
    rows.write.mode("overwrite").parquet(f"{folder}/private")
    rows.sparkSession.read.parquet(f"{folder}/private").drop(*private).write.mode("overwrite").parquet(f"{folder}/public")


def routed(rows: DataFrame, key: str, routes: dict[str, str]) -> dict[str, DataFrame]:
    """Rows by the prefix of their key; the rest under ''. Longer prefixes win."""
    left, out = rows, {}
    for prefix, name in sorted(routes.items(), key=lambda r: -len(r[0])):
        out[name] = left.where(F.col(key).startswith(prefix))
        left = left.where(~F.col(key).startswith(prefix))
    return out | {"": left}


def append_registry(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").csv(path, sep="\t")


def splice(page: str, placeholder: str, data: str) -> str:
    """A static page with data in place of its placeholder, which must be there once."""
    if page.count(placeholder) != 1:
        raise ValueError(f"{placeholder} is not there exactly once")
    return page.replace(placeholder, data.replace("</", "<\\/"))
