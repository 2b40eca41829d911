"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tropelens.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def long(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("long")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, counts as long: results that compare across engines."""
    kinds = dict(df.dtypes)
    return df.select(*(r6(F.col(c).cast("double")).alias(c) if kinds[c].startswith(("double", "decimal", "float")) else long(c).alias(c) if kinds[c] in ("int", "bigint") else F.col(c) for c in df.columns))
