"""N-grams as rows: sets, positions, overlap and lexical contrast."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tropelens.functions.text import ngrams


#: Odd factors of the two rolling hashes.
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def gram_set(rows: DataFrame, n: int, keys: list[str] | None = None, tokens: str = "tokens") -> DataFrame:
    """(keys, gram) without repeats; repeats inside a row go before anything is shuffled."""
    keys = keys or []
    return rows.select(*keys, F.explode(F.array_distinct(ngrams(F.col(tokens), n))).alias("gram")).distinct()


def hashed(rows: DataFrame, keys: list[str], n: int, tokens: str = "tokens") -> DataFrame:
    """(keys, at, h, g): each n-gram's place from 0 and two 64-bit hashes of it. Words are hashed one by one, and rolled together in
    arrays, a chunk of rows at a time; no string of an n-gram is built. Two different n-grams agree in both only if their words'
    hashes do, with a chance of about words^2 / 2^65, or by a chance of n-grams^2 / 2^129."""
    narrow = rows.where(F.size(tokens) >= n).select(*keys, F.transform(F.col(tokens), lambda w: F.xxhash64(w)).alias("__w"))
    schema = StructType([*narrow.drop("__w").schema.fields, StructField("at", IntegerType()), StructField("h", LongType()), StructField("g", LongType())])

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("__w")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            words = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            ends = np.cumsum(sizes)
            start = 0
            while start < len(sizes):  # rows of about a million words together
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + (1 << 20), side="right")))
                many = sizes[start:stop] - (n - 1)
                row = np.repeat(np.arange(start, stop), many)
                at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                first, sums = (ends - sizes)[row] + at, []
                for factor in FACTORS:
                    h = np.zeros(len(row), dtype=np.uint64)
                    for k in range(n):
                        h = h * factor + words[first + k]
                    sums.append(pa.array((h ^ (h >> np.uint64(32))).view(np.int64)))
                kept = batch.select(keys).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(at.astype(np.int32)), *sums], names=schema.names)
                start = stop

    return narrow.mapInArrow(roll, schema)


def small_side(rows: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """rows, marked for broadcast if their summed size is shown to be small; else Spark joins them by key."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in rows.columns), F.lit(0)) + 64  # with an object's overhead
    return F.broadcast(rows) if (rows.agg(F.sum(size).alias("b")).first()["b"] or 0) <= most_bytes else rows


def shared(a: DataFrame, b: DataFrame, key_a: str, key_b: str, n: int) -> DataFrame:
    """(key_a, key_b, shared): distinct n-grams in common, for pairs that have any. a is the smaller side: while it is
    small, b's n-grams meet it where they are and only common ones are shuffled."""
    left = small_side(hashed(a, [key_a], n).drop("at").distinct())
    return hashed(b, [key_b], n).join(left, ["h", "g"]).select(key_a, key_b, "h", "g").distinct().groupBy(key_a, key_b).agg(F.count(F.lit(1)).alias("shared"))


def log_odds(rows: DataFrame, key: str, positive: str, tokens: str, least_items: int = 4, strength: float = 10.0) -> DataFrame:
    """Per term: items with it in either class, log-odds difference under an informative prior and its z.

    The prior has `strength` pseudo-items with the term's overall share, at most 0.999.
    """
    totals = rows.agg(F.sum(F.col(positive).cast("long")).alias("n1"), F.sum((~F.col(positive)).cast("long")).alias("n0")).first()
    n1, n0 = float(totals["n1"] or 0), float(totals["n0"] or 0)
    terms = rows.select(F.col(positive).alias("y"), F.explode(F.array_distinct(tokens)).alias("term"))
    c = terms.groupBy("term").agg(F.sum(F.col("y").cast("long")).alias("k1"), F.sum((~F.col("y")).cast("long")).alias("k0")).where(F.col("k1") + F.col("k0") >= least_items)
    prior = strength * F.least((F.col("k1") + F.col("k0")) / (n1 + n0), F.lit(0.999))
    x1, x0 = F.col("k1") + prior, F.col("k0") + prior
    delta = F.log(x1 / (n1 + strength - x1)) - F.log(x0 / (n0 + strength - x0))
    return c.select("term", "k1", "k0", delta.alias("delta"), (delta / F.sqrt(1 / x1 + 1 / x0)).alias("z"))
