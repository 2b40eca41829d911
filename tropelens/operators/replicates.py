"""Bootstrap and permutation replicates: weights are made where the rows are, a batch of rows at a time, and multiplied with
them there. What is shuffled is a row a task and replicate, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tropelens.operators.order import numbered

ROUNDS = 6
CHUNK = 4096


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def keyed(seed: int, replicates: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return spread(np.arange(1, replicates + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))


def poisson_weights(hashes: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """[replicate, row]: how often a row, named by the hash of its key, is drawn; Poisson with mean 1."""
    u = spread(hashes.astype(np.int64).view(np.uint64)[None, :] ^ keyed(seed, replicates)[:, None]) >> np.uint64(11)
    u, below, term, out = u.astype(np.float64) / 2.0**53, np.exp(-1.0), np.exp(-1.0), np.zeros((replicates, len(hashes)))
    for k in range(1, 18):
        out += u >= below
        term /= k
        below += term
    return out


def shuffled_places(places: np.ndarray, n: int, replicates: int, seed: int) -> np.ndarray:
    """[replicate, row]: where the row at each place from 0 on goes; each replicate is a permutation of 0 to n - 1.

    A Feistel network permutes the next power of four; what falls outside is sent through it again until it is inside.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = spread(keyed(seed, replicates)[:, None] ^ np.arange(ROUNDS, dtype=np.uint64)[None, :])

    def once(x: np.ndarray, rep: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in range(ROUNDS):
            left, right = right, left ^ (spread(right ^ keys[rep, k]) & mask)
        return (left << shift) | right

    rep = np.repeat(np.arange(replicates), len(places))
    x = once(np.tile(places.astype(np.uint64), replicates), rep)
    while (out := np.flatnonzero(x >= n)).size:
        x[out] = once(x[out], rep[out])
    return x.astype(np.int64).reshape(replicates, len(places))


def chosen(places: np.ndarray, n: int, k: int, replicates: int, seed: int) -> np.ndarray:
    """[replicate, row] 0 or 1: k of n rows, at random, in each replicate."""
    return (shuffled_places(places, n, replicates, seed) < k).astype(np.float64)


def replicate_sums(rows: DataFrame, values: list[Column], draw: Column, weights, replicates: int) -> DataFrame:
    """(rep, s0, s1, ...): per replicate the sums of weight * value. draw is a number a row that weights(numbers) turns into
    [replicate, row]; null values count as 0."""
    names = [f"s{k}" for k in range(len(values))]
    narrow = rows.select(draw.cast("long").alias("draw"), *(F.coalesce(v.cast("double"), F.lit(0.0)).alias(s) for v, s in zip(values, names, strict=True)))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((replicates, len(names)))
        for batch in batches:
            x, d = batch[names].to_numpy(dtype=np.float64), batch["draw"].to_numpy(dtype=np.int64)
            for k in range(0, len(d), CHUNK):
                total += weights(d[k : k + CHUNK]) @ x[k : k + CHUNK]
        yield pd.DataFrame({"rep": np.arange(replicates), **{s: total[:, k] for k, s in enumerate(names)}})

    parts = narrow.mapInPandas(add, "rep long, " + ", ".join(f"{s} double" for s in names))
    return parts.groupBy("rep").agg(*(F.sum(s).alias(s) for s in names))


def interval(values: np.ndarray) -> tuple[float | None, float | None]:
    values = values[np.isfinite(values)]
    return tuple(float(x) for x in np.percentile(values, [2.5, 97.5])) if len(values) else (None, None)


def bootstrap_mean(rows: DataFrame, value: str, key: str, replicates: int = 1000, seed: int = 5) -> DataFrame:
    """One row: n, mean and the percentile interval of the mean. A row enters each replicate Poisson(1) times, by a hash of
    replicate and key: the same on any partitioning. Rows without a value don't count."""
    rows = rows.where(F.col(value).isNotNull())
    sums = replicate_sums(rows, [F.col(value), F.lit(1.0)], F.xxhash64(F.col(key)), lambda h: poisson_weights(h, replicates, seed), replicates).where("s1 > 0")
    ends = sums.agg(F.percentile(F.col("s0") / F.col("s1"), F.array(F.lit(0.025), F.lit(0.975))).alias("e")).first()["e"] or [None, None]
    total = rows.agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return total.select("n", "mean", F.lit(ends[0]).cast("double").alias("lower"), F.lit(ends[1]).cast("double").alias("upper"))


def permutation_difference(rows: DataFrame, value: str, flag: str, key: str, replicates: int = 500, seed: int = 5) -> DataFrame:
    """One row: the observed difference of means (flag true - false) and the add-one permutation p, two-sided. Each replicate
    shuffles the flags, so their number stays. The order of the keys (all different) names the rows; nulls don't count."""
    base = rows.select(F.col(value).cast("double").alias("v"), F.col(flag).cast("int").alias("f"), F.col(key).alias("k")).where("v is not null and f is not null")
    base = numbered(base, [], ["k"], "n")
    got = base.agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("n1"), F.sum("v").alias("v"), F.sum(F.when(F.col("f") == 1, F.col("v"))).alias("v1")).first()
    n, n1 = got["n"], got["n1"] or 0
    if not 0 < n1 < n:
        return rows.sparkSession.createDataFrame([(None, None)], "observed double, p double")
    difference = lambda one: one / n1 - (got["v"] - one) / (n - n1)
    observed = difference(got["v1"])
    sums = replicate_sums(base, [F.col("v")], F.col("n") - 1, lambda i: chosen(i, n, n1, replicates, seed), replicates)
    far = (F.abs(difference(F.col("s0"))) >= abs(observed) * (1 - 1e-12)).cast("long")
    return sums.agg(F.lit(observed).alias("observed"), ((F.sum(far) + 1) / float(replicates + 1)).alias("p"))


def grouped_moments(rows: DataFrame, group: str, xs: list[str], ys: list[str], least: int = 2) -> DataFrame:
    """Per group (with at least so many rows) the sums of products of its demeaned columns: (group, xx.., xy..). Rows with a null
    are left out."""
    for c in {group, *xs, *ys}:
        rows = rows.where(F.col(c).isNotNull())
    rows = rows.select(F.col(group).alias("g"), *(F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate([*xs, *ys])))
    v = [F.col(f"v{k}") for k in range(len(xs) + len(ys))]
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(v))]
    n = F.count(F.lit(1))
    products = [(F.sum(v[i] * v[j]) - F.sum(v[i]) * F.sum(v[j]) / n).alias(f"m{i}_{j}") for i, j in pairs]
    return rows.groupBy("g").agg(n.alias("n"), *products).where(F.col("n") >= least)


def solved(moments: np.ndarray, k: int, m: int) -> np.ndarray:
    """[replicate, x, y] coefficients from moments in the order of grouped_moments; singular systems give nan."""
    out = np.full((len(moments), k, m), np.nan)
    for r, row in enumerate(moments):
        full, at = np.zeros((k, k + m)), 0
        for i in range(k):
            full[i, i:] = row[at : at + k + m - i]
            at += k + m - i
        gram = np.triu(full[:, :k]) + np.triu(full[:, :k], 1).T
        if np.isfinite(gram).all() and abs(np.linalg.det(gram)) > 1e-12 * max(1e-300, np.prod(np.diag(gram))):
            out[r] = np.linalg.solve(gram, full[:, k:])
    return out


def bootstrap_within(rows: DataFrame, group: str, xs: list[str], ys: list[str], replicates: int = 500, seed: int = 1) -> DataFrame:
    """(y, x, estimate, lower, upper): within-group least squares of each outcome on xs, with percentile intervals from drawing
    whole groups; and for each outcome but the first `y0 - y`, the difference of their coefficients.

    Groups are reduced to their moments once; replicates weigh those. The driver gets a row of moments a replicate.
    """
    moments = grouped_moments(rows, group, xs, ys)
    columns = [F.col(c) for c in moments.columns if c.startswith("m")]
    k, m = len(xs), len(ys)
    whole = moments.agg(*(F.sum(c) for c in columns)).first()
    estimate = solved(np.array([[np.nan if x is None else x for x in whole]]), k, m)[0]
    sums = replicate_sums(moments, columns, F.xxhash64("g"), lambda h: poisson_weights(h, replicates, seed), replicates).orderBy("rep").collect()
    boots = solved(np.array([list(r)[1:] for r in sums]).reshape(len(sums), len(columns)), k, m)
    out = []
    for i, x in enumerate(xs):
        for j, y in enumerate(ys):
            out.append((y, x, estimate[i, j], *interval(boots[:, i, j])))
            if j:
                out.append((f"{ys[0]} - {y}", x, estimate[i, 0] - estimate[i, j], *interval(boots[:, i, 0] - boots[:, i, j])))
    clean = [tuple(None if isinstance(v, float) and not np.isfinite(v) else float(v) if not isinstance(v, str) and v is not None else v for v in r) for r in out]
    return rows.sparkSession.createDataFrame(clean, "y string, x string, estimate double, lower double, upper double")
