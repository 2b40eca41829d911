"""Embeddings: cosine, seeds, typicality, neighbours, cohesion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tropelens.operators.repositories import settled


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """rows with the vector scaled to length 1, as doubles."""
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    return rows.withColumn("__norm", norm).withColumn(vector, F.transform(vector, lambda x: x.cast("double") / F.col("__norm"))).drop("__norm")


def vector_blocks(rows: DataFrame, key: str, vector: str, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, matrix) of a query set, a bounded block at a time on the driver, in the order of the keys."""
    keys, values = [], []
    for row in rows.select(key, vector).orderBy(key).toLocalIterator():
        keys.append(row[key])
        values.append(row[vector])
        if len(keys) == block:
            yield np.array(keys), np.array(values, dtype=float)
            keys, values = [], []
    if keys:
        yield np.array(keys), np.array(values, dtype=float)


def seed_similarity(rows: DataFrame, seeds: DataFrame, key: str = "vec_id", vector: str = "embedding", block: int = 10_000) -> DataFrame:
    """Per row the largest cosine to a seed and that seed's key (smallest on ties). Seeds are a query set: rows meet them in
    blocks of a matrix product, and each row's best of all blocks is taken."""
    out = None
    for keys, matrix in vector_blocks(seeds, key, vector, block):
        shared = rows.sparkSession.sparkContext.broadcast((keys, matrix))

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            keys, m = shared.value
            for batch in batches:
                if len(batch):
                    sims = np.stack(batch[vector].to_numpy()).astype(float) @ m.T
                    at = sims.round(12).argmax(axis=1)
                    yield pd.DataFrame({key: batch[key].to_numpy(), "seed": keys[at], "similarity": sims[np.arange(len(batch)), at]})

        found = rows.select(key, vector).mapInPandas(best, f"{key} long, seed long, similarity double")
        out = (found, 1) if out is None else (out[0].union(found), out[1] + 1)
    if out is None:
        return rows.sparkSession.createDataFrame([], f"{key} long, seed long, similarity double")
    if out[1] == 1:
        return out[0]
    first = F.struct((-F.round("similarity", 12)).alias("order"), "seed", "similarity")
    return out[0].groupBy(key).agg(F.min(first).alias("b")).select(key, "b.seed", "b.similarity")


def centroid_sums(rows: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """Per group n and the vector sum, by position: sums are made before the shuffle."""
    parts = rows.select(*by, F.posexplode(vector).alias("at", "x")).groupBy(*by, "at").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    return parts.groupBy(*by).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "x"))).alias("__s")).select(*by, "n", F.transform("__s", lambda s: s["x"]).alias("total"))


def typicality(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Mean cosine of each unit vector to all others, from the sum of all vectors: (v . s - 1) / (n - 1)."""
    total = centroid_sums(rows.withColumn("__all", F.lit(1)), ["__all"], vector).first()
    if total is None or total["n"] < 2:
        return rows.select(key, F.lit(None).cast("double").alias("typicality"))
    s = F.array(*(F.lit(float(x)) for x in total["total"]))
    return rows.select(key, ((dot(F.col(vector), s) - 1) / (total["n"] - 1)).alias("typicality"))


def cohesion(rows: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Per pair of labels (a <= b) the mean cosine of unit vectors, without a vector's pair with itself: from the labels' sums."""
    sums = centroid_sums(rows, [label], vector)
    a, b = sums.alias("a"), sums.alias("b")
    pairs = a.join(b, F.col(f"a.{label}") <= F.col(f"b.{label}"))
    same = F.col(f"a.{label}") == F.col(f"b.{label}")
    product = dot(F.col("a.total"), F.col("b.total"))
    mean = F.when(same & (F.col("a.n") > 1), (product - F.col("a.n")) / (F.col("a.n") * (F.col("a.n") - 1))).when(~same, product / (F.col("a.n") * F.col("b.n")))
    return pairs.select(F.col(f"a.{label}").alias("label_a"), F.col(f"b.{label}").alias("label_b"), mean.alias("mean_cosine"))


def best_of(ids: np.ndarray, keys: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of found rows (query's place, key, similarity) the k best of each query, by similarity, then key."""
    order = np.lexsort((keys, -sims, ids))
    ids, keys, sims = ids[order], keys[order], sims[order]
    kept = np.arange(len(ids)) - np.searchsorted(ids, ids) < k
    return ids[kept], keys[kept], sims[kept]


#: Similarities that a task holds at a time.
MOST_CELLS = 1 << 20


def nearest(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 5_000, cells: int = MOST_CELLS) -> DataFrame:
    """The k nearest other rows of each query by cosine of unit vectors: (query, key, similarity, rank), ties by key.

    Queries go to all rows in blocks. A task takes its rows in pieces of at most `cells` similarities (or a row), and keeps the
    k best rows a query of those it has seen; it returns these, and a window picks among them.
    """
    out = rows.sparkSession.createDataFrame([], f"query long, {key} long, similarity double")
    for keys, matrix in vector_blocks(queries, key, vector, block):
        shared = rows.sparkSession.sparkContext.broadcast((keys, matrix))

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, m = shared.value
            step, worst = max(1, cells // max(1, len(ids))), np.full(len(ids), -np.inf)  # worst: of k rows, else of none
            top = (np.array([], dtype=np.int64), np.array([], dtype=np.int64), np.array([]))
            for batch in batches:
                for start in range(0, len(batch), step):
                    piece = batch.iloc[start : start + step]
                    own = piece[key].to_numpy()
                    sims = (m @ np.stack(piece[vector].to_numpy()).astype(float).T).round(9)
                    sims[ids[:, None] == own[None, :]] = -np.inf
                    least = worst if len(own) <= k else np.maximum(worst, np.partition(sims, -k, axis=1)[:, -k])
                    at, row = np.nonzero(np.isfinite(sims) & (sims >= least[:, None]))
                    if len(at):
                        top = best_of(np.concatenate([top[0], at]), np.concatenate([top[1], own[row]]), np.concatenate([top[2], sims[at, row]]), k)
                        full = np.flatnonzero(np.bincount(top[0], minlength=len(ids)) == k)
                        worst[full] = top[2][np.searchsorted(top[0], full, side="right") - 1]
            if len(top[0]):
                yield pd.DataFrame({"query": ids[top[0]], key: top[1], "similarity": top[2]})

        found = rows.select(key, vector).mapInPandas(best, f"query long, {key} long, similarity double")
        out = out.union(found)
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Best:
    """The k best rows of each query of a block, kept while blocks of rows pass."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.exact, self.short, self.k = ids, vectors, vectors.astype(np.float32), k
        self.longest = np.sqrt((vectors * vectors).sum(1).max(initial=0.0))
        self.worst, self.worst_key = np.full(len(ids), -np.inf), np.full(len(ids), np.iinfo(np.int64).max)  # of k rows, else of none
        self.top = (np.array([], dtype=np.int64), np.array([], dtype=np.int64), np.array([]))

    def meet(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        """Short products are at most `slack` off: they only tell which rows need the product in doubles."""
        sims = self.short @ vectors.astype(np.float32).T
        slack = np.float32(1e-8 + (vectors.shape[1] + 4) * 2.0**-23 * self.longest * np.sqrt((vectors * vectors).sum(1).max(initial=0.0)))
        if keys.min() <= self.ids.max() and self.ids.min() <= keys.max():
            sims[self.ids[:, None] == keys[None, :]] = -np.inf
        least = (self.worst - slack).astype(np.float32)
        if np.isneginf(least).any() and len(keys) > self.k:
            least = np.maximum(least, np.partition(sims, -self.k, axis=1)[:, -self.k] - 2 * slack)
        at, row = np.nonzero(sims >= (least - slack)[:, None])
        if len(at) > sims.size >> 6:
            exact = (self.exact @ vectors.T)[at, row].round(9)
        else:
            exact = np.einsum("ij,ij->i", self.exact[at], vectors[row]).round(9)
        own, worst = keys[row], self.worst[at]
        kept = np.flatnonzero((sims[at, row] > -np.inf) & ((exact > worst) | ((exact == worst) & (own < self.worst_key[at]))))
        if not len(kept):
            return
        self.add(at[kept], own[kept], exact[kept])

    def add(self, at: np.ndarray, keys: np.ndarray, sims: np.ndarray) -> None:
        self.top = best_of(*(np.concatenate(x) for x in zip(self.top, (at, keys, sims), strict=True)), self.k)
        full = np.flatnonzero(np.bincount(self.top[0], minlength=len(self.ids)) == self.k)
        last = np.searchsorted(self.top[0], full, side="right") - 1
        self.worst[full], self.worst_key[full] = self.top[2][last], self.top[1][last]


#: Rows of a block, and of the parts in which one side meets a part of the other; a part is held by a task.
BLOCK, FEW_ROWS, MOST_ROWS = 1 << 10, 1 << 16, 1 << 18


def all_nearest(rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, few: int = FEW_ROWS, most: int = MOST_ROWS) -> DataFrame:
    """The k nearest other rows of every row, as `nearest` with all rows as queries: (query, key, similarity, rank), ties by key.

    All pairs are compared, so time grows with the square of the rows. Vectors are packed in blocks, a row a block, and stored;
    parts of at most `few` rows meet parts of at most `most`, a task a pair of parts, and nothing passes through the driver. A task
    holds one part of the stored vectors and the k best of one block; only these bests are moved. Rows without a vector don't count.
    """
    rows = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, vector)
    n = rows.count()
    parts = max(1, -(-n // few), min(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-n // block)))

    def packed(keys: list[np.ndarray], values: list[np.ndarray], number: int) -> pd.DataFrame:
        ids, m = np.concatenate(keys).astype("<i8"), np.concatenate(values).astype("<f8")
        return pd.DataFrame({"block": [number], "ids": [ids.tobytes()], "m": [m.tobytes()]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, values, held, number = [], [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            start = 0
            while start < len(batch):
                piece = batch.iloc[start : start + block - held]
                keys.append(piece[key].to_numpy())
                values.append(np.stack(piece[vector].to_numpy()))
                start, held = start + len(piece), held + len(piece)
                if held == block:
                    yield packed(keys, values, number)
                    keys, values, held, number = [], [], 0, number + 1
        if held:
            yield packed(keys, values, number)

    blocks = settled(rows.repartitionByRange(parts, key).sortWithinPartitions(key).mapInPandas(pack, "block long, ids binary, m binary"))
    others = blocks.coalesce(-(-n // most) or 1).select(F.col("ids").alias("keys"), F.col("m").alias("v"))

    def sent(block: int, ids: bytes, b: Best) -> pd.DataFrame:
        at, keys, sims = b.top
        return pd.DataFrame({"block": [block], "ids": [ids], "at": [at.astype("<i8").tobytes()], "keys": [keys.astype("<i8").tobytes()], "sims": [sims.astype("<f8").tobytes()]})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ids, b = None, b"", None
        for batch in batches:
            for number, i, m, keys, v in batch[["block", "ids", "m", "keys", "v"]].itertuples(index=False):
                if number != now:
                    if b is not None:
                        yield sent(now, ids, b)
                    own = np.frombuffer(i, "<i8")
                    now, ids, b = number, i, Best(own, np.frombuffer(m, "<f8").reshape(len(own), -1), k)
                other = np.frombuffer(keys, "<i8")
                b.meet(other, np.frombuffer(v, "<f8").reshape(len(other), -1))
        if b is not None:
            yield sent(now, ids, b)

    def told(ids: bytes, found: list[tuple[bytes, bytes, bytes]]) -> pd.DataFrame:
        at, keys, sims = best_of(*(np.concatenate([np.frombuffer(x[j], kind) for x in found]) for j, kind in enumerate(("<i8", "<i8", "<f8"))), k)
        rank = np.arange(len(at)) - np.searchsorted(at, at) + 1
        return pd.DataFrame({"query": np.frombuffer(ids, "<i8")[at], key: keys, "similarity": sims, "rank": rank.astype("int32")})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ids, found = None, b"", []
        for batch in batches:
            for number, i, *rest in batch[["block", "ids", "at", "keys", "sims"]].itertuples(index=False):
                if number != now and found:
                    yield told(ids, found)
                    found = []
                now, ids = number, i
                found.append(tuple(rest))
        if found:
            yield told(ids, found)

    tops = blocks.join(others.hint("shuffle_replicate_nl")).mapInPandas(search, "block long, ids binary, at binary, keys binary, sims binary")
    tops = tops.repartition(parts, "block").sortWithinPartitions("block")
    return tops.mapInPandas(merge, f"query long, {key} long, similarity double, rank int")


def unseen_texts(rows: DataFrame, cache: DataFrame | None, text: str = "text") -> DataFrame:
    """(text_key, text): each normalised text that the cache (text_key, embedding) doesn't have, once."""
    plain = F.trim(F.regexp_replace(F.col(text), r"\s+", " "))
    texts = rows.where(F.col(text).isNotNull()).select(F.sha1(plain).alias("text_key"), plain.alias("text")).dropDuplicates(["text_key"])
    return texts if cache is None else texts.join(cache.select("text_key"), "text_key", "left_anti")


def with_embeddings(rows: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """rows with the cached embedding of their text; null where there is none."""
    keyed = rows.withColumn("text_key", F.sha1(F.trim(F.regexp_replace(F.col(text), r"\s+", " "))))
    return keyed.join(cache.select("text_key", "embedding"), "text_key", "left").drop("text_key")


def context_similarity(items: DataFrame, context: DataFrame, key: str = "item_id", vector: str = "embedding") -> DataFrame:
    """(key, n, nearest, mean): cosine of each item's vector with those of its context sentences (same key)."""
    a = unit_vectors(items.select(key, vector), vector).select(key, F.col(vector).alias("__a"))
    b = unit_vectors(context.select(key, vector), vector).select(key, F.col(vector).alias("__b"))
    sims = a.join(b, key).select(key, dot(F.col("__a"), F.col("__b")).alias("s"))
    return sims.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("nearest"), F.avg("s").alias("mean"))
