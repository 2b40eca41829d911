"""Reproducible samples: rows are ordered by a hash of seed and key, so results don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tropelens.functions.text import let


def hash_order(seed: int, *keys: str) -> Column:
    """An order that other engines can compute too: the md5 of seed and keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def stratified(rows: DataFrame, stratum: str, keys: list[str], k: int, seed: int = 13) -> DataFrame:
    """min(k, available) rows of each stratum. Tasks keep only what can still be drawn: Spark limits groups before the shuffle."""
    w = Window.partitionBy(stratum).orderBy(hash_order(seed, *keys), *keys)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def even_split(rows: DataFrame, source: str, keys: list[str], n: int, sources: list[str], seed: int = 13) -> DataFrame:
    """n rows over the sources evenly, earlier sources taking the remainder; an error if a source has too few."""
    quota = {s: n // len(sources) + (i < n % len(sources)) for i, s in enumerate(sources)}
    got = {r[source]: r["n"] for r in rows.where(F.col(source).isin(sources)).groupBy(source).agg(F.count(F.lit(1)).alias("n")).collect()}
    short = [s for s in sources if got.get(s, 0) < quota[s]]
    if short:
        raise ValueError(f"too few rows in {', '.join(short)}")
    w = Window.partitionBy(source).orderBy(hash_order(seed, *keys), *keys)
    limit = F.coalesce(*(F.when(F.col(source) == s, F.lit(q)) for s, q in quota.items()))
    return rows.where(F.col(source).isin(sources)).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")


def folds(rows: DataFrame, label: str, keys: list[str], k: int, seed: int = 13) -> DataFrame:
    """rows with `fold`, dealt round within each label."""
    w = Window.partitionBy(label).orderBy(hash_order(seed, *keys), *keys)
    return rows.withColumn("fold", F.pmod(F.row_number().over(w) - 1, F.lit(k)).cast("long"))


def capped(rows: DataFrame, group: str, keys: list[str], most: int, n: int, seed: int = 13) -> DataFrame:
    """n rows, at most `most` a group, round after round through the groups."""
    w = Window.partitionBy(group).orderBy(hash_order(seed, *keys), *keys)
    out = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most)
    return out.orderBy("__n", hash_order(seed, group), group).limit(n).drop("__n")


def spaced(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """At most k evenly spaced rows of each group: places int(i * n / k)."""
    w = Window.partitionBy(*by)
    pos, n = F.row_number().over(w.orderBy(*order)) - 1, F.count(F.lit(1)).over(w)
    out = rows.withColumns({"__p": pos, "__n": n})
    first = F.ceil(F.col("__p") * k / F.col("__n"))
    return out.where((F.col("__n") <= k) | ((F.floor(first * F.col("__n") / k) == F.col("__p")) & (first < k))).drop("__p", "__n")


def spread(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """At most k rows of each group from its first to its last: places round(i * (n - 1) / (k - 1)), halves to even; the first
    row alone for k = 1. A place is taken if one of the two whole i next to it leads there."""
    w = Window.partitionBy(*by)
    out = rows.withColumns({"__p": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count(F.lit(1)).over(w)})
    if k == 1:
        return out.where("__p = 0").drop("__p", "__n")
    step = (F.col("__n") - 1) / F.lit(float(k - 1))
    taken = [F.rint(i * step) == F.col("__p") for i in (F.floor(F.col("__p") / step), F.ceil(F.col("__p") / step))]
    return out.where((F.col("__n") <= k) | taken[0] | taken[1]).drop("__p", "__n")


def first_of_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first in order."""
    best = F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("__v")).select(*keys, "__v.*")


def draw_batch(pool: DataFrame, registry: DataFrame, batch: str, source: str, keys: list[str], n: int, sources: list[str], seed: int = 13) -> tuple[DataFrame, DataFrame]:
    """(rows of the batch, registry rows to append). A batch that the registry knows is returned as drawn, and asking for
    another size is an error; else rows that no batch has are drawn."""
    known = registry.where(F.col("batch") == batch)
    size = known.count()
    if size:
        if size != n:
            raise ValueError(f"batch {batch} has {size} rows, not {n}")
        return pool.join(known.select(source, *keys), [source, *keys], "left_semi"), registry.limit(0)
    drawn = even_split(pool.join(registry.select(source, *keys), [source, *keys], "left_anti"), source, keys, n, sources, seed)
    return drawn, drawn.select(F.lit(batch).alias("batch"), source, *keys)


def few_shot(rows: DataFrame, label: str, keys: list[str], k: int, seed: int = 13) -> tuple[DataFrame, DataFrame]:
    """(k examples of each label, the other rows): examples are never judged."""
    examples = stratified(rows.where(F.col(label).isNotNull()), label, keys, k, seed)
    return examples, rows.join(examples.select(*keys), keys, "left_anti")


def balanced(rows: DataFrame, group: str, removed: str, keys: list[str], seed: int = 13) -> DataFrame:
    """All removed rows and, in each group, as many kept ones at most."""
    rows = rows.withColumn("__gone", F.coalesce(F.col(removed).cast("boolean"), F.lit(False)))
    gone = rows.where("__gone").groupBy(F.col(group).alias("__group")).agg(F.count(F.lit(1)).alias("__most"))
    order = F.row_number().over(Window.partitionBy(group, "__gone").orderBy(hash_order(seed, *keys), *keys))
    ranked = rows.withColumn("__n", order).join(gone, F.col(group).eqNullSafe(F.col("__group")))
    return ranked.where(F.col("__gone") | (F.col("__n") <= F.col("__most"))).drop("__gone", "__n", "__group", "__most")


def annotator_order(assigned: DataFrame, key: str, who: str, seed: int = 13) -> DataFrame:
    """Assigned items (a row per annotator and item) with their `place`, from 0, in the annotator's own order."""
    w = Window.partitionBy(who).orderBy(hash_order(seed, who, key), key)
    return assigned.withColumn("place", (F.row_number().over(w) - 1).cast("long"))


def vicinity(sentences: DataFrame, items: DataFrame, size: int, good, key: str = "doc_id", pos: str = "pos", text: str = "sentence", shifts: int = 4, seed: int = 13) -> DataFrame:
    """(key, item_pos, side, start, passage): for each item (key, item_pos) the first usable window of `size` sentences near it.

    Windows start a sentence away from the item's neighbours and move off by up to shifts - 1 sentences; which side is
    tried first is a hash's choice. `good` maps a passage column to a boolean. Items without a usable window have no row.
    Each document's sentences are brought together once; no window is a row.
    """
    parts = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(text).alias("sentence"))))
    docs = sentences.where(F.col(pos).isNotNull()).groupBy(key).agg(parts.alias("__parts"))
    places = items.where(F.col("item_pos").isNotNull()).groupBy(key).agg(F.collect_set("item_pos").alias("__items"))
    docs = docs.join(places, key).withColumn("__sentences", F.col("__parts.sentence")).withColumn("__places", F.col("__parts.pos"))
    return first_windows(docs, "__sentences", F.col("__items"), size, good, key, lambda at: F.array_position("__places", at.cast(sentences.schema[pos].dataType)), shifts, seed)


def vicinity_in_lists(docs: DataFrame, sentences: str, is_item, size: int, good, key: str = "doc_id", shifts: int = 4, seed: int = 13) -> DataFrame:
    """As vicinity(), of documents with an array of their sentences, numbered from 0: items are those that the condition
    is_item (a sentence's column -> a boolean's) holds for. Nothing is moved."""
    places = F.filter(F.sequence(F.lit(0), F.size(sentences) - 1), lambda i: is_item(F.get(F.col(sentences), i)))
    docs = docs.where(F.size(sentences) > 0)
    return first_windows(docs, sentences, places, size, good, key, lambda at: F.when(at >= 0, at + 1).otherwise(0), shifts, seed)


def first_windows(docs: DataFrame, sentences: str, places: Column, size: int, good, key: str, row_of, shifts: int, seed: int) -> DataFrame:
    """A row an item of each document that has a usable window: tries one after the other, up to the first. row_of maps a sentence's
    number to its place in the array from 1, or 0."""
    none = F.lit(None).cast("struct<side:string,start:int,passage:string>")

    def tried(item: Column, k: Column, flip: Column) -> Column:
        shift, before = F.floor(k / 2).cast("int"), (k % 2 == 0) == flip
        start = F.when(before, item - 2 - size - shift).otherwise(item + 2 + shift).cast("int")
        row = row_of(start).cast("int")
        parts = F.slice(F.col(sentences), F.greatest(row, F.lit(1)), size)
        whole = (row > 0) & (F.size(parts) == size) & ~F.exists(parts, lambda x: x.isNull())
        return F.struct(F.when(before, "before").otherwise("after").alias("side"), start.alias("start"), F.when(whole, F.array_join(parts, " ")).alias("passage"))

    def usable(found: Column, w: Column) -> Column:
        return F.when(found.isNull() & w["passage"].isNotNull() & good(w["passage"]), w).otherwise(found)

    def first(item: Column) -> Column:
        flip = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), item.cast("string"))), 1, 1) < "8"
        return let(flip, lambda f: F.aggregate(F.sequence(F.lit(0), F.lit(2 * shifts - 1)), none, lambda found, k: F.when(found.isNotNull(), found).otherwise(let(tried(item, k, f), lambda w: usable(found, w)))))

    found = docs.select(key, F.explode(F.transform(places, lambda p: F.struct(p.alias("item_pos"), first(p).alias("w")))).alias("__f"))
    return found.select(key, "__f.item_pos", "__f.w").where("w is not null").select(key, "item_pos", "w.*")
