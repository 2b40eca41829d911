"""Annotated items: which rows count, pairs and positions, revision sets, samples for precision, permutations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tropelens.operators.order import numbered
from tropelens.operators.sampling import hash_order


def without_value(rows: DataFrame, value: Column) -> DataFrame:
    """Rows whose optional field is absent (null)."""
    return rows.where(value.isNull())


def both_usable(pairs: DataFrame, a: str, b: str, bad: str) -> DataFrame:
    """Pairs of labels of which neither is null or the label `bad`."""
    return pairs.where((F.col(a) != bad) & (F.col(b) != bad))


def real_annotators(rows: DataFrame, who: str, test_prefix: str = "zz-test") -> DataFrame:
    """Rows of annotators whose name doesn't begin with the test prefix, in any case; null names go."""
    return rows.where(~F.lower(who).startswith(test_prefix))


def in_body(instances: DataFrame, bodies: DataFrame, key: str = "doc_id", start: str = "char_start", length: str = "body_len") -> DataFrame:
    """Instances that start within their document's body: bodies has a row a document with its length in characters."""
    joined = instances.join(bodies.select(key, F.col(length).alias("__len")), key)
    return joined.where((F.col(start) >= 0) & (F.col(start) < F.col("__len"))).drop("__len")


def used_columns(rows: DataFrame, columns: list[str], least: int = 1) -> list[str]:
    """Design columns with at least so many positive rows, in their order: one aggregate."""
    sums = rows.agg(*(F.sum((F.col(c) > 0).cast("long")).alias(c) for c in columns)).first()
    return [c for c in columns if (sums[c] or 0) >= least]


def without_pairs(pairs: DataFrame, listed: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Pairs of which neither side is listed."""
    names = listed.select(F.col(key).alias("__k")).distinct()
    return pairs.join(names, F.col(a) == F.col("__k"), "left_anti").join(names, F.col(b) == F.col("__k"), "left_anti")


def relative_position(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with `position` from 0 for a group's first row to 1 for its last; null in groups of one."""
    w = Window.partitionBy(*by)
    place, n = F.row_number().over(w.orderBy(*order)) - 1, F.count(F.lit(1)).over(w)
    return rows.withColumn("position", F.when(n > 1, place / (n - 1)))


def both_ends(rows: DataFrame, metric: str, key: str, n: int) -> DataFrame:
    """The n highest and the n lowest rows of a ranking as (side, ...): two bounded sorts. Ties go by key."""
    top = rows.orderBy(F.desc(metric), key).limit(n).select(F.lit("top").alias("side"), *rows.columns)
    return top.union(rows.orderBy(F.asc(metric), key).limit(n).select(F.lit("bottom").alias("side"), *rows.columns))


def reading_order(files: DataFrame, focus: list[str], repo: str = "repo") -> DataFrame:
    """files (repo, path, kind, depth, reach, size) with `place` from 1 in their repository: linked files and what
    is in linked folders before others, then by
    kind, distance along imports (unreached last), vendored and test files after, shallow, small, and by path."""
    path = F.lower("path")
    tier = F.array_position(F.array(*map(F.lit, ("readme", "config", "code", "notebook", "test", "other"))), F.col("kind"))
    linked = [f.rstrip("/") for f in focus]
    focused = reduce(lambda a, b: a | b, ((F.col("path") == f) | F.col("path").startswith(f + "/") for f in linked), F.lit(False)).cast("int")
    vendored = path.rlike(r"(?:^|/)(?:vendor|third_party|node_modules|external)/").cast("int")
    order = [F.desc(focused), F.when(tier > 0, tier).otherwise(99), F.asc_nulls_last("reach"), vendored, F.col("depth"), F.col("size"), F.col("path")]
    return files.withColumn("place", F.row_number().over(Window.partitionBy(repo).orderBy(*order)))


def coverage(files: DataFrame, repo: str = "repo") -> DataFrame:
    """Per repository: files, characters, how many and how much of them was taken, and whether all were. files has a boolean
    column `taken` and a `size`."""
    size = F.when(F.col("taken"), F.col("size")).otherwise(0)
    return files.groupBy(repo).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size").alias("chars"),
        F.sum(F.col("taken").cast("long")).alias("files_taken"),
        F.sum(size).alias("chars_taken"),
        F.bool_and("taken").alias("complete"),
    )


def focus_paths(links: DataFrame, files: DataFrame) -> DataFrame:
    """links (repo, url) -> (repo, focus): the paths inside a repository that its links name (tree/<branch>/<path> or
    blob/...), as far as the repository has a file there or below. files has repo and path."""
    path = F.regexp_replace(F.regexp_extract("url", r"(?i)github\.com/[^/]+/[^/]+/(?:tree|blob)/[^/]+/([^?#]+)", 1), r"[./]+$", "")
    wanted = links.select("repo", path.alias("focus")).where("focus <> ''").distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    there = files.select("repo", F.explode(above).alias("focus"))
    return wanted.join(there, ["repo", "focus"], "left_semi")


def prompts(rows: DataFrame, template: str) -> Column:
    """The template with {column} filled in from each row; null if one of them is null. {{ and }} stand for braces."""
    import string

    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(text))
        if name is not None:
            if name not in rows.columns:
                raise ValueError(f"no column {name}")
            parts.append(F.col(name).cast("string"))
    return F.concat(*parts)


def revision_sets(instances: DataFrame, hunks: DataFrame, latest: DataFrame, paper: str = "doc_id", least: int = 30, seed: int = 13) -> DataFrame:
    """(paper, char_start, sentence, fate): instances of the first version that a revision removed, and per paper as many that
    it kept.

    Removed: the sentence stands in the old side of one of the paper's hunks (paper, old_text; those of surgical removals) and
    not in the latest text (paper, text). Kept: sentences of over `least` characters that the latest text still has, drawn by
    hash. White space is squeezed on all sides. Both joins are by paper.
    """
    norm = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    rows = instances.select(paper, "char_start", norm(F.col("sentence")).alias("sentence"))
    rows = rows.join(latest.select(paper, norm(F.col("text")).alias("__latest")), paper)
    rows = rows.withColumn("__stays", F.contains("__latest", F.col("sentence"))).drop("__latest")
    old = hunks.select(paper, norm(F.col("old_text")).alias("__old")).groupBy(paper).agg(F.collect_list("__old").alias("__old"))
    there = F.exists(F.coalesce("__old", F.array().cast("array<string>")), lambda x: F.contains(x, F.col("sentence")))
    fate = F.when(~F.col("__stays") & there, "removed").when(F.col("__stays") & (F.length("sentence") > least), "kept")
    rows = rows.join(old, paper, "left").withColumn("fate", fate).where("fate is not null").drop("__old", "__stays")
    # all by paper, so rows are made and moved once; equal places of a paper stand together in the order
    drawn = Window.partitionBy(paper, "fate").orderBy(hash_order(seed, paper, "char_start"), "char_start", "sentence")
    again = F.coalesce(F.lag("char_start").over(drawn) == F.col("char_start"), F.lit(False))
    rows = rows.withColumns({"__n": F.row_number().over(drawn), "__counts": (F.col("fate") == "removed") & ~again})
    rows = rows.withColumn("__most", F.sum(F.col("__counts").cast("long")).over(Window.partitionBy(paper)))
    return rows.where(F.col("__counts") | ((F.col("fate") == "kept") & (F.col("__n") <= F.col("__most")))).select(paper, "char_start", "sentence", "fate")


def precision_sample(instances: DataFrame, texts: DataFrame, per_cell: int, cell: list[str], key: str = "doc_id", seed: int = 13) -> DataFrame:
    """At most per_cell instances of each cell, drawn by hash, from those in the body (texts: key, text, body_len) whose offsets
    still hold in the text; stale ones are left out."""
    joined = in_body(instances, texts, key).join(texts.select(key, "text"), key)
    start, end = F.col("char_start").cast("int"), F.col("char_end").cast("int")
    fresh = joined.where(F.substring("text", start + 1, end - start) == F.col("match_text")).drop("text")
    w = Window.partitionBy(*cell).orderBy(hash_order(seed, key, "pattern_id", "char_start"), key, "char_start")
    return fresh.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_cell).drop("__n")


def corrected_ratios(rates: DataFrame, judged: DataFrame, base: str, other: str, pattern: str = "pattern_id", corpus: str = "corpus") -> DataFrame:
    """rates (pattern, corpus, rate) and judged (pattern, corpus, k of n are instances) -> per pattern that both corpora have a
    rate of: `ratio` of other's rate to base's, and `corrected`, times other's precision over base's. Null where it would
    divide by zero or nothing was judged."""

    def of(name: str, value: str):
        return F.max(F.when(F.col(corpus) == name, F.col(value)))

    raw = rates.groupBy(pattern).agg(of(base, "rate").alias("__r0"), of(other, "rate").alias("__r1")).where("__r0 is not null and __r1 is not null")
    share = judged.withColumn("__p", F.when(F.col("n") > 0, F.col("k") / F.col("n")))
    share = share.groupBy(pattern).agg(of(base, "__p").alias("__p0"), of(other, "__p").alias("__p1"))
    ratio = F.when(F.col("__r0") > 0, F.col("__r1") / F.col("__r0"))
    return raw.join(share, pattern, "left").select(pattern, ratio.alias("ratio"), F.when(F.col("__p0") > 0, ratio * F.col("__p1") / F.col("__p0")).alias("corrected"))


def pilot_table(rates: DataFrame, model: str = "model", stage: str = "stage") -> DataFrame:
    """rates (model, stage, words, n) -> per model: documents, mean words, files with a hit and mean rate of the first draft,
    and the mean rate after revision (null without one). Documents without words have no rate."""
    rate = F.when(F.col("words") > 0, 1000.0 * F.col("n") / F.col("words"))
    draft, revised = F.col(stage) == "draft", F.col(stage) == "revised"
    return rates.groupBy(model).agg(
        F.sum(draft.cast("long")).alias("docs"),
        F.avg(F.when(draft, F.col("words"))).alias("words"),
        F.sum((draft & (F.col("n") > 0)).cast("long")).alias("with_hit"),
        F.avg(F.when(draft, rate)).alias("rate"),
        F.avg(F.when(revised, rate)).alias("revised_rate"),
    )


def refilled(answered: DataFrame, pool: DataFrame, source: str, keys: list[str], quota: dict[str, int], seed: int = 13) -> DataFrame:
    """All answered items, and from the pool as many others of each source, by hash, as it lacks to its quota."""
    got = {r[source]: r["n"] for r in answered.groupBy(source).agg(F.count(F.lit(1)).alias("n")).collect()}
    lack = {s: max(0, q - got.get(s, 0)) for s, q in quota.items()}
    most = F.coalesce(*(F.when(F.col(source) == s, F.lit(n)) for s, n in lack.items()), F.lit(0))
    fresh = pool.join(answered.select(*keys), keys, "left_anti")
    place = F.row_number().over(Window.partitionBy(source).orderBy(hash_order(seed, *keys), *keys))
    fresh = fresh.withColumn("__n", place).where(F.col("__n") <= most).drop("__n")
    return answered.unionByName(fresh.select(*answered.columns))


def permuted(rows: DataFrame, label: str, key: str, replicates: int, stratum: str | None = None, seed: int = 13) -> DataFrame:
    """rows once for each replicate `rep`, with the labels dealt anew within each stratum: rows in the order of a hash of seed,
    replicate and key take the labels of the rows in the order of their keys. Places are counted in ranges of these orders, so
    no task holds a replicate; equal keys are not allowed for."""
    part = [stratum] if stratum else []
    base = numbered(rows, part, [key], "__at")
    labels = base.select(*(F.col(p).alias("__s") for p in part), F.col("__at").alias("__place"), F.col(label).alias("__label"))
    reps = rows.drop(label).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col(key).cast("string")))
    reps = numbered(reps.withColumn("__order", order), ["rep", *part], ["__order", key], "__at").drop("__order")
    on = F.col("__at") == F.col("__place")
    if stratum:
        on &= F.col(stratum).eqNullSafe(F.col("__s"))
    return reps.join(labels, on).drop("__s", "__at", "__place").withColumnRenamed("__label", label)


def add_one_p(observed: float, replicates: DataFrame, value: str) -> DataFrame:
    """(observed, p, replicates): the share of replicates that reach the observed value, the observed one counted in."""
    n = F.count(F.lit(1))
    return replicates.agg(F.lit(float(observed)).alias("observed"), ((F.sum((F.col(value) >= observed - 1e-9).cast("long")) + 1) / (n + 1)).alias("p"), n.alias("replicates"))


def repeat_drift(repeats: DataFrame, first: str, again: str, who: str, label: str) -> DataFrame:
    """Per annotator: repeats, same label, into and out of `label`."""
    a, b = F.col(first), F.col(again)
    count = lambda x: F.sum(x.cast("long"))
    return repeats.groupBy(who).agg(F.count(F.lit(1)).alias("repeats"), count(a == b).alias("same"), count((a != label) & (b == label)).alias("into"), count((a == label) & (b != label)).alias("out_of"))
