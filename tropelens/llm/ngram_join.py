"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Documents with the same set of word shingles are one class; the join runs between classes. A shingle's document frequency
is counted over all classes, by shuffling hashed shingles as packed arrays. What comes back to a class are only the
shingles that some other class has too: a shingle that occurs once can't be part of any intersection, its number is
enough. Classes whose rare-first prefix holds nothing but such shingles have no partner and go no further, and
intersections are taken over what came back: texts are read once, and never moved.

Classes that share a prefix shingle are candidates. First each prefix bucket links its classes to its most central class
(a star: as many pairs as entries), then pairs of classes of the same bucket that aren't connected yet are joined, under
the length, positional and suffix filters; each pair is verified once. So a large group of near copies costs no square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tropelens.llm.common import WHITE_BYTES, as_bytes, mixed, partitions, release, shards, word_hashes, written
from tropelens.llm.components import connected_components

#: Text of one block in a task: more lanes take larger blocks, so that packed arrays don't get too short.
BLOCK_BYTES, MOST_BLOCK_BYTES = 4 << 20, 24 << 20
#: Text whose shingles one lane takes: its arrays are a few times that.
LANE_BYTES = 32 << 20
#: Classes that a task remembers, so that it sends copies once.
SEEN_CLASSES = 150_000
SIGNATURE = 64
FREQUENT = np.iinfo(np.int32).max
# Odd multipliers of the places in a shingle.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles; fewer words than `width` are one shingle of their own
    kind, no words are none. A-Z are lower-cased, words are parted by the six ASCII white characters."""
    h, counts = word_hashes(texts, WHITE_BYTES)
    ends = np.cumsum(counts)
    out = []
    total = np.full(max(0, len(h) - width + 1), width, dtype=np.uint64)
    for k in range(width if len(total) else 0):
        total = mixed(total + h[k : k + len(total)] * PLACES[k % len(PLACES)])
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(total[end - n : end - width + 1]))
        elif n:
            short = np.full(1, n, dtype=np.uint64)
            for k in range(n):
                short = mixed(short + h[end - n + k : end - n + k + 1] * PLACES[k % len(PLACES)])
            out.append(short)
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def set_hash(shingles: np.ndarray) -> int:
    """A class: 64 bits of the set as a whole, as a signed number."""
    import xxhash

    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles)))))


def lanes(spark: SparkSession, text_bytes: int, lane_bytes: int) -> tuple[int, list[int]]:
    """(number of partitions, a key for each that Spark's hash sends there): packed arrays are dealt out evenly, to one lane
    for lane_bytes of text, so that what a task holds doesn't grow with the input; at least to the shuffle partitions set."""
    p = max(partitions(spark), -(-text_bytes // lane_bytes))
    found = spark.range(0, 16 * p + 64).groupBy(F.pmod(F.hash("id"), F.lit(p)).alias("to")).agg(F.min("id").alias("id")).orderBy("to").collect()
    return p, [r["id"] for r in found]


def packed(lane: np.ndarray, keys: list[int], kind: int, *columns: np.ndarray) -> Iterator[tuple]:
    """(lane key, kind, arrays as bytes) for each lane that has rows."""
    order = np.argsort(lane, kind="stable")
    ends = np.cumsum(np.bincount(lane, minlength=len(keys)))
    start = 0
    for k, end in enumerate(ends):
        if end > start:
            yield (keys[k], kind, *(c[order[start:end]].tobytes() for c in columns), *[b""] * (3 - len(columns)))
        start = end


PACKED = "lane long, kind int, a binary, b binary, c binary"
MEMBERS, TOKENS, FOUND = 0, 1, 2


def to_lanes(x: np.ndarray, n: int) -> np.ndarray:
    return ((x.astype(np.uint64) >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def tables(batch: pd.DataFrame, kind: int, *types: type) -> list[np.ndarray]:
    part = batch[batch["kind"] == kind]
    return [np.frombuffer(b"".join(part[c]), dtype=t) for c, t in zip("abc", types, strict=False)]


def frequent_shingles(docs: DataFrame, n: int, width: int, sample_docs: int, share: float) -> np.ndarray:
    """Shingles of at least `share` of a bounded sample of documents, sorted.

    They only change where a shingle's entries are dealt (with their class instead of with each other) and put it last in
    the order, the same way in every class; results are the same with any set. So no task gathers a shingle that a large
    share of all documents has.
    """
    step = -(-n // sample_docs) if n else 1
    rows = docs.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(step)) == 0)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in shards(batch, "text", BLOCK_BYTES):
                found = shingle_sets(list(part["text"]), width)
                values, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), [])
                yield pd.DataFrame({"h": values.view(np.int64), "n": counts}).astype({"n": "int64"})

    least = max(3, int(share * min(n, sample_docs)))
    got = rows.mapInPandas(sets, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h").toPandas()
    return np.sort(got["h"].to_numpy(dtype=np.int64).view(np.uint64))


def classes(docs: DataFrame, width: int, sample_docs: int = 5_000, frequent_share: float = 0.004, lane_bytes: int = LANE_BYTES) -> DataFrame:
    """docs (id long, text binary) -> one written table of two kinds of rows:

    members: (id, class, n_shingles); candidates: (class, n_shingles, n_single, shingles, signature) where shingles are
    those that other classes have too, rare first, and n_single is the number of all others.
    """
    spark = docs.sparkSession
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    p, keys = lanes(spark, total["bytes"] or 0, lane_bytes)
    n_lanes = len(keys)
    block = min(MOST_BLOCK_BYTES, max(BLOCK_BYTES, n_lanes << 15))
    common = spark.sparkContext.broadcast(frequent_shingles(docs, total["n"], width, sample_docs, frequent_share))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, frequent = set(), common.value
        for batch in batches:
            for part in shards(batch, "text", block):
                ids, nodes, sizes, own, owners = [], [], [], [], []
                for key, s in zip(part["id"], (s for small in shards(part, "text", BLOCK_BYTES) for s in shingle_sets(list(small["text"]), width)), strict=True):
                    node = set_hash(s) if len(s) else 0
                    ids.append(key)
                    nodes.append(node)
                    sizes.append(len(s))
                    if len(s) and node not in seen:  # copies add nothing
                        if len(seen) >= SEEN_CLASSES:
                            seen.clear()
                        seen.add(node)
                        own.append(s)
                        owners.append(node)
                nodes = np.array(nodes, dtype=np.int64)
                rows = list(packed(to_lanes(nodes.view(np.uint64), n_lanes), keys, MEMBERS, np.array(ids, dtype=np.int64), nodes, np.array(sizes, dtype=np.int64)))
                if own:
                    tokens = np.concatenate(own)
                    owner = np.repeat(np.array(owners, dtype=np.int64), [len(s) for s in own])
                    often = np.isin(tokens, frequent) if len(frequent) else np.zeros(len(tokens), dtype=bool)
                    rows += packed(to_lanes(owner[often].view(np.uint64), n_lanes), keys, FOUND, owner[often], tokens[often], np.full(often.sum(), FREQUENT, dtype=np.int32))
                    tokens, owner = tokens[~often], owner[~often]
                    # owners as runs: a lane has several shingles of each class
                    lane = to_lanes(tokens, n_lanes)
                    order = np.argsort(lane, kind="stable")
                    tokens, owner, lane = tokens[order], owner[order], lane[order]
                    ends = np.cumsum(np.bincount(lane, minlength=n_lanes))
                    start = 0
                    for k, end in enumerate(ends):
                        if end > start:
                            o = owner[start:end]
                            first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
                            runs = np.diff(np.append(first, len(o))).astype(np.int32)
                            rows.append((keys[k], TOKENS, tokens[start:end].tobytes(), o[first].tobytes(), runs.tobytes()))
                        start = end
                yield pd.DataFrame(rows, columns=["lane", "kind", "a", "b", "c"])
                del rows, own, part
                release()

    def counted(batch: pd.DataFrame) -> pd.DataFrame:
        """Keeps the shingles of two classes or more, each with its frequency, and sends them to their class's lane."""
        part = batch[batch["kind"] == TOKENS]
        rows = list(batch[batch["kind"] != TOKENS].itertuples(index=False, name=None))
        tokens = np.frombuffer(b"".join(part["a"]), dtype=np.uint64)
        owner = np.repeat(np.frombuffer(b"".join(part["b"]), dtype=np.int64), np.frombuffer(b"".join(part["c"]), dtype=np.int32))
        order = np.argsort(tokens, kind="stable")
        ordered = tokens[order]
        equal = ordered[1:] == ordered[:-1]
        twice = np.zeros(len(order), dtype=bool)
        twice[1:] |= equal
        twice[:-1] |= equal
        order = order[twice]  # most shingles occur once and end here
        tokens, owner = tokens[order], owner[order]
        del ordered, equal, twice, part
        if len(tokens):
            order = np.lexsort((owner, tokens))
            tokens, owner = tokens[order], owner[order]
            new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])])  # copies from several tasks
            tokens, owner = tokens[new], owner[new]
            first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            n = np.diff(np.append(first, len(tokens)))
            n = np.repeat(n, n)
            tokens, owner, n = tokens[n > 1], owner[n > 1], n[n > 1].astype(np.int32)
            rows += packed(to_lanes(owner.view(np.uint64), n_lanes), keys, FOUND, owner, tokens, n)
        release()
        return pd.DataFrame(rows, columns=["lane", "kind", "a", "b", "c"])

    def gathered(batch: pd.DataFrame) -> pd.DataFrame:
        ids, nodes, sizes = tables(batch, MEMBERS, np.int64, np.int64, np.int64)
        owner, tokens, n = tables(batch, FOUND, np.int64, np.uint64, np.int32)
        out = pd.DataFrame({"id": ids, "class": nodes, "n_shingles": sizes, "n_single": -1, "shingles": None, "signature": None})
        order = np.lexsort((tokens, n, owner))
        owner, tokens = owner[order], tokens[order]
        if not len(owner):
            return out
        fresh = np.concatenate([[True], (owner[1:] != owner[:-1]) | (tokens[1:] != tokens[:-1])])
        owner, tokens = owner[fresh], tokens[fresh]
        size_of = dict(zip(nodes.tolist(), sizes.tolist(), strict=True))
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        rows = []
        for a, b in zip(first, np.append(first[1:], len(owner)), strict=True):
            size = size_of[int(owner[a])]
            single = size - (b - a)
            if single < prefix_length(size):
                t = tokens[a:b]
                rows.append((0, int(owner[a]), size, int(single), t.view(np.int64).tolist(), np.bincount((t & np.uint64(SIGNATURE - 1)).astype(np.int64), minlength=SIGNATURE).tolist()))
        release()
        return pd.concat([out, pd.DataFrame(rows, columns=out.columns)]) if rows else out

    moved = docs.mapInPandas(hashed, PACKED).repartition(p, "lane")
    found = moved.groupBy("lane").applyInPandas(counted, PACKED).repartition(p, "lane")
    schema = "id long, class long, n_shingles long, n_single long, shingles array<long>, signature array<int>"
    return written(found.groupBy("lane").applyInPandas(gathered, schema), "classes")


def prefix_length(n: int) -> int:
    """Shingles of a set of n of which a partner at 0.75 must share one: n - ceil(0.75 n) + 1."""
    return n - -(-3 * n // 4) + 1


def entries(candidates: DataFrame) -> DataFrame:
    """A row for each shingle in a class's prefix that another class has too, with its place in the whole order."""
    n, single = F.col("n_shingles"), F.col("n_single")
    length = n - F.ceil(3 * n / 4) + 1 - single
    rows = candidates.withColumn("__prefix", F.slice("shingles", F.lit(1), F.greatest(length, F.lit(0)).cast("int")))
    rows = rows.select("class", "n_shingles", "n_single", "signature", F.posexplode("__prefix").alias("at", "shingle"))
    return rows.withColumn("at", F.col("at") + F.col("n_single"))


def needed(n: Column, m: Column) -> Column:
    """The least intersection of sets of n and m with Jaccard 0.75: ceil(3 (n + m) / 7)."""
    return F.floor((3 * (n + m) + 6) / 7)


def star_pairs(rows: DataFrame, hot_entries: int, salts: int) -> DataFrame:
    """Each bucket's classes with its pivot, the class with the smallest share of single shingles. Buckets of more than
    hot_entries are split by salt, and their parts' pivots linked in a second step."""
    hot = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_entries).select("shingle", F.lit(True).alias("__hot"))
    rows = rows.join(hot, "shingle", "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64("class"), F.lit(salts))).otherwise(F.lit(0)))
    best = F.struct((F.col("n_single") / F.col("n_shingles")).alias("share"), F.col("class").alias("pivot"), F.col("n_shingles").alias("m"))
    local = rows.withColumn("__best", F.min(best).over(Window.partitionBy("shingle", "__salt")))
    over = local.where("__hot").select("shingle", "__best").distinct().withColumn("__top", F.min("__best").over(Window.partitionBy("shingle")))
    pairs = local.select(F.col("class").alias("x"), F.col("n_shingles").alias("n"), F.col("__best.pivot").alias("y"), F.col("__best.m").alias("m"))
    pairs = pairs.union(over.select(F.col("__best.pivot"), F.col("__best.m"), F.col("__top.pivot"), F.col("__top.m")))
    pairs = pairs.where((F.col("x") != F.col("y")) & (4 * F.least("n", "m") >= 3 * F.greatest("n", "m")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def bucket_pairs(rows: DataFrame, apart: bool, part: int = 2_000) -> DataFrame:
    """Pairs of classes that share a prefix shingle and pass the filters; with `apart`, only of different components.

    Length: the smaller set has at least three quarters of the larger one's size; classes meet in bands of a factor 4/3 of
    their size, their own and the next. Positional: after the shared shingle enough of both sets is left; single
    shingles, which stand first, can't be shared. Suffix: the sets fall into 64 parts by hash, and the parts' smaller
    counts together bound the intersection.

    A band of a bucket with more than `part` classes is split: one side is dealt to slices of that size by hash, the other
    goes to every slice, so that no task has all of its pairs.
    """
    rows = rows.withColumn("band", F.floor(F.log("n_shingles") / F.log(F.lit(4 / 3))).cast("int"))
    sizes = rows.groupBy("shingle", "band").agg(F.count(F.lit(1)).alias("__n"))
    hot = sizes.where(F.col("__n") > part).select("shingle", "band", F.ceil(F.col("__n") / part).cast("int").alias("slices"))
    hot = written(hot, "hot")
    x = rows.join(hot, ["shingle", "band"], "left").withColumn("slice", F.when(F.col("slices").isNull(), 0).otherwise(F.pmod(F.xxhash64("class"), F.col("slices"))).cast("int"))
    y = rows.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).join(hot, ["shingle", "band"], "left")
    y = y.withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)))
    x, y = x.alias("x"), y.alias("y")
    n, m = F.col("x.n_shingles"), F.col("y.n_shingles")
    on = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.slice") == F.col("y.slice")) & (F.col("x.class") < F.col("y.class"))
    if apart:
        on &= F.col("x.component") != F.col("y.component")
    on &= 4 * F.least(n, m) >= 3 * F.greatest(n, m)
    on &= F.least(n - F.col("x.at"), m - F.col("y.at")) >= needed(n, m)
    bound = F.aggregate(F.zip_with("x.signature", "y.signature", lambda p, q: F.least(p, q)), F.lit(0), lambda s, v: s + v)
    return x.join(y, on & (bound >= needed(n, m))).select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()


def verified(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(a, b, common, linked): the exact test, once a pair."""
    sets = candidates.select("class", "n_shingles", "shingles")
    x = sets.select(F.col("class").alias("a"), F.col("n_shingles").alias("n"), F.col("shingles").alias("s"))
    y = sets.select(F.col("class").alias("b"), F.col("n_shingles").alias("m"), F.col("shingles").alias("t"))
    both = pairs.join(x, "a").join(y, "b").withColumn("common", F.size(F.array_intersect("s", "t")).cast("long"))
    union = F.col("n") + F.col("m") - F.col("common")
    return both.select("a", "b", "common", (F.col("common") / union).alias("jaccard"), (100 * F.col("common") >= 75 * union).alias("linked"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, hot_entries: int = 50_000, salts: int = 64, lane_bytes: int = LANE_BYTES) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links, its own included), class_id.

    Two documents link when the Jaccard similarity of their sets of distinct `width`-word shingles (A-Z lower-cased; a
    shorter text is one shingle as a whole) is 0.75 or more. Null, empty and blank texts have no shingles and link with
    nothing. Repeated rows are each returned, and link as documents with equal sets do. Ids are whole numbers; a row with
    a null id gets its n_shingles, links nothing and has a null component. An empty table gives an empty result. Very long
    texts are hashed whole; ties in the order of shingles go by their hash. Extra columns are ignored. Shingles and classes
    are compared under 64-bit hashes. A task holds the packed shingles of lane_bytes of text; for many TB take more.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), as_bytes(F.col(text_col)).alias("text"))
    table = classes(base.where("id is not null"), width, lane_bytes=lane_bytes)
    members = table.where("n_single < 0").select("id", "class", "n_shingles")
    candidates = table.where("n_single >= 0").drop("id")
    rows = entries(candidates)

    first = written(verified(star_pairs(rows, hot_entries, salts), candidates), "star")
    linked = connected_components(first.where("linked").select("a", "b"))
    rows = rows.join(linked.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    rows = written(rows, "entries")
    open_ = rows.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("shingle")
    rest = bucket_pairs(rows.join(open_, "shingle", "left_semi"), apart=True).join(first.select("a", "b"), ["a", "b"], "left_anti")
    second = written(verified(rest, candidates).where("linked"), "rest")
    linked = connected_components(first.where("linked").select("a", "b").union(second.select("a", "b")))

    full = members.where("n_shingles > 0")
    of_class = class_components(full, linked)
    out = full.join(of_class, "class").select("id", "n_shingles", "component_id", F.col("class").alias("class_id"))
    blank = members.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"), F.lit(None).cast("long").alias("class_id"))
    nameless = base.where("id is null").select("id", unnamed_count(F.col("text"), width).alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(None).cast("long").alias("class_id"))
    return out.union(blank).union(nameless).withColumnRenamed("id", id_col)


def class_components(members: DataFrame, linked: DataFrame) -> DataFrame:
    """(class, component_id) of all classes, written: the smallest id of the class's component.

    Ids are reduced within classes and classes within components before they meet, and both sides of each join are plain
    tables: a class or component with a large share of all rows is then split by Spark's own handling of skewed joins.
    """
    first = members.groupBy("class").agg(F.min("id").alias("first"))
    first = written(first.join(linked.select(F.col("node").alias("class"), "component"), "class", "left"), "firsts")
    several = first.where("component is not null")
    least = written(several.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    alone = first.where("component is null").select("class", F.col("first").alias("component_id"))
    return written(several.join(least, "component").select("class", "component_id").union(alone), "of_class")


def unnamed_count(text: Column, width: int) -> Column:
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(s) for part in shards(pd.DataFrame({"text": texts}), "text", BLOCK_BYTES) for s in shingle_sets(list(part["text"]), width)], dtype="int64")

    return count(text)


def all_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members: id, class, n_shingles; links: a, b, common, jaccard): the whole join between classes, every link once."""
    table = classes(docs.select(F.col(id_col).cast("long").alias("id"), as_bytes(F.col(text_col)).alias("text")).where("id is not null"), width)
    candidates = table.where("n_single >= 0").drop("id")
    links = verified(bucket_pairs(entries(candidates), apart=False), candidates).where("linked").drop("linked")
    return table.where("n_single < 0").select("id", "class", "n_shingles"), links


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = w.doc_id
"""
