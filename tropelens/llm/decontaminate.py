"""Benchmark decontamination with a distributed positional inverted index.

The documents are read once: each task writes the token postings of its documents to the shared folder, a row for each
shard of about two megabytes of whole documents, with the sorted hashes of its terms, the list of positions of each term, and
where its documents begin. Test windows meet the stored shards in blocks of bounded size. A window is searched from the
list of the term that is rarest in all documents on; the lists of its further terms, shifted by their offsets, are
intersected with it one after the other. So neither order nor result depends on how documents are dealt, a further block
reads postings only, and a passage that a third of all documents share costs each shard its own part only. Findings are
kept by a 128-bit hash of the text, once for equal texts, and joined to the documents at the end.

Terms are compared under 64-bit hashes: a collision could take one word for another, with a chance of about terms^2 / 2^65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tropelens.llm.common import ALNUM_BYTES, as_bytes, shards, small_batches, word_hashes, written

SHARD_BYTES = 2 << 20
#: Test windows of one block: what a task holds of the benchmark at once.
BLOCK_WINDOWS = 1 << 18
INDEX = "keys binary, doc_start binary, terms binary, sizes binary, positions binary"
#: Rows are large: the writer looks at its buffer every few rows.
WRITE = {"compression": "zstd", "parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "4", "parquet.page.size.row.check.min": "1"}
FOUND = "k1 long, k2 long, spans array<long>, items array<string>, near array<long>, near_spans array<long>, near_items array<string>"


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all bytes of other characters; A-Z lower-cased."""
    return text.translate(ALNUM_BYTES).split()


class TestWindows:
    """The windows of a block of test items, as term numbers in a matrix; short items pad their one window with -1."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.width, self.terms, owners = width, {}, {}
        for item, text in items:
            words = words_of(text)
            ids = tuple(self.terms.setdefault(w, len(self.terms)) for w in words)
            for k in range(max(1, len(ids) - width + 1) if ids else 0):
                owners.setdefault(ids[k : k + width], set()).add(item)
        rows = list(owners)
        self.owners = [sorted(owners[r]) for r in rows]
        self.sizes = np.array([len(r) for r in rows], dtype=np.int64)
        self.matrix = np.array([r + (-1,) * (width - len(r)) for r in rows], dtype=np.int64).reshape(-1, width)
        self.order = np.tile(np.arange(width), (len(rows), 1))
        names = list(self.terms)
        digests = (hashlib.blake2b(b" ".join(names[i] for i in r), digest_size=8).digest() for r in rows)
        self.keys = np.array([int.from_bytes(x, "big", signed=True) for x in digests], dtype=np.int64)  # the same in all blocks
        hashes, _ = word_hashes(names, ALNUM_BYTES)
        self.by_hash = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.by_hash]

    def meet(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(term numbers of the block, places in `terms`) of the terms that a shard has too."""
        at = np.searchsorted(self.hashes, terms)
        same = np.append(self.hashes, np.uint64(0))[at] == terms
        same &= at < len(self.hashes)
        return self.by_hash[at[same]], np.flatnonzero(same)

    def rank(self, counts: np.ndarray) -> None:
        """Orders each window's offsets by its terms' counts in all documents, rarest first; padding comes last."""
        if len(self.matrix):
            self.order = np.argsort(np.where(self.matrix >= 0, counts[self.matrix], np.iinfo(np.int64).max), axis=1, kind="stable")


def expanded(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its posting list: (row numbers, indices into the postings)."""
    rows = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return rows, np.arange(len(rows)) - first[rows] + starts[rows]


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers byte by byte: first all lowest bytes, and so on. The high ones repeat, so that files get small."""
    return np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<i4").reshape(-1).astype(np.int64)


def shard_row(keys: list[tuple[int, int]], texts: list[bytes]) -> tuple[bytes, ...]:
    """One shard of the index: the documents' keys and first positions, the terms, the lengths of their lists, and the lists
    one after the other. Documents are one position apart, so that no window crosses them."""
    tokens, counts = word_hashes(texts, ALNUM_BYTES)
    starts = np.concatenate([[0], np.cumsum(counts + 1)])
    at = np.arange(len(tokens)) + np.repeat(np.arange(len(texts)), counts)
    order = np.argsort(tokens, kind="stable")
    tokens = tokens[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])[: len(tokens)])
    sizes = np.diff(np.append(first, len(tokens)))
    return np.array(keys, dtype=np.int64).tobytes(), planes(starts), tokens[first].tobytes(), planes(sizes), planes(at[order])


def positional_index(docs: DataFrame) -> DataFrame:
    """docs (k1, k2, text binary) -> the written index, a row a shard. Texts without words have no place in it."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in shards(batch, "text", SHARD_BYTES):
                yield pd.DataFrame([shard_row(list(zip(part["k1"], part["k2"], strict=True)), list(part["text"]))], columns=[x.split()[0] for x in INDEX.split(", ")])

    return written(docs.mapInPandas(build, INDEX), "postings", **WRITE)


class Shard:
    """A stored shard, as far as a block's terms go: lists of positions by term number."""

    def __init__(self, row, windows: TestWindows):
        self.doc_keys = np.frombuffer(row.keys, dtype=np.int64).reshape(-1, 2)
        self.doc_start = numbers(row.doc_start)
        self.length = int(self.doc_start[-1])
        term, place = windows.meet(np.frombuffer(row.terms, dtype=np.uint64))
        order = np.argsort(term, kind="stable")
        term, place = term[order], place[order]
        all_sizes = numbers(row.sizes)
        sizes, first = all_sizes[place], (np.cumsum(all_sizes) - all_sizes)[place]
        rows, at = expanded(first, sizes)
        self.postings = numbers(row.positions)[at]
        self.count = np.zeros(len(windows.terms), dtype=np.int64)
        self.count[term] = sizes
        self.first = np.cumsum(self.count) - self.count
        self.stride = self.length + 1
        self.keys = term[rows] * self.stride + self.postings
        self.term_at = term[rows]

    def within(self, term: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The first position of each term's list from lo to hi, or -1."""
        lo = np.maximum(lo, 0)
        at = np.searchsorted(self.keys, term * self.stride + lo)
        found = np.append(self.keys, np.iinfo(np.int64).max)[at]
        return np.where(found <= term * self.stride + np.minimum(hi, self.length), found - term * self.stride, -1)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_start, at, side="right") - 1

    def search(self, windows: TestWindows, slop: int, chunk: int = 1 << 18) -> Iterator[tuple[np.ndarray, ...]]:
        """(window numbers, start positions, positions of the rarest term, exact) of all exact occurrences, and of the
        places in proximity.

        A window is in proximity where its two rarest terms (in all documents; the earlier ones on ties) stand within
        `slop` places of their due distance, but the phrase as a whole doesn't match.
        """
        m = windows.matrix
        present = np.append(self.count, 1) > 0  # the padding, -1, is no obstacle
        pair = np.take_along_axis(m, windows.order[:, :2], axis=1)
        live = np.flatnonzero(present[pair].all(axis=1)) if len(m) else np.empty(0, dtype=np.int64)
        order = windows.order[live]
        rare = order[:, 0]
        lists = self.count[m[live, rare]] if len(live) else np.empty(0, dtype=np.int64)
        ends = np.cumsum(lists)
        for k in range(0, int(ends[-1]) if len(ends) else 0, chunk):  # slices of the lists, however long one is
            lo = np.maximum(0, k - (ends - lists))
            n = np.clip(np.minimum(ends, k + chunk) - np.maximum(ends - lists, k), 0, None)
            rows, at = expanded(self.first[m[live, rare]] + lo, n)
            seen = self.postings[at]
            start = seen - rare[rows]
            exact, left = start >= 0, np.flatnonzero(start >= 0)
            for step in range(1, windows.width):  # the next rarest term's list, shifted by its offset
                offset = order[rows[left], step]
                term, due = m[live[rows[left]], offset], start[left] + offset
                ok = (term < 0) | (self.within(np.maximum(term, 0), due, due) >= 0)
                exact[left[~ok]] = False
                left = left[ok]
            near = np.zeros(len(rows), dtype=bool)
            if windows.width > 1 and slop:
                second = order[rows, 1]
                term, doc = m[live[rows], second], self.doc_of(seen)
                lo, hi = np.maximum(start + second - slop, self.doc_start[doc]), np.minimum(start + second + slop, self.doc_start[doc + 1] - 2)
                near = (term >= 0) & (lo <= hi) & (self.within(np.maximum(term, 0), lo, hi) >= 0)
            near &= ~exact
            keep = exact | near
            yield live[rows[keep]], start[keep], seen[keep], exact[keep]

    def near_search(self, windows: TestWindows, slop: int, exact: np.ndarray, chunk: int = 1 << 18) -> Iterator[tuple[np.ndarray, ...]]:
        """(window numbers, first and last position) of the places where a window stands with changes.

        One in five of a window's terms may lack (of ten, two). Starting from each place of its rarest terms, one more than
        may lack, the others must stand within `slop` places of their due places in the same document, and so many terms
        must come in the window's order. exact: window * stride + start of the exact occurrences, ordered; a place at most
        `slop` beside one of the same window is no other find.
        """
        m, sizes, spare = windows.matrix, windows.sizes, windows.sizes // 5
        present = np.append(self.count, 0) > 0
        live = np.flatnonzero((sizes > 1) & (present[m].sum(axis=1) >= sizes - spare)) if len(m) else np.empty(0, dtype=np.int64)
        for rank in range(int(spare[live].max()) + 1 if len(live) else 0):
            some = live[spare[live] >= rank]
            anchor = windows.order[some, rank]
            lists = self.count[m[some, anchor]]
            ends = np.cumsum(lists)
            for k in range(0, int(ends[-1]) if len(ends) else 0, chunk):
                lo = np.maximum(0, k - (ends - lists))
                n = np.clip(np.minimum(ends, k + chunk) - np.maximum(ends - lists, k), 0, None)
                rows, at = expanded(self.first[m[some, anchor]] + lo, n)
                w, seen = some[rows], self.postings[at]
                start, first, last, lacking = seen - anchor[rows], seen, seen, np.zeros(len(rows), dtype=np.int64)
                doc = self.doc_of(seen)
                begin, end = self.doc_start[doc], self.doc_start[doc + 1] - 2
                for step in range(windows.width):
                    if step == rank:
                        continue
                    offset = windows.order[w, step]
                    term, due = m[w, offset], start + offset
                    got = self.within(np.maximum(term, 0), np.maximum(due - slop, begin), np.minimum(due + slop, end))
                    got = np.where(term >= 0, got, -1)
                    lacking = lacking + ((term >= 0) & (got < 0))
                    first, last = np.where(got >= 0, np.minimum(first, got), first), np.maximum(last, got)
                    left = lacking <= spare[w]
                    w, start, first, last, lacking, begin, end = (x[left] for x in (w, start, first, last, lacking, begin, end))
                key = w * self.stride + start
                other = np.append(exact, np.iinfo(np.int64).max)[np.searchsorted(exact, key - slop)] > key + slop
                w, start, first, last, begin, end = (x[other] for x in (w, start, first, last, begin, end))
                ordered = self.in_order(m[w], start - slop, begin, end, windows.width + 2 * slop) >= sizes[w] - spare[w]
                yield w[ordered], first[ordered], last[ordered]

    def in_order(self, rows: np.ndarray, start: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
        """How many terms of each row come in order, each at a place of its own, among the `length` places from start."""
        best = np.zeros((length + 1, len(rows)), dtype=np.int64)
        if not len(rows):
            return best[-1]
        if not hasattr(self, "tokens"):  # the block's terms at their places
            self.tokens = np.full(self.length, -1)
            self.tokens[self.postings] = self.term_at
        places = start + np.arange(length)[:, None]
        inside = (places >= begin) & (places <= end)
        tokens = np.where(inside, self.tokens[np.where(inside, places, 0)], -1)
        for j in range(rows.shape[1]):
            same = (tokens == rows[:, j]) & (rows[:, j] >= 0)
            now = np.zeros_like(best)
            now[1:] = np.maximum(best[1:], best[:-1] + same)
            best = np.maximum.accumulate(now, axis=0)
        return best[-1]

    def report(self, windows: TestWindows, slop: int) -> Iterator[tuple]:
        """Rows of FOUND: a document's spans of hit words, its items, the keys of windows whose rarest pair is near, then
        spans and items of the places with changes. Documents without any have no row, repeated ones have one."""
        size, n = max(1, len(windows.sizes)), len(self.doc_keys)
        marks, near_marks = np.zeros(self.length + 1, dtype=np.int64), np.zeros(self.length + 1, dtype=np.int64)
        none = np.empty(0, dtype=np.int64)
        pairs, near_pairs, change_pairs, exacts = [none], [none], [none], [none]
        for window, start, seen, exact in self.search(windows, slop):
            w, s = window[exact], start[exact]
            np.add.at(marks, s, 1)
            np.add.at(marks, s + windows.sizes[w], -1)
            exacts.append(w * self.stride + s)
            doc = self.doc_of(seen)
            pairs.append(np.unique(doc[exact] * size + w))
            near_pairs.append(np.unique(doc[~exact] * size + window[~exact]))
        for w, first, last in self.near_search(windows, slop, np.unique(np.concatenate(exacts))) if slop else ():
            np.add.at(near_marks, first, 1)
            np.add.at(near_marks, last + 1, -1)
            change_pairs.append(np.unique(self.doc_of(first) * size + w))
        items, near_items = ({d: set() for d in range(n)} for _ in range(2))
        keys: list[list[int]] = [[] for _ in range(n)]
        for found, out in ((pairs, items), (change_pairs, near_items)):
            for pair in np.unique(np.concatenate(found)):
                out[int(pair // size)].update(windows.owners[pair % size])
        for pair in np.unique(np.concatenate(near_pairs)):
            keys[pair // size].append(int(windows.keys[pair % size]))
        spans, near_spans = self.spans(np.cumsum(marks[:-1]) > 0), self.spans(np.cumsum(near_marks[:-1]) > 0)
        done = set()
        for d in range(n):
            key = (int(self.doc_keys[d, 0]), int(self.doc_keys[d, 1]))
            if (items[d] or keys[d] or near_items[d]) and key not in done:
                done.add(key)
                yield (*key, spans.get(d, []), sorted(items[d]), keys[d], near_spans.get(d, []), sorted(near_items[d]))

    def spans(self, hit: np.ndarray) -> dict[int, list[int]]:
        """Per document the hit runs as start, end, start, end ... in word numbers."""
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
        out: dict[int, list[int]] = {}
        for d, a, b in zip(self.doc_of(edges[::2]).tolist(), edges[::2], edges[1::2], strict=True):
            out.setdefault(d, []).extend((int(a - self.doc_start[d]), int(b - self.doc_start[d])))
        return out


def item_parts(words: list[bytes], width: int, most: int) -> Iterator[tuple[int, list[bytes]]]:
    """(number of windows, words) of an item, cut so that a part has at most `most` windows: parts overlap by width - 1 words,
    and every window is in exactly one. Items without words have none."""
    windows = max(1, len(words) - width + 1) if words else 0
    for k in range(0, windows, most):
        n = min(most, windows - k)
        yield n, words[k : k + n + width - 1]


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, width: int, block_windows: int) -> Iterator[TestWindows]:
    """The test items in blocks of at most block_windows windows, one at a time on the driver. A long item is cut over blocks;
    findings of all blocks are united under its id."""
    items, windows = [], 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), as_bytes(F.col(text_col)).alias("text")).orderBy("item", "text")
    for row in rows.toLocalIterator():
        for n, words in item_parts(words_of(bytes(row["text"])), width, block_windows):
            if windows + n > block_windows:
                yield TestWindows(items, width)
                items, windows = [], 0
            items.append((row["item"] or "", b" ".join(words)))
            windows += n
    if items:
        yield TestWindows(items, width)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
    slop: int = 3,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """docs with n_words, n_hit, hit_spans, n_items, items, items_sha256, contaminated, n_near, near_items and near_spans added.

    A window is `width` consecutive words of a test item, or a shorter item as a whole. A document's words inside exact
    occurrences are hit; items are those with an occurring window. n_near counts the windows whose two rarest terms are in
    proximity, without the phrase as a whole. near_items and near_spans (as hit_spans) are the items and places of windows
    with changes: at least four in five of their terms, in order, within `slop` of their due places (see near_search).

    The benchmark is a query set: its blocks, each of at most block_windows windows (a long item is cut over blocks), meet the stored index one after the other, and
    the findings of all blocks are joined to the documents at the end; no block reads or moves a document. n_hit counts the
    union of the blocks' hit words. hit_spans has the hit runs as word numbers: start, end, start, end ...

    Null and empty texts have no words and no hits; items without words have no windows; a null item id counts as the
    empty string; repeated rows are each reported; very long texts are a shard of their own; ties of term counts go to the
    earlier word; a benchmark without windows hits nothing. Columns of docs are kept, those with names of added columns are
    replaced.
    """
    names = ("n_words", "n_hit", "n_items", "items", "items_sha256", "n_near", "contaminated", "hit_spans", "near_items", "near_spans")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumns({"__k1": F.xxhash64(text), "__k2": F.xxhash64(F.lit(17), text)})
    index = positional_index(keyed.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), as_bytes(F.col(text_col)).alias("text")).where("octet_length(text) > 0"))
    blocks = [block_findings(index, windows, slop) for windows in benchmark_blocks(benchmark, item_col, item_text_col, width, block_windows)]
    found = merged(blocks) if blocks else docs.sparkSession.createDataFrame([], FOUND)
    found = found.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.struct(*[x.split()[0] for x in FOUND.split(", ")[2:]]).alias("__found"))
    keyed = keyed.select(*[c for c in docs.columns if c not in names], "__k1", "__k2", word_count(text).alias("n_words"))
    out = keyed.join(found, ["__k1", "__k2"], "left")

    def got(name: str, kind: str) -> Column:
        return F.coalesce(F.col(f"__found.{name}"), F.array().cast(f"array<{kind}>"))

    out = out.withColumns(
        {
            "hit_spans": got("spans", "long"),
            "items": got("items", "string"),
            "near_items": got("near_items", "string"),
            "near_spans": got("near_spans", "long"),
            "n_near": F.size(got("near", "long")).cast("long"),
        }
    )
    ends = F.aggregate(F.transform("hit_spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda n, x: n + x)
    out = out.withColumns({"n_hit": ends, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ",").cast("binary"), 256)})
    return out.withColumn("contaminated", F.col("n_hit") > 0).drop("__k1", "__k2", "__found")


#: The bytes that part words, one by one: the engine tests such a class by a bit set.
PARTING = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())


def word_count(text: Column) -> Column:
    """Words of a text that isn't null, from the runs of what parts them."""
    ends = [F.substring(text, 1, 1), F.right(text, F.lit(1))]
    outside = sum(x.rlike(f"[{PARTING}]").cast("long") for x in ends)
    return F.when(text == "", F.lit(0)).otherwise(F.regexp_count(text, F.lit(f"[{PARTING}]++")) + 1 - outside).cast("long")


def term_counts(index: DataFrame, windows: TestWindows) -> np.ndarray:
    """How often each term of a block stands in all documents, from the lengths of its lists: summed within each task first."""
    total = np.zeros(len(windows.terms), dtype=np.int64)
    if not len(total):
        return total
    shared = index.sparkSession.sparkContext.broadcast(windows)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows = shared.value
        n = np.zeros(len(windows.terms), dtype=np.int64)
        for batch in batches:
            for terms, sizes in zip(batch["terms"], batch["sizes"], strict=True):
                term, place = windows.meet(np.frombuffer(terms, dtype=np.uint64))
                n[term] += numbers(sizes)[place]
        at = np.flatnonzero(n)
        yield pd.DataFrame({"term": at, "n": n[at]})

    with small_batches(index.sparkSession, 64):
        for row in index.select("terms", "sizes").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
            total[row["term"]] = row["n"]
    shared.unpersist()
    return total


def block_findings(index: DataFrame, windows: TestWindows, slop: int) -> DataFrame:
    """Rows of FOUND for one block, a row for each different text, written."""
    windows.rank(term_counts(index, windows))
    shared = index.sparkSession.sparkContext.broadcast(windows)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows = shared.value
        names = [x.split()[0] for x in FOUND.split(", ")]
        for batch in batches:
            yield pd.DataFrame([found for row in batch.itertuples(index=False) for found in Shard(row, windows).report(windows, slop)], columns=names)

    with small_batches(index.sparkSession, 8):
        found = index.mapInPandas(search, FOUND)
        values = [x.split()[0] for x in FOUND.split(", ")[2:]]
        return written(found.groupBy("k1", "k2").agg(F.first(F.struct(*values)).alias("v")).select("k1", "k2", "v.*"), "findings")


def merged(blocks: list[DataFrame]) -> DataFrame:
    """The findings of all blocks, a row for each different text: spans are united, items and keys counted once."""
    if len(blocks) == 1:
        return blocks[0].withColumns({"items": F.array_sort("items"), "near_items": F.array_sort("near_items")})
    rows = blocks[0]
    for block in blocks[1:]:
        rows = rows.union(block)
    sets = {c: F.array_distinct(F.flatten(F.collect_list(c))) for c in ("items", "near", "near_items")}
    runs = {c: F.flatten(F.collect_list(F.transform(F.filter(c, lambda x, i: i % 2 == 0), lambda x, i: F.struct(x.alias("a"), F.get(c, 2 * i + 1).alias("b"))))) for c in ("spans", "near_spans")}
    out = rows.groupBy("k1", "k2").agg(*(x.alias(c) for c, x in (sets | runs).items()))
    out = out.withColumns({"items": F.array_sort("items"), "near_items": F.array_sort("near_items"), "spans": united("spans"), "near_spans": united("near_spans")})
    return out.select(*[x.split()[0] for x in FOUND.split(", ")])


def united(column: str) -> Column:
    """array<struct<a, b>> of runs -> start, end, start, end ... of their union."""
    none = F.array().cast("array<bigint>")

    def add(out: Column, run: Column) -> Column:
        last = F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(-1))
        longer = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.greatest(last, run["b"])))
        return F.when((F.size(out) > 0) & (run["a"] <= last), longer).otherwise(F.concat(out, F.array(run["a"], run["b"])))

    return F.aggregate(F.array_sort(column), none, add)


def query(spark, sf_dir: str) -> DataFrame:
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs.select("doc_id", "text"), items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g))),
h AS (SELECT rid, i, p.n, item_id FROM p JOIN g ON p.g = g.g AND p.n = g.n),
k AS (SELECT rid, count(DISTINCT spot) AS n FROM (SELECT rid, unnest(range(i, i + n)) AS spot FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid),
m AS (SELECT rid, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item_id FROM h) GROUP BY rid),
t AS (SELECT rid, w[i] AS x, i FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c AS (SELECT x, count(*) AS n FROM t GROUP BY x),
o AS (SELECT g, list(j ORDER BY coalesce(c.n, 0), j) AS js, list(x ORDER BY coalesce(c.n, 0), j) AS xs
  FROM (SELECT g, string_split(g, ' ')[j] AS x, j FROM (SELECT g, unnest(range(1, n + 1)) AS j FROM (SELECT DISTINCT g, n FROM g))) LEFT JOIN c USING (x) GROUP BY g),
near AS (SELECT a.rid, count(DISTINCT o.g) AS n FROM o JOIN t a ON a.x = o.xs[1] JOIN t b ON b.rid = a.rid AND b.x = o.xs[2] AND b.i - a.i - (o.js[2] - o.js[1]) BETWEEN -3 AND 3
  WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.rid = a.rid AND p.g = o.g AND p.i = a.i - o.js[1] + 1) GROUP BY a.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(k.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items, sha256(coalesce(m.s, '')) AS items_sha256, coalesce(k.n, 0) > 0 AS contaminated, coalesce(near.n, 0)::BIGINT AS n_near
FROM d LEFT JOIN k USING (rid) LEFT JOIN m USING (rid) LEFT JOIN near USING (rid)
"""
