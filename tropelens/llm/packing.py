"""Mixture-controlled packing: every sequence holds the sources in their target proportions.

Each source is a queue of tokens. Where a queue stands after any number of blocks (256 sequences) follows from the queues'
lengths and weights alone, so each row finds its block without looking at any other row; what a queue is owed in fractions of
a packet is carried from block to block, and so from partition to partition. Within a block deficit round-robin serves the
queues: a round adds a queue's share of a sequence to its deficit, and a packet goes out once the deficit covers it; what
is left is carried to the next sequence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from tropelens.llm.common import BROADCAST_BYTES, site_key, small_batches, written

#: Tokens of a document that are stored in one row at most.
ROW_TOKENS = 8192
#: Sequences that are laid out by one task at a time.
BLOCK = 256
WHITE_RUN = re.compile(r"\s{2000}")
_encoders: dict[tuple, Encoder] = {}


class Encoder:
    """Token ids as the tokenizers library gives them.

    With a rank file of the same vocabulary the faster tiktoken does the work; texts where the two could differ (with a
    special token's string) or where tiktoken's expression runs out of stack (long white space) go to tokenizers.
    """

    def __init__(self, path: str, ranks: str | None, pattern: str | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.size, self.fast = self.whole.get_vocab_size(), None
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special) or (len(text) >= 2000 and WHITE_RUN.search(text)):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


def encoder(*paths: str | None) -> Encoder:
    """Loaded once a Python worker."""
    if paths not in _encoders:
        _encoders[paths] = Encoder(*paths)
    return _encoders[paths]


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary values: the stretches of flat that begin at starts."""
    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
    offsets = np.concatenate([[0], ends * flat.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(flat[at])])


def flat_ids(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, where each row begins)."""
    values = column.to_pylist()
    sizes = np.array([len(v) for v in values], dtype=np.int64) // np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(values), dtype=dtype), np.cumsum(sizes) - sizes


def tokens(docs: DataFrame, id_col: str, text_col: str, source_col: str, paths: tuple, end: int, dtype: str) -> DataFrame:
    """Rows of at most ROW_TOKENS ids: part (of the input), at (tokens of this source before it in the part), id, source_key,
    start, count, doc_tokens, ids. Null texts are empty ones; every document ends with the id `end`."""
    rows = docs.select(F.col(id_col).alias("id"), site_key(F.col(source_col)).alias("source_key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    more = [StructField(c, LongType()) for c in ("part", "at", "start", "count", "doc_tokens")]
    schema = StructType([rows.schema["id"], StructField("source_key", StringType()), *more, StructField("ids", BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part, places = encoder(*paths), TaskContext.get().partitionId(), {}
        for batch in batches:
            keys, texts, found, held = batch.column("source_key").to_pylist(), batch.column("text"), [], 0
            for i in range(batch.num_rows):
                ids = np.append(own.ids(texts[i].as_py()), end).astype(dtype)
                for start in range(0, len(ids), ROW_TOKENS):
                    piece = ids[start : start + ROW_TOKENS]
                    at = places.get(keys[i], 0)
                    places[keys[i]] = at + len(piece)
                    found.append((i, at, start, len(piece), len(ids), piece.tobytes()))
                    held += len(piece)
                if held > 1 << 20 or i == batch.num_rows - 1:
                    taken = batch.select(["id", "source_key"]).take(pa.array([f[0] for f in found]))
                    numbers = [pa.array([f[k] for f in found], pa.int64()) for k in range(1, 5)]
                    parts = pa.array(np.full(len(found), part, dtype=np.int64))
                    columns = [*taken.columns, parts, *numbers, pa.array([f[5] for f in found], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                    found, held = [], 0

    return rows.mapInArrow(encode, schema)


class Clock:
    """Where all queues stand when t units have gone out in their proportions.

    Queue q has given min(floor(weight * v), length) at virtual time v. Between two neighbouring times at which the sum
    passes t, the missing units are taken in the order of the queues; so the places add up to t and never go back.
    """

    def __init__(self, weights: np.ndarray, tokens: np.ndarray, unit: int = 1):
        self.weights, self.tokens, self.unit = weights.astype(np.float64), tokens.astype(np.int64), unit
        self.lengths = self.tokens // unit
        self.total = int(self.lengths.sum())
        self.last = np.nextafter((self.lengths / self.weights).max(initial=0.0) * (1 + 1e-12), np.inf)

    def given(self, v: np.ndarray) -> np.ndarray:
        return np.minimum(np.floor(v[:, None] * self.weights), self.lengths).astype(np.int64)

    def rounds(self, queue: np.ndarray, y: np.ndarray, window: int) -> np.ndarray:
        """The first round whose credit covers the queue's first y tokens. A round is a sequence; the queues that still hold
        tokens share it by weight."""
        out = np.zeros(len(y), dtype=np.int64)
        for k in range(0, len(y), 4096):
            v = y[k : k + 4096, None] / self.weights[queue[k : k + 4096], None]
            out[k : k + 4096] = np.ceil(np.minimum(v * self.weights, self.tokens).sum(1) / window - 1e-9)
        return out

    def places(self, t: np.ndarray) -> np.ndarray:
        """int64 [t, queue]; times are searched by halving the bits of doubles, which order like the doubles."""
        low, high = np.zeros(len(t), dtype=np.int64), np.full(len(t), np.float64(self.last).view(np.int64))
        while (high - low > 1).any():
            middle = low + (high - low) // 2
            over = self.given(middle.view(np.float64)).sum(1) > t
            high, low = np.where(over, middle, high), np.where(over, low, middle)
        least = self.given(low.view(np.float64))
        jump = self.given(high.view(np.float64)) - least
        before = np.cumsum(jump, 1) - jump
        out = least + np.clip((t - least.sum(1))[:, None] - before, 0, jump)
        return np.where((t >= self.total)[:, None], self.lengths, out)

    def cut(self, queue: np.ndarray, first: np.ndarray, count: np.ndarray, block: int) -> tuple[np.ndarray, ...]:
        """Stretches of queues cut at blocks of so many units: (row, start in the row, length, block).

        The clock counts units of several tokens, so that a rare source sends whole units to far blocks and no single tokens.
        What follows the last whole unit of a queue, or the last whole block, is the last block.
        """
        unit = self.unit
        n = (first + count - 1) // unit - first // unit + 1
        row = np.repeat(np.arange(len(queue)), n)
        u = np.repeat(first // unit - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        left = np.maximum(u * unit, first[row])
        length = np.minimum((u + 1) * unit, first[row] + count[row]) - left
        q, full = queue[row], self.total // block
        whole = u < self.lengths[q]
        guess = self.given((np.minimum(u, self.lengths[q]) + 1) / self.weights[q]).sum(1) // block
        near = 2 + len(self.weights) // block
        blocks = np.unique(np.append(np.clip(np.unique(guess)[:, None] + np.arange(-near, near + 1), 0, full), full))
        places, of = self.places(blocks * block), np.full(len(row), full)
        for k in np.unique(q[whole]):
            mine = np.flatnonzero(whole & (q == k))
            of[mine] = blocks[np.searchsorted(places[:, k], u[mine], "right") - 1]
        fresh = np.ones(len(row), dtype=bool)  # neighbouring units of a row in one block are one stretch
        fresh[1:] = (row[1:] != row[:-1]) | (of[1:] != of[:-1])
        at = np.flatnonzero(fresh)
        return row[at], (left - first[row])[at], np.add.reduceat(length, at) if len(at) else length, of[at]


def bounds(n: int, window: int) -> np.ndarray:
    """Where the sequences of n tokens begin: full ones, then one for each power of two that the rest is made of."""
    sizes = [window] * (n // window) + [1 << k for k in reversed(range(n.bit_length())) if (n % window) >> k & 1]
    return np.cumsum([0] + sizes)[:-1] if sizes else np.zeros(0, dtype=np.int64)


def laid_out(clock: Clock, queue: np.ndarray, first: np.ndarray, count: np.ndarray, window: int, packet: int) -> tuple[np.ndarray, ...]:
    """Pieces of a block's rows: (row, start in the row, length, sequence in the block, offset).

    Deficit round-robin: a round adds to each queue's deficit its share of a sequence, and a packet goes out in the first
    round whose deficit covers it; as a queue has waiting packets until it is empty, that is the first round whose whole
    credit reaches the packet's end. Rounds serve the queues in order. Packets are cut where a sequence ends.
    """
    total = int(count.sum())
    n = -(-count // packet)
    row = np.repeat(np.arange(len(count)), n)
    start = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * packet
    length = np.minimum(packet, count[row] - start)
    y = first[row] + start + length
    turn = clock.rounds(queue[row], y, window)
    order = np.lexsort((y, queue[row], turn))
    row, start, length = row[order], start[order], length[order]
    pos = np.cumsum(length) - length

    begins = bounds(total, window)
    a, b = np.searchsorted(begins, pos, "right") - 1, np.searchsorted(begins, pos + length - 1, "right") - 1
    n = b - a + 1
    of = np.repeat(np.arange(len(row)), n)
    sequence = np.arange(int(n.sum())) + np.repeat(a - (np.cumsum(n) - n), n)
    ends = np.append(begins[1:], total)
    left, right = np.maximum(pos[of], begins[sequence]), np.minimum(pos[of] + length[of], ends[sequence])
    row, start, length, offset = row[of], start[of] + left - pos[of], right - left, left - begins[sequence]
    fresh = np.ones(len(row), dtype=bool)  # neighbours of one document in one sequence are one piece
    fresh[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + length[:-1]) | (sequence[1:] != sequence[:-1])
    at = np.flatnonzero(fresh)
    return row[at], start[at], np.add.reduceat(length, at), sequence[at], offset[at]


def queues(sizes: DataFrame, weights: dict[str | None, float] | None, most_queues: int, unit: int) -> tuple[DataFrame, Clock]:
    """(part, source_key, queue, first: where this part's tokens of the source begin in the queue; the queues' clock).

    sizes: part, source_key, n. Without weights, sources go by their share of all tokens. A source that weights doesn't
    name has the least of the given weights. Beyond most_queues sources, sources share queues by hash.
    """
    spark = sizes.sparkSession
    sources = sizes.groupBy("source_key").agg(F.sum("n").alias("n"))
    queue = F.dense_rank().over(Window.orderBy("source_key")) - 1
    if sources.count() > most_queues:
        queue = F.pmod(F.xxhash64("source_key"), F.lit(most_queues)).cast("int")
    weight = F.col("n").cast("double")
    if weights:
        given = spark.createDataFrame([("0" if s is None else f"1{s}", float(w)) for s, w in weights.items()], "source_key string, weight double")
        sources = sources.join(F.broadcast(given), "source_key", "left")
        weight = F.coalesce("weight", F.lit(float(min(weights.values()))))
    sources = written(sources.select("source_key", "n", queue.alias("queue"), weight.alias("weight")), "queues")
    plan = sources.groupBy("queue").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).orderBy("queue").collect()
    many = max((r["queue"] + 1 for r in plan), default=0)
    weight, length = np.ones(many), np.zeros(many, dtype=np.int64)
    for r in plan:
        weight[r["queue"]], length[r["queue"]] = r["weight"], r["n"]
    clock = Clock(weight, length, unit)
    before = Window.partitionBy("queue").orderBy("source_key", "part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.join(sources.select("source_key", "queue"), "source_key").select("part", "source_key", "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("first")), clock


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: dict[str | None, float] | None = None,
    window: int = 1024,
    packet: int = 128,
    end: int = 0,
    ranks: str | None = None,
    pattern: str | None = None,
    vocabulary: int = 1 << 16,
    most_queues: int = 4096,
) -> DataFrame:
    """One row per piece of a document: id, start, length, doc_tokens, sequence_id, offset and ids (unsigned little-endian
    32-bit numbers). A document's ids are those of the tokenizer file and `end`; each is in exactly one piece.

    Every sequence holds the sources within about a packet of their target proportions: by `weights` while there are tokens
    of all of them (then the others share what a source leaves), else by the sources' shares of all tokens. Sequences have
    `window` ids, and the last few have powers of two, so nothing is padded. Documents are only cut into packets of `packet` ids.

    Documents are tokenized once and stored; a second pass moves the ids to their block, once. If the table of parts and
    sources is too large to broadcast, the stored ids are joined with it by shuffle.

    Null texts are empty: one piece with `end`. Null sources are a source of their own. Null and repeated ids, repeated rows
    and texts of any length are packed each. An empty table gives an empty result. Extra columns are ignored.
    """
    spark, dtype = docs.sparkSession, "<u2" if vocabulary <= 1 << 16 else "<u4"
    if window % packet:
        raise ValueError("packet has to divide window")
    if weights and min(weights.values()) <= 0:
        raise ValueError("weights have to be positive")
    paths, units = (tokenizer, ranks, pattern), BLOCK * window // packet
    with small_batches(spark, 500):
        stored = written(tokens(docs, id_col, text_col, source_col, paths, end, dtype), "tokens", compression="zstd")
    sizes = written(stored.groupBy("part", "source_key").agg(F.sum("count").alias("n")), "sizes")
    first, clock = queues(sizes, weights, most_queues, packet)
    first = written(first, "first")
    if first.count() * 64 <= BROADCAST_BYTES:
        first = F.broadcast(first)
    placed = stored.join(first, ["part", "source_key"]).select("id", "queue", (F.col("first") + F.col("at")).alias("first"), "start", "count", "doc_tokens", "ids")
    numbers = [StructField(c, LongType()) for c in ("block", "first", "start", "count", "doc_tokens")]
    dealt = StructType([placed.schema["id"], StructField("queue", IntegerType()), *numbers, StructField("ids", BinaryType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                queue, at, start, count = (batch.column(c).to_numpy() for c in ("queue", "first", "start", "count"))
                row, cut, length, of = clock.cut(queue, at, count, units)
                ids, begins = flat_ids(batch.column("ids"), dtype)
                kept = batch.select(["id", "queue", "doc_tokens"]).take(pa.array(row))
                columns = [kept.column(0), kept.column(1), *(pa.array(x) for x in (of, at[row] + cut, start[row] + cut, length)), kept.column(2), gathered(ids, begins[row] + cut, length)]
                yield pa.RecordBatch.from_arrays(columns, names=dealt.names)

    out = StructType([placed.schema["id"], *(StructField(c, LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")), StructField("ids", BinaryType())])

    def lay(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        queue, first, start, count = (table.column(c).to_numpy() for c in ("queue", "first", "start", "count"))
        row, cut, length, sequence, offset = laid_out(clock, queue, first, count, window, packet)
        ids, begins = flat_ids(table.column("ids"), dtype)
        kept = table.select(["id", "doc_tokens"]).take(pa.array(row))
        sequence = sequence + table.column("block")[0].as_py() * BLOCK
        columns = [kept.column(0), pa.array(start[row] + cut), pa.array(length), kept.column(1), pa.array(sequence), pa.array(offset), gathered(ids.astype("<u4"), begins[row] + cut, length)]
        return pa.Table.from_arrays(columns, names=out.names)

    return placed.mapInArrow(deal, dealt).groupBy("block").applyInArrow(lay, out).withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves, ids as unsigned little-endian 32-bit numbers."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = F.aggregate("parts", F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    rows = pieces.groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select("sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("length"), joined.alias("ids"))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = pack(docs, public.path("byte_bpe_50k.json"), ranks=public.path("byte_bpe_50k.tiktoken"), pattern=public.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
