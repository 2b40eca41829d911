"""Shared helpers of the training-data operators: scratch tables, words, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of whitespace words.
WHITE = " \t\n\x0b\x0c\r"
#: A side of a join is broadcast only when a count or sum has shown it to be at most this large.
BROADCAST_BYTES = 64 << 20
#: Letters lower-cased, every ASCII byte that is no letter or digit turned into a space.
ALNUM_BYTES = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32) for c in range(256))
#: Letters lower-cased, white space turned into spaces.
WHITE_BYTES = bytes((c + 32 if 65 <= c <= 90 else 32 if chr(c) in WHITE else c) for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session on one machine (tests) may go without and gets a
    temporary folder; on a cluster a missing setting is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            folder = known.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            folder = tempfile.mkdtemp(prefix="tropelens-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tropelens/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, is computed once and outlives any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a written() table that nothing lazy depends on any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def release() -> None:
    """Gives freed memory back to the system: Python workers are reused, and hold on to what the largest task took."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def white_words(text: Column) -> Column:
    """array<string> of the runs of non-white characters; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \t-\r]+"))


def site_key(site: Column) -> Column:
    """A join key that is never null: a null site is a site of its own, different from the empty string."""
    return F.when(site.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), site.cast("string")))


def as_bytes(text: Column) -> Column:
    """UTF-8 bytes for Arrow: no decoding on the way to Python."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, plans that are run send Python so many rows at a time at most: for rows that are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, "10000")
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words of the texts in order, number of words of each text).

    table folds bytes; words are runs of what isn't a space then. Eight bytes of all words are mixed in at a time; words of
    over 256 bytes are hashed one by one.
    """
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join([b" ".join(texts).translate(table), b" " * 9]), dtype=np.uint8)
    word = np.zeros(len(data), dtype=np.int8)
    word[1:-7] = data[:-8] != 32
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, size = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
    h = mixed(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = np.arange(len(starts))
    for k in range(0, min(int(size.max(initial=0)), 256), 8):
        at = at[size[at] > k] if k else at
        part = eight[starts[at] + k] & MASKS[np.minimum(size[at] - k, 8)]
        h[at] = mixed(h[at] ^ part)
    for i in np.flatnonzero(size > 256):
        import xxhash

        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + size[i]].tobytes())
    ends = np.searchsorted(starts, np.cumsum(lengths))
    return h, np.diff(ends, prepend=0)


#: The first 0 to 8 bytes of a little-endian number.
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def shards(batch: pd.DataFrame, column: str, most: int = 8 << 20) -> Iterator[pd.DataFrame]:
    """Cuts a batch into blocks of rows with at most about `most` bytes of text; a longer text is a block of its own."""
    sizes = batch[column].str.len().to_numpy(dtype=np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(batch):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield batch.iloc[start:stop]
        start = stop
