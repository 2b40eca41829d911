"""Vector code compression: vectors become a byte for each part, the index of the nearest entry of that part's codebook.

Components become integers, so that every sum, distance and tie is exact and no partitioning changes the result. Equal parts
of one position are gathered into weighted distinct rows; Lloyd's rounds run over these alone, and codes and errors are
joined back to the vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from tropelens.llm.common import BROADCAST_BYTES, written

#: Integer components are held within +-2^24 (65,536 before scaling): squared distances of 4,096 components then fit 64 bits.
LIMIT = 1 << 24
#: Up to this size of components products and sums are exact in doubles, too.
EXACT = 1 << 20
ROWS = 1 << 14


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """int64 rows of a binary column, each of `width` little-endian 32-bit integers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(-1, width).astype(np.int64)


def integer_parts(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int, scale: int) -> DataFrame:
    """Kept rows: key (of the row), id, label and parts, an array of binaries that hold floor(scale * x) of their components."""
    rows = vectors.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("v is not null")
    schema = StructType([*rows.drop("v").schema.fields, StructField("size", LongType()), StructField("parts", ArrayType(BinaryType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
            bad = np.zeros(len(x) + 1, dtype=np.int64)
            np.cumsum(~np.isfinite(x), out=bad[1:])
            ends = np.cumsum(sizes)
            keep = np.flatnonzero((bad[ends] == bad[ends - sizes]) & (sizes % parts == 0) & (sizes > 0))
            x = np.clip(np.floor(np.where(np.isfinite(x), x, 0.0) * scale), -LIMIT, LIMIT).astype("<i4")
            cuts = []
            for i in keep:
                data, width = x[ends[i] - sizes[i] : ends[i]].tobytes(), 4 * int(sizes[i]) // parts
                cuts.append([data[k : k + width] for k in range(0, len(data), width)])
            kept = batch.drop_columns(["v"]).take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sizes[keep]), pa.array(cuts, pa.list_(pa.binary()))], names=[*kept.schema.names, "size", "parts"])

    return rows.mapInArrow(cut, schema)


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, the lower one of equals; squared distance) of each row. All exact."""
    if max(np.abs(values).max(initial=0), np.abs(book).max(initial=0)) <= EXACT:
        left = (book * book).sum(1).astype(np.float64) - 2.0 * (values.astype(np.float64) @ book.T.astype(np.float64))
        at = left.argmin(1)
    else:
        at = np.stack([((values - entry) ** 2).sum(1) for entry in book], 1).argmin(1)
    return at, ((values - book[at]) ** 2).sum(1)


def moved(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every distinct row goes to its nearest entry, every entry to the floor of its rows' weighted mean. Each task
    adds up its own rows first; what the driver gets is as large as the codebooks."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                pos, weight, values = rows.column("pos").to_numpy(), rows.column("weight").to_numpy(), matrix(rows.column("part"), width)
                for p in np.unique(pos):
                    mine = pos == p
                    at, _ = nearest(values[mine], books[p])
                    np.add.at(count[p], at, weight[mine])
                    np.add.at(total[p], at, values[mine] * weight[mine, None])
        used = np.argwhere(count > 0)
        rows = {"pos": used[:, 0], "entry": used[:, 1], "count": count[used[:, 0], used[:, 1]]}
        lists = pa.array(total[used[:, 0], used[:, 1]].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*(pa.array(v.astype(np.int64)) for v in rows.values()), lists], names=[*rows, "total"])

    found = distinct.select("pos", "part", "weight").mapInArrow(sums, "pos long, entry long, count long, total array<long>")
    added = [F.sum(F.col("total")[k]).alias(f"c{k}") for k in range(width)]
    new = books.copy()
    for pos, entry, count, *total in found.groupBy("pos", "entry").agg(F.sum("count").alias("count"), *added).collect():
        new[pos, entry] = [x // count for x in total]
    return new


def assigned(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """distinct with entry and error."""
    width = books.shape[2]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                pos, values = rows.column("pos").to_numpy(), matrix(rows.column("part"), width)
                entry, error = np.zeros(len(pos), dtype=np.int64), np.zeros(len(pos), dtype=np.int64)
                for p in np.unique(pos):
                    mine = pos == p
                    entry[mine], error[mine] = nearest(values[mine], books[p])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(entry), pa.array(error)], names=[*rows.schema.names, "entry", "error"])

    return distinct.mapInArrow(assign, StructType([*distinct.schema.fields, StructField("entry", LongType()), StructField("error", LongType())]))


def joined_back(left: DataFrame, right: DataFrame, keys: list[str], total: int, row_bytes: int, budget: int) -> DataFrame:
    """left with right's other columns; right has one row for each key of left and `weight`, the number of its rows in left.

    A right side within the budget is broadcast. Beyond it only its heaviest keys are: `total` is the sum of all weights, so
    fewer than k keys weigh more than total / k. What is left has no key of more rows than that, and is joined by shuffle.
    Null keys match each other.
    """
    most = max(budget // row_bytes, 1)
    right = right.toDF(*(f"r_{c}" for c in right.columns))
    same = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys]
    gone = [f"r_{k}" for k in keys]
    if right.count() <= most:
        out = left.join(F.broadcast(right), same)
    else:
        heavy = F.col("r_weight") > total / most
        hot = F.broadcast(right.where(heavy))
        out = left.join(hot, same).unionByName(left.join(hot, same, "left_anti").join(right.where(~heavy), same))
    out = out.drop(*gone)
    return out.withColumnsRenamed({c: c[2:] for c in out.columns if c.startswith("r_")})


def vector_codes(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
    broadcast_bytes: int = BROADCAST_BYTES // 4,
) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error, label_error), codebooks [part, entry, component]).

    code holds two hex digits a part, error is the squared distance to the coded vector in units of 1/scale, label_error the
    sum of the errors of all rows with the same label (nulls are one label). Codebooks start with the vectors of the smallest
    ids (`entries` of 256 at most); rows that repeat an id come in the order of their components, null ids last.

    Rows go whose vector is null, has a null or non-finite component, or has a length that `parts` doesn't divide or that
    isn't the most common one of the others (of equals the smaller). Components beyond +-65,536 (at scale 256) count as that.
    Repeated rows are coded each. An empty table gives empty results and codebooks. Extra columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte: 1 to 256 entries")
    rows = written(integer_parts(vectors, id_col, vector_col, label_col, parts, scale), "parts")
    size = rows.groupBy("size").count().orderBy(F.col("count").desc(), "size").first()
    names = [F.col("id").alias(id_col), F.col("label").alias(label_col)]
    if size is None:
        none = rows.select(*names, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none, np.zeros((parts, 0, 0), dtype=np.int64)
    total, width = size["count"], size["size"] // parts
    rows = rows.where(F.col("size") == size["size"])
    first = rows.orderBy(F.col("id").asc_nulls_last(), "parts").limit(entries).select("parts").collect()
    books = np.stack([matrix(pa.array(r["parts"], pa.binary()), width) for r in first], 1)

    single = rows.select("key", "id", "label", F.posexplode("parts").alias("pos", "part"))
    distinct = written(single.groupBy("pos", "part").agg(F.count(F.lit(1)).alias("weight")), "distinct")
    for _ in range(rounds):
        books = moved(distinct, books)
    coded = written(assigned(distinct, books), "coded")

    single = joined_back(single, coded, ["pos", "part"], total * parts, 64 + 8 * width, broadcast_bytes)
    words = -(-parts // 8)
    byte = [F.bit_or(F.when(F.floor(F.col("pos") / 8) == k, F.call_function("shiftleft", F.col("entry"), (56 - 8 * (F.col("pos") % 8)).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(words)]
    codes = single.groupBy("key").agg(F.first("id").alias("id"), F.first("label").alias("label"), F.sum("error").alias("error"), *byte)
    code = F.substring(F.concat(*(F.lpad(F.lower(F.hex(f"w{k}")), 16, "0") for k in range(words))), 1, 2 * parts)
    codes = written(codes.select("id", "label", code.alias("code"), "error"), "codes")
    labels = written(codes.groupBy("label").agg(F.count(F.lit(1)).alias("weight"), F.sum("error").alias("label_error")), "labels")
    out = joined_back(codes, labels, ["label"], total, 256, broadcast_bytes)
    return out.select(*names, "code", "error", "label_error"), books


def books_sha256(books: np.ndarray) -> str:
    """Of all components, by part, entry and place, as decimal numbers with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    coded, books = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _round(k: int) -> str:
    return f"""a{k} AS (SELECT pos, part, weight, min(list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e) AS m FROM q JOIN b{k} USING (pos) GROUP BY pos, part, weight),
s{k} AS (SELECT pos, m % 64 AS e, i, floor(sum(part[i] * weight)::DOUBLE / sum(weight))::BIGINT AS v FROM a{k}, (SELECT unnest(range(1, 1 + (SELECT max(len(part)) FROM q))) AS i) GROUP BY ALL),
b{k + 1} AS (SELECT pos, e, coalesce(moved, entry) AS entry FROM b{k} LEFT JOIN (SELECT pos, e, list(v ORDER BY i) AS moved FROM s{k} GROUP BY ALL) USING (pos, e))"""


SQL = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, len(embedding) // 16 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, pos, v[pos * w + 1 : pos * w + w] AS part FROM k, (SELECT unnest(range(16)) AS pos)),
q AS (SELECT pos, part, count(*) AS weight FROM p GROUP BY ALL),
b0 AS (SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS e, part AS entry FROM p QUALIFY e < 64),
{_round(0)},
{_round(1)},
a2 AS (SELECT pos, part, min(list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e) AS m FROM q JOIN b2 USING (pos) GROUP BY pos, part),
c AS (SELECT vec_id, label, string_agg(printf('%02x', (m % 64)::INT), '' ORDER BY pos) AS code, sum(m // 64)::BIGINT AS error FROM p JOIN a2 USING (pos, part) GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY pos, e)) FROM b2) AS codebooks_sha256 FROM c
"""
