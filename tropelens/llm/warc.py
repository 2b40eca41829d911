"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of one or more whole WARC records, and a footer: a skippable
frame with a seek table that lists every frame's compressed and decompressed size (the public "zstd seekable format").
A reader that knows (bundle, frame, offset in the frame, length) reads one frame to get one record.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tropelens.llm.common import BROADCAST_BYTES, partitions, scratch_path, written

# Fixed values of the seekable format: magic numbers of the skippable frame and of the footer.
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, page_id string, bundle string, frame int, frame_start long, frame_bytes long, record_offset long, record_bytes long"


def filesystem(uri: str):
    """pyarrow's file system and path for a URI: local folders, HDFS and object stores alike."""
    from pyarrow import fs

    found, path = fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")
    return found, path


def record_id(page_id: str | None) -> str:
    """A URN of the page's id, percent-encoded; pages without an id have a name space of their own."""
    return "<urn:x-nopage:0>" if page_id is None else f"<urn:x-page:{quote(page_id, safe='')}>"


def page_of(urn: str) -> str | None:
    kind, tail = urn.strip("<>").rsplit(":", 1)
    return None if kind == "urn:x-nopage" else unquote(tail)


def make_record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, revisit: bool) -> bytes:
    """One WARC record. A revisit has the HTTP header with the full length, but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record in a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        start, size = end + 4, int(head["Content-Length"])
        yield at, start + size + 4 - at, head, data[start : start + size]
        at = start + size + 4


class BundleWriter:
    """Writes one bundle; add() returns the record's place. The file gets its name when it is complete."""

    def __init__(self, folder: str, frame_bytes: int, level: int = 3):
        import zstandard

        self.fs, path = filesystem(folder)
        self.fs.create_dir(path, recursive=True)
        self.name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        self.path, self.frame_bytes = f"{path}/{self.name}", frame_bytes
        self.out = self.fs.open_output_stream(f"{self.path}.part")
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.frames, self.pending, self.waiting, self.fill, self.start = [], [], [], 0, 0

    def add(self, key: tuple, record: bytes) -> list[tuple]:
        """The places of the records of a frame that this record has made full, else nothing."""
        self.waiting.append((key, self.fill, len(record)))
        self.pending.append(record)
        self.fill += len(record)
        return self.flush() if self.fill >= self.frame_bytes else []

    def flush(self) -> list[tuple]:
        if not self.pending:
            return []
        frame = self.zstd.compress(b"".join(self.pending))
        self.out.write(frame)
        placed = [(*key, self.name, len(self.frames), self.start, len(frame), offset, size) for key, offset, size in self.waiting]
        self.frames.append((len(frame), self.fill))
        self.start += len(frame)
        self.pending, self.waiting, self.fill = [], [], 0
        return placed

    def close(self) -> list[tuple]:
        placed = self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, FOOTER)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        self.fs.move(f"{self.path}.part", self.path)
        return placed


def seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed bytes, decompressed bytes) of each frame, from the bundle's footer."""
    file.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != FOOTER:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * n)
    table, start, out = file.read(8 * n), 0, []
    for k in range(n):
        packed, full = struct.unpack_from("<II", table, 8 * k)
        out.append((start, packed, full))
        start += packed
    return out


def write_bundles(records: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """records (page_id, url, payload, digest, revisit, refers_to) -> index of all records, itself a table in folder.

    Each task writes its own bundles under fresh names and lists them in the index only when they are complete: a task
    that is run again after a lost executor leaves at most a file that no index names.
    """
    spark = records.sparkSession

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in INDEX.split(", ")]
        writer, written_bytes = None, 0
        for batch in batches:
            placed = []
            ids = [None if pd.isna(x) else x for x in batch["page_id"]]
            refs = [None if pd.isna(x) else x for x in batch["refers_to"]]
            for page, url, payload, digest, revisit, ref in zip(ids, batch["url"], batch["payload"], batch["digest"], batch["revisit"], refs, strict=True):
                record = make_record(page, None if pd.isna(url) else url, payload, digest, ref, revisit)
                writer = writer or BundleWriter(folder, frame_bytes)
                placed += writer.add((record_id(page), page), record)
                written_bytes += len(record)
                if written_bytes >= bundle_bytes:
                    placed += writer.close()
                    writer, written_bytes = None, 0
            yield pd.DataFrame(placed, columns=names)
        if writer:
            yield pd.DataFrame(writer.close(), columns=names)

    path = f"{folder}/index"
    records.select(F.col("page_id").cast("string"), "url", "payload", "digest", "revisit", F.col("refers_to").cast("string")).mapInPandas(pack, INDEX).write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def read_record(folder: str, place) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, given its row of the index: reads one frame."""
    import zstandard

    fs, path = filesystem(folder)
    with fs.open_input_file(f"{path}/{place['bundle']}") as file:
        start, packed, full = seek_table(file, file.size())[place["frame"]]
        file.seek(start)
        data = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=full)
    at, size = place["record_offset"], place["record_bytes"]
    _, _, head, block = next(parse_records(data[at : at + size]))
    return head, block


def read_bundles(index: DataFrame, folder: str, task_bytes: int = 32 << 20) -> DataFrame:
    """A row for each record of the bundles that the index names, read frame by frame through the seek tables: page_id and
    refers_to as strings, payload_bytes, payload_digest, record_type.

    Responses are digested anew from their payload; a revisit's digest and length come from its own headers. Frames are
    dealt to as many tasks as their summed size asks for, about task_bytes each, and never to fewer than the cores known.
    """
    spark = index.sparkSession
    frames = index.groupBy("bundle", "frame").agg(F.max("frame_bytes").alias("frame_bytes"))
    total = frames.agg(F.sum("frame_bytes").alias("bytes")).first()["bytes"] or 0
    tasks = max(spark.sparkContext.defaultParallelism, partitions(spark), -(-total // task_bytes))

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        fs, path = filesystem(folder)
        names, zstd = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], zstandard.ZstdDecompressor()
        for batch in batches:
            for bundle, part in batch.groupby("bundle"):
                with fs.open_input_file(f"{path}/{bundle}") as file:
                    table = seek_table(file, file.size())
                    for frame in sorted(part["frame"]):
                        start, packed, full = table[frame]
                        file.seek(start)
                        rows = []
                        for _, _, head, block in parse_records(zstd.decompress(file.read(packed), max_output_size=full)):
                            cut = block.index(b"\r\n\r\n") + 4
                            length = int(block[:cut].split(b"Content-Length: ")[1].split(b"\r\n")[0])
                            page, revisit = page_of(head["WARC-Record-ID"]), head["WARC-Type"] == "revisit"
                            digest = head["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(block[cut:]).hexdigest()
                            rows.append((page, length if revisit else len(block) - cut, digest, head["WARC-Type"], page_of(head["WARC-Refers-To"]) if revisit else None))
                        yield pd.DataFrame(rows, columns=names)

    dealt = frames.select("bundle", "frame").repartition(tasks, F.col("bundle"), F.floor(F.col("frame") / 4))
    return dealt.mapInPandas(unpack, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """The records to write: which page is the first with its payload, and which others refer to it."""
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= least_bytes
    keys = base.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = written(keys.where("n > 1").select("digest", "first"), "firsts")
    if firsts.count() * 160 <= BROADCAST_BYTES:  # a digest, an id and their overhead
        firsts = F.broadcast(firsts)
    out = base.join(firsts, "digest", "left")
    revisit = F.coalesce(large & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    return out.select("page_id", "url", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100, folder: str | None = None) -> DataFrame:
    """Writes all pages as WARC bundles and returns what a reader finds in them, a row per page.

    Among pages with equal payloads of at least least_bytes, the one with the smallest id is the response and the others
    revisit it. Ids may be numbers or strings and come back in their own type. Null html: an empty payload. Null id: written
    as such, and never the first of its payload unless all ids are null. Repeated rows: each gets a record; rows that repeat
    the smallest id are all responses. Null url: no target URI. An empty table writes no bundle. Extra columns are ignored.
    A payload is a Spark value and so under 2 GiB; a frame holds at most that and frame_bytes, within the 32 bits of the
    seek table. The list of repeated payloads is broadcast if it is proven small; else pages are joined with it by digest.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    kind = pages.schema[id_col].dataType
    found = read_bundles(write_bundles(with_revisits(pages, id_col, url_col, html_col, least_bytes), folder), folder)
    return found.select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def query(spark, sf_dir: str) -> DataFrame:
    return warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f
"""
