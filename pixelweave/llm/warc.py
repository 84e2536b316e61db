"""Operator 13: WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames with a seek table at its end, in the public seekable format: any
Zstandard decoder reads the whole of it, a seekable one any frame alone. A frame holds whole WARC records, about
FRAME_BYTES of them; a bundle ends after FRAMES frames or BUNDLE_BYTES bytes. An index maps each record's identifier to bundle, frame, and offset and length within the frame.

Spark's own text writer and committer write the bundles, row by row, so that a task holds one frame at a time, a lost
executor leaves no half file, and any store that Spark writes to will do. The writer ends each row with a separator;
chosen as the last three bytes of the format's magic number it completes the seek table, and after each frame of
records it is the content of a small skippable frame, which the seek table lists too.

Equal payloads of REVISIT_BYTES or more are stored once, with the largest id; the other records are revisits that
refer to it. Payloads are equal if their SHA-256 and length are. The groups of most rows, HOT of them at most, are looked
up by broadcast, the others by a shuffle, so that no key gathers in a task.

Defined results: a null payload is empty; of rows with the same largest id and payload each is a response (they can't be
told apart); where all ids of a group are null each is a response; a null id is kept, as `none` in the identifier; a
null url leaves out the target's header; control characters and spaces in a url are percent-encoded, not read back;
an empty table gives no bundle and no rows; other columns are ignored. A record has to fit in memory, and is never cut.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import read_table, scratch_path, stage, unstage

#: Fixed values of the seekable format, little-endian: skippable frames, the seek table's, and the footer's magic number.
SKIPPABLE = 0x184D2A50
SEEK_TABLE = 0x184D2A5E
FOOTER = 0x8F92EAB1
#: Its UTF-8 bytes are the last three of FOOTER.
SEPARATOR = "\ua48f"
TAIL = SEPARATOR.encode()
#: Bytes of records in a frame, unless one record is longer, and frames in a bundle.
FRAME_BYTES = 1 << 20
FRAMES = 128
#: Bytes after which a bundle ends early; readers take a bundle at a time.
BUNDLE_BYTES = 128 << 20
LEVEL = 3
REVISIT_BYTES = 1000
#: Groups of equal payloads that are looked up by broadcast: some 0.5 MB.
HOT = 4096
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ODD = re.compile(rb"[^\x21-\x7e]")
RECORDS = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"
SLICE = 256


def record_id(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def page_of(record: Column) -> Column:
    """The id in a record's identifier; null for none."""
    return F.regexp_extract(record, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def make_record(page: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One record: response with its payload, or revisit (refers_to given) with the header of the response alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if refers_to is None else "revisit"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + ODD.sub(lambda m: b"%%%02X" % m[0][0], url.encode()).decode())
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    block = http + payload if refers_to is None else http
    head.append(f"Content-Length: {len(block)}")
    return b"".join((b"WARC/1.1\r\n", "\r\n".join(head).encode(), b"\r\n\r\n", block, b"\r\n\r\n"))


def fields_of(block: bytes) -> dict[bytes, bytes]:
    """Header lines by lower-case name."""
    out = {}
    for line in block.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower()] = value.strip()
    return out


def parse_records(content: bytes) -> Iterator[tuple[int, int, tuple]]:
    """(offset, length, fields of RECORDS) of each record of a frame; a response's digest is computed anew and must agree."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        head = fields_of(content[at:end])
        size = int(head[b"content-length"])
        body = end + 4
        split = content.index(b"\r\n\r\n", body) + 4
        digest = base64.b32decode(head[b"warc-payload-digest"].removeprefix(b"sha1:"))
        response = head[b"warc-type"] == b"response"
        payload = content[split : body + size] if response else None
        told = int(fields_of(content[body : split - 4])[b"content-length"])
        name = head[b"warc-record-id"].decode()
        if content[body + size : body + size + 4] != b"\r\n\r\n" or (response and (len(payload) != told or hashlib.sha1(payload).digest() != digest)):
            raise ValueError(f"record {name} is damaged")
        text = lambda key: head[key].decode() if key in head else None  # noqa: E731, B023
        yield at, body + size + 4 - at, (name, text(b"warc-type"), text(b"warc-target-uri"), digest.hex(), told, text(b"warc-refers-to"), payload)
        at = body + size + 4


class Bundle:
    """The frames of one bundle, as rows for the writer: each without the three bytes of the separator."""

    def __init__(self):
        self.entries: list[tuple[int, int, int]] = []
        self.rows, self.bytes = 0, 0

    def frame(self, content: bytes, level: int = LEVEL) -> bytes:
        packed = zstandard.ZstdCompressor(level=level).compress(content)
        self.entries.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.bytes += len(packed)
        return packed + self.gap()

    def gap(self) -> bytes:
        """An empty skippable frame: the end of each row, and a row of its own where a bundle ends early."""
        self.rows += 1
        self.entries.append((8 + len(TAIL), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        return struct.pack("<II", SKIPPABLE, len(TAIL))

    def close(self, rows: int) -> Iterator[bytes]:
        """The rest of its rows, so many before the seek table that the writer begins a new file behind it."""
        for _ in range(self.rows, rows):
            yield self.gap()
        yield self.seek_table()

    def seek_table(self) -> bytes:
        rows = b"".join(struct.pack("<III", *e) for e in self.entries)
        whole = struct.pack("<II", SEEK_TABLE, len(rows) + 9) + rows + struct.pack("<IBI", len(self.entries), 1 << 7, FOOTER)
        return whole.removesuffix(TAIL)


def seek_table(content: bytes) -> list[tuple[int, int, int, int]]:
    """(offset, compressed size, size, checksum) of the frames of a bundle, read from its end."""
    count, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != FOOTER:
        raise ValueError("no seek table")
    width = 12 if flags & 1 << 7 else 8
    start = len(content) - 9 - count * width
    if struct.unpack("<II", content[start - 8 : start]) != (SEEK_TABLE, count * width + 9):
        raise ValueError("the seek table is damaged")
    out, at = [], 0
    for i in range(count):
        packed, size = struct.unpack_from("<II", content, start + i * width)
        out.append((at, packed, size, struct.unpack_from("<I", content, start + i * width + 8)[0] if width == 12 else -1))
        at += packed
    return out


def read_frame(content: bytes, entry: tuple[int, int, int, int]) -> bytes:
    at, packed, size, check = entry
    out = zstandard.ZstdDecompressor().decompress(content[at : at + packed], max_output_size=size)
    if len(out) != size or (check >= 0 and xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != check):
        raise ValueError("a frame is damaged")
    return out


def payload_groups(pages: DataFrame, page_id: str, payload: str, digest: str) -> DataFrame:
    """(key, size, n, first): for payloads that occur more than once their SHA-256, rows and largest id."""
    groups = pages.where(F.length(payload) >= REVISIT_BYTES).groupBy(digest, F.length(payload).alias("size")).agg(F.count("*").alias("n"), F.max(page_id).alias("first"))
    return groups.where("n > 1 AND first IS NOT NULL").select(F.col(digest).alias("key"), "size", "n", "first")


def with_referrals(pages: DataFrame, groups: DataFrame, page_id: str, payload: str, digest: str) -> DataFrame:
    """pages with refers_to: the largest id of those with the same payload, for all others of them; null for responses.

    digest names a column with the payload's SHA-256, payload a binary column.
    """
    spark = pages.sparkSession
    hot = groups.orderBy(F.desc("n"), "key").limit(HOT)
    floor = spark.createDataFrame(hot.select("key", "size", "first").collect(), "key binary, size long, hot long")
    known = pages.join(F.broadcast(floor), (F.col(digest) == F.col("key")) & (F.length(payload) == F.col("size")), "left").drop("key", "size")
    # what is settled goes past the join under keys of its own, spread evenly
    open_ = F.col("hot").isNull() & (F.length(payload) >= REVISIT_BYTES)
    key = F.when(open_, F.col(digest)).otherwise(F.monotonically_increasing_id().cast("string").cast("binary"))
    cold = groups.join(F.broadcast(floor), ["key", "size"], "left_anti").select(F.col("key").alias("cold_key"), F.col("size").alias("cold_size"), F.col("first").alias("cold"))
    met = known.withColumn("open_key", key).join(cold, (F.col("open_key") == F.col("cold_key")) & (F.length(payload) == F.col("cold_size")), "left")
    first = F.coalesce("hot", "cold")
    return met.withColumn("refers_to", F.when(~F.col(page_id).eqNullSafe(first), first)).drop("hot", "cold", "cold_key", "cold_size", "open_key")


def write_bundles(pages: DataFrame, path: str, frame_bytes: int = FRAME_BYTES, frames: int = FRAMES, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """Write pages(page_id, url, html) under path/bundles, then the index under path/index."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    groups = stage(payload_groups(rows, "page_id", "payload", "digest"), "payloads")
    told = with_referrals(rows, groups, "page_id", "payload", "digest").select("page_id", "url", "payload", F.unhex(F.sha1("payload")).alias("sha1"), "refers_to")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda value: pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], ["value"])
        bundle, held, size = Bundle(), [], 0
        for batch in batches:
            for lo in range(0, len(batch), SLICE):
                for fields in zip(*(c.to_pylist() for c in batch.slice(lo, SLICE).columns), strict=True):
                    held.append(make_record(*fields))
                    size += len(held[-1])
                    if size >= frame_bytes:
                        yield row(bundle.frame(b"".join(held)))
                        held, size = [], 0
                        if bundle.rows == frames or bundle.bytes >= bundle_bytes:
                            yield from map(row, bundle.close(frames))
                            bundle = Bundle()
        if held:
            yield row(bundle.frame(b"".join(held)))
        if bundle.rows:
            yield row(bundle.seek_table())

    made = told.mapInArrow(task, "value binary").select(F.col("value").cast("string").alias("value"))
    # a full bundle has frames + 1 rows: the writer's files end where bundles do
    made.write.option("maxRecordsPerFile", frames + 1).option("compression", "none").option("lineSep", SEPARATOR).text(f"{path}/bundles")
    unstage(groups)
    places = read_records(spark, path, with_payload=False).select("record_id", "bundle", "frame", "offset", "length")
    places.sortWithinPartitions("record_id").write.option("compression", "zstd").parquet(f"{path}/index")


def bundle_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/bundles").select(F.element_at(F.split("path", "/"), -1).alias("bundle"), "content")


PLACES = "bundle string, frame int, offset long, length long, "


def rows_of(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True), schema, strict=True)], schema.names)


def arrow_schema(with_payload: bool = True) -> pa.Schema:
    kinds = [("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())]
    return pa.schema(kinds if with_payload else kinds[:-1])


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records, with their places: frame by frame, each record's digest computed anew."""
    schema = arrow_schema(with_payload)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = value.as_py()
                for i, entry in enumerate(seek_table(content)):
                    if entry[2]:
                        yield rows_of([(name, i, at, n, *fields[: len(schema) - 4]) for at, n, fields in parse_records(read_frame(content, entry))], schema)

    return bundle_files(spark, path).mapInArrow(task, PLACES + (RECORDS if with_payload else RECORDS.removesuffix(", payload binary")))


def lookup(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The records named in ids(record_id), by way of the index: only their frames are decompressed."""
    index = spark.read.parquet(f"{path}/index").join(ids.select("record_id").distinct(), "record_id")
    wanted = index.groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset", "length")).alias("places"))
    schema = arrow_schema()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                content, frames = value.as_py(), {}
                for p in places.as_py():
                    frames.setdefault(p["frame"], []).append((p["offset"], p["length"]))
                table = seek_table(content)
                for i, spans in sorted(frames.items()):
                    frame = read_frame(content, table[i])
                    yield rows_of([(name, i, at, n, *fields) for at, n in sorted(spans) for _, _, fields in parse_records(frame[at : at + n])], schema)

    return bundle_files(spark, path).join(wanted, "bundle").select("bundle", "content", "places").mapInArrow(task, PLACES + RECORDS)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through the bundles and back."""
    path = scratch_path(spark, "warc")
    write_bundles(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    found = read_records(spark, path, with_payload=False)
    return found.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))


OP13_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest, CASE WHEN octet_length(b) >= 1000 THEN max(page_id) OVER (PARTITION BY b) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM d
"""
