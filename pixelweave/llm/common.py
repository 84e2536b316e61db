"""Shared plumbing: reading tables, cutting lineage, word hashing, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: space and U+0009 to U+000D. bytes.split() cuts at just these.
WORD = "[^\\x20\\x09-\\x0D]+"
MASK64 = (1 << 64) - 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where unset (tests) one of our own."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        where = "file://" + tempfile.mkdtemp(prefix="pixelweave-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/pixelweave/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later steps restart from the files, not from the plan above.

    The files stay as long as the shared folder keeps them; drop_path() removes one early.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_staged_path", None):
            drop_path(df.sparkSession, path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """Evaluate value once per row, although body may use it many times or inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def training_rows(doc_id: Column, modulus: int, left_out: int) -> Column:
    """True for documents to learn from: crc32 of the id's decimal text, mod modulus, is not left_out. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus != left_out


_held: dict[tuple, object] = {}


def worker_state(owner: tuple, make=lambda: True):
    """What make() gives, once for each Python worker, as long as no other owner asks.

    Spark uses its Python workers again, for other operators too: what one of them remembers must not stay beside what
    the next one needs, so it goes first, and its memory back to the system.
    """
    if owner not in _held:
        if _held:
            _held.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # only the GNU library has it
                ctypes.CDLL(None).malloc_trim(0)
        _held[owner] = make()
    return _held[owner]


class Recent(dict):
    """A memo of two generations: when the new one is full it becomes the old one, and what is asked for again moves up."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def find(self, key):
        """The value, or None."""
        value = self.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix; a bijection, so distinct inputs stay distinct."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of n consecutive hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return mix64(out)


#: Bytes that belong to words, and a random 64-bit value of each byte; a capital letter of ASCII has that of the small one.
IN_WORD = ~np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ODD = 0x9E3779B97F4A7C15
BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD))[LOWER]
#: Bytes of text hashed at once.
SPAN = 1 << 20


@functools.lru_cache(1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of ODD and of its inverse, modulo 2^64."""
    up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)]), dtype=np.uint64) for x in (ODD, pow(ODD, -1, 1 << 64)))
    return up, down


def raw_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of binary texts one after the other, and where each begins and the last ends; a null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8))[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of raw_texts() begins and ends, and the number of each text's first word; at last that of all words."""
    word = IN_WORD[data]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    some = at[:-1] < at[1:]
    begin[at[:-1][some]] = word[at[:-1][some]]
    end[at[1:][some] - 1] = word[at[1:][some] - 1]
    a = np.flatnonzero(begin)
    return a, np.flatnonzero(end) + 1, np.searchsorted(a, at)


def span_hashes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of words data[a:b], the letters A-Z as a-z: polynomials of all prefixes, whose differences are those of the words."""
    out, i = np.empty(len(a), np.uint64), 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(b, a[i] + SPAN, "right")))
        lo, hi = int(a[i]), int(b[j - 1])
        up, down = powers(1 << max(20, (hi - lo - 1).bit_length()))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[data[lo:hi]] * up[: hi - lo], dtype=np.uint64)])
        out[i:j] = (sums[b[i:j] - lo] - sums[a[i:j] - lo]) * down[a[i:j] - lo]
        i = j
    return mix64(out + (b - a).astype(np.uint64) * np.uint64(ODD))


def word_hash(word: bytes) -> np.uint64:
    """The hash of one word."""
    return span_hashes(np.frombuffer(word, np.uint8), np.zeros(1, np.int64), np.full(1, len(word)))[0]


def span_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """The words data[a:b] as binary values, the letters A-Z as a-z."""
    ends = np.concatenate(([0], np.cumsum(b - a)))
    flat = LOWER[data[np.repeat(a - ends[:-1], b - a) + np.arange(ends[-1])]]
    return pa.Array.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)])


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """For each binary text the sorted distinct hashes of its n-word shingles; with fewer words, one hash of the whole sequence; none for no words."""
    data, at = raw_texts(texts)
    a, b, first = word_spans(data, at)
    h = span_hashes(data, a, b)
    windows, out = window_hashes(h, n), []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo < n:
            out.append(window_hashes(h[lo:hi], hi - lo) ^ np.uint64(hi - lo) if hi > lo else np.empty(0, np.uint64))
        else:
            s = np.sort(windows[lo : hi - n + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
    return out


def components(nodes: DataFrame | None, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for every end of an edge the smallest node it reaches.

    Alternating large-star and small-star rounds; each groups edges by a node with a map-side minimum and
    is written to the shared folder, so neither a hub nor a long chain gathers in one task. nodes is unused
    but for its rows being added with themselves as component.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = stage(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select("v", "m", "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(down.select("u", F.col("m").alias("v"))).distinct()
        nxt = stage(small, "cc")
        now = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        unstage(e)
        e = nxt
        if now == before:
            break
        before = now
    found = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    found = found.union(roots).groupBy("node").agg(F.min("component").alias("component"))
    if nodes is not None:
        found = nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return found
