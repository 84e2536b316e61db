"""Operator 3: token ids in binary shards coded with Simple-8b.

A shard file is a run of blocks. A block is a header, the ids of its documents, their lengths and the ids of
their tokens packed by Simple-8b, then one newline byte (Spark's text writer puts it there; a reader goes by
the lengths in the header). Spark's own committer writes the files, so a lost executor leaves no half shard,
and any store that Spark writes to will do. Beside the shards lies a manifest: the ids before each shard.

Defined results: a null text counts as empty and yields just the end id; an empty table yields no shard and
no row; repeated rows each get their own place, ordered by doc_id and then by a hash of the text; a null
doc_id comes first and stays null; other columns are ignored. A text of any length is one document; a block
closes after the document that fills it.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import Recent, read_table, scratch_path, worker_state

#: Bits of each value and values of each word, by selector. Selector 0 escapes: its low 60 bits count the raw
#: 64-bit words that follow. Selector 1 is a run of 120 zeros.
WIDTHS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
COUNTS = (0, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
LOW60 = (1 << 60) - 1
#: magic, shard, block, documents, ids before this block in its shard, ids, 64-bit words
HEADER = struct.Struct("<4sIIIQQI")
MAGIC = b"S8B1"
BLOCK_IDS = 1 << 16
BLOCKS_PER_FILE = 256
#: Cores that a worker remembers, in each of two generations: about 40 MB.
MEMO = 200_000


def simple8b_encode(values: np.ndarray) -> np.ndarray:
    """Pack unsigned 64-bit values into 64-bit words; values of more than 60 bits are escaped as they are."""
    values = np.asarray(values, dtype=np.uint64)
    wide = values > np.uint64(LOW60)
    if wide.any():
        edges = np.flatnonzero(np.diff(np.concatenate(([False], wide, [False])).astype(np.int8)))
        out, at = [], 0
        for lo, hi in zip(edges[::2], edges[1::2], strict=True):
            out += [simple8b_encode(values[at:lo]), np.array([hi - lo], np.uint64), values[lo:hi]]
            at = hi
        return np.concatenate([*out, simple8b_encode(values[at:])])
    n = len(values)
    if not n:
        return np.empty(0, np.uint64)
    # frexp gives the bit length; values near 2**60 may round up to 61 bits, which still means one a word
    bits = np.minimum(np.frexp(values.astype(np.float64))[1], 60).astype(np.uint8)
    step = np.ones(n, np.uint8)
    pick = np.full(n, 15, np.uint8)
    reach, high = 1, bits
    for s in range(14, 0, -1):
        k = COUNTS[s]
        if k > n:
            break
        while reach < k:  # high[i]: most bits of values[i : i + reach]
            d = min(reach, k - reach)
            high = np.maximum(high[:-d], high[d:])
            reach += d
        fits = np.flatnonzero(high <= WIDTHS[s])
        step[fits], pick[fits] = k, s
    starts, at, steps = [], 0, step.tolist()
    while at < n:
        starts.append(at)
        at += steps[at]
    start = np.array(starts)
    chosen = pick[start]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        if WIDTHS[s]:
            at = np.flatnonzero(chosen == s)
            base = start[at]
            for j in range(COUNTS[s]):
                words[at] |= values[base + j] << np.uint64(j * WIDTHS[s])
    return words


def simple8b_decode(words: np.ndarray) -> np.ndarray:
    """The values of simple8b_encode(): each selector's words are unpacked at once."""
    words = np.asarray(words, dtype=np.uint64)
    sel = (words >> np.uint64(60)).astype(np.intp)
    if (escapes := np.flatnonzero(sel == 0)).size:
        out, at = [], 0
        for e in escapes:
            if e >= at:  # else it lies among escaped values
                n = int(words[e])
                out += [simple8b_decode(words[at:e]), words[e + 1 : e + 1 + n]]
                at = e + 1 + n
                if (sel[at:] != 0).all():
                    break
        return np.concatenate([*out, simple8b_decode(words[at:])])
    counts = np.array(COUNTS)[sel]
    ends = np.cumsum(counts)
    values = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    first = ends - counts
    for s in np.unique(sel):
        if WIDTHS[s]:
            at = np.flatnonzero(sel == s)
            w, base = words[at], first[at]
            for j in range(COUNTS[s]):
                values[base + j] = (w >> np.uint64(j * WIDTHS[s])) & np.uint64((1 << WIDTHS[s]) - 1)
    return values


#: Marks that the tokenizer always parts from a letter before them, and chunks that end in a letter once these are gone.
MARKS = ",.;:!?"
TRAILING = "^.*?([,.;:!?]*)$"
LETTERS_AT_ENDS = "^[a-zß-öø-ÿ](?:.*[a-zß-öø-ÿ])?$"


class ChunkEncoder:
    """Token ids of whole texts by the tokenizers library, remembered by runs of non-space bytes.

    The tokenizer lower-cases, drops white space and parts letters from other signs before it merges
    anything, so a text's ids are those of its chunks in order, and a chunk's are those of its core and of its
    trailing marks. Arrow splits texts and finds the distinct chunks and parts of a batch; the library sees each
    part that is not remembered, many in one string.
    Where words end in a suffix of the vocabulary, cores of lower-case letters go to a copy of the tokenizer
    that neither normalises nor cuts (there is nothing to do), and the suffix tells them apart; other cores
    have a bar between them. Texts that hold one of the tokenizer's added tokens, in letters of any case, go to the
    library whole.
    """

    def __init__(self, path: str, limit: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.special = [t["content"] for t in json.loads(self.whole.to_str()).get("added_tokens", []) if t["content"]]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.bar = self.ids("|")
        self.cores = Recent(limit)
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.bare = None
        if suffix:
            self.bare = Tokenizer.from_file(path)
            self.bare.encode_special_tokens = True
            self.bare.normalizer = None
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
            for token, i in self.tokenizer.get_vocab().items():
                self.last[i] = token.endswith(suffix)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def plain(core: bytes) -> bool:
        """Nothing but letters that the tokenizer would leave as they are."""
        if core.isalpha():
            return core.islower()
        text = core.decode()
        return text.isalpha() and text.lower() == text and unicodedata.is_normalized("NFC", text)

    def learn(self, cores: list[bytes]) -> dict[bytes, bytes]:
        out = {}
        letters = [c for c in cores if self.plain(c)] if self.bare else []
        for lo in range(0, len(letters), 1000):
            part = letters[lo : lo + 1000]
            ids = np.array(self.bare.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) != len(part):
                continue  # some word is not one run of tokens; all of them are encoded one by one below
            raw, begin = ids.tobytes(), [0, *ends]
            out.update((c, raw[4 * i : 4 * j]) for c, i, j in zip(part, begin, ends))
        others = [c for c in cores if c not in out and b"|" not in c] if len(self.bar) == 1 else []
        for lo in range(0, len(others), 200):
            part = others[lo : lo + 200]
            ids = np.array(self.ids(" | ".join([c.decode() for c in part])), "<u4")
            cuts = np.flatnonzero(ids == self.bar[0])
            if len(cuts) != len(part) - 1:
                continue
            raw, at = ids.tobytes(), [-1, *cuts.tolist(), len(ids)]
            out.update((c, raw[4 * i + 4 : 4 * j]) for c, i, j in zip(part, at, at[1:]))
        for c in cores:
            if c not in out:
                out[c] = np.array(self.ids(c.decode()), "<u4").tobytes()
        return out

    def parts(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
        """For each chunk the numbers of its core and of its trailing marks among distinct parts; and these."""
        low = pc.ascii_lower(chunks)
        core = pc.ascii_rtrim(low, characters=MARKS)
        cut = pc.match_substring_regex(core, LETTERS_AT_ENDS)
        core = pc.if_else(cut, core, low)
        tail = pc.if_else(cut, pc.replace_substring_regex(low, pattern=TRAILING, replacement="\\1"), "")
        both = pa.concat_arrays([core, tail]).dictionary_encode()
        numbers = both.indices.to_numpy()
        return numbers[: len(chunks)], numbers[len(chunks) :], both.dictionary

    def encode(self, texts: pa.StringArray) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        whole = np.zeros(len(texts), bool)
        for token in self.special:
            whole |= pc.match_substring(texts, token, ignore_case=True).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self.encode_chunks(texts)
        out = self.encode_chunks(pc.if_else(pa.array(whole), "", texts))
        for i in np.flatnonzero(whole):
            out[i] = np.array(self.whole.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def encode_chunks(self, texts: pa.StringArray) -> list[bytes]:
        """The same for texts without added tokens."""
        split = pc.ascii_split_whitespace(texts)
        at = split.offsets.to_numpy()
        distinct = split.values.slice(int(at[0]), int(at[-1] - at[0])).dictionary_encode()
        core, tail, names = self.parts(distinct.dictionary)
        keys = names.cast(pa.binary()).to_pylist()
        ids = [self.cores.find(k) if k else b"" for k in keys]
        new = [i for i, x in enumerate(ids) if x is None]
        fresh = self.learn([keys[i] for i in new])
        for i in new:
            ids[i] = fresh[keys[i]]
            if len(keys[i]) <= 64:
                self.cores.keep(keys[i], ids[i])
        # the ids of all parts in one array, then those of each part of each chunk in order
        flat = np.frombuffer(b"".join(ids), "<u4")
        size = np.array([len(x) // 4 for x in ids], np.int64)
        begin = np.cumsum(size) - size
        numbers = distinct.indices.to_numpy()
        order = np.stack([core[numbers], tail[numbers]], axis=1).ravel()
        n = size[order]
        ends = np.concatenate(([0], np.cumsum(n)))
        out = flat[np.repeat(begin[order] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        cuts = (ends[2 * (at - at[0])] * 4).tolist()
        return [out[i:j] for i, j in zip(cuts, cuts[1:])]


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker and vocabulary."""
    return worker_state(("token_output", path), lambda: ChunkEncoder(path))


def pack_block(shard: int, block: int, before: int, doc_ids: list, ids: list[bytes]) -> bytes:
    values = np.frombuffer(b"".join(ids), dtype="<u4")
    words = simple8b_encode(values)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    lens = np.array([len(x) // 4 for x in ids], "<u4")
    head = HEADER.pack(MAGIC, shard, block, len(doc_ids), before, len(values), len(words))
    return b"".join((head, keys.tobytes(), known.tobytes(), lens.tobytes(), words.astype("<u8").tobytes()))


def blocks(content: bytes) -> Iterator[tuple[tuple, int]]:
    """Header fields and place of the body, for each block of a shard file."""
    at = 0
    while at < len(content):
        head = HEADER.unpack_from(content, at)
        if head[0] != MAGIC:
            raise ValueError(f"no block at byte {at}")
        yield head, at + HEADER.size
        at += HEADER.size + head[3] * 13 + head[6] * 8 + 1


def unpack_block(content: bytes, head: tuple, at: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, their numbers of tokens, and all token ids of a block."""
    n, words = head[3], head[6]
    keys = np.frombuffer(content, "<i8", n, at)
    known = np.frombuffer(content, np.uint8, n, at + 8 * n)
    lens = np.frombuffer(content, "<u4", n, at + 9 * n)
    values = simple8b_decode(np.frombuffer(content, "<u8", words, at + 13 * n))
    return [k if ok else None for k, ok in zip(keys.tolist(), known.tolist(), strict=True)], lens, values.astype("<u4")


def write_token_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of docs(doc_id, text) under path/shards in ascending doc_id order, then path/manifest."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        end, enc = struct.pack("<I", end_id), encoder(tokenizer_path)
        doc_ids, held, size = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal block, before, doc_ids, held, size
            out = pa.RecordBatch.from_arrays([pa.array([pack_block(shard, block, before, doc_ids, held)], pa.binary())], ["block"])
            block, before, doc_ids, held, size = block + 1, before + size, [], [], 0
            return out

        for batch in batches:
            for lo in range(0, len(batch), 1024):
                rows = batch.slice(lo, 1024)
                texts = pc.fill_null(rows.column(1), "")
                for d, ids in zip(rows.column(0).to_pylist(), enc.encode(texts), strict=True):
                    doc_ids.append(d)
                    held.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= block_ids:
                        yield close()
        if doc_ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    coded = dealt.mapInArrow(encode, "block binary").select(F.col("block").cast("string").alias("value"))
    coded.write.option("maxRecordsPerFile", BLOCKS_PER_FILE).option("compression", "none").text(f"{path}/shards")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                heads = [h for h, _ in blocks(content.as_py())]
                if heads:
                    yield pa.RecordBatch.from_arrays([pa.array([heads[0][1]], pa.int64()), pa.array([sum(h[5] for h in heads)], pa.int64())], ["shard", "ids"])

    # one row for each shard, as many as there were partitions
    sums = shard_files(spark, path).mapInArrow(totals, "shard long, ids long").groupBy("shard").agg(F.sum("ids").alias("ids"))
    start, rows = 0, []
    for r in sorted(sums.collect()):
        rows.append((r.shard, start, r.ids))
        start += r.ids
    spark.createDataFrame(rows, "shard long, start long, ids long").coalesce(1).write.parquet(f"{path}/manifest")


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards").select("content")


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document's place among all ids, and its ids as little-endian 32-bit integers."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                content = batch.column(0)[i].as_py()
                for head, at in blocks(content):
                    doc_ids, lens, values = unpack_block(content, head, at)
                    ends = np.cumsum(lens, dtype=np.int64)
                    raw = values.tobytes()
                    ids = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([head[1]] * len(lens), pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(ends - lens + head[4], pa.int64()), pa.array(lens.astype(np.int64)), pa.array(ids, pa.binary())],
                        ["shard", "doc_id", "place", "n_tokens", "ids"],
                    )

    rows = shard_files(spark, path).mapInArrow(decode, "shard long, doc_id long, place long, n_tokens long, ids binary")
    manifest = spark.read.parquet(f"{path}/manifest").select("shard", F.col("start").alias("base"))
    return rows.join(manifest, "shard").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the shard files and back."""
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_token_shards(read_table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_token_shards(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


