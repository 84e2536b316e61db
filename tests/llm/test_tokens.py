from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pixelweave.llm import byte_bpe
from pixelweave.llm import token_output as to

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
TEXT = st.text(alphabet="abeAZ  \n\t'sé漢🙂 1290.,!|<>́ñü\x1c\x0b", max_size=60) | st.text(max_size=40)
own = byte_bpe.text_encoder(RANKS, P.PATTERN)
theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
library = Tokenizer.from_file(WORDS)
library.encode_special_tokens = True


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_byte_bpe_is_exact(text):
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text)
    assert own.bpe.decode(ids) == text.encode()


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_chunk_encoder_is_exact(text):
    got = np.frombuffer(to.encoder(WORDS).encode(pa.array([text]))[0], "<u4").tolist()
    assert got == library.encode(text, add_special_tokens=False).ids


def test_long_pieces_and_small_memos():
    for text in ("ab" * 20000, "x" * 30000, " ".join(f"w{i}" for i in range(3000))):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == theirs.encode_ordinary(text)
    small = to.ChunkEncoder(WORDS, limit=8)
    texts = [" ".join(f"w{i % 37}x{i % 11}" for i in range(k, k + 50)) for k in range(20)]
    for t, got in zip(texts, small.encode(pa.array(texts).slice(0)), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 60000) | st.just(0), max_size=300))
def test_simple8b_round_trip(values):
    words = to.simple8b_encode(np.array(values, np.uint64))
    assert to.simple8b_decode(words).tolist() == values


def test_packing_is_dense():
    assert len(to.simple8b_encode(np.zeros(1200, np.uint64))) == 10
    assert len(to.simple8b_encode(np.ones(600, np.uint64))) == 10


def test_shards_round_trip(spark, tmp_path):
    rows = [(3, "Hello  world"), (1, ""), (2, None), (3, "Hello  world"), (None, "first"), (10**12, "long " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    to.write_token_shards(df, f"file://{tmp_path}/a", WORDS, 2, block_ids=5)
    got = sorted(to.read_token_shards(spark, f"file://{tmp_path}/a").collect(), key=lambda r: r.start)
    want, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in got] == want
    to.write_token_shards(df.limit(0), f"file://{tmp_path}/b", WORDS, 2)
    assert to.read_token_shards(spark, f"file://{tmp_path}/b").count() == 0


def test_byte_bpe_frame(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "Größe 漢字", "y"), (None, "a", None)], "doc_id long, text string, decoded string")
    coded = byte_bpe.encode_texts(df, RANKS, P.PATTERN)
    back = byte_bpe.decode_ids(coded.drop("decoded"), RANKS, P.PATTERN)
    assert sorted(bytes(r.decoded).decode() for r in back.collect()) == ["", "Größe 漢字", "a"]
    both = byte_bpe.encode_texts(df.drop("decoded"), RANKS, P.PATTERN, decoded="decoded").select(*back.columns)
    assert sorted(both.drop("text").collect(), key=str) == sorted(back.drop("text").collect(), key=str)
    assert byte_bpe.encode_texts(df.limit(0), RANKS, P.PATTERN).count() == 0


SPECIAL = ["<|endoftext|> a b", "x<|ENDOFTEXT|>y", "plain, text", "", "<|startoftext|>", "Two <|endoftext|><|endoftext|> ends"]


def test_special_tokens_in_texts(spark, tmp_path):
    """As the library has it by default: a special token in a text is that token."""
    path = P.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    assert own.get_added_tokens_decoder()
    df = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    to.write_token_shards(df, f"file://{tmp_path}/t", path, 2)
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in to.read_token_shards(spark, f"file://{tmp_path}/t").collect()}
    assert got == {i: [*own.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(SPECIAL)}


def test_token_query_over_small_tables(spark, sf):
    own = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    want, start = set(), 0
    for d, t in docs:
        ids = np.array([*own.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.add((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert {tuple(r) for r in to.op3_token_output(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()} == want


def test_bpe_query_over_small_tables(spark, sf):
    import hashlib

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in byte_bpe.op9_byte_bpe(spark, sf).collect()}
    for d, t in texts.items():
        ids = np.array(enc.encode_ordinary(t), "<u4")
        assert got[d] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
