"""Operator 9: byte-level BPE by longest matches and backtracking.

Bytes become Latin-1 characters, so an Aho-Corasick automaton over the vocabulary (pyahocorasick takes
strings) finds all tokens that match anywhere in a piece in one pass. From the left the longest match is
taken if it is compatible with the token before it, else the next shorter one; where none is left the
encoder steps back. Two adjacent tokens are compatible if merging their bytes by rank would leave just
these two, a test on their merge trees that is remembered by pair. A byte position that failed once never
needs trying again, so the work is linear in the piece, and the ids are those of merging by rank.

Defined results: a null text counts as empty and has no ids; empty tables give no rows; repeated rows are
encoded each; other columns are ignored; texts and pieces may be of any length.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import Recent, read_table, worker_state

#: Pieces, units and pairs of tokens that a memo remembers, in each of its two generations: about 35 MB a worker in all.
MEMO = 60_000
#: The same where encoding has the executor to itself: about 140 MB a worker.
LARGE_MEMO = 250_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteBPE:
    """Encoder and decoder for a table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = MEMO):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[int, bool] = {}
        self.pieces = Recent(limit)
        self.limit = limit

    def merge(self, piece: bytes, stop: int = 1) -> list[bytes]:
        """The parts of a piece after merging by rank until `stop` are left or nothing merges."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = len(self.ranks)
        while len(parts) > stop:
            at = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], none))
            if parts[at] + parts[at + 1] not in self.ranks:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self.halves:
            whole = self.bytes_of[token]
            self.halves[token] = tuple(self.ranks[p] for p in self.merge(whole, 2)) if len(whole) > 1 else None
        return self.halves[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of a then b merge to just a, b.

        Undo the later of the two merges step by step: a pair across the border that would merge before the
        merges that built its two sides takes the border away.
        """
        key = a << 32 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= self.limit:
                self.fits.clear()
            known = self.fits[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        left, right, before = a, b, len(self.ranks) + 1
        while True:
            # left and right stand side by side until the merge ranked `before` happens
            joined = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joined is not None and joined < before:
                return False
            sl, sr = self.split(left), self.split(right)
            if sl is None and sr is None:
                return True
            # the merge made last goes first; equal merges are made from left to right
            if sr is None or (sl is not None and left > right):
                before, left = left, sl[1]
            else:
                before, right = right + 1, sr[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece, as merging by rank gives them."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, signs = len(piece), piece.decode("latin-1")
        # longest matches from the left: where each fits its neighbour nothing else can be the answer
        greedy = [token for _, (_, token) in self.automaton.iter_long(signs)]
        if all(map(self.compatible, greedy, greedy[1:])) and sum([len(self.bytes_of[t]) for t in greedy]) == n:
            return greedy
        at_start: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(signs):
            at_start[end - found[0] + 1].append(found)  # ends rise, so the longest is last and is taken first
        out: list[tuple[int, int]] = []
        at, dead = 0, bytearray(n + 1)
        while at < n:
            options = at_start[at]
            last = out[-1][1] if out else None
            while options:
                size, token = options.pop()
                if not dead[at + size] and (last is None or self.compatible(last, token)):
                    out.append((size, token))
                    at += size
                    break
            else:
                if not out:
                    raise ValueError("bytes that no token covers")
                dead[at] = 1
                at -= out.pop()[0]
        return [t for _, t in out]

    def encode_unit(self, unit: str) -> bytes:
        """Packed ids of a run of text that no piece reaches over."""
        out = []
        for p in self.find(unit):
            ids = self.pieces.find(p)
            if ids is None:
                k = self.encode_piece(p.encode())
                ids = struct.pack(f"<{len(k)}I", *k)
                if len(p) <= 64:
                    self.pieces.keep(p, ids)
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        get = self.bytes_of.__getitem__
        return b"".join(map(get, memoryview(ids).cast("I")))


#: Where cutting before each space could change a piece: two white-space characters around or before a space.
RUNS = re.compile(r"\s \s|  ")


class Units(Recent):
    """Packed ids by unit: a space and what follows up to the next one."""

    def __init__(self, bpe: ByteBPE, limit: int):
        super().__init__(limit)
        self.bpe = bpe

    def __missing__(self, unit: str) -> bytes:
        ids = self.old.get(unit)
        if ids is None:
            ids = self.bpe.encode_unit(" " + unit)
        if len(unit) <= 64:
            self.keep(unit, ids)
        return ids


class TextEncoder:
    """Whole texts: cut before single spaces where that keeps every piece whole, else matched as they are."""

    def __init__(self, ranks_path: str, pattern: str, limit: int = MEMO):
        self.bpe = ByteBPE(load_ranks(ranks_path), pattern, limit)
        self.units = Units(self.bpe, limit)

    def encode(self, text: str) -> bytes:
        if RUNS.search(text):
            return self.bpe.encode_unit(text)
        first, *rest = text.split(" ")
        return self.bpe.encode_unit(first) + b"".join(map(self.units.__getitem__, rest))


def text_encoder(ranks_path: str, pattern: str, memo: int = MEMO) -> TextEncoder:
    return worker_state(("byte_bpe", ranks_path, pattern, memo), lambda: TextEncoder(ranks_path, pattern, memo))


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None, memo: int = MEMO) -> DataFrame:
    """docs with one more column: the ids of each text, little-endian unsigned 32-bit. A narrow map: no shuffle.

    Texts are cut before single spaces, which holds for patterns that, like those of the public byte-level vocabularies,
    join a space to the piece behind it and never to one before.

    With decoded, a column of that name has the bytes that those ids stand for: as decode_ids() after it would add, but
    in the same Python worker, so that a task holds one vocabulary and not two.
    """
    at = docs.columns.index(text)
    more = [ids] if decoded is None else [ids, decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_encoder(ranks_path, pattern, memo)
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                coded = [coder.encode(t or "") for t in part.column(at).to_pylist()]
                columns = [pa.array(coded, pa.binary())]
                if decoded is not None:
                    columns.append(pa.array(list(map(coder.bpe.decode, coded)), pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *more])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(n, T.BinaryType()) for n in more]]))


def decode_ids(rows: DataFrame, ranks_path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """rows with one more column: the bytes that the ids stand for."""
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = text_encoder(ranks_path, pattern).bpe
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                got = [None if x is None else bpe.decode(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], [*part.schema.names, out])

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType())]))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the digest of what they decode to."""
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    back = encode_texts(docs, path, P.PATTERN, decoded="decoded", memo=LARGE_MEMO)
    return back.select("doc_id", (F.length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


