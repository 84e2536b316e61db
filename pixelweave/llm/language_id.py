"""Operator 5: language identification by error-correcting output codes.

Every language has a codeword; one binary classifier on hashed byte n-grams predicts each of its bits. The
decoder sums, for each language, the logistic loss of the bit margins against its codeword: the nearest wins,
and a document whose nearest codeword is not clearly nearer than the next is flagged ambiguous.

The classifiers are fitted on the driver to a bounded sample of the labelled rows: about SAMPLE_ROWS in all,
drawn evenly over the languages by a hash. Executors turn sampled texts into feature vectors of fixed length,
so the driver holds SAMPLE_ROWS x DIMENSIONS numbers whatever the input. Prediction is a narrow map.

Defined results: a null text, and one without any letter, is `und` with score 0; so is every text if there
are no labelled rows; with a single language every text with a letter is of that language, score 1; equal
distances go to the first language in code-point order; repeated rows and other columns do not matter; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import read_table, training_rows, worker_state

SAMPLE_ROWS = 2400
DIMENSIONS = 4096
ORDERS = (2, 3, 4)
UNKNOWN = "und"
#: Below this share of the likelihood the nearest codeword is ambiguous.
CLEAR = 0.5

WORD_SIGN = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in WORD_SIGN.finditer(text))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams of the whole lower-cased text."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    counts = np.zeros(DIMENSIONS, np.float64)
    x = b
    for n in range(2, max(ORDERS) + 1):
        if len(b) < n:
            break
        x = x[:-1] * np.uint32(0x01000193) ^ b[n - 1 :]
        if n in ORDERS:
            at = (x * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(20)
            counts += np.bincount(at, minlength=DIMENSIONS)
    total = counts.sum()
    return np.sqrt(counts / total if total else counts).astype(np.float32)


def code_matrix(k: int, seed: int = 5) -> np.ndarray:
    """k codewords of -1 and 1: distinct columns up to sign, from the seeded tries the one whose words lie farthest apart."""
    if k < 2:
        return np.ones((k, 1), np.float32)
    rng = np.random.default_rng(seed)
    bits = int(min(2 ** min(k - 1, 20) - 1, max(15, np.ceil(10 * np.log2(k)))))
    best, far = None, -1
    for _ in range(40 if k <= 256 else 3):
        columns: dict[bytes, np.ndarray] = {}
        while len(columns) < bits:
            c = rng.integers(0, 2, k).astype(np.int8)
            c ^= c[0]
            if c.any():
                columns[c.tobytes()] = c
        m = np.array(list(columns.values())).T.astype(np.float32) * 2 - 1
        apart = (bits - m @ m.T) / 2 + bits * np.eye(k)
        if apart.min() > far:
            best, far = m, apart.min()
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text."""
        known = [i for i, t in enumerate(texts) if t is not None and has_letter(t)] if self.languages else []
        langs, score, unclear = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if known:
            margins = np.array([features(texts[i]) for i in known]) @ self.weights + self.bias
            loss = np.logaddexp(0, -margins[:, None, :].astype(np.float64) * self.codes[None]).sum(axis=2)
            near = loss.argmin(axis=1)
            like = np.exp(loss.min(axis=1, keepdims=True) - loss)
            share = 1 / like.sum(axis=1)
            for i, best, s in zip(known, near.tolist(), share.tolist(), strict=True):
                langs[i], score[i], unclear[i] = self.languages[best], min(1.0, s), s < CLEAR
        return langs, score, unclear


def fit(x: np.ndarray, labels: list[str], steps: int = 150, decay: float = 1e-5) -> LanguageModel:
    """Logistic regressions for all bits at once, by full-batch Adam; each language weighs the same."""
    names = sorted(set(labels))
    codes = code_matrix(len(names))
    w, b = np.zeros((DIMENSIONS, codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    if len(names) > 1:
        y = np.array([names.index(v) for v in labels])
        weigh = (1 / np.bincount(y)[y] / len(names)).astype(np.float32)[:, None]
        goal = codes[y]
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
        for t in range(1, steps + 1):
            g = -goal * weigh / (1 + np.exp(np.clip(goal * (x @ w + b), -30, 30)))
            gw, gb = x.T @ g + decay * w, g.sum(axis=0)
            m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            rate = 0.5 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            w -= (rate * m / (np.sqrt(v) + 1e-6)).astype(np.float32)
            b -= (rate * mb / (np.sqrt(vb) + 1e-6)).astype(np.float32)
    else:
        b += 20
    return LanguageModel(names, codes, w, b)


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> LanguageModel:
    """Fit to about sample_rows distinct texts of docs(text, lang), as many of each language where there are enough; rows without language or letter teach nothing."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != UNKNOWN)).select("lang", "text")
    # a text's own hash decides, so the sample does not hang on order or partitions; copies are one text
    key = F.xxhash64(F.lit(seed), F.col("text"))
    counts = {r["lang"]: r["n"] for r in rows.select("lang", key.alias("key")).distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit(np.zeros((0, DIMENSIONS), np.float32), [])
    each = max(8, sample_rows // len(counts))
    share = docs.sparkSession.createDataFrame([(k, min(1.0, each / n)) for k, n in counts.items()], "lang string, share double")
    draw = F.pmod(key, F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.join(F.broadcast(share), "lang").where(draw < F.col("share")).select("lang", "text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(a, t) for a, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.string()), pa.array([features(t).astype(np.float16).tobytes() for _, t in pairs], pa.binary())], ["lang", "x"])

    found = drawn.mapInArrow(run, "lang string, x binary").collect()
    x = np.array([np.frombuffer(r["x"], np.float16) for r in found], np.float32).reshape(-1, DIMENSIONS)
    order = sorted(range(len(found)), key=lambda i: (found[i]["lang"], bytes(found[i]["x"])))
    return fit(x[order], [found[i]["lang"] for i in order])


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", names: tuple = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """docs with language, score and ambiguity under `names` (which replace columns of docs so called); only the text is looked at. The model is a few hundred KB at most for a few hundred languages."""
    from pyspark.sql import types as T

    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("language_id",))
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                langs, score, unclear = held.value.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(unclear)], [*part.schema.names, *names])

    more = [T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)]
    kept = docs.drop(*names)
    at = kept.columns.index(text)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *more]))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; those whose id's crc32 mod 3 is 1 are held out from fitting."""
    docs = read_table(spark, sf_dir, "documents")
    learn = training_rows(F.col("doc_id"), 3, 1)
    model = train(docs.where(learn))
    return predict(docs.select("doc_id", (~learn).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
