"""The corpus pipeline: language ID, near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
run() writes each stage's rows as Parquet to the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm import byte_bpe, language_id, mixing, near_dup
from pixelweave.llm.common import read_table, stage


def own_name(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name in docs.columns:
        name = "_" + name
    return name


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts, texts without a letter, and those whose codeword is ambiguous.

    A text's prediction hangs on the text and the model alone: equal texts, repeated rows too, stay or go together, and texts
    of any length are read whole. Where nothing can be learned (an empty table, no labels) no document has a language. A tie
    between codewords is ambiguous. Null ids and sources and other columns, whatever their names, are kept as they are.
    """
    model = language_id.train(docs)
    lang, unclear, score = (own_name(docs, n) for n in ("lang_pred", "ambiguous", "lang_score"))
    told = language_id.predict(docs, model, names=(lang, score, unclear))
    return told.where((F.col(lang) != language_id.UNKNOWN) & ~F.col(unclear)).select(*docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document of the smallest id, once; of a group without ids one text.

    Null texts and texts without words resemble nothing and stay, but rows equal in id and text are one document. Of rows
    with one id and different texts that are alike one stays. Texts of any length are compared whole; an empty table gives no rows; other
    columns, whatever their names, are kept, of repeated rows those of any one.
    """
    found = near_dup.near_duplicates(docs.select("doc_id", "text"))
    key = own_name(docs, "row_key")
    named = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("text_key").alias(key)).distinct()
    kept = named.union(found.where("component_id is null").groupBy("group").agg(F.min("text_key").alias(key)).select(key))
    return docs.withColumn(key, near_dup.text_key("doc_id", "text")).join(kept, key).dropDuplicates([key]).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out whole documents so that sources meet their targets.

    A null source is a source of its own, the last one; texts that are null or have no word weigh nothing and are taken
    as often as what lies beside them in their shard; of rows equal in id and text each is taken as often as the one of
    them taken least; an empty table gives no rows; other columns, whatever their names, are kept.
    """
    key, copies = own_name(docs, "mix_key"), own_name(docs, "copies")
    mix = mixing.mix_sources(docs).groupBy(F.col("key").alias(key)).agg(F.min("copies").alias(copies)).where(F.col(copies) > 0)
    taken = docs.withColumn(key, mixing.row_key("doc_id", "text")).join(mix, key)
    again = own_name(docs, "copy")
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(again)).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the digest of what they decode to.

    A null text counts as empty and has no ids; equal rows are coded each; an empty table gives no rows; columns other
    than doc_id, source and text, whatever their names, are left out.
    """
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    back = byte_bpe.encode_texts(docs.select("doc_id", "source", "text"), path, P.PATTERN, decoded="decoded")
    return back.select("doc_id", "source", (F.length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_stage),
    ("near_dup", near_dup_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", bpe_stage),
]

#: Models and tokenizers are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
