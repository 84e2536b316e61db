"""Operator 10: document fingerprints by one-permutation MinHash, in DataFrame functions only.

A text's five-word shingles are hashed once. The top 8 bits of a hash choose one of 256 bins, each bin keeps
its least hash, and an empty bin copies the bin that comes first in its own pseudo-random order of all bins
(optimal densification), so two texts with nearly the same shingles fill alike. The low four bits of each
bin's hash, mixed with the bin's number so that copies are not copies of chance agreements, make the
fingerprint, 256 hex digits. The share of equal digits, less the one in 16 that agree by chance,
estimates the Jaccard similarity of the shingle sets.

Defined results: a null text counts as empty; a text without words has the empty fingerprint, which is like
itself (1) and unlike all others (0); with fewer than five words the whole sequence is the one shingle; equal
texts have equal fingerprints; repeated rows stand next to each other and are each other's next document; a
null doc_id comes first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelweave.llm.common import let, read_table

SHINGLE = 5
BINS = 256
#: Places of an empty bin's order that are looked up in tables before the rest is searched.
TRIES = 8
PRIME = 1_000_000_007

#: Rows wanted in a run of consecutive documents, and the most runs there are: beyond 65 million documents runs grow, and
#: a window sorts a run outside memory.
RUN_ROWS = 1000
MAX_RUNS = 65_536


def order_key(i, j):
    """Where bin j comes in the order of bin i, for numbers and columns alike: squares modulo a prime."""
    x = (i * 1_000_003 + j * 15_485_863 + 7_368_787) % PRIME
    return (x * x + i) % PRIME


def first_tries() -> list[list[int]]:
    """By place t, for each bin the t-th bin of its order, itself left out (it is empty)."""
    orders = [sorted((j for j in range(BINS) if j != i), key=lambda j: (order_key(i, j), j)) for i in range(BINS)]
    return [[orders[i][t] for i in range(BINS)] for t in range(TRIES)]


def words(text: Column) -> Column:
    return F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), "[\\x20\\x09-\\x0D]+")


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """Hashes of all runs of n words; of all words together if they are fewer; none for no words."""
    hashes = F.transform(F.filter(words(text), lambda w: w != ""), lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < n, F.array(F.xxhash64(h))).otherwise(many)

    return let(hashes, runs)


def fingerprint(text: Column) -> Column:
    """256 hex digits, or the empty string for a text without words."""
    bin_of = lambda x: F.shiftright(x, 56).cast("int") + BINS // 2
    digit = lambda x, i: F.lower(F.hex(F.xxhash64(x, i).bitwiseAND(F.lit(15).cast("long"))))
    tables = [F.lit(t) for t in first_tries()]

    def least(h: Column) -> Column:  # of sorted hashes the first of each bin
        return F.filter(h, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(h, i - 1), 56)))

    def spread(f: Column) -> Column:  # least hashes by bin, null where a bin is empty
        gap = lambda n: F.array_repeat(F.lit(None).cast("bigint"), n)
        parts = F.transform(f, lambda x, k: F.concat(gap(bin_of(x) - F.when(k == 0, F.lit(-1)).otherwise(bin_of(F.get(f, k - 1))) - 1), F.array(x)))
        return F.concat(F.flatten(parts), gap(BINS - 1 - bin_of(F.element_at(f, -1))))

    def dense(f: Column) -> Column:
        def fill(a: Column) -> Column:
            def one(i: Column) -> Column:
                far = F.array_min(F.transform(f, lambda x: F.struct(order_key(i.cast("long"), bin_of(x).cast("long")).alias("k"), bin_of(x).alias("j"), x.alias("x"))))
                return digit(F.coalesce(F.get(a, i), *[F.get(a, F.get(t, i)) for t in tables], far["x"]), i)

            return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), one), "")

        return let(spread(f), fill)

    return let(let(F.sort_array(shingles(text)), least), lambda f: F.when(F.size(f) == 0, F.lit("")).otherwise(dense(f)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two fingerprints, 0 to 1."""
    same = F.aggregate(F.sequence(F.lit(1), F.lit(BINS)), F.lit(0), lambda s, i: s + (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))).cast("int"))
    raw = (same / BINS - 1 / 16) / (1 - 1 / 16)
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def with_next(docs: DataFrame, columns: list[str], run_rows: int = RUN_ROWS) -> DataFrame:
    """docs(doc_id, text, ...) with next_<column> of the document with the next larger doc_id; after the last comes the first.

    Documents are dealt to runs of consecutive ids. The cuts are quantiles of the ids, as Spark's sketch gives them,
    so runs are even however the ids lie; the driver sees the cuts, fewer than MAX_RUNS. The first document of each run
    also goes to the run before it, so each run is a window of its own, and no window spans the table.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    least, n = docs.agg(F.min(key), F.count("*")).first()
    if not n:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    runs = min(MAX_RUNS, -(-n // run_rows))
    shares = F.split(F.lit(",".join(str(i / runs) for i in range(1, runs))), ",").cast("array<double>")
    found = docs.agg(F.percentile_approx(key, shares, max(10_000, 10 * runs))).first()[0] if runs > 1 else []
    # a cut is an id of the table, the first of its run
    firsts = [least, *sorted({c for c in found if c > least})]
    cuts = F.split(F.lit(",".join(map(str, firsts))), ",").cast("array<bigint>")
    steps = [1 << k for k in reversed(range(len(firsts).bit_length()))]
    # the last first id that is not above the key, by halving steps
    run = F.aggregate(F.array(*[F.lit(k) for k in steps]), F.lit(0), lambda at, k: at + F.when(F.get(cuts, at + k) <= F.col("id_key"), k).otherwise(0)).cast("long")
    also = [(first, [(r - 1, 0)] if r else [(len(firsts) - 1, 1)]) for r, first in enumerate(firsts)]
    # at most MAX_RUNS rows
    also_table = F.broadcast(spark.createDataFrame([(k, [{"run": a, "wrap": b} for a, b in x]) for k, x in also], "id_key long, also array<struct<run:long,wrap:int>>"))
    # the columns of docs travel in a struct, so that their names cannot clash with these
    rows = docs.select(F.struct(*docs.columns).alias("doc"), key.alias("id_key"), F.xxhash64("text").alias("tie"))
    rows = rows.withColumn("run", run).join(also_table, "id_key", "left")
    own = F.struct("run", F.lit(0).alias("wrap"), F.lit(True).alias("own"))
    more = F.transform(F.coalesce("also", F.array().cast("array<struct<run:bigint,wrap:int>>")), lambda s: F.struct(s["run"].alias("run"), s["wrap"].alias("wrap"), F.lit(False).alias("own")))
    rows = rows.select("doc", "id_key", "tie", F.explode(F.concat(F.array(own), more)).alias("at"))
    order = Window.partitionBy("at.run").orderBy("at.wrap", "id_key", F.col("at.own").desc(), "tie")
    rows = rows.select("doc", "at", *[F.lead(F.col(f"doc.{c}")).over(order).alias(f"next_{c}") for c in columns]).where("at.own")
    return rows.select("doc.*", *[f"next_{c}" for c in columns])


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how like they are."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("fingerprint", fingerprint(F.col("text")))
    rows = with_next(docs, ["text", "fingerprint"])
    n = F.char_length("text").cast("long")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n.cast("int") - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.select("doc_id", n.alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).withColumn("edited_fingerprint", fingerprint(F.col("edited"))).drop("edited")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
