"""Catalogue logic: matching, splits, batches, logs, configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.operators.fanout import run_join
from pixelweave.operators.numbering import resume_after


def place_of(session: Column) -> Column:
    return F.split_part(session, F.lit("_"), F.lit(2))


def match_orthos(sessions: DataFrame, orthos: DataFrame, on: str = "place", keep: list[str] | None = None) -> DataFrame:
    """All orthos at the place of each session; a place may have many of both. keep: the columns to return, all if none."""
    return run_join(sessions, orthos, [on], keep)


def orthos_by_place(orthos: DataFrame) -> DataFrame:
    return orthos.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("ortho_id", "crs", "height", "width"))).alias("orthos"))


def assert_single_crs(orthos: DataFrame, keys: tuple = ()) -> DataFrame:
    """One row with the CRS, for each of keys if given; more than one raises."""
    one = orthos.groupBy(*keys).agg(F.count_distinct("crs").alias("n"), F.min("crs").alias("crs"))
    return one.select(*keys, F.when(F.col("n") == 1, F.col("crs")).otherwise(F.raise_error(F.lit("more than one CRS"))).alias("crs"))


def pair_examples(images: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    return images.join(annotations, key)


def hold_out(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys, on, "left_anti")


def split(df: DataFrame, name: str, frac: float = 0.3) -> DataFrame:
    """df with `held`: a share of the rows by a hash of their name, the same on every run and engine."""
    bucket = F.conv(F.substring(F.md5(F.col(name).cast("string").cast("binary")), 1, 4), 16, 10).cast("int")
    return df.withColumn("held", bucket < int(frac * 65536))


def batches(df: DataFrame, size: int, order: list[str], by: list[str]) -> DataFrame:
    """df with `batch`: chunks of `size` in order, within groups."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size).cast("long"))


def resume_from(df: DataFrame, start: str, order: str) -> DataFrame:
    """Rows from position `start` on; all of them if it is not a number within range."""
    n = df.count()
    k = int(start) if start.isnumeric() and int(start) < n else 0
    return resume_after(df, [order], k)


def epoch_log(df: DataFrame, run: str, epoch: str, pos: str, loss: str) -> DataFrame:
    """The first row of each whole epoch that has a loss."""
    w = Window.partitionBy(run, "epoch_no").orderBy(pos)
    rows = df.where(F.col(loss).isNotNull()).withColumn("epoch_no", F.floor(epoch).cast("long"))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def require_sections(df: DataFrame, config: str, paths: tuple) -> DataFrame:
    """df, where a JSON config without one of the dotted sections, or with an empty one, raises."""
    got = F.col(config)
    for p in paths:
        found = F.get_json_object(config, f"$.{p}")
        got = F.when(found.isNull() | (found == "{}"), F.raise_error(F.lit(f"no section {p} in config")).cast("string")).otherwise(got)
    return df.withColumn(config, got)


def cascade_delete(bad: DataFrame, on: str, *artefacts: DataFrame) -> list[DataFrame]:
    """Each table of artefacts without the rows whose key stands in bad."""
    gone = bad.select(on).distinct()
    return [a.join(gone, on, "left_anti") for a in artefacts]


def early_stop(df: DataFrame, patience: int, run: str = "run", epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """df with best (so far), waited (evaluations since it was reached, whatever their epochs) and stop."""
    w = Window.partitionBy(run).orderBy(epoch)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({"best": F.min(loss).over(upto), "at": F.row_number().over(w)}).withColumn("before", F.lag("best").over(w))
    out = out.withColumn("last", F.max(F.when(F.col("before").isNull() | (F.col(loss) < F.col("before")), F.col("at"))).over(upto))
    return out.withColumn("waited", F.col("at") - F.col("last")).withColumn("stop", F.col("waited") >= patience).drop("at", "before", "last")


def latest(df: DataFrame, key: str, what: str, when: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(what, F.struct(when, what)).alias(what), F.max(when).alias(when))


def stack_layers(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def with_class_info(df: DataFrame, classes: DataFrame) -> DataFrame:
    """Labels and colours by class id; the class table has a row for each class."""
    return df.join(F.broadcast(classes), "cls")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def masked_mean(emb: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """(by, i, mean): means of the vectors of each group, by component."""
    return emb.select(by, F.posexplode(vector).alias("i", "v")).groupBy(by, "i").agg(F.avg(F.col("v").cast("double")).alias("mean"))


#: Distinct stems that are broadcast, to leave out what equals none of them before it travels; more are met in the join alone.
STEMS = 10_000


def contains_join(names: DataFrame, name: str, stems: DataFrame, stem: str, keep: list[str] | None = None) -> DataFrame:
    """Rows of names and stems where the name contains the stem, each pair once. keep: the columns to return, all if none.

    A name is cut into its substrings of the stems' lengths, which meet the stems in an equi-join. The lengths, as many
    as the longest stem has letters at most, are read first. An empty stem is in every name that is not null.
    """
    known = stems.where(F.col(stem).isNotNull())
    lengths = sorted((r.n, r.d) for r in known.groupBy(F.length(stem).alias("n")).agg(F.count_distinct(stem).alias("d")).collect())

    def pieces(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(name) - n + 1, F.lit(1)))
        return F.when(F.length(name) >= n, F.transform(places, lambda i: F.substring(name, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    parts = [pieces(n) for n, _ in lengths]
    part = "_".join(["part", *names.columns, *stems.columns])
    cut = names.where(F.col(name).isNotNull()).withColumn(part, F.explode(F.array_distinct(F.flatten(F.array(*parts))) if parts else F.array().cast("array<string>")))
    if sum(d for _, d in lengths) <= STEMS:
        cut = cut.join(F.broadcast(known.select(F.col(stem).alias(part)).distinct()), part, "left_semi")
    return run_join(cut, stems.withColumn(part, F.col(stem)), [part], keep).drop(part)
