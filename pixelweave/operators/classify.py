"""From class probabilities to class maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid_probabilities(prob: DataFrame, labels: list[str] | None = None, label: str = "label", v: str = "v") -> DataFrame:
    """Rows with a number, of whitelisted labels."""
    rows = prob.where(F.col(v).isNotNull() & ~F.isnan(v))
    return rows.where(F.col(label).isin(labels)) if labels is not None else rows


def class_ids(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, cls): ids from 1 in order of the names."""
    names = df.select(label).distinct()
    return names.withColumn("cls", F.row_number().over(Window.orderBy(label)).cast("int"))


#: Rank error of the sketches that bracket exact quantiles: one row in so many.
ACCURACY = 10_000


def class_quantiles(prob: DataFrame, qs: tuple = (0.01, 0.99), accuracy: int = ACCURACY) -> DataFrame:
    """(cls, q_lo, q_hi): exact quantiles over all scenes, linear between neighbours.

    A sketch gives for each class of more than `accuracy` rows two values that a quantile lies between for sure, a few
    rows in `accuracy` apart. What lies below them is only counted, and what lies between is ranked by distinct values, so no task holds a class.
    """
    rows = prob.where(F.col("v").isNotNull()).select("cls", F.col("v").cast("double").alias("v"))
    off = 3.0 / accuracy
    shares = [min(1.0, max(0.0, q + d)) for q in qs for d in (-off, off)]
    # a row for each class
    found = rows.groupBy("cls").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", F.array(*[F.lit(s) for s in shares]), F.lit(accuracy)).alias("p"))
    place = [(F.col("n") - 1) * F.lit(float(q)) for q in qs]
    few = F.col("n") <= accuracy
    ends = [(F.col("least") if shares[2 * i] <= off else F.when(few, F.col("least")).otherwise(F.col("p")[2 * i]), F.col("most") if shares[2 * i + 1] >= 1 - off else F.when(few, F.col("most")).otherwise(F.col("p")[2 * i + 1])) for i in range(len(qs))]
    wanted = found.select("cls", F.posexplode(F.array(*[F.struct(a.alias("a"), b.alias("b"), p.alias("place")) for (a, b), p in zip(ends, place, strict=True)])).alias("i", "w")).select("cls", "i", "w.*")
    near = rows.join(wanted, "cls").where(F.col("v") <= F.col("b"))
    near = near.groupBy("cls", "i", "place", F.when(F.col("v") >= F.col("a"), F.col("v")).alias("v")).agg(F.count("*").alias("k"))
    ranked = near.withColumn("upto", F.sum("k").over(Window.partitionBy("cls", "i").orderBy(F.col("v").asc_nulls_first()))).where("v is not null")
    low, high = F.floor("place"), F.ceil("place")
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    both = ranked.groupBy("cls", "i", "place").agg(at(low).alias("x"), at(high).alias("y"))
    value = F.col("x") + (F.col("y") - F.col("x")) * (F.col("place") - low)
    return both.groupBy("cls").agg(F.max(F.when(F.col("i") == 0, value)).alias("q_lo"), F.max(F.when(F.col("i") == 1, value)).alias("q_hi"))


def stretch(prob: DataFrame, quantiles: DataFrame, eps: float = 1e-6) -> DataFrame:
    """v scaled to 0..1 between its class's quantiles; nodata stays nodata, a class without quantiles stays as it is."""
    q = prob.join(F.broadcast(quantiles), "cls", "left")
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - F.col("q_lo")) / (F.col("q_hi") - F.col("q_lo") + eps)))
    return q.withColumn("v", F.when(F.col("v").isNotNull() & F.col("q_lo").isNotNull(), scaled).otherwise(F.col("v"))).select(*prob.columns)


def classify(prob: DataFrame, keys: tuple = ("scene", "r", "c"), nan_policy: str = "ignore") -> DataFrame:
    """(keys, cls, v): the class of the highest value, of equals the lowest class; no row where no class has a value.

    nan_policy "numpy" lets a missing value win, as an arg-max over NaN does, except where all are missing.
    """
    if nan_policy == "numpy":
        filled = prob.withColumn("v", F.coalesce("v", F.lit(float("nan"))))
        out = filled.groupBy(*keys).agg(F.max_by("cls", F.struct("v", -F.col("cls"))).alias("cls"), F.max(F.when(~F.isnan("v"), F.col("v"))).alias("v"))
        return out.where("v is not null")
    return prob.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy(*keys).agg(F.max_by("cls", F.struct("v", -F.col("cls"))).alias("cls"), F.max("v").alias("v"))
