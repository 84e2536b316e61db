"""Confusion matrices and the measures drawn from them. Rows of truth 0 (nodata) are left out; a prediction outside the label list leaves the matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-7


def align_truth(pred: DataFrame, truth: DataFrame, keys: tuple = ("scene", "r", "c")) -> DataFrame:
    """(keys, gt, pred): truth pixels with the prediction at the same place, 0 where there is none."""
    p = pred.select(*keys, F.col("cls").alias("pred"))
    return truth.select(*keys, F.col("cls").alias("gt")).join(p, list(keys), "left").select(*keys, "gt", F.coalesce("pred", F.lit(0)).alias("pred"))


def label_universe(df: DataFrame, by: tuple = ()) -> DataFrame:
    """Distinct labels of truth and prediction without 0."""
    return df.select(*by, F.col("gt").alias("label")).union(df.select(*by, F.col("pred").alias("label"))).where("label <> 0").distinct()


def confusion(df: DataFrame, by: tuple = ()) -> DataFrame:
    """(by, gt, pred, n) dense over each group's labels."""
    n = df.where("gt <> 0").groupBy(*by, "gt", "pred").agg(F.count("*").alias("n"))
    labels = label_universe(n, by)  # from the counts, whose shuffle is made once
    grid = labels.withColumnRenamed("label", "gt").join(labels.withColumnRenamed("label", "pred"), list(by)) if by else labels.withColumnRenamed("label", "gt").crossJoin(labels.withColumnRenamed("label", "pred"))
    return grid.join(n, [*by, "gt", "pred"], "left").select(*by, "gt", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def normalise(cm: DataFrame, by: tuple = ()) -> DataFrame:
    """Percent of each truth row."""
    total = F.sum("n").over(Window.partitionBy(*by, "gt"))
    return cm.withColumn("pct", F.col("n") / (total + EPS) * 100)


def class_metrics(cm: DataFrame, by: tuple = ()) -> DataFrame:
    """(by, label, tp, support, accuracy, iou)."""
    sides = cm.select(*by, F.explode(F.array(F.struct(F.col("gt").alias("label"), F.lit(1).alias("is_row")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("is_row")))).alias("s"), "gt", "pred", "n")
    out = sides.groupBy(*by, F.col("s.label").alias("label")).agg(
        F.sum(F.when((F.col("gt") == F.col("pred")) & (F.col("s.is_row") == 1), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("s.is_row") == 1, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("s.is_row") == 0, F.col("n")).otherwise(0)).alias("predicted"),
    )
    return out.select(*by, "label", "tp", "support", (F.col("tp") / (F.col("support") + EPS)).alias("accuracy"), (F.col("tp") / (F.col("support") + F.col("predicted") - F.col("tp") + EPS)).alias("iou"))


def metrics(cm: DataFrame, by: tuple = (), positive_only: bool = True) -> DataFrame:
    """(by, pixel_acc, mean_acc, mean_iou); means skip classes that score 0 unless told otherwise."""
    per = class_metrics(cm, by)
    keep = lambda c: F.when(F.col(c) > 0, F.col(c)) if positive_only else F.col(c)
    agg = [(F.sum("tp") / F.sum("support")).alias("pixel_acc"), F.avg(keep("accuracy")).alias("mean_acc"), F.avg(keep("iou")).alias("mean_iou")]
    return per.groupBy(*by).agg(*agg) if by else per.agg(*agg)


def class_distribution(px: DataFrame, cls: str = "cls") -> DataFrame:
    """(cls, n, pct) of classes other than 0, for a chart."""
    n = px.where(F.col(cls) != 0).groupBy(cls).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def dice_loss(df: DataFrame, keys: tuple = ("image", "cls"), smooth: float = 1e-5) -> DataFrame:
    """One row: 1 - mean over images and classes of (2 I + s) / (U + s), for rows of p (probability) and t (0 or 1)."""
    per = df.groupBy(*keys).agg(F.sum(F.col("p") * F.col("t")).alias("i"), F.sum(F.col("p") + F.col("t")).alias("u"))
    return per.agg((1 - F.avg((2 * F.col("i") + smooth) / (F.col("u") + smooth))).alias("loss"))
