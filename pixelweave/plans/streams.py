"""Queries of streams with state of their own: growing mosaics and training logs."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from pixelweave.operators import views
from pixelweave.operators.views import table, with_views
from pixelweave.plans.registry import query
from pixelweave.scratch import scratch_path, stage
from pixelweave.streaming import epochs
from pixelweave.streaming.mosaic import MosaicStore, grow


def grown(spark, sf) -> MosaicStore:
    """The votes, arrived in four files of which two come after a restart; the last batch is merged twice."""
    path = scratch_path(spark, "growing")
    votes = views.votes(spark, sf)
    store = MosaicStore(spark, f"{path}/mosaic", 8)
    for step in (0, 1):
        part = votes.where((F.col("c") + F.col("r")) % 4 >= 2) if step else votes.where((F.col("c") + F.col("r")) % 4 < 2)
        part.repartition(2).write.mode("append").parquet(f"{path}/arrivals")
        src = spark.readStream.schema(votes.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/arrivals")
        grow(src, store, f"{path}/checkpoint").awaitTermination()
    store.merge(votes, store.snapshot()["batch"])
    return store


@query("STR02_growing_votes", with_views("votes", "SELECT scene, r, c, cls, count(*) AS n FROM votes GROUP BY 1, 2, 3, 4"))
def str02_growing(spark, sf):
    return grown(spark, sf).counts().select("scene", "r", "c", "cls", "n")


@query("SNK04_growing_mosaic", with_views("votes", ",,n AS (SELECT scene, r, c, cls, count(*) AS n FROM votes GROUP BY 1, 2, 3, 4) SELECT scene, r, c, arg_max(cls, row(n, -cls)) AS cls, max(n) AS n FROM n GROUP BY 1, 2, 3"))
def snk04_growing(spark, sf):
    return grown(spark, sf).mosaic()


@contextmanager
def rocks(spark):
    """State in RocksDB, which keeps lists and timers, for the time of a stream."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def read_log(spark, source: str, target: str, checkpoint: str) -> None:
    """Read the evaluations that have arrived; a restart goes on."""
    with rocks(spark):
        src = spark.readStream.schema("run string, epoch int, ts timestamp, loss double").option("maxFilesPerTrigger", 1).parquet(source)
        out = epochs.progress(src, patience=2, stop_after=9, late="2 days").writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        out.trigger(availableNow=True).start().awaitTermination()


EPOCHS = """WITH RECURSIVE l AS (SELECT event_type AS run, CAST(day(ts) AS INT) AS epoch, round(avg(value), 6) AS loss FROM events WHERE day(ts) % 5 <> 3 GROUP BY 1, 2),
  m AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS n FROM l),
  t(run, n, epoch, loss, best, plateau, waited, bad, rate, stop) AS (
    SELECT run, n, epoch, loss, loss, loss, 0, 0, 1e-3::DOUBLE, false FROM m WHERE n = 1
    UNION ALL
    SELECT run, n, epoch, loss, best, plateau, waited, CASE WHEN more > 2 THEN 0 ELSE more END, CASE WHEN more > 2 AND rate - rate * 0.1::DOUBLE > 1e-8::DOUBLE THEN rate * 0.1::DOUBLE ELSE rate END, waited >= 9 FROM (
      SELECT m.run, m.n, m.epoch, m.loss, least(best, m.loss) AS best, CASE WHEN m.loss < plateau * (1 - 1e-4::DOUBLE) THEN m.loss ELSE plateau END AS plateau, CASE WHEN m.loss < best THEN 0 ELSE waited + 1 END AS waited, CASE WHEN m.loss < plateau * (1 - 1e-4::DOUBLE) THEN 0 ELSE bad + 1 END AS more, rate
      FROM t JOIN m ON m.run = t.run AND m.n = t.n + 1 WHERE NOT t.stop))
  SELECT run, epoch, loss, best, waited, bad, round(rate, 12) AS rate, stop FROM t"""


@query("STR05_training_log", EPOCHS)
def str05(spark, sf):
    """Daily losses of each event type as a training log with gaps: in three files, each day's neighbours swapped, with a restart after the second."""
    path = scratch_path(spark, "epochs")
    daily = table(spark, sf, "events").where(F.day("ts") % 5 != 3).groupBy(F.col("event_type").alias("run"), F.day("ts").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("loss"))
    at = lambda day: F.to_timestamp(F.concat(F.lit("2024-01-"), F.lpad(day.cast("string"), 2, "0")))
    rows = stage(daily.select("run", "epoch", at(F.col("epoch")).alias("ts"), "loss"), "daily")
    # the last days of a file change places with the first of the next
    file = F.when((F.col("epoch") <= 9) | (F.col("epoch") == 11), 0).when((F.col("epoch") <= 20) & (F.col("epoch") != 19), 1).otherwise(2)
    ends = rows.groupBy("run").agg((F.max("epoch") + 1).alias("epoch")).select("run", "epoch", at(F.lit(31)).alias("ts"), F.lit(None).cast("double").alias("loss"))
    for i in range(3):
        part = rows.where(file == i)
        (part.union(ends) if i == 2 else part).coalesce(1).write.mode("append").parquet(f"{path}/log")
        if i:
            read_log(spark, f"{path}/log", f"{path}/rows", f"{path}/checkpoint")
    out = spark.read.schema(epochs.OUTPUT).parquet(f"{path}/rows")
    return out.withColumn("rate", F.round("rate", 12))
