"""Streams of pixels: stateless tile filters, running votes, resumable sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pixelweave.operators.vote import plurality, vote_counts


def read_stream(spark: SparkSession, path: str, schema: str, files_a_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def running_votes(px: DataFrame, keys: tuple = ("scene", "r", "c")) -> DataFrame:
    """Vote counts over all files so far, for update or complete mode."""
    return vote_counts(px, keys)


def mosaic_stream(px: DataFrame, target: str, checkpoint: str, keys: tuple = ("scene", "r", "c")) -> StreamingQuery:
    """Writes the winners so far to target/batch=N after each batch; a restart goes on from the checkpoint."""

    def emit(counts: DataFrame, batch: int) -> None:
        plurality(counts, keys).write.mode("overwrite").parquet(f"{target}/batch={batch}")

    return running_votes(px, keys).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(emit).trigger(availableNow=True).start()


def latest_batch(spark: SparkSession, target: str) -> DataFrame:
    """The rows that the last batch of mosaic_stream or result_stream wrote."""
    rows = spark.read.parquet(target)
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == last).drop("batch")


def result_stream(out: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Files of the rows so far: appended, or (complete) the whole result of each batch under target/batch=N."""
    w = out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        return w.format("parquet").option("path", target).start()
    return w.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{target}/batch={batch}")).start()
