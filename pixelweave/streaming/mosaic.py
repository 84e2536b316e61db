"""A mosaic of votes that grows with its batches.

Votes are kept as counts in strips of rows, one folder of files a strip. A batch reads the strips it touches, adds its
own counts, writes those strips anew and commits a numbered snapshot that names the folder of every strip; what it
writes grows with the batch, not with the mosaic. A snapshot holds the number of its batch, so that a batch that comes
again after a failure changes nothing, and readers see all of a batch or nothing of it. There is no state besides the files.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pixelweave.operators.vote import plurality, vote_counts
from pixelweave.scratch import commit_text, delete, names_in, read_text

STRIP = 64
#: Newest snapshots that stay readable.
RETAIN = 3


class MosaicStore:
    """Vote counts (scene, r, c, cls, n) under a path of any Hadoop file system; one writer, any number of readers.

    The snapshot has an entry for each strip and passes through the driver.
    """

    def __init__(self, spark: SparkSession, path: str, strip: int = STRIP, retain: int = RETAIN):
        self.spark, self.path, self.strip, self.retain = spark, path.rstrip("/"), strip, retain

    def versions(self) -> list[int]:
        return sorted(int(n[1:11]) for n in names_in(self.spark, f"{self.path}/snapshots") if n.endswith(".json"))

    def snapshot(self, version: int | None = None) -> dict:
        """{batch, strips: {"scene/strip": folder}} of a version, the newest by default."""
        if version is None:
            version = max(self.versions(), default=0)
        return json.loads(read_text(self.spark, f"{self.path}/snapshots/v{version:010d}.json")) if version else {"version": 0, "batch": -1, "strips": {}}

    def merge(self, votes: DataFrame, batch: int) -> bool:
        """Add votes(scene, r, c, cls), unless this batch or a later one is in the snapshot; False if it is."""
        now = self.snapshot()
        if batch <= now["batch"]:
            return False
        strip = F.floor(F.col("r") / self.strip).cast("long")
        fresh = vote_counts(votes).withColumn("strip", strip)
        touched = [f"{r.scene}/{r.strip}" for r in fresh.select("scene", "strip").distinct().collect()]  # a row for each strip
        held = [now["strips"][t] for t in touched if t in now["strips"]]
        parts = fresh.select("scene", "r", "c", "cls", "n", "strip")
        if held:
            old = self.spark.read.schema("scene string, r int, c int, cls int, n long").parquet(*[f"{self.path}/data/{h}" for h in held])
            parts = parts.union(old.withColumn("strip", strip))
        place = uuid.uuid4().hex
        sums = parts.groupBy("scene", "strip", "r", "c", "cls").agg(F.sum("n").alias("n"))
        # the folder names of a strip are numbers, so that no scene's name has to be one
        order = self.spark.createDataFrame([(t.rsplit("/", 1)[0], int(t.rsplit("/", 1)[1]), i) for i, t in enumerate(touched)], "scene string, strip long, part int")
        sums.join(F.broadcast(order), ["scene", "strip"]).select("scene", "r", "c", "cls", "n", "part").repartition("part").sortWithinPartitions("part", "r", "c").write.option("compression", "zstd").partitionBy("part").parquet(f"{self.path}/data/{place}")
        strips = now["strips"] | {t: f"{place}/part={i}" for i, t in enumerate(touched)}
        commit_text(self.spark, f"{self.path}/snapshots/v{now['version'] + 1:010d}.json", json.dumps({"version": now["version"] + 1, "batch": batch, "strips": strips}))
        self.vacuum()
        return True

    def vacuum(self) -> None:
        """Delete snapshots older than the newest `retain`, and the strips that only they name."""
        versions = self.versions()
        old, kept = versions[: -self.retain], versions[-self.retain :]
        if old:
            live = {f for v in kept for f in self.snapshot(v)["strips"].values()}
            for f in {f for v in old for f in self.snapshot(v)["strips"].values()} - live:
                delete(self.spark, f"{self.path}/data/{f}")
            for v in old:
                delete(self.spark, f"{self.path}/snapshots/v{v:010d}.json")

    def counts(self, version: int | None = None) -> DataFrame:
        schema = "scene string, r int, c int, cls int, n long"
        folders = [f"{self.path}/data/{f}" for f in self.snapshot(version)["strips"].values()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def mosaic(self, version: int | None = None) -> DataFrame:
        """(scene, r, c, cls, n): the winners."""
        return plurality(self.counts(version))


def grow(votes: DataFrame, store: MosaicStore, checkpoint: str) -> StreamingQuery:
    """Feed a stream of votes(scene, r, c, cls) into the store until its source is read; a restart goes on from the checkpoint."""
    return votes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: store.merge(rows, batch)).trigger(availableNow=True).start()
