"""Operator 7: shards under size-tiered compaction, in DataFrame functions only.

Each arrival becomes a run: a folder of immutable Parquet shards. Runs of similar size (one tier covers a
factor of `fan_in`) are merged, `fan_in` or more at a time, into files of the target size; runs that have
reached it are left alone. A manifest is a numbered JSON file that names the live runs. It is written aside
and renamed to its number, which fails if another writer was first; that rename is the commit. Readers take
the newest manifest, so they see all of a commit or nothing of it, and files that no manifest names (from a
job that was lost) are never read. Runs stay as long as one of the newest RETAIN manifests names them, so older
versions can be read that far back. A writer that loses the race for a version reads the newest manifest and commits
again, if the runs it merged are still live. Only the driver touches manifests; rows move in Spark jobs, without a
shuffle: a merged file is a coalesced read of its runs.

An arrival may bring other columns. The manifest holds the columns of all arrivals so far: new ones come last, and are null
in rows that came without them; a type may widen (whole numbers to longer ones, those up to int and float to double), and older rows are read
in the wider one. An arrival whose types don't go together with the store's is refused before anything is written.

Defined results: rows come back as they were, repeated ones too, with nulls, very long texts and all columns; a run of no
rows adds nothing; a store of no rows reads as an empty table with the columns of its first arrival; a table's own
column named like the run folders keeps its name.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweave.llm.common import drop_path, read_table, scratch_path

TARGET_BYTES = 128 << 20
FAN_IN = 4
BASE_BYTES = 1 << 20
#: Merges that one job carries out.
MERGES_A_JOB = 64
#: Newest versions that can be read.
RETAIN = 10
TRIES = 20


#: Hours after which a folder that no manifest names is taken for that of a lost job.
ORPHAN_HOURS = 24
#: Types that may follow, from narrow to wide.
WIDER = {"tinyint": ("smallint", "int", "bigint"), "smallint": ("int", "bigint"), "int": ("bigint", "double"), "float": ("double",)}


def wider(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The one of two types that holds the values of both; None if neither does."""
    x, y = a.simpleString(), b.simpleString()
    return a if x == y or x in WIDER.get(y, ()) else b if y in WIDER.get(x, ()) else None


def evolved(old: T.StructType | None, new: T.StructType) -> T.StructType:
    """The columns of both, those of old first; raises a TypeError where they don't go together."""
    fields = {f.name: f.dataType for f in old} if old else {}
    lower = {n.lower(): n for n in fields}
    for f in new:
        if (known := lower.setdefault(f.name.lower(), f.name)) != f.name:
            raise TypeError(f"columns {known} and {f.name} differ in case alone")
        kind = wider(fields.get(f.name, f.dataType), f.dataType)
        if kind is None:
            raise TypeError(f"column {f.name} is {fields[f.name].simpleString()}, not {f.dataType.simpleString()}")
        fields[f.name] = kind
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def read_schema(manifest: dict) -> T.StructType | None:
    return T.StructType.fromJson(json.loads(manifest["schema"])) if manifest["schema"] else None


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    """A table kept as immutable shards under a path of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, base_bytes: int = BASE_BYTES, retain: int = RETAIN):
        self.spark, self.path, self.target, self.fan_in, self.base, self.retain = spark, path, target_bytes, fan_in, base_bytes, retain
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _list(self, path: str) -> list[tuple[str, int]]:
        at = self._at(path)
        fs = at.getFileSystem(self.conf)
        return [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(at)] if fs.exists(at) else []

    def manifest(self, version: int | None = None) -> dict:
        """A manifest, the newest by default; version 0 is the empty store."""
        if version is None:
            version = max((int(n[1:11]) for n, _ in self._list(f"{self.path}/manifests") if n.startswith("v")), default=0)
        if not version:
            return {"version": 0, "schema": None, "runs": []}
        at = self._at(f"{self.path}/manifests/v{version:010d}.json")
        opened = at.getFileSystem(self.conf).open(at)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8"))
        finally:
            opened.close()

    def commit(self, old: dict, runs: list[dict], schema: str) -> dict:
        """Make `runs` the live runs, if `old` is still the newest manifest."""
        new = {"version": old["version"] + 1, "schema": schema, "runs": runs}
        aside = self._at(f"{self.path}/manifests/_{uuid.uuid4().hex}")
        out = aside.getFileSystem(self.conf).create(aside, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        final = self._at(f"{self.path}/manifests/v{new['version']:010d}.json")
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.getFileSystem(self.conf).getUri(), self.conf).rename(aside, final, options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {new['version']} exists") from e
            raise
        return new

    def _runs(self, rows: DataFrame, column: str) -> list[dict]:
        """Write rows, one run for each value of `column`, and describe the runs."""
        place = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").partitionBy(column).parquet(place)
        out = []
        for name, _ in self._list(place):
            if "=" in name:
                files = [(f, n) for f, n in self._list(f"{place}/{name}") if f.startswith("part-")]
                out.append({"path": f"{place}/{name}", "files": len(files), "bytes": sum(n for _, n in files)})
        return sorted(out, key=lambda r: r["path"])

    def append(self, rows: DataFrame, arrival: str | None = None) -> None:
        """Add rows as new runs: one, or one for each value of the column `arrival`, all in one commit."""
        own = [c for c in rows.columns if c != arrival]
        column = "run"
        while column in own:
            column = "_" + column
        marked = rows.withColumnRenamed(arrival, column) if arrival else rows.withColumn(column, F.lit(0))
        schema = rows.select(*own).schema
        evolved(read_schema(self.manifest()), schema)
        runs = self._runs(marked, column)
        try:
            self.retry(lambda now: (now["runs"] + runs, evolved(read_schema(now), schema).json()))
        except TypeError:  # another writer has just brought a column of another type
            for run in runs:
                drop_path(self.spark, run["path"])
            raise

    def retry(self, change) -> bool:
        """Commit the runs and schema that change() makes of the newest manifest, until no other writer is first; False if it makes none."""
        for _ in range(TRIES):
            now = self.manifest()
            if not (new := change(now)):
                return False
            try:
                self.commit(now, *new)
            except Conflict:
                continue
            self.vacuum()
            return True
        raise Conflict(f"{TRIES} times another writer was first")

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.base, self.fan_in) + 1e-9)) if size > self.base else 0

    def merges(self, runs: list[dict]) -> list[list[dict]]:
        """Groups of similarly sized runs to merge; runs whose files are of the target size or more rest."""
        tiers: dict[int, list[dict]] = {}
        for run in runs:
            if run["bytes"] / max(1, run["files"]) < 0.5 * self.target:
                tiers.setdefault(self.tier(run["bytes"]), []).append(run)
        groups = []
        for _, some in sorted(tiers.items()):
            whole = len(some) // self.fan_in
            groups += [some[i * len(some) // whole : (i + 1) * len(some) // whole] for i in range(whole)]
        return groups

    def compact(self) -> int:
        """Merge until no tier has fan_in runs; the number of manifests committed."""
        commits = 0
        while groups := self.merges((now := self.manifest())["runs"])[:MERGES_A_JOB]:
            schema = read_schema(now)
            column = "run"
            while column in schema.names:
                column = "_" + column
            rows = None
            for i, group in enumerate(groups):
                size = sum(r["bytes"] for r in group)
                part = self.spark.read.schema(schema).parquet(*[r["path"] for r in group]).coalesce(max(1, math.ceil(size / self.target))).withColumn(column, F.lit(i))
                rows = part if rows is None else rows.union(part)
            made = self._runs(rows, column)
            gone = {r["path"] for g in groups for r in g}
            def change(newest: dict) -> tuple | None:
                live = {r["path"] for r in newest["runs"]}
                return ([r for r in newest["runs"] if r["path"] not in gone] + made, newest["schema"]) if gone <= live else None

            if self.retry(change):
                commits += 1
            else:  # another writer has merged some of them
                for run in made:
                    drop_path(self.spark, run["path"])
        return commits

    def vacuum(self) -> None:
        """Delete manifests older than the newest `retain`, and the runs that only these name."""
        versions = sorted(int(n[1:11]) for n, _ in self._list(f"{self.path}/manifests") if n.startswith("v"))
        old, kept = versions[: -self.retain], versions[-self.retain :]
        if old:
            live = {r["path"] for v in kept for r in self.manifest(v)["runs"]}
            for path in {r["path"] for v in old for r in self.manifest(v)["runs"]} - live:
                drop_path(self.spark, path)
            for v in old:
                drop_path(self.spark, f"{self.path}/manifests/v{v:010d}.json")

    def sweep(self, hours: float = ORPHAN_HOURS) -> int:
        """Delete folders older than `hours` of which no readable manifest names a run: those of lost jobs. The number deleted."""
        at = self._at(f"{self.path}/data")
        fs = at.getFileSystem(self.conf)
        if not fs.exists(at):
            return 0
        # folders first: what is committed meanwhile is in the manifests read after
        old = [s.getPath().getName() for s in fs.listStatus(at) if time.time() - s.getModificationTime() / 1000 >= 3600 * hours]
        versions = [int(n[1:11]) for n, _ in self._list(f"{self.path}/manifests") if n.startswith("v")]
        live = {r["path"].rsplit("/", 2)[-2] for v in versions for r in self.manifest(v)["runs"]}
        gone = [n for n in old if n not in live]
        for name in gone:
            drop_path(self.spark, f"{self.path}/data/{name}")
        return len(gone)

    def read(self, version: int | None = None) -> DataFrame:
        found = self.manifest(version)
        schema = read_schema(found) or T.StructType([])
        paths = [r["path"] for r in found["runs"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


ARRIVALS = 8


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, arrived in parts, after compaction and as the newest manifest has them."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    store = ShardStore(spark, scratch_path(spark, "shards"))
    store.append(docs.withColumn("arrival", F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))), "arrival")
    store.compact()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP7_SQL = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"
