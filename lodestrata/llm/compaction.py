"""Size-tiered compaction of a sharded table.

Arrivals are written as runs of small immutable shards. Runs of similar size share a tier; when a tier
has fanout of them they are merged into files of the target size, and a run of such files is left alone. What the
table holds is named by a numbered manifest, put in place by a step that fails if the number is taken, so readers
see all of a change or nothing and a writer that lost the race starts again from the newer one. Rows are only ever
moved by Spark's readers and writers; the driver handles names and sizes of runs.
"""

from __future__ import annotations

import contextlib
import json
import math
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import folder

#: Bytes of a merged file; runs of a tier that start a merge, and ratio between tiers; bytes below which all runs share a tier.
TARGET, FANOUT, SMALLEST = 64 << 20, 4, 1 << 20


@contextlib.contextmanager
def _reading(spark: SparkSession, piece: int) -> Iterator[None]:
    """Scans planned inside read at most piece bytes of files together in one partition."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, value in zip(names, (piece, 0)):
            spark.conf.set(n, value)
        yield
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


class Conflict(Exception):
    """Another writer committed this version first."""


class ShardTable:
    """A table at path, which must lie in storage that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, fanout: int = FANOUT, smallest: int = SMALLEST):
        self.spark, self.path, self.target, self.fanout, self.smallest = spark, path.rstrip("/"), target, fanout, smallest
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    # manifests

    def version(self) -> int:
        """The newest committed version; 0 for an empty table."""
        at = self._at("manifests")
        if not self._fs.exists(at):
            return 0
        return max([int(s.getPath().getName()) for s in self._fs.listStatus(at) if s.getPath().getName().isdigit()], default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{version, runs: [{id, bytes, files, tier}]} as of a version."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "runs": []}
        f = self._fs.open(self._at(f"manifests/{version:012d}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8"))
        finally:
            f.close()

    def commit(self, base: dict, add: list[dict], remove: set[str] = frozenset()) -> dict:
        """The next version after base; Conflict if someone else has written it."""
        new = {"version": base["version"] + 1, "runs": [r for r in base["runs"] if r["id"] not in remove] + add}
        draft, final = self._at(f"manifests/.{uuid.uuid4().hex}"), self._at(f"manifests/{new['version']:012d}")
        out = self._fs.create(draft, False)
        self._jvm.org.apache.commons.io.IOUtils.write(json.dumps(new), out, "UTF-8")
        out.close()
        try:
            self._place(draft, final)
        except Py4JJavaError as e:
            if self._fs.exists(final):
                raise Conflict(new["version"]) from None
            raise e
        finally:
            self._fs.delete(draft, False)
        return new

    def _place(self, draft, final) -> None:
        """Give draft the name final, in one step that fails if something has it.

        On a local or mounted disk that is a hard link; elsewhere a rename without overwriting, which HDFS and stores
        with its semantics carry out atomically. Other object stores need a committer of their own here.
        """
        jvm = self._jvm
        if self._fs.getUri().getScheme() == "file":
            name = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(name(final), name(draft))
            return
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        flags = self.spark.sparkContext._gateway.new_array(rename, 1)
        flags[0] = rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(final), flags)

    # runs

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.smallest, self.fanout)) + 1) if size >= self.smallest else 0

    def _run(self, name: str) -> dict:
        files = [s.getLen() for s in self._fs.listStatus(self._at(f"runs/{name}")) if s.getPath().getName().endswith(".parquet")]
        return {"id": name, "bytes": sum(files), "files": max(1, len(files)), "tier": self.tier(sum(files))}

    def _retry(self, change) -> dict:
        while True:
            try:
                return change(self.manifest())
            except Conflict:
                continue

    def append(self, rows: DataFrame) -> dict:
        """Write rows as one run and commit it; the new manifest."""
        name = uuid.uuid4().hex
        rows.write.option("compression", "zstd").parquet(f"{self.path}/runs/{name}")
        run = self._run(name)
        return self._retry(lambda m: self.commit(m, [run]))

    def append_each(self, rows: DataFrame, arrival: str, compact: bool = True) -> dict:
        """Write each value of the column arrival (null too) as a run of its own, in one job; commit them in order."""
        name = uuid.uuid4().hex
        rows.write.partitionBy(arrival).option("compression", "zstd").parquet(f"{self.path}/runs/{name}")
        m = self.manifest()
        folders = sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(f"runs/{name}")) if s.isDirectory())
        for folder in folders:
            run = self._run(f"{name}/{folder}")
            m = self._retry(lambda m, run=run: self.commit(m, [run]))
            if compact:
                m = self.compact()
        return m

    def settled(self, run: dict) -> bool:
        """Whether a run's files are of the target size already, on average: merging it again gains nothing."""
        return 2 * run["bytes"] >= self.target * run["files"]

    def compact(self) -> dict:
        """Merge until no tier has fanout runs that aren't settled; the manifest then."""
        while True:
            m = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for r in m["runs"]:
                if self.settled(r):
                    continue
                tiers.setdefault(r["tier"], []).append(r)
            full = [t for t, runs in tiers.items() if len(runs) >= self.fanout]
            if not full:
                return m
            old = tiers[min(full)]
            name = uuid.uuid4().hex
            files = max(1, math.ceil(sum(r["bytes"] for r in old) / self.target))
            with _reading(self.spark, max(1, self.target // 8)):  # pieces much smaller than a file, so files come out even
                self._rows(old).coalesce(files).write.option("compression", "zstd").parquet(f"{self.path}/runs/{name}")
            run = self._run(name)
            run["tier"] = max(run["tier"], old[0]["tier"] + 1)
            gone = {r["id"] for r in old}

            def change(now, run=run, gone=gone):
                if not gone <= {r["id"] for r in now["runs"]}:
                    return now  # another writer has merged some of these; its result stands, ours is an orphan
                return self.commit(now, [run], gone)

            self._retry(change)

    def vacuum(self, versions: int = 1) -> int:
        """Delete manifests older than the last versions, and runs that none of these names; how many runs went.

        Runs being written by others are orphans until they are committed: call it when no one writes.
        """
        last = self.version()
        keep = range(max(1, last - versions + 1), last + 1)
        named = {r["id"] for v in keep for r in self.manifest(v)["runs"]}
        gone = 0
        for s in self._fs.listStatus(self._at("runs")) if self._fs.exists(self._at("runs")) else []:
            name = s.getPath().getName()
            inner = [f"{name}/{c.getPath().getName()}" for c in self._fs.listStatus(s.getPath()) if c.isDirectory() and "=" in c.getPath().getName()]
            for run in inner or [name]:
                if run not in named:
                    self._fs.delete(self._at(f"runs/{run}"), True)
                    gone += 1
        for v in range(1, max(1, last - versions + 1)):
            self._fs.delete(self._at(f"manifests/{v:012d}"), False)
        return gone

    def _rows(self, runs: list[dict]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/runs/{r['id']}" for r in runs))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows as of a version."""
        return self._rows(self.manifest(version)["runs"])


def size_tiered_compaction(docs: DataFrame, arrivals: int = 16, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_chars, text_md5, shard, version) of every row of documents after arrivals runs came in and were merged.

    A row arrives by hash of its id and text. Rows come back exactly as they were, nulls, repeats and
    extra columns included, whatever their names; shard names the file that holds the row. Texts of any length are moved as they are; a row
    group of the readers and writers holds some 128 MB of them. Of an empty table nothing is written.
    """
    spark = docs.sparkSession
    table = ShardTable(spark, path or f"{folder(spark)}/{uuid.uuid4().hex}/shards")
    name = "arrival"
    while name in docs.columns:
        name += "_"
    table.append_each(docs.withColumn(name, F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(arrivals))), name)
    table.vacuum()
    m = table.manifest()
    rows = table.read() if m["runs"] else docs.limit(0)
    shard = F.substring_index(F.input_file_name(), "/", -1) if m["runs"] else F.lit("")
    return rows.select("doc_id", "source", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"), shard.alias("shard"), F.lit(m["version"]).cast("long").alias("version"))


def sharded_rows(docs: DataFrame) -> DataFrame:
    """What is read back after all arrivals and merges, without the names of files."""
    return size_tiered_compaction(docs).drop("shard", "version")


ORACLE = "select doc_id, source, cast(length(text) as bigint) n_chars, md5(text) text_md5 from documents"
