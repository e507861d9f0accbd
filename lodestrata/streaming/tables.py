"""Tables that streams write into: versions put in place whole, leaves of a key's hash that split as they grow, a ledger of batches."""

from __future__ import annotations

import functools
import json
import math
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import delete, exists, path_of, put_new

#: Bytes of a leaf's files above which it is split; bytes of a row where nothing is stored yet; halvings in one go; tries of a commit.
LEAF_BYTES, ROW_BYTES, HALVINGS, TRIES = 64 << 20, 200, 12, 20


def stream_name(spark: SparkSession, checkpoint: str) -> Callable[[], str]:
    """A function that gives the id of the stream with a checkpoint, which Spark writes there before its first batch."""

    @functools.cache
    def name() -> str:
        return json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]

    return name


class VersionedTable:
    """A table in leaves of a key's hash, of which every batch writes anew those that it touches; readers see the last complete version.

    A leaf is (value, depth): the rows whose hash has that value in its last depth bits. A leaf that has grown beyond
    leaf_bytes is split when it is next written, so what a key's change costs doesn't grow with the table. A version is a small
    file that names each leaf's folder and the last batch of each stream; its number is the table's own, and it is put
    in place only if no other writer took that number, else the batch is merged again on top of what that one left. A batch
    that the ledger has changes nothing. Folders are written under new names and are deleted when none of the last keep
    versions names them. A version names all leaves, so leaf_bytes should grow with tables beyond some thousand leaves.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: Sequence[str] = ("connection_id", "external_id"), keep: int = 2, leaf_bytes: int = LEAF_BYTES):
        self.spark, self.path, self.schema, self.key, self.keep, self.leaf_bytes = spark, path.rstrip("/"), schema, list(key), keep, leaf_bytes

    def versions(self) -> list[int]:
        fs, at = path_of(self.spark, f"{self.path}/versions")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()) if fs.exists(at) else []

    def state(self, version: int | None = None) -> dict:
        """Of a version, or the last: its number, leaves ("value-depth": [folder or null, bytes, rows]) and the last batch of each stream."""
        held = self.versions()
        if version is None and not held:
            return {"version": 0, "leaves": {"0-0": [None, 0, 0]}, "batches": {}}
        version = held[-1] if version is None else version
        return json.loads(self.spark.read.text(f"{self.path}/versions/{version:012d}", wholetext=True).first().value)

    def leaf(self, leaves: Sequence[str]) -> Column:
        """Name of the leaf, one of those given, that a row's key lies in."""
        by: dict[int, list[int]] = {}
        for x in leaves:
            value, depth = map(int, x.split("-"))
            by.setdefault(depth, []).append(value)
        low = lambda d: F.pmod(F.xxhash64(*self.key), F.lit(1 << d))
        return F.coalesce(*(F.when(low(d).isin(values), F.concat(low(d).cast("string"), F.lit(f"-{d}"))) for d, values in sorted(by.items())))

    def read(self, only: Sequence[str] | None = None, state: dict | None = None) -> DataFrame:
        """Rows of the last version (or of a state), of all leaves or only some."""
        named = [f for x, (f, *_) in (state or self.state())["leaves"].items() if f and (only is None or x in only)]
        return self.spark.read.schema(self.schema).parquet(*named) if named else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], stream: str | None = None, number: int | None = None) -> bool:
        """Commit a batch: merge is given the rows of the leaves that it touches, and the batch. False if the stream's batch is in already."""
        for _ in range(TRIES):
            state = self.state()
            if stream is not None and state["batches"].get(stream, -1) >= number:
                return False
            new, data = self._written(state, batch, merge)
            new["batches"] = state["batches"] | ({stream: number} if stream is not None else {})
            if put_new(self.spark, f"{self.path}/versions/{new['version']:012d}", json.dumps(new)):
                self._forget()
                return True
            delete(self.spark, data)
        raise OSError(f"{self.path} was written by others {TRIES} times while a batch was merged")

    def _written(self, state: dict, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[dict, str]:
        leaves = dict(state["leaves"])
        touched = {r.leaf: r.n for r in batch.groupBy(self.leaf(list(leaves)).alias("leaf")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a leaf
        rows = merge(self.read(list(touched), state), batch)
        parts = [x for name, n in touched.items() for x in self._halves(name, *leaves.pop(name)[1:], n)]
        data = f"{self.path}/data/{uuid.uuid4().hex}"
        if parts:
            at = rows.withColumn("leaf", self.leaf(parts))
            at.repartition("leaf").write.partitionBy("leaf").parquet(data)
            fs, folder = path_of(self.spark, data)
            sizes = {s.getPath().getName().partition("=")[2]: fs.getContentSummary(s.getPath()).getLength() for s in fs.listStatus(folder) if s.getPath().getName().startswith("leaf=")}
            counts = {r.leaf: r.n for r in self.spark.read.parquet(data).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()} if sizes else {}
            leaves |= {x: [f"{data}/leaf={x}" if x in sizes else None, sizes.get(x, 0), counts.get(x, 0)] for x in parts}
        return {"version": state["version"] + 1, "leaves": leaves}, data

    def _halves(self, name: str, size: int, rows: int, more: int) -> list[str]:
        """A leaf, or what it is split into if it and more rows of a batch are too large."""
        expected = size + more * (size / rows if rows else ROW_BYTES)
        times = min(HALVINGS, max(0, math.ceil(math.log2(max(expected, 1) / self.leaf_bytes))))
        value, depth = map(int, name.split("-"))
        return [f"{value + (k << depth)}-{depth + times}" for k in range(1 << times)]

    def _forget(self) -> None:
        held = self.versions()
        folders = lambda v: {f for f, *_ in self.state(v)["leaves"].values() if f}
        kept = {f for v in held[-self.keep :] for f in folders(v)}
        for v in held[: -self.keep]:
            for folder in folders(v) - kept:
                delete(self.spark, folder)
            delete(self.spark, f"{self.path}/versions/{v:012d}")

    def exists(self) -> bool:
        return exists(self.spark, f"{self.path}/versions")
