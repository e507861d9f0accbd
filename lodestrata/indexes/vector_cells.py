"""A stored vector index: vectors in partitions by their nearest centroid, searches that read a few of them.

Centroids are trained by spherical k-means over a bounded sample. Every vector is stored, in its cell's partition and with its
angle to the centroid, so a cell's largest angle bounds how near any of its vectors can be to a query. A search
reads the cells nearest to the query, as many as found nearly all true neighbours of sampled vectors when the
cells were trained, and compares there exactly. An exact search then reads all other cells whose bound reaches the k-th score.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..store import path_of

#: Vectors that cells are trained with at most, by hash of their ids; vectors of a cell; cells at most; rounds of training.
SAMPLE, EACH, CELLS, ROUNDS = 20_000, 400, 4096, 12
#: Sampled vectors whose neighbours are looked for, how many each, and the share of them that the probed cells have to hold.
TRIED, NEAREST, SHARE = 400, 20, 0.985
#: Rows of a stored file at most, so a cell that many vectors lie in is many files.
FILE_ROWS = 500_000


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def train_centroids(x: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means of unit vectors; a cell that runs empty starts again at the vector that fits worst."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own, near = nearest_cells(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(c)) == 0)
        sums[empty] = x[np.argsort(near, kind="stable")[: len(empty)]]
        c = unit(sums)
    return c


def nearest_cells(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, cosine to its centroid) of each unit vector, a block of vectors at a time."""
    own, near = np.zeros(len(x), np.int64), np.zeros(len(x))
    for at in range(0, len(x), 4096):
        s = x[at : at + 4096] @ c.T
        own[at : at + 4096] = s.argmax(1)
        near[at : at + 4096] = s.max(1)
    return own, near


def probes_needed(x: np.ndarray, c: np.ndarray, seed: int = 7) -> int:
    """Nearest cells to be read so that SHARE of the sample's true neighbours are found."""
    some = np.random.default_rng(seed).choice(len(x), min(TRIED, len(x)), replace=False)
    own, _ = nearest_cells(x, c)
    k = min(NEAREST, len(x) - 1)
    if k < 1:
        return 1
    places = []
    for at in range(0, len(some), 64):
        q = x[some[at : at + 64]]
        score = q @ x.T
        score[np.arange(len(q)), some[at : at + 64]] = -2  # not itself
        found = np.argpartition(-score, k - 1, axis=1)[:, :k]
        order = np.argsort(-(q @ c.T), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(len(c))[None], 1)
        places.append(np.take_along_axis(place, own[found], 1).ravel())
    return int(np.ceil(np.quantile(np.concatenate(places), SHARE, method="higher"))) + 1


class VectorCells:
    """The index below a path: vectors/ (tenant, cell), cells/ (what each write put into them), model (centroids and probes)."""

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", vector: str = "embedding", tenant: str = "org_id"):
        self.spark, self.path, self.key, self.vector, self.tenant = spark, path.rstrip("/"), key, vector, tenant
        self._model: tuple[np.ndarray, int] | None = None

    def train(self, rows: DataFrame, sample: int = SAMPLE, cells: int | None = None) -> None:
        """Learn the centroids from at most sample vectors, those with the smallest hashes of their ids."""
        ok = rows.where(F.col(self.vector).isNotNull() & (F.size(self.vector) > 0))
        n = ok.count()
        taken = ok.select(self.key, F.col(self.vector).cast("array<double>").alias("v")).orderBy(F.xxhash64(self.key), self.key).limit(sample)
        x = [r.v for r in taken.collect() if None not in r.v]
        if len({len(v) for v in x}) > 1:
            raise ValueError("vectors of different widths")
        x = np.array(x, np.float64).reshape(len(x), -1)
        x = unit(x[np.isfinite(x).all(1) & (np.linalg.norm(x, axis=1) > 0)]) if len(x) else x
        count = cells or max(1, min(CELLS, round(n / EACH), len(x) // 8))
        c = train_centroids(x, count) if len(x) else np.zeros((1, 0))
        model = {"probes": probes_needed(x, c) if len(x) else 1, "centroids": c.tolist()}
        self.spark.createDataFrame([(json.dumps(model),)], "model string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/model")
        self._model = None

    def model(self) -> tuple[np.ndarray, int]:
        """(centroids, probes), read once."""
        if self._model is None:
            m = json.loads(self.spark.read.parquet(f"{self.path}/model").first().model)
            self._model = np.array(m["centroids"], np.float64), m["probes"]
        return self._model

    def assigned(self, rows: DataFrame) -> DataFrame:
        """rows that have a direction, with (cell, angle); null, zero and non-finite vectors are never found and not stored."""
        c, _ = self.model()
        shared = self.spark.sparkContext.broadcast(c)  # CELLS rows at most
        at = rows.columns.index(self.vector)

        def run(batches):
            c = shared.value
            for batch in batches:
                own, angle = np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, np.nan)
                v = batch.column(at).to_pylist()
                some = [i for i, x in enumerate(v) if x and None not in x]
                if some:
                    if {len(v[i]) for i in some} != {c.shape[1]}:
                        raise ValueError("vectors of different widths")
                    x = np.array([v[i] for i in some], np.float64)
                    good = np.isfinite(x).all(1) & (np.linalg.norm(x, axis=1) > 0)
                    own[np.array(some)[good]], near = nearest_cells(unit(x[good]), c)
                    angle[np.array(some)[good]] = np.arccos(np.clip(near, -1, 1))
                keep = pa.array(~np.isnan(angle))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"]).filter(keep)

        fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
        return rows.mapInArrow(run, f"{fields}, cell int, angle double")

    def append(self, rows: DataFrame) -> None:
        """Store rows (tenant, key, vector and whatever filters need); a hot cell is many files, written by many tasks."""
        out = self.assigned(rows)
        out.hint("rebalance", self.tenant, "cell").write.mode("append").option("maxRecordsPerFile", FILE_ROWS).partitionBy(self.tenant, "cell").parquet(f"{self.path}/vectors")
        self._count()

    def _count(self) -> None:
        """What cells hold: rows and the largest angle of each tenant's."""
        v = self.vectors().groupBy(self.tenant, "cell").agg(F.count(F.lit(1)).alias("rows"), F.max("angle").alias("radius"))
        v.coalesce(8).write.mode("overwrite").parquet(f"{self.path}/cells")

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def ranked_cells(self, tenant, query: Sequence[float]) -> list[tuple[int, float]]:
        """(cell, greatest cosine that a vector of it may have) of a tenant's cells, nearest centroid first."""
        c, _ = self.model()
        q = np.asarray(query, np.float64)
        if len(q) != c.shape[1]:
            raise ValueError("vectors of different widths")
        angle = np.arccos(np.clip(unit(q) @ c.T, -1, 1))
        held = self.spark.read.parquet(f"{self.path}/cells").where(F.col(self.tenant) == F.lit(tenant)).select("cell", "radius").collect()  # CELLS rows at most
        return [(r.cell, float(np.cos(max(0.0, angle[r.cell] - r.radius - 1e-7)))) for r in sorted(held, key=lambda r: (angle[r.cell], r.cell))]

    def rows_of(self, tenant, cells: Sequence[int]) -> DataFrame:
        """Rows of a tenant's cells: partitions are pruned when the query is planned."""
        return self.vectors().where((F.col(self.tenant) == F.lit(tenant)) & F.col("cell").isin(list(cells)))

    def nearest(self, tenant, query: Sequence[float], k: int, exact: bool = False, only: Column | None = None, gone: DataFrame | None = None, probes: int | None = None) -> DataFrame:
        """(key, score) of the k rows nearest to query, ties by key; k rows at most pass the driver.

        only is a filter on stored columns, gone holds keys that don't count. Where the probed cells have fewer than k such rows, all
        others are read as well. exact reads the cells, too, that may hold a nearer row than the k-th.
        """
        order = self.ranked_cells(tenant, query)
        q = F.array(*(F.lit(float(x)) for x in query))

        def best(cells: list[int]) -> DataFrame:
            rows = self.rows_of(tenant, cells)
            rows = rows if only is None else rows.where(only)
            rows = rows if gone is None else rows.join(gone.select(self.key), self.key, "left_anti")
            scored = rows.select(self.key, F.explode(F.array(cosine(F.col(self.vector), q))).alias("score"))
            return scored.where("score is not null").orderBy(F.desc("score"), self.key).limit(k)

        first = [c for c, _ in order[: probes or self.model()[1]]]
        top = best(first)
        schema, found = top.schema, [tuple(r) for r in top.collect()]
        least = min((s for _, s in found), default=-2.0) if len(found) >= k else -2.0
        rest = [c for c, bound in order[len(first) :] if len(found) < k or exact and bound >= least - 1e-12]
        if rest:
            found += [tuple(r) for r in best(rest).collect()]
            found = sorted(found, key=lambda r: (-r[1], r[0]))[:k]
        return self.spark.createDataFrame(found, schema)

    def exists(self) -> bool:
        fs, at = path_of(self.spark, f"{self.path}/model")
        return fs.exists(at)
