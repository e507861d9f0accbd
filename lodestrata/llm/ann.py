"""Approximate nearest neighbours by cross-polytope hashing.

A vector, scaled to length one, is rotated by three rounds of random signs and fast Hadamard transform
and hashed to the signed axis nearest to it; a bucket is named by the axes of one or more such rotations, more
with more rows, so that buckets keep their size. Each table has rotations of its own. A query looks up its
own bucket and the next nearest ones (multiprobe) in every table; what it meets is ranked by exact
distance inside the bucket, so a bucket sends on ten rows a query and not its members.

How many buckets are looked up is fitted: for a bounded sample of queries the true neighbours are found by comparing
them with all rows, and the least number of probes is taken that finds RECALL of these. Where MOST_PROBES don't,
buckets are named by an axis less; with one axis the probes may go as far as all buckets, which is exact.

Equal vectors are one entry with their smallest ids, so copies can't fill a bucket, and equal queries are one query; a bucket's
rows and its queries are both cut into blocks of bounded size. Vectors of different widths never meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Tables, rows of a bucket on average from which buckets are named by another axis, rows compared in one task.
TABLES, CROWD, BLOCK = 12, 4_096, 8_192
#: Share of true neighbours that the probes must find among a sample of so many queries; probes of a table at most.
RECALL, SAMPLE, MOST_PROBES = 0.97, 200, 1_024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        y = x.reshape(len(x), -1, 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, table: int, seed: int = 29) -> np.ndarray:
    """Pseudo-rotation of a table: three rounds of signs and transform, padded to a power of two."""
    width = 1 << max(1, int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    rng = np.random.default_rng((seed, table, width))
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], width))
    return x


def axes_per_table(rows: int, width: int) -> int:
    """Rotations that name a bucket, so that one holds at most CROWD of the rows on average."""
    sides, n = 2 << max(1, int(width - 1).bit_length()), 1
    while rows > CROWD * sides**n and sides ** (n + 1) < 1 << 62:
        n += 1
    return n


def buckets(x: np.ndarray, table: int, axes: int, probes: int) -> np.ndarray:
    """The probes nearest buckets of each row of unit vectors, nearest first.

    Axis i of a rotation is i, its opposite i + width. A bucket is as near as its axes together: the sum of
    squares of how far each falls short of the row's best one.
    """
    best = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for r in range(axes):
        y = rotated(x, table * axes + r)
        if probes == 1:
            at = np.abs(y).argmax(1)
            side = np.where(np.take_along_axis(y, at[:, None], 1)[:, 0] < 0, at + y.shape[1], at)
            best = best[0], best[1] * 2 * y.shape[1] + side[:, None]
            continue
        short = (np.abs(y).max(1, keepdims=True) - np.concatenate([y, -y], 1)) ** 2
        cost = (best[0][:, :, None] + short[:, None]).reshape(len(x), -1)
        name = (best[1][:, :, None] * short.shape[1] + np.arange(short.shape[1])).reshape(len(x), -1)
        n = min(probes, cost.shape[1])
        top = np.argpartition(cost, n - 1, 1)[:, :n] if n < cost.shape[1] else np.broadcast_to(np.arange(n), cost.shape)
        top = np.take_along_axis(top, np.lexsort((np.take_along_axis(name, top, 1), np.take_along_axis(cost, top, 1)), 1), 1)
        best = np.take_along_axis(cost, top, 1), np.take_along_axis(name, top, 1)
    return best[1]


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of rows, also where squares would over- or underflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        d = a - b
        out = np.sqrt((d**2).sum(1))
        odd = ~((out > 1e-140) & (out < 1e140))
        if odd.any():
            far = np.abs(d[odd]).max(1)
            scale = np.where((far > 0) & np.isfinite(far), far, 1)[:, None]
            out[odd] = np.where(np.isfinite(far), np.sqrt(((d[odd] / scale) ** 2).sum(1)) * scale[:, 0], np.inf)
    return out


def _matrix(column) -> np.ndarray:
    """Vectors of one width as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def valid(vector: str) -> F.Column:
    """Not null or empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def named(rows: DataFrame, tables: int, axes: int, probes: int) -> DataFrame:
    """rows, whose last two columns are width and vector, with names: the nearest buckets in each table, one table after another."""
    columns = rows.columns

    def run(batches):
        for batch in batches:
            widths = batch.column(batch.num_columns - 2).to_numpy()
            for width in np.unique(widths):
                some = batch.filter(pa.array(widths == width))
                step = max(1, (1 << 22) // (probes * 4 * int(width)))
                for at in range(0, some.num_rows, step):
                    part = some.slice(at, step)
                    x = units(_matrix(part.column(part.num_columns - 1)))
                    names = np.concatenate([buckets(x, t, axes, probes) for t in range(tables)], 1)
                    ends = np.arange(len(x) + 1, dtype=np.int32) * names.shape[1]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(names.ravel()))], names=[*columns, "names"])

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{fields}, names array<long>")


def _by_bucket(rows: DataFrame, tables: int) -> DataFrame:
    """A row for each of a row's names: (table, bucket) instead of them."""
    rest = [c for c in rows.columns if c != "names"]
    each = rows.select(*rest, (F.size("names") / tables).cast("int").alias("probes"), F.posexplode("names").alias("at", "bucket"))
    return each.select(*rest, F.floor(F.col("at") / F.col("probes")).cast("int").alias("table"), "bucket")


def nearest(queries: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) of the k nearest points of each query and of any that may tie with the last, in rows of bounded size."""
    q_out, p_out = [], []
    top = max(np.abs(queries).max(), np.abs(points).max())
    queries, points = queries / top, points / top
    norms = (points**2).sum(1)
    step = max(1, 4_000_000 // max(1, len(points)))
    for i in range(0, len(queries), step):
        q = queries[i : i + step]
        d = norms - 2 * q @ points.T
        if len(points) > k:
            last = np.partition(d, k - 1, 1)[:, k - 1 : k]
            near = d <= last + 1e-9 * (1 + np.abs(last))
        else:
            near = np.ones(d.shape, bool)
        a, b = np.nonzero(near)
        q_out.append(a + i)
        p_out.append(b)
    return np.concatenate(q_out), np.concatenate(p_out)


def fitted_probes(sample: list, tables: int, axes: int, recall: float) -> int | None:
    """Probes of a table that find recall of the sample's true neighbours, (query, neighbour) vectors; None if MOST_PROBES don't.

    A neighbour is found if in any table its bucket is among the query's.
    """
    found = []
    for width in {len(q) for q, _ in sample}:
        q, v = (units(np.array([p[i] for p in sample if len(p[0]) == width], np.float64)) for i in (0, 1))
        need = np.full(len(q), MOST_PROBES)
        step = max(1, (1 << 22) // (MOST_PROBES * 4 * width))
        for at in range(0, len(q), step):
            for t in range(tables):
                hit = buckets(q[at : at + step], t, axes, MOST_PROBES) == buckets(v[at : at + step], t, axes, 1)
                need[at : at + step] = np.minimum(need[at : at + step], np.where(hit.any(1), hit.argmax(1), MOST_PROBES))
        found.append(need)
    need = np.sort(np.concatenate(found))
    last = need[max(0, int(np.ceil(recall * len(need))) - 1)]
    return int(last) + 1 if last < MOST_PROBES else None


def _fit(entries: DataFrame, axes: int, width: int, k: int, tables: int, recall: float) -> tuple[int, int, int]:
    """(tables, axes, probes) for a recall, of at most SAMPLE queries and their neighbours among all rows."""
    asked = entries.where("asks").orderBy(F.xxhash64(F.element_at("ids", 1)), "h1", "h2").limit(SAMPLE).select(F.col("entry").alias("id"), "width", "v").toArrow()

    def run(batches):
        for batch in batches:
            out = []
            for w in np.unique(batch.column("width").to_numpy()):
                q, a = (x.filter(pa.array(x.column("width").to_numpy() == w)) for x in (asked, batch))
                near, entry = _held(a, q, k, apart=True)
                out.append(near.append_column("v", a.column("v").take(pa.array(entry))))
            yield from (b for t in out for b in t.to_batches())

    near = _ranked(entries.select("entry", "ids", "width", "v").mapInArrow(run, "query_id long, vec_id long, score double, v array<double>"), k, "v")
    vector = dict(zip(asked.column("id").to_pylist(), asked.column("v").to_pylist()))
    sample = [(vector[r.query_id], r.v) for r in near.collect()]  # SAMPLE * k rows at most
    while True:
        probes = fitted_probes(sample, tables, axes, recall) if sample else 1
        if axes > 1 and probes is None:
            axes -= 1
            continue
        sides = 2 << max(1, int(width - 1).bit_length())
        return (1, 1, sides) if axes == 1 and (probes is None or tables * probes > sides) else (tables, axes, probes)


def _entries(x: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """(entry, h1, h2, asks, ids, width, v): one row for equal vectors, its smallest ids, and whether a query is among them.

    A vector is shuffled once; ids are chosen among hashes of 128 bits.
    """
    # the smallest k + 1 ids are all that an answer can need of a vector's copies; first by chunks, then of those
    chunk, per = (W.partitionBy("h1", "h2", *more).orderBy("id") for more in ([F.pmod("id", F.lit(64))], []))
    some = keys.withColumn("n", F.row_number().over(chunk)).where(F.col("n") <= k + 1)
    some = some.withColumn("n", F.row_number().over(per)).where(F.col("n") <= k + 1)
    ids = some.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    once = x.groupBy("h1", "h2").agg(F.max("is_query").alias("asks"), F.first("width").alias("width"), F.first("v").alias("v"))
    return cut(once.join(ids, ["h1", "h2"]).select(F.monotonically_increasing_id().alias("entry"), "h1", "h2", "asks", "ids", "width", "v"), "entries")


def search(vectors: DataFrame, is_query, k: int = 10, tables: int = TABLES, probes: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows found for each query row, by Euclidean distance.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null
    ids. Ties go to the smaller id; repeated ids count as one row each vector. Vectors of different widths are no
    candidates of each other. Equal query vectors are looked up once. If a query met fewer than k others in its buckets, it is
    held against all rows, in blocks. probes sets their number by hand. An empty table gives an empty one; other columns are
    left out, whatever their names.
    """
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(valid("v") & F.col("id").isNotNull())
    x = cut(x.select("id", F.size("v").alias("width"), "v", is_query(F.col("id")).alias("is_query"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2")), "vectors")
    keys = x.select("id", "h1", "h2", "is_query").distinct()
    entries = _entries(x, keys, k)
    queries = entries.where("asks").select(F.col("entry").alias("id"), "width", "v")
    rows, width = entries.agg(F.count("*"), F.max("width")).first()
    axes = axes_per_table(rows, width or 1)
    if probes is None:
        tables, axes, probes = _fit(entries, axes, width or 1, k, tables, recall)
    on = ["width", "table", "bucket"]
    # vectors stay where they are while buckets are named, and are copied for each table as they are sent
    index = _by_bucket(cut(named(entries.select("ids", "width", "v"), tables, axes, 1), "index"), tables)
    asked = _by_bucket(cut(named(queries, tables, axes, probes), "asked"), tables)
    blocks = lambda df, name: df.groupBy(on).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = cut(blocks(index, "blocks").join(blocks(asked, "turns"), on), "sizes")  # buckets that nobody looks up are left out
    # the k + 1 nearest of a query vector: one of them may be the row that asks
    best = cut(_compare(_cut_up(index, sizes, F.element_at("ids", 1), "block", "turn"), _cut_up(asked, sizes, F.col("id"), "turn", "block"), [*on, "block", "turn"], k + 1).distinct(), "best")
    enough = best.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") > k).select(F.col("query_id").alias("id"))
    short = cut(queries.join(enough, "id", "left_anti"), "short")
    found, asking = best, short.count()
    if asking:
        whole = {"blocks": F.lit(max(1, rows // block)), "turns": F.lit(-(-asking // block))}
        left, right = (_cut_up(side.withColumns(whole), None, F.col(name), *own) for side, name, own in ((entries.select("entry", "ids", "width", "v"), "entry", ("block", "turn")), (short, "id", ("turn", "block"))))
        rest = _compare(left, right, ["width", "block", "turn"], k + 1)
        found = best.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
    near = _ranked(found, k + 1).groupBy("query_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("near"))
    near = near.join(entries.where("asks").select(F.col("entry").alias("query_id"), "h1", "h2"), "query_id").select("h1", "h2", "near")
    answers = keys.where("is_query").join(near, ["h1", "h2"]).select(F.col("id").alias("query_id"), F.inline("near")).where("vec_id <> query_id")
    return _ranked(answers, k)


def _cut_up(side: DataFrame, sizes: DataFrame | None, key: F.Column, own: str, other: str) -> DataFrame:
    """side in blocks of its own by hash of key, each row once for every block of the other side."""
    joined = side if sizes is None else side.join(sizes, ["width", "table", "bucket"])
    copies = F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))
    return joined.withColumn(own, F.pmod(F.xxhash64(key), F.col(f"{own}s")).cast("int")).withColumn(other, copies).drop("blocks", "turns")


def _held(a, b, k: int, apart: bool = False) -> tuple[pa.Table, np.ndarray]:
    """(query_id, vec_id, score) of the k nearest in entries a of each query of b, and which entry each one is; apart leaves out a query's own entry."""
    q_ids = v_ids = entry = np.zeros(0, np.int64)
    score = np.zeros(0)
    if a.num_rows and b.num_rows:
        points, asked = _matrix(a.column("v")), _matrix(b.column("v"))
        q, p = nearest(asked, points, k + 1)
        if apart:
            other = a.column("entry").to_numpy()[p] != b.column("id").to_numpy()[q]
            q, p = q[other], p[other]
        d = distances(asked[q], points[p])
        ids = a.column("ids")
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        n = ids.value_lengths().to_numpy()
        begin = np.cumsum(n) - n
        row = np.repeat(np.arange(len(q)), n[p])
        at = np.repeat(begin[p] - (np.cumsum(n[p]) - n[p]), n[p]) + np.arange(len(row))
        v_ids, q_ids, score, entry = ids.flatten().to_numpy()[at], b.column("id").to_numpy()[q][row], d[row], p[row]
        order = np.lexsort((v_ids, score, q_ids))
        asks = q_ids[order]
        new = np.flatnonzero(np.concatenate((asks[:1] == asks[:1], asks[1:] != asks[:-1])))
        order = order[np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order)))) < k]
        q_ids, v_ids, score, entry = q_ids[order], v_ids[order], score[order], entry[order]
    return pa.table({"query_id": pa.array(q_ids, pa.int64()), "vec_id": pa.array(v_ids, pa.int64()), "score": pa.array(score, pa.float64())}), entry


def _compare(left: DataFrame, right: DataFrame, on: list[str], k: int) -> DataFrame:
    """(query_id, vec_id, score) of the k nearest in each block, exact distances in double precision."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return _held(a, b, k)[0]

    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(run, "query_id long, vec_id long, score double")


def _ranked(best: DataFrame, k: int, *more: str) -> DataFrame:
    once = best.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"), *(F.first(c).alias(c) for c in more))
    w = W.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *more)


def nearest_neighbours(vectors: DataFrame) -> DataFrame:
    """The ten nearest of each row whose vec_id is divisible by 100."""
    return search(vectors, lambda i: i % 100 == 0)
