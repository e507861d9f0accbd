"""Streams with timers against the batch queries, co-located tables by their plans, look-ups by what scans read, SQL functions."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import ids, sql
from lodestrata.operators import catalogue, chunking, filters, search
from lodestrata.sources import colocated
from lodestrata.streaming import stateful


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_of(spark, folder, batches, schema):
    folder.mkdir()
    for i, rows in enumerate(batches):
        (folder / f"{i:03d}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(folder / f"{i:03d}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def collected(spark, out, name, checkpoint):
    assert out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination(180)
    return spark.table(name)


MESSAGES = "data_source_id string, position long, content string, context string, authors array<string>, source_url string, merges boolean, ts timestamp"


def test_grouped_stream_is_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(90):
        source = rng.choice("ab")
        rows.append({"data_source_id": source, "position": i, "content": rng.choice(["", "   ", "word " * rng.randrange(1, 60), "x" * rng.randrange(1, 400)]), "context": f"c{i // 20}", "authors": [rng.choice("uvw")], "source_url": f"p{i}", "merges": source == "a", "ts": f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}Z"})
    size = chunking.Size(60, 10, 8)
    want = chunking.group_messages(spark.read.schema(MESSAGES).json(spark.sparkContext.parallelize(map(json.dumps, rows))), size)
    last = {**rows[0], "data_source_id": "z", "content": "later", "position": 999, "ts": "2024-02-01T00:00:00Z"}  # moves the watermark on
    batches = [rows[:7], rows[7:40], rows[40:41], rows[41:], [last]]
    got = collected(spark, stateful.grouped_stream(stream_of(spark, tmp_path / "in", batches, MESSAGES), size=size), "grouped", tmp_path / "cp").where("data_source_id <> 'z'")
    assert want.count() > 20 and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_a_silent_source_is_closed_and_goes_on(spark, tmp_path):
    m = lambda p, at, x: {"data_source_id": "a", "position": p, "content": x, "context": "c", "authors": ["u"], "source_url": f"p{p}", "merges": True, "ts": at}
    z = lambda at: {**m(1, at, "z"), "data_source_id": "z"}
    batches = [[m(0, "2024-01-01T00:00:00Z", "one")], [z("2024-01-01T08:00:00Z")], [m(1, "2024-01-01T09:00:00Z", "two")], [z("2024-01-02T08:00:00Z")]]
    got = collected(spark, stateful.grouped_stream(stream_of(spark, tmp_path / "in", batches, MESSAGES)), "closed", tmp_path / "cp")
    assert [(r.chunk_index, r.content) for r in got.where("data_source_id = 'a'").orderBy("chunk_index").collect()] == [(0, "one"), (1, "two")]


def windows(times, period, most):
    out, start = [], None
    for t in sorted(times):
        if start is None or t >= start + period:
            start = t
            out.append([t, 0])
        out[-1][1] += 1
    return [(s, n, max(0, n - most)) for s, n in out]


def test_windows_from_the_first_hit(spark, tmp_path):
    rng = random.Random(9)
    hits = {k: sorted(rng.randrange(40_000) for _ in range(n)) for k, n in (("a", 60), ("b", 1), ("c", 12))} | {"d": [0, 0, 0, 0, 0, 0, 3599, 3600, 7199, 7200]}
    rows = sorted(({"key": k, "ts": t} for k, ts in hits.items() for t in ts), key=lambda r: (r["ts"], r["key"]))
    stamped = [{**r, "ts": f"2024-01-01T{r['ts'] // 3600:02d}:{r['ts'] // 60 % 60:02d}:{r['ts'] % 60:02d}Z"} for r in rows]
    want = sorted((k, *w) for k, ts in hits.items() for w in windows(ts, 3600, 5))
    shown = lambda df: sorted((r.key, int(r.s) - 1704067200, r.requests, r.blocked) for r in df.select("key", F.unix_seconds("window_start").alias("s"), "requests", "blocked").collect())
    table = spark.createDataFrame([(r["key"], r["ts"]) for r in stamped] + [(None, "2024-01-01T00:00:00Z"), ("e", None)], "key string, at string").withColumn("ts", F.col("at").cast("timestamp"))
    assert shown(stateful.first_hit_windows(table)) == want and stateful.first_hit_windows(table.limit(0)).count() == 0
    batches = [stamped[:20], stamped[20:21], stamped[21:60], stamped[60:], [{"key": "z", "ts": "2024-03-01T00:00:00Z"}]]
    got = collected(spark, stateful.first_hit_stream(stream_of(spark, tmp_path / "in", batches, "key string, ts timestamp")), "hits", tmp_path / "cp")
    assert shown(got.where("key <> 'z'")) == want


def test_pending_values_expire_and_are_taken_once(spark, tmp_path):
    """Time to live is time of the clock, so the stream runs on while files come."""
    row = lambda k, kind, seq, v=None: {"key": k, "kind": kind, "value": v, "seq": seq}
    (tmp_path / "in").mkdir()
    events = spark.readStream.schema("key string, kind string, value string, seq long").json(str(tmp_path / "in"))
    q = stateful.pending_stream(events, 8).writeStream.format("memory").queryName("taken").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()

    def shown():
        return sorted((r.key, str(r.value), r.found) for r in spark.table("taken").collect())

    def put(i, rows, want):
        (tmp_path / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        os.rename(tmp_path / f"{i}.json", tmp_path / f"in/{i}.json")
        end = time.time() + 60
        while len(shown()) < want and time.time() < end and q.isActive:
            time.sleep(0.3)

    try:
        put(0, [row("old", "put", 0, "o"), row("x", "take", 0)], 1)
        time.sleep(9)
        put(1, [row("old", "take", 1), row("live", "put", 2, "a"), row("live", "put", 3, "b"), row("used", "put", 4, "c"), row("used", "take", 5)], 3)
        put(2, [row("live", "take", 6), row("live", "take", 7), row("used", "take", 8)], 6)
        assert shown() == [("live", "None", False), ("live", "b", True), ("old", "None", False), ("used", "None", False), ("used", "c", True), ("x", "None", False)]
    finally:
        q.stop()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbours_without_an_exchange(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("abc") if i % 3 else "hot", rng.randrange(60), f"text {i}") for i in range(500)] + [(900, None, 3, "no source"), (901, "a", None, "no place")]
    chunks = spark.createDataFrame(rows, "chunk_id long, data_source_id string, chunk_index int, content string")
    colocated.write_placed(chunks, "placed_chunks", 4, stretch=8)
    got = colocated.neighbours(spark, "placed_chunks")
    assert "Exchange" not in plan_of(got)
    want = search.with_context(chunks.drop("content"), chunks).select(*got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert spark.table("placed_chunks").where("data_source_id = 'hot'").select("stretch").distinct().count() > 7
    spark.sql("drop table placed_chunks")


def test_bucketed_rows_and_keys_without_an_exchange(spark):
    rows = spark.range(2000).select((F.col("id") % 50).alias("a"), (F.col("id") % 7).alias("b"), F.col("id").alias("v"))
    keys = spark.range(300).select((F.col("id") % 90).alias("a"), (F.col("id") % 3).alias("b"))
    colocated.write_bucketed(rows, "rows_b", ["a", "b"], 4)
    colocated.write_bucketed(keys, "keys_b", ["a", "b"], 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = filters.keyed_rows(spark.table("rows_b"), spark.table("keys_b"), ["a", "b"])
        assert "Exchange" not in plan_of(joined)
        assert sorted(r.v for r in joined.collect()) == sorted(r.v for r in filters.keyed_rows(rows, keys, ["a", "b"]).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table rows_b")
        spark.sql("drop table keys_b")


def test_lookups_skip_row_groups(spark, tmp_path):
    rows = spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), (F.col("id") % 2).alias("org_id"), F.repeat(F.col("id").cast("string"), 20).alias("x"))
    colocated.write_lookup(rows.repartition(1), str(tmp_path / "t"), group_bytes=64 << 10)
    key = rows.where("org_id = 1").orderBy("id").limit(9_000).orderBy(F.desc("id")).first().id

    def scanned(df):
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        return leaves.apply(0).metrics().apply("numOutputRows").value()

    stored = spark.read.parquet(str(tmp_path / "t"))
    mine = stored.where(F.col("org_id") == 1).where(F.col("id") == key)
    assert mine.count() == 1 and catalogue.found(stored, 1, key).count() == 1 and catalogue.found(stored, 0, key).count() == 0
    assert 0 < scanned(mine) < 5_000
    assert scanned(stored.where((F.col("org_id") == 0) & (F.col("id") == key))) == 0  # a Bloom filter knows that it isn't there


def test_pages_by_bins(spark):
    rng = random.Random(4)
    pages, ranges = [], []
    for d in range(6):
        at = 0
        for p in range(40):
            n = rng.choice((0, 1, 5, 90, 700))
            pages.append((d, p, at, at + n))
            at += n
        ranges += [(d, i, max(0, 60 * i - 9), min(at, 60 * i + 60)) for i in range(at // 60 + 1) if 60 * i < at]
    r = spark.createDataFrame(ranges, "doc_id long, chunk_index long, start long, end long")
    p = spark.createDataFrame(pages, "doc_id long, page long, page_start long, page_end long")
    want = {(d, i): [q for e, q, x, y in pages if e == d and x < b and y > a] for d, i, a, b in ranges}
    for size in (1, 64, 4096):
        assert {(x.doc_id, x.chunk_index): list(x.pages) for x in chunking.pages_touched(r, p, bin_size=size).collect()} == {k: v for k, v in want.items() if v}


def test_a_document_of_very_many_pages(spark):
    n = 100_000
    pages = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("page"), (F.col("id") * 30).alias("page_start"), (F.col("id") * 30 + 30).alias("page_end"))
    ranges = spark.range(n * 30 // 1500).select(F.lit(1).alias("doc_id"), F.col("id").alias("chunk_index"), (F.col("id") * 1500).alias("start"), (F.col("id") * 1500 + 1500).alias("end"))
    out = chunking.pages_touched(ranges, pages)
    assert out.agg(F.count("*"), F.min(F.size("pages")), F.max(F.size("pages")), F.sum(F.size("pages"))).first()[:] == (2000, 50, 50, n)


def test_functions_in_sql(spark, sf):
    sql.register(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    want = chunking.chunk_texts(docs).select("doc_id", "chunk_index", "content")
    got = spark.sql("select d.doc_id, c.* from {docs} d, lateral text_chunks(d.text) c", docs=docs)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    few = spark.sql("select c.* from {docs} d, lateral text_chunks(d.text, 50, 0, 1) c where d.doc_id = 3", docs=docs)
    assert [r.content for r in few.collect()] == chunking.split_text(docs.where("doc_id = 3").first().text, chunking.Size(50, 0, 1))
    x = spark.range(5).withColumn("m", F.col("id") * 1_000_000_007)
    same = x.select(ids.pack_id(F.col("id"), F.col("m"), F.lit(18), F.col("id")).alias("a"), F.expr("pack_id(id, m, 18, cast(id as string)) b"))
    assert same.where("a <> b or id_org(b) is null or id_entity(b) <> 18 or not is_packed_id(b)").count() == 0
    assert same.where(ids.created_at(F.col("a")) != F.expr("id_time(b)")).count() == 0
