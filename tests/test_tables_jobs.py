"""Tables under several streams, leaves that split, jobs that fail, and provider exports over restarts."""

import json
import os
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestrata.sources import provider_source as ps
from lodestrata.streaming import jobs, sync
from lodestrata.streaming.tables import VersionedTable

SCHEMA = "connection_id string, external_id string, action string, title string, append_only boolean, seq long"
STORED = "id long, connection_id string, external_id string, status string, title string"


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("connection_id", "external_id", "action", "title", "append_only", "seq"), x))) for x in rows))


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))


def titles(table):
    return {(r.connection_id, r.external_id): r.title for r in table.read().collect()}


def test_a_new_checkpoint_loses_no_rows(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), STORED)
    for i in range(4):
        put(tmp_path / "a", f"{i}.json", [("k", f"a{i}", "created", f"t{i}", False, i)])
    assert sync.sync_stream(stream(spark, tmp_path / "a"), table, str(tmp_path / "cp1")).awaitTermination(120)
    put(tmp_path / "b", "0.json", [("k", "b0", "created", "new", False, 9)])
    assert sync.sync_stream(stream(spark, tmp_path / "b"), table, str(tmp_path / "cp2")).awaitTermination(120)
    assert titles(table) == {("k", f"a{i}"): f"t{i}" for i in range(4)} | {("k", "b0"): "new"}
    assert sorted(table.state()["batches"].values()) == [0, 3]


def test_two_streams_at_once(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), STORED)
    for i in range(3):
        put(tmp_path / "a", f"{i}.json", [("k", f"a{i}", "created", "x", False, i)])
        put(tmp_path / "b", f"{i}.json", [("k", f"b{i}", "created", "y", False, i)])
    both = [sync.sync_stream(stream(spark, tmp_path / d), table, str(tmp_path / f"cp-{d}")) for d in "ab"]
    assert all(q.awaitTermination(240) for q in both)
    assert titles(table) == {("k", f"{d}{i}"): v for d, v in (("a", "x"), ("b", "y")) for i in range(3)}


def test_writers_that_meet_merge_again(spark, tmp_path):
    table = lambda: VersionedTable(spark, str(tmp_path / "t"), "k string, v long", ["k"])
    rows = lambda i: spark.createDataFrame([(f"k{i}", i), ("shared", i)], "k string, v long")
    add = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("v").alias("v"))
    some = [threading.Thread(target=lambda i=i: table().merge(rows(i), add, f"s{i}", 0)) for i in range(4)]
    [x.start() for x in some]
    [x.join() for x in some]
    assert {r.k: r.v for r in table().read().collect()} == {f"k{i}": i for i in range(4)} | {"shared": 6}
    assert table().state()["version"] == 4


def test_leaves_split_as_the_table_grows(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "k long, v string", ["k"], leaf_bytes=8_000)
    add = lambda old, new: jobs.replaced(old, new, "k")
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    table.merge(rows(0, 50), add)
    few = len(table.state()["leaves"])
    table.merge(rows(50, 3_000), add)
    before = table.state()
    assert few < 4 < 16 < len(before["leaves"]) and table.read().count() == 3_000
    assert sum(n for _, _, n in before["leaves"].values()) == 3_000
    table.merge(spark.createDataFrame([(7, "new")], "k long, v string"), add)
    after = table.state()
    same = [x for x in after["leaves"] if before["leaves"].get(x) == after["leaves"][x]]
    assert len(same) >= len(before["leaves"]) - 1 and table.read().where("k = 7").first().v == "new" and table.read().count() == 3_000
    table.merge(rows(0, 0), add)
    assert table.read().count() == 3_000


T0 = datetime(2024, 1, 1)


def handler(fails):
    """Fails a job as often as its payload says, by a count of what has been tried."""

    def handle(todo):
        n = F.col("payload").cast("int")
        return todo.select("job_id", F.when(F.col("attempts") < n, F.concat(F.lit("failed "), F.col("attempts").cast("string"))).alias("error"), F.concat(F.lit("done "), "job_id").alias("title"))

    return handle


def setup(spark, tmp_path):
    held = jobs.job_table(spark, str(tmp_path / "jobs"))
    target = VersionedTable(spark, str(tmp_path / "target"), "job_id string, title string", ["job_id"])
    return held, target, lambda old, new: jobs.replaced(old, new)


def status(held):
    return {r.job_id: (r.status, r.attempts, r.due_at) for r in held.read().collect()}


def test_failed_jobs_are_tried_again(spark, tmp_path):
    held, target, merge = setup(spark, tmp_path)
    arrived = spark.createDataFrame([("a", "0"), ("b", "2"), ("c", "9"), ("a", "0")], "job_id string, payload string")
    at = T0
    jobs.attempt(held, arrived, at, handler(None), target, merge, "s", 0)
    assert status(held) == {"a": ("DONE", 1, None), "b": ("WAITING", 1, at + timedelta(seconds=1)), "c": ("WAITING", 1, at + timedelta(seconds=1))}
    jobs.attempt(held, arrived, at, handler(None), target, merge, "s", 0)  # replayed
    assert status(held)["b"][1] == 1
    jobs.attempt(held, arrived, at + timedelta(seconds=0.5), handler(None), target, merge, "s", 1)  # known, and not due yet
    assert status(held)["b"][1] == 1
    at += timedelta(seconds=1)
    jobs.work_due(held, at, handler(None), target, merge)
    assert status(held)["b"] == ("WAITING", 2, at + timedelta(seconds=2)) and target.read().count() == 1
    at += timedelta(seconds=2)
    jobs.work_due(held, at, handler(None), target, merge)
    assert {k: v[:2] for k, v in status(held).items()} == {"a": ("DONE", 1), "b": ("DONE", 3), "c": ("DEAD", 3)}
    assert sorted(r.job_id for r in target.read().collect()) == ["a", "b"]  # each once
    assert held.read().where("job_id = 'c'").first().error == "failed 2"
    jobs.swept(held, at + timedelta(hours=2))
    assert set(status(held)) == {"c"}
    jobs.swept(held, at + timedelta(days=2))
    assert status(held) == {}


def test_job_stream(spark, tmp_path):
    held, target, merge = setup(spark, tmp_path)
    (tmp_path / "in").mkdir()
    times = iter(range(100))
    clock = lambda: T0 + timedelta(seconds=10 * next(times))
    for i, rows in enumerate(([("a", "0"), ("b", "1")], [("c", "0")])):
        (tmp_path / f"in/{i}.json").write_text("\n".join(json.dumps({"job_id": j, "payload": p}) for j, p in rows))
        os.utime(tmp_path / f"in/{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    source = spark.readStream.schema("job_id string, payload string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    assert jobs.work_stream(source, held, handler(None), target, merge, str(tmp_path / "cp"), clock).awaitTermination(120)
    assert {k: v[:2] for k, v in status(held).items()} == {"a": ("DONE", 1), "b": ("DONE", 2), "c": ("DONE", 1)}
    assert sorted(r.job_id for r in target.read().collect()) == ["a", "b", "c"]


def test_only_the_newest_done_jobs_are_kept(spark, tmp_path):
    held, *_ = setup(spark, tmp_path)
    rows = [(f"{k}{i:03d}", "", k, 1, None, None, T0 + timedelta(seconds=i)) for k in ("DONE", "DEAD") for i in range(250)] + [("w", "", "WAITING", 1, T0, "x", None)]
    held.merge(spark.createDataFrame(rows, jobs.JOBS), jobs.replaced)
    jobs.swept(held, T0 + timedelta(seconds=300))
    left = sorted(r.job_id for r in held.read().collect())
    assert left == [f"DEAD{i:03d}" for i in range(50, 250)] + [f"DONE{i:03d}" for i in range(150, 250)] + ["w"]


def page(base, channel, until, items):
    at = base / ps.channel_folder(channel) / f"until={until}"
    at.mkdir(parents=True)
    (at / "part-0.txt").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in items) + "\n")


def issue(i, at):
    return {"entity": "issue", "id": i, "updated_at": at, "title": f"t{i}"}


def test_provider_pages(spark, tmp_path):
    page(tmp_path, "org/repo:1", "2024-02", [issue(1, "2024-01"), issue(2, "2024-02"), "no json", "", {"entity": "odd", "id": 5}, [1]])
    page(tmp_path, "org/repo:1", "2024-04", [issue(3, "2024-04")])
    page(tmp_path, "b", "2024-03", [issue(4, "2024-03"), {"entity": "comment", "id": "c", "updated_at": None}])
    everything = ps.provider_pages(spark, str(tmp_path), "github")
    assert everything.columns == [c.split()[0] for c in ps.SCHEMA.split(", ")]
    assert sorted((r.channel, r.external_id, r.updated_at) for r in everything.collect()) == [("b", "4", "2024-03"), ("org/repo:1", "1", "2024-01"), ("org/repo:1", "2", "2024-02"), ("org/repo:1", "3", "2024-04")]
    assert everything.rdd.getNumPartitions() == 2  # a task a channel
    later = ps.provider_pages(spark, f"file:{tmp_path}", "github", after="2024-02")
    assert sorted(r.external_id for r in later.collect()) == ["3", "4"]
    assert [r.external_id for r in ps.provider_pages(spark, str(tmp_path), "github", channels=("b",)).collect()] == ["4"]
    assert ps.provider_pages(spark, str(tmp_path / "none"), "slack").count() == 0


def test_a_restarted_sync_neither_loses_nor_doubles(spark, tmp_path):
    export, to, checkpoint = tmp_path / "export", str(tmp_path / "items"), str(tmp_path / "cp")
    run = lambda: ps.sync_items(spark, str(export), "github", to, checkpoint, after="2024-01-02").awaitTermination(120)
    taken = lambda: sorted(int(r.external_id) for r in spark.read.parquet(to).collect())
    page(export, "a", "2024-01-04", [issue(i, f"2024-01-0{i}") for i in (1, 2, 3, 4)])
    page(export, "b", "2024-01-03", [issue(13, "2024-01-03")])
    assert run() and taken() == [3, 4, 13]
    assert run() and taken() == [3, 4, 13]
    page(export, "a", "2024-01-06", [issue(5, "2024-01-05"), issue(6, "2024-01-06")])
    page(export, "c", "2024-01-05", [issue(25, "2024-01-05")])  # a new channel, whose cursor lies behind another's
    assert run() and taken() == [3, 4, 5, 6, 13, 25]
    # a batch that failed after it was planned is read again as it was planned: the sink's log is taken back
    log = tmp_path / "cp/commits"
    last = max((f for f in os.listdir(log) if f.isdigit()), key=int)
    os.remove(log / last)
    (log / f".{last}.crc").unlink(missing_ok=True)
    page(export, "a", "2024-01-09", [issue(9, "2024-01-09")])
    assert run() and run() and taken() == [3, 4, 5, 6, 9, 13, 25]


@pytest.mark.parametrize("size", [3, 50])
def test_pages_of_a_client(spark, tmp_path, size):
    rows = [("c" if i % 3 else "d", f"t{i // 4:02d}", json.dumps({"entity": "issue", "id": str(i), "updated_at": f"t{i // 4:02d}"})) for i in range(60)]
    ps.put_down(spark.createDataFrame(rows, "channel string, updated_at string, payload string"), str(tmp_path / "e"), size)
    got = ps.provider_pages(spark, str(tmp_path / "e"), "github", after="t03").collect()
    assert sorted(r.payload for r in got) == sorted(p for _, t, p in rows if t > "t03")
    each = [spark.read.text(str(p)).count() for p in (tmp_path / "e").glob("*/until=*")]
    assert min(each) >= 1 and (size == 50 or max(each) <= size + 2)
