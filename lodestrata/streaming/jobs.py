"""Jobs with attempts: what fails waits and is tried again, three times at most, then it is a dead letter."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..store import cut
from .tables import VersionedTable, stream_name

# fixed values: attempts of a job, seconds before the second one (doubled each time), seconds and number that done and dead jobs are kept
ATTEMPTS, DELAY = 3, 1.0
KEPT = {"DONE": (3600, 100), "DEAD": (86_400, 200)}
#: A job as it is held: WAITING until due_at, DONE or DEAD since finished_at.
JOBS = "job_id string, payload string, status string, attempts int, due_at timestamp, error string, finished_at timestamp"

Handler = Callable[[DataFrame], DataFrame]
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def job_table(spark, path: str, **more) -> VersionedTable:
    return VersionedTable(spark, path, JOBS, ("job_id",), **more)


def replaced(old: DataFrame, new: DataFrame, key: str = "job_id") -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new.select(*old.columns))


def outcome(attempts: Column, error: Column, now: Column) -> dict[str, Column]:
    """What is held of a job after an attempt, attempts counting it."""
    again = error.isNotNull() & (attempts < ATTEMPTS)
    wait = F.make_dt_interval(secs=F.lit(DELAY).cast("decimal(18, 6)") * F.pow(F.lit(2), attempts - 1).cast("int"))
    return {
        "status": F.when(error.isNull(), "DONE").when(again, "WAITING").otherwise("DEAD"),
        "due_at": F.when(again, now + wait),
        "finished_at": F.when(~again, now),
    }


def attempt(jobs: VersionedTable, arrived: DataFrame | None, now: datetime, handle: Handler, target: VersionedTable, merge: Merge, stream: str, number: int) -> None:
    """One batch: jobs that arrived (job_id, payload) and those that are due go through handle once.

    handle returns (job_id, error) and what target's merge needs of them, a row for each job; an error that isn't null is a failure. A job that is held
    already isn't taken again. What succeeded is merged into target first, then all outcomes are held in one commit; both know
    the stream's batch, so a batch that is replayed after either of them changes nothing that is in.
    """
    held = jobs.read()
    due = held.where((F.col("status") == "WAITING") & (F.col("due_at") <= F.lit(now))).select("job_id", "payload", "attempts")
    if arrived is not None:
        new = arrived.groupBy("job_id").agg(F.min("payload").alias("payload")).join(held.select("job_id"), "job_id", "left_anti")
        due = due.unionByName(new.withColumn("attempts", F.lit(0)))
    due = cut(due, "due")
    done = cut(handle(due), "outcomes")
    target.merge(done.where("error is null").drop("error"), merge, stream, number)
    after = due.join(done.select("job_id", "error"), "job_id").withColumn("attempts", F.col("attempts") + 1)
    rows = after.withColumns(outcome(F.col("attempts"), F.col("error"), F.lit(now)))
    jobs.merge(rows.selectExpr(*(f"cast({c.split()[0]} as {c.split()[1]}) {c.split()[0]}" for c in JOBS.split(", "))), replaced, stream, number)


def work_stream(arrived: DataFrame, jobs: VersionedTable, handle: Handler, target: VersionedTable, merge: Merge, checkpoint: str, clock: Callable[[], datetime] = datetime.now, every: str | None = None) -> StreamingQuery:
    """Work off a stream of jobs (job_id, payload); jobs that wait are taken with the next batch after they are due."""
    name = stream_name(arrived.sparkSession, checkpoint)
    writer = arrived.writeStream.foreachBatch(lambda batch, number: attempt(jobs, batch, clock(), handle, target, merge, name(), number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def work_due(jobs: VersionedTable, now: datetime, handle: Handler, target: VersionedTable, merge: Merge) -> None:
    """Work off what is due while no jobs arrive, as a scheduler does between batches."""
    number = max(jobs.state()["batches"].get("due", -1), target.state()["batches"].get("due", -1)) + 1
    attempt(jobs, None, now, handle, target, merge, "due", number)


def swept(jobs: VersionedTable, now: datetime) -> None:
    """Forget done and dead jobs that are too old, or too many: of each kind the newest few stay."""
    rows = jobs.read()
    gone = None
    for status, (seconds, most) in KEPT.items():
        own = rows.where(F.col("status") == status)
        fresh = own.where(F.col("finished_at") >= F.lit(now) - F.expr(f"interval {seconds} seconds")).orderBy(F.desc("finished_at"), "job_id").limit(most)
        old = own.join(fresh.select("job_id"), "job_id", "left_anti")
        gone = old if gone is None else gone.unionByName(old)
    jobs.merge(cut(gone, "gone"), lambda held, away: held.join(away.select("job_id"), "job_id", "left_anti"))
