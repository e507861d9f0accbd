"""Usage reports over the append-only log of model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pricing import cost, provider
from ..functions.scalars import member_name

SUMS = ("input_tokens", "output_tokens", "total_tokens")


def log_rows(calls: DataFrame) -> DataFrame:
    """Calls with provider, total tokens and cost derived, as they are appended to the log."""
    return calls.withColumns({"provider": provider(F.col("model")), "total_tokens": F.col("input_tokens") + F.col("output_tokens"), "cost": cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens"))})


def append_log(calls: DataFrame, path: str) -> None:
    """The only way to write the log: rows are added, never changed."""
    log_rows(calls).write.mode("append").partitionBy("org_id").parquet(path)


def since(log: DataFrame, now: str, days: int) -> DataFrame:
    """The last days times 24 hours before now, so the first day is partial."""
    if not 1 <= days <= 90:
        raise ValueError("days must lie between 1 and 90")
    return log.where(F.col("created_at") >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name)


def summary(log: DataFrame) -> DataFrame:
    """One row, zeros for an empty log."""
    return log.agg(F.count(F.lit(1)).alias("requests"), *map(_total, SUMS))


def daily(log: DataFrame) -> DataFrame:
    day = F.date_trunc("day", "created_at")
    return log.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("requests"), *map(_total, SUMS)).select(F.date_format("day", "yyyy-MM-dd").alias("date"), "requests", *SUMS).orderBy("date")


def by_model(log: DataFrame) -> DataFrame:
    out = log.groupBy("model", "provider").agg(F.count(F.lit(1)).alias("requests"), *map(_total, SUMS), F.sum("cost").alias("cost"))
    return out.orderBy(F.desc_nulls_last("total_tokens"), "model")


def by_request_type(log: DataFrame) -> DataFrame:
    return log.groupBy("request_type").agg(F.count(F.lit(1)).alias("requests"), _total("total_tokens")).orderBy(F.desc("total_tokens"), "request_type")


def by_source(log: DataFrame) -> DataFrame:
    return log.groupBy("source").agg(F.count(F.lit(1)).alias("requests"), *map(_total, SUMS)).orderBy(F.desc("total_tokens"), "source")


def by_member(log: DataFrame, users: DataFrame) -> DataFrame:
    """Totals are summed by user before names are joined, so the join sees one row a user."""
    per_user = log.groupBy("user_id").agg(F.count(F.lit(1)).alias("requests"), *map(_total, SUMS))
    named = per_user.join(users.select(F.col("id").alias("user_id"), "first_name", "last_name"), "user_id", "left")
    return named.select("user_id", member_name(F.col("first_name"), F.col("last_name")).alias("name"), "requests", *SUMS).orderBy(F.desc("total_tokens"), F.asc_nulls_last("user_id"))


def cost_by_member(log: DataFrame) -> DataFrame:
    """(user_id, cost) of a period, calls of no member under null."""
    return log.groupBy("user_id").agg(F.sum("cost").alias("cost"))


def report(log: DataFrame, users: DataFrame) -> dict[str, DataFrame]:
    """All six reports of one period. The window is a filter on the scan, so each reads only its own columns of it."""
    return {"summary": summary(log), "daily": daily(log), "by_model": by_model(log), "by_request_type": by_request_type(log), "by_source": by_source(log), "by_member": by_member(log, users)}


def report_in_one_scan(log: DataFrame) -> DataFrame:
    """(section, key, requests, totals) of the five reports without names, by grouping sets: the log is read once."""
    day = F.date_format(F.date_trunc("day", "created_at"), "yyyy-MM-dd")
    x = log.select(day.alias("day"), "model", "request_type", "source", *SUMS)
    sets = [[], [F.col("day")], [F.col("model")], [F.col("request_type")], [F.col("source")]]
    g = x.groupingSets(sets, "day", "model", "request_type", "source").agg(F.count(F.lit(1)).alias("requests"), *map(_total, SUMS), F.grouping_id().alias("gid"))
    section = F.when(F.col("gid") == 15, "summary").when(F.col("gid") == 7, "daily").when(F.col("gid") == 11, "by_model").when(F.col("gid") == 13, "by_request_type").otherwise("by_source")
    return g.select(section.alias("section"), F.coalesce("day", "model", "request_type", "source").alias("key"), "requests", *SUMS)


def throttle(requests: DataFrame, limits: tuple[tuple[str, int], ...] = (("1 second", 10), ("60 seconds", 100), ("3600 seconds", 1000)), key: str = "key", ts: str = "ts") -> DataFrame:
    """(key, period, window_start, requests, blocked): fixed windows, and how many of each window were over the limit.

    One scan: a request counts in its window of each period, and counts are added up before the shuffle.
    """
    at = F.unix_seconds(F.col(ts).cast("timestamp"))
    window = lambda p, n: F.struct(F.lit(p).alias("period"), F.lit(n).alias("most"), F.timestamp_seconds(at - F.pmod(at, F.lit(int(p.split()[0])))).alias("window_start"))
    each = requests.select(F.col(key).alias("key"), F.explode(F.array(*(window(p, n) for p, n in limits))).alias("w"))
    counts = each.groupBy("key", "w.period", "w.most", "w.window_start").agg(F.count(F.lit(1)).alias("requests"))
    return counts.select("key", "period", "window_start", "requests", F.greatest(F.lit(0), F.col("requests") - F.col("most")).alias("blocked"))
