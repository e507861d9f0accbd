"""Provider exports as item tables and streams, and the cursors that a sync carries on.

An export is JSON lines, one object an item, as an API client has put them down; Spark reads it from any
store, in batch or as a file stream, and a sync takes the items after its cursor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: days that a first sync looks back, hours between scheduled syncs (none: webhooks only)
LOOK_BACK_DAYS = 30
SYNC_HOURS = {"SLACK": 1, "NOTION": 1, "LINEAR": None, "GITHUB": None}
#: Entities of each provider, and the field whose value is the cursor; those without one are always read.
ENTITIES = {
    "SLACK": {"channel": None, "message": "ts", "reply": "ts"},
    "GITHUB": {"issue": "updated_at", "pull_request": "updated_at", "discussion": "updatedAt", "comment": "updated_at", "diff": "updated_at"},
    "LINEAR": {"issue": "updatedAt"},
    "NOTION": {"page": "last_edited_time", "block": "last_edited_time"},
}
PAGE_SIZE = 50


def provider_items(spark: SparkSession, path: str, provider: str, after: str = "", stream: bool = False) -> DataFrame:
    """(entity, external_id, updated_at, payload) of an export's items with a cursor value above after, compared as text."""
    fields = ENTITIES[provider.upper()]
    raw = (spark.readStream if stream else spark.read).text(path)
    get = lambda f: F.get_json_object("value", f"$.{f}")
    at = F.coalesce(*(F.when(get("entity") == e, get(f)) for e, f in fields.items() if f), F.lit(""))
    x = raw.select(get("entity").alias("entity"), F.coalesce(get("external_id"), get("id"), get("ts")).alias("external_id"), at.alias("updated_at"), F.col("value").alias("payload"))
    timed = [e for e, f in fields.items() if f]
    return x.where(F.col("entity").isin(list(fields)) & (~F.col("entity").isin(timed) | (F.col("updated_at") > after)))


def cursors(items: DataFrame, key: str, at: str, old: DataFrame | None = None) -> DataFrame:
    """(key, cursor): the largest time that each channel or sync has seen, as text; what was known stays where nothing is new."""
    new = items.groupBy(key).agg(F.max(at).alias("cursor"))
    if old is None:
        return new
    return old.select(key, F.col("cursor").alias("before")).join(new, key, "full_outer").select(key, F.greatest(F.coalesce("cursor", "before"), F.coalesce("before", "cursor")).alias("cursor"))


def slack_cursors(messages: DataFrame, bot_mention: str, old: DataFrame | None = None) -> DataFrame:
    """Cursors of channels: only top-level messages that are no bot's and don't call the bot move them."""
    top = messages.where((F.coalesce("thread_ts", F.lit("")) == "") | (F.col("thread_ts") == F.col("ts")))
    spoken = top.where((F.coalesce("bot_id", F.lit("")) == "") & ~F.coalesce(F.col("text").contains(bot_mention), F.lit(False)))
    return cursors(spoken, "channel_id", "ts", old)


def due(connections: DataFrame, now) -> DataFrame:
    """Active connections whose schedule asks for a sync."""
    hours = F.try_element_at(F.create_map(*(F.lit(x) for p, h in SYNC_HOURS.items() if h for x in (p, h))), F.col("provider"))
    late = F.col("last_synced_at").isNull() | (now.cast("double") - F.col("last_synced_at").cast("double") >= hours * 3600)
    return connections.where((F.col("status") == "ACTIVE") & hours.isNotNull() & late)


def since_for(connections: DataFrame, now) -> DataFrame:
    """connections with where their sync starts: after the last one, or LOOK_BACK_DAYS ago for a first."""
    return connections.withColumn("since", F.coalesce("last_synced_at", now - F.expr(f"interval {LOOK_BACK_DAYS} days")))
