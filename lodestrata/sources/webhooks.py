"""Inbound events of the providers as (provider, action, external_id), and whom they concern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BODY = (
    "action string, type string, url string, event struct<type:string,subtype:string,channel:string>, repository struct<full_name:string>, "
    "installation struct<id:long>, issue struct<number:long>, pull_request struct<number:long,merged:boolean>, discussion struct<number:long>, "
    "data struct<id:string,issueId:string>, entity struct<id:string,type:string>"
)

# fixed values: event types that mean a page has changed
PAGE_CHANGED = (
    "page.content_updated", "page.created", "page.properties_updated", "page.moved", "page.locked", "page.unlocked",
    "data_source.schema_updated", "database.schema_updated", "page.undeleted", "comment.created", "comment.updated",
)


def normalised(bodies: DataFrame, body: str = "body") -> DataFrame:
    """bodies (provider, body as JSON) with (action, external_id, installation_id); events that mean nothing are dropped.

    Works on streams as on tables.
    """
    b = lambda f: F.col(f"b.{f}")
    x = bodies.withColumn("b", F.from_json(body, BODY))
    slack = F.when(
        b("event.channel").isNotNull() & (b("event.type") == "message"),
        F.struct(F.when(b("event.subtype") == "message_deleted", "deleted").when(b("event.subtype") == "message_changed", "updated").otherwise("created").alias("action"), b("event.channel").alias("external_id")),
    )
    number = F.coalesce(b("issue.number"), b("pull_request.number"), b("discussion.number"))
    closed = b("pull_request.number").isNotNull() & b("issue.number").isNull() & (b("action") == "closed") & ~F.coalesce(b("pull_request.merged"), F.lit(True))
    created = (b("action") == "created") | ((b("action") == "opened") & b("discussion.number").isNull())
    github = F.when(
        number.isNotNull() & b("repository.full_name").isNotNull(),
        F.struct(F.when(created, "created").when((b("action") == "deleted") | closed, "deleted").otherwise("updated").alias("action"), F.concat(b("repository.full_name"), F.lit("#"), number.cast("string")).alias("external_id")),
    )
    linear_action = F.when(b("action") == "create", "created").when(b("action") == "update", "updated").when(b("action") == "remove", "deleted")
    linear_id = F.when(b("type") == "Comment", b("data.issueId")).when(b("type") == "Issue", b("data.id"))
    linear = F.when(linear_action.isNotNull() & linear_id.isNotNull(), F.struct(linear_action.alias("action"), linear_id.alias("external_id")))
    notion_action = F.when(b("type") == "page.deleted", "deleted").when(b("type").isin(*PAGE_CHANGED), "updated")
    notion = F.when(notion_action.isNotNull() & b("entity.id").isNotNull(), F.struct(notion_action.alias("action"), b("entity.id").alias("external_id")))
    p = F.col("provider")
    found = F.when(p == "SLACK", slack).when(p == "GITHUB", github).when(p == "LINEAR", linear).when(p == "NOTION", notion)
    return x.withColumn("e", found).where(F.col("e").isNotNull()).withColumns({"action": F.col("e.action"), "external_id": F.col("e.external_id"), "installation_id": b("installation.id")}).drop("b", "e")


def fanned_out(events: DataFrame, connections: DataFrame) -> DataFrame:
    """Events with the active connections that they concern: all of the provider, of GitHub those of the event's installation."""
    live = connections.where(F.col("status") == "ACTIVE").select(F.col("id").alias("connection_id"), "provider", "installation_id")
    named = F.coalesce((F.col("provider") == "GITHUB") & F.col("installation_id").isNotNull(), F.lit(False))
    columns = ["provider", *(c for c in events.columns if c != "provider"), "connection_id"]
    own = events.where(named).join(live, ["provider", "installation_id"]).select(columns)
    return own.unionByName(events.where(~named).join(live.drop("installation_id"), "provider").select(columns))


def hmac_sha256(key: Column, body: Column) -> Column:
    """The body's HMAC under a key of up to 64 bytes, in hexadecimal: two hashes over key and padding, all built-in functions."""
    padded = F.rpad(F.hex(F.encode(key, "UTF-8")), 128, "0")
    digit = lambda i: F.conv(F.substr(padded, F.lit(2 * i + 1), F.lit(2)), 16, 10).cast("int")
    mask = lambda m: F.unhex(F.concat(*(F.lpad(F.hex(digit(i).bitwiseXOR(F.lit(m))), 2, "0") for i in range(64))))
    inner = F.sha2(F.concat(mask(0x36), F.encode(body, "UTF-8")), 256)
    return F.sha2(F.concat(mask(0x5C), F.unhex(inner)), 256)


def signed(secret: str, prefix: str = "sha256="):
    """Column function (body, signature): whether the signature is the body's HMAC; without one it isn't.

    Hashes of the two are compared, so how alike they are doesn't show in the time taken.
    """
    return lambda body, signature: F.sha2(F.concat(F.lit(prefix), hmac_sha256(F.lit(secret), F.coalesce(body, F.lit("")))), 256) == F.sha2(F.coalesce(signature, F.lit("")), 256)


def fresh(sent_at: Column, now: Column, seconds: int = 300) -> Column:
    """Whether an event was sent within the replay window."""
    return F.abs(now.cast("double") - sent_at.cast("double")) <= seconds
