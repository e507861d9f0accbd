"""Metadata filters of a search, as one predicate below every leg."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_blank

TYPES = ("PDF", "CSV", "DOCX", "XLSX", "TXT", "JSON", "IMAGE", "SLACK", "LINEAR", "GITHUB", "NOTION")

#: One nullable struct for the metadata of all kinds of chunks.
METADATA = (
    "type STRING, pages ARRAY<INT>, sheet STRING, row INT, columns ARRAY<STRING>, slackChannelId STRING, slackMessageTs STRING, "
    "slackAuthors ARRAY<STRING>, slackAuthor STRING, linearIssueId STRING, linearCommentId STRING, linearTimestamp STRING, "
    "githubItemType STRING, githubCommentId STRING, notionPageId STRING, notionBlockId STRING"
)
FIELDS = tuple(x.split()[0] for x in METADATA.replace("ARRAY<", "").split(", "))
#: Fields that a chunk of each type may have.
LEGAL = {
    "PDF": ("pages",), "DOCX": ("pages",), "CSV": ("row", "columns"), "XLSX": ("sheet", "row", "columns"), "TXT": (), "JSON": (), "IMAGE": (),
    "SLACK": ("slackChannelId", "slackMessageTs", "slackAuthors", "slackAuthor"), "LINEAR": ("linearIssueId", "linearCommentId", "linearTimestamp"),
    "GITHUB": ("githubItemType", "githubCommentId"), "NOTION": ("notionPageId", "notionBlockId"),
}


def legal_metadata(meta: str = "metadata") -> Column:
    """Whether a chunk has a known type and only fields of that type."""
    ok = [F.when(F.col(f"{meta}.type") == t, reduce(lambda a, b: a & b, [F.col(f"{meta}.{f}").isNull() for f in FIELDS if f not in ("type", *LEGAL[t])], F.lit(True))) for t in TYPES]
    return F.coalesce(*ok, F.lit(False))


def condition(field: str, operator: str, value, meta: str = "metadata") -> Column:
    """One filter: eq or in on type; eq on the others. Names are compared exactly; authors also in the older scalar field."""
    if operator not in ("eq", "in"):
        raise ValueError(f"unknown operator {operator}")
    values = list(value) if isinstance(value, (list, tuple)) else [value]
    c = lambda f: F.col(f"{meta}.{f}")
    if field == "type":
        return c("type").isin(values) if operator == "in" else c("type") == values[0]
    if operator != "eq":
        raise ValueError(f"{field} takes eq only")
    if field == "slackAuthors":
        return F.coalesce(F.array_contains(c("slackAuthors"), values[0]), F.lit(False)) | (c("slackAuthor") == values[0])
    if field in ("slackChannelId", "notionPageId", "linearIssueId"):
        return c(field) == values[0]
    raise ValueError(f"unknown field {field}")


def filtered(chunks: DataFrame, org_id, collections: list | None = None, filters: list[dict] | None = None, meta: str = "metadata") -> DataFrame:
    """The rows that every leg of a search starts from: tenant, collections (none given: all) and all filters."""
    out = chunks.where(F.col("org_id") == F.lit(org_id))
    if collections:
        out = out.where(F.col("collection_id").isin(list(collections)))
    for f in filters or []:
        out = out.where(condition(f["field"], f.get("operator", "eq"), f["value"], meta))
    return out


def spoken_messages(messages: DataFrame, bot_mention: str | None = None) -> DataFrame:
    """Messages that aren't blank, aren't a bot's and don't call the bot."""
    out = messages.where(~is_blank(F.coalesce("text", F.lit(""))) & (F.coalesce("bot_id", F.lit("")) == ""))
    return out.where(~F.coalesce(F.col("text").contains(bot_mention), F.lit(False))) if bot_mention else out


def keyed_rows(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows whose key tuple is among keys."""
    return rows.join(keys.select(*on).distinct(), on, "left_semi")
