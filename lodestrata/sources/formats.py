"""Items of chat, issue and wiki tools as text: headers, bodies, comments and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import iso_stamp, slack_permalink, slack_stamp


def _given(prefix: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(prefix), value))


def _listed(prefix: str, values: Column) -> Column:
    return F.when(F.size(F.coalesce(values, F.array().cast("array<string>"))) > 0, F.concat(F.lit(prefix), F.array_join(values, ", ")))


def github_header(x) -> Column:
    """Context of an issue, pull request or discussion; x gives its columns by name."""
    first = F.concat(x("repo"), F.lit("#"), x("number").cast("string"), F.coalesce(F.concat(F.lit(" ("), x("kind"), F.lit(")")), F.lit("")), F.lit(": "), x("title"))
    facts = F.concat_ws(" | ", _given("Category: ", x("category")), _given("State: ", x("state")), _given("Author: ", x("author")), _listed("Assignees: ", x("assignees")))
    branches = F.when(x("head").isNotNull() & x("base").isNotNull(), F.concat(F.lit("Branches: "), x("head"), F.lit(" -> "), x("base")))
    return F.concat_ws("\n", first, F.nullif(facts, F.lit("")), branches, _listed("Labels: ", x("labels")))


def linear_header(x) -> Column:
    facts = F.concat_ws(" | ", _given("Status: ", x("state")), _given("Priority: ", x("priority_label")), _given("Assignee: ", x("assignee")), _given("Team: ", x("team")))
    child = F.transform(x("children"), lambda c: F.concat(c["identifier"], F.lit(" "), c["title"], F.coalesce(F.concat(F.lit(" ("), c["state"], F.lit(")")), F.lit(""))))
    parent = F.when(x("parent_identifier").isNotNull(), F.concat(F.lit("Parent: "), x("parent_identifier"), F.lit(" "), x("parent_title")))
    return F.concat_ws("\n", F.concat(F.lit("Issue "), x("identifier"), F.lit(": "), x("title")), F.nullif(facts, F.lit("")), _listed("Labels: ", x("labels")), parent, _listed("Sub-issues: ", child))


def linear_comment_line(x) -> Column:
    return F.concat_ws(" | ", F.concat(F.lit("Comment on "), x("identifier"), F.lit(" ("), x("title"), F.lit(")")), F.nullif(x("state"), F.lit("")), F.nullif(x("priority_label"), F.lit("")))


def with_body(header: Column, body: Column) -> Column:
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(header, F.lit("\n\n"), body)).otherwise(header)


def comment_text(context: Column, created_at: Column, author: Column, body: Column, nobody: str = "unknown") -> Column:
    return F.concat(context, F.lit("\n["), iso_stamp(created_at), F.lit("] "), F.coalesce(author, F.lit(nobody)), F.lit(": "), body)


def items(heads: DataFrame, comments: DataFrame, key: str = "external_id", joint: str = "\n\n") -> DataFrame:
    """heads with (content, messages): the head's text and its comments' in order of pos, joined."""
    c = comments.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("replies"))
    out = heads.join(c, key, "left").withColumn("messages", F.concat(F.array("head_text"), F.coalesce("replies", F.array().cast("array<string>"))))
    return out.withColumn("content", F.array_join("messages", joint)).drop("replies", "head_text")


def github_title(repo: Column, number: Column, title: Column) -> Column:
    return F.concat(F.lit("["), repo, F.lit("#"), number.cast("string"), F.lit("] "), title)


def label_names(labels: Column) -> Column:
    """Names of a variant array of strings or objects with a name; others are left out."""
    each = F.transform(labels.cast("array<variant>"), lambda v: F.coalesce(F.try_variant_get(v, "$.name", "string"), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))))
    return F.filter(each, lambda x: x.isNotNull())


def rich_text(parts: Column) -> Column:
    return F.array_join(F.transform(F.coalesce(parts, F.array().cast("array<struct<plain_text string>>")), lambda p: p["plain_text"]), "")


# fixed values: what precedes the text of a block of each kind
BLOCK_MARKS = {"paragraph": "", "quote": "", "callout": "", "toggle": "", "heading_1": "# ", "heading_2": "## ", "heading_3": "### ", "bulleted_list_item": "- ", "numbered_list_item": "- "}
MEDIA_BLOCKS = ("image", "video", "file", "pdf", "bookmark", "embed")


def block_text(kind: Column, text: Column, checked: Column, language: Column, cells: Column, title: Column) -> Column:
    """A wiki block as text; kinds that aren't known give none."""
    plain = F.coalesce(text, F.lit(""))
    mark = F.try_element_at(F.create_map(*(F.lit(x) for p in BLOCK_MARKS.items() for x in p)), kind)
    return (
        F.when(mark.isNotNull(), F.concat(mark, plain))
        .when(kind == "to_do", F.concat(F.when(checked, "[x] ").otherwise("[ ] "), plain))
        .when(kind == "code", F.concat(F.lit("```"), F.coalesce(language, F.lit("")), F.lit("\n"), plain, F.lit("\n```")))
        .when(kind == "divider", "---")
        .when(kind == "table_row", F.array_join(cells, " | "))
        .when(kind == "child_page", F.concat(F.lit("[Child Page: "), title, F.lit("]")))
        .when(kind == "child_database", F.concat(F.lit("[Child Database: "), title, F.lit("]")))
        .when(kind.isin(*MEDIA_BLOCKS), F.concat(F.lit("["), kind, F.lit("]")))
        .otherwise("")
    )


def page_title(titles: Column) -> Column:
    """First title that isn't empty, else Untitled."""
    return F.coalesce(F.get(F.filter(titles, lambda t: t.isNotNull() & (t != "")), 0), F.lit("Untitled"))


def block_tree(blocks: DataFrame, depth: int = 3) -> DataFrame:
    """(page_id, path, level, block columns): blocks below each page in reading order, at most depth levels below the first.

    blocks: id, parent_id, page_id, pos; a block of the page itself has parent_id equal to page_id.
    """
    rest = [c for c in blocks.columns if c not in ("parent_id", "page_id", "pos")]
    level = blocks.where(F.col("parent_id") == F.col("page_id")).select("page_id", F.array(F.col("pos")).alias("path"), F.lit(0).alias("level"), *rest)
    out = level
    for n in range(1, depth + 1):
        up = level.select(F.col("id").alias("parent_id"), "page_id", F.col("path").alias("above"))
        level = blocks.join(up, ["parent_id", "page_id"]).select("page_id", F.concat("above", F.array("pos")).alias("path"), F.lit(n).alias("level"), *rest)
        out = out.unionByName(level)
    return out


def slack_messages(messages: DataFrame, team: str | None = None) -> DataFrame:
    """(channel_id, ts, content, author, source_url): a message as `[time] author: text`."""
    who = F.coalesce("user", F.lit("unknown"))
    content = F.concat(F.lit("["), slack_stamp(F.col("ts")), F.lit("] "), who, F.lit(": "), F.coalesce("text", F.lit("")))
    return messages.select("channel_id", "ts", content.alias("content"), who.alias("author"), slack_permalink(F.lit(team), F.col("channel_id"), F.col("ts")).alias("source_url"))


def threads_expanded(messages: DataFrame, replies: DataFrame, most: int = 30) -> DataFrame:
    """(channel_id, pos, reply_pos, ts, text): messages with the replies of the most answered threads of each channel behind their parents.

    Messages keep their order; a reply that repeats its parent is left out.
    """
    busy = messages.where(F.coalesce("reply_count", F.lit(0)) > 0).withColumn("n", F.row_number().over(W.partitionBy("channel_id").orderBy(F.desc("reply_count"), "pos"))).where(F.col("n") <= most)
    r = replies.where(F.col("ts") != F.col("thread_ts")).select("channel_id", F.col("thread_ts").alias("parent_ts"), F.col("ts").alias("r_ts"), F.col("text").alias("r_text"), "reply_pos")
    below = busy.select("channel_id", "pos", F.col("ts").alias("parent_ts")).join(r, ["channel_id", "parent_ts"]).select("channel_id", "pos", "reply_pos", F.col("r_ts").alias("ts"), F.col("r_text").alias("text"))
    return messages.select("channel_id", "pos", F.lit(0).alias("reply_pos"), "ts", "text").unionByName(below)


def transcript(messages: DataFrame, key: str = "thread_id") -> DataFrame:
    """(thread_id, transcript): a thread but for its last message, each line led by who speaks."""
    line = F.concat(F.when(F.col("is_bot"), "Assistant: ").otherwise("User: "), F.col("text"))
    g = messages.select(key, "pos", line.alias("line")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("m"))
    return g.select(key, F.array_join(F.transform(F.slice("m", 1, F.greatest(F.lit(0), F.size("m") - 1)), lambda x: x["line"]), "\n").alias("transcript"))


PER_FILE, PER_DIFF, CUT_MARK = 100_000, 500_000, "\n... (truncated)"


def diff_messages(files: DataFrame, key: str = "pull", order: str = "pos") -> DataFrame:
    """Files of a pull request with their patch, each cut at PER_FILE characters, up to the first that would pass PER_DIFF together."""
    patch = F.when(F.length("patch") > PER_FILE, F.concat(F.substring("patch", 1, PER_FILE), F.lit(CUT_MARK))).otherwise(F.col("patch"))
    label = F.when(F.col("status") == "added", "new file").when(F.col("status") == "removed", "deleted").when(F.col("status") == "renamed", F.concat(F.lit("renamed from "), F.col("previous_filename"))).otherwise("modified")
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    some = files.where(F.coalesce("patch", F.lit("")) != "").withColumn("patch", patch).withColumn("running", F.sum(F.length("patch")).over(w))
    head = F.concat(F.lit("File: "), F.col("filename"), F.lit(" ("), label, F.lit(", +"), F.col("additions").cast("string"), F.lit(" -"), F.col("deletions").cast("string"), F.lit(")\n\n"))
    return some.where(F.col("running") <= PER_DIFF).withColumn("content", F.concat(head, F.col("patch"))).drop("running")
