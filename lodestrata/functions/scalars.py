"""Formatting and parsing expressions: all built-in functions, usable in any select or filter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^[\s﻿]+|[\s﻿]+$", "")


def is_blank(text: Column) -> Column:
    return F.length(trimmed(text)) == 0


def stamp(ts: Column) -> Column:
    """2024-01-02 03:04:05 UTC, fractions dropped."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss 'UTC'")


def slack_stamp(ts: Column) -> Column:
    """The same from an epoch string like 1704164645.678900."""
    return stamp(F.timestamp_seconds(F.floor(ts.cast("decimal(20,6)")).cast("long")))


def iso_stamp(ts: Column) -> Column:
    return stamp(F.to_timestamp(ts))


def without_mentions(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, "<@[A-Z0-9]+>", ""))


def issue_reference(external_id: Column) -> Column:
    """owner/repo#12 as (owner, repo, number); null if it is none."""
    pattern = r"^(.+?)/(.+?)#(\d+)$"
    return F.when(external_id.rlike(pattern), F.struct(*(F.regexp_extract(external_id, pattern, i).alias(n) for i, n in ((1, "owner"), (2, "repo"))), F.regexp_extract(external_id, pattern, 3).cast("long").alias("number")))


def like_escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([%_\\])", r"\\$1")


def contains_ignoring_case(text: Column, needle: str) -> Column:
    return F.lower(text).contains(needle.lower())


def abbreviated(n: Column) -> Column:
    """1234 as 1.2K, 2500000 as 2.5M, for whole numbers; halves of a tenth go up."""

    def tenths(unit: int, mark: str) -> Column:
        t = F.floor((n * 10 + unit // 2) / unit).cast("long")
        return F.format_string(f"%d.%d{mark}", F.floor(t / 10).cast("long"), t % 10)

    return F.when(n >= 1_000_000, tenths(1_000_000, "M")).when(n >= 1_000, tenths(1_000, "K")).otherwise(n.cast("string"))


def relative_time(then: Column, now: Column) -> Column:
    minutes = F.floor((now.cast("double") - then.cast("double")) / 60).cast("long")
    hours = F.floor(minutes / 60)
    part = lambda n, unit: F.concat(n.cast("long").cast("string"), F.lit(f"{unit} ago"))
    return F.when(minutes < 1, "Just now").when(minutes < 60, part(minutes, "m")).when(hours < 24, part(hours, "h")).otherwise(part(F.floor(hours / 24), "d"))


def rounded(x: Column) -> Column:
    """To the nearest whole number, halves up, also below zero."""
    return F.floor(x + 0.5).cast("long")


def schedule_label(every_ms: Column) -> Column:
    hours, minutes = rounded(every_ms / 3_600_000), rounded(every_ms / 60_000)
    text = lambda n, unit: F.concat(F.lit("Updates every "), n.cast("string"), F.lit(unit))
    return F.when(hours == 1, "Updates every hour").when(hours > 1, text(hours, " hours")).otherwise(text(minutes, " minutes"))


def location_label(sheet: Column, pages: Column, rows: Column, columns: Column) -> Column:
    """' Sheet1, p. 1, 2, row 7, a, b', parts left out where there is nothing."""
    listed = lambda prefix, xs: F.when(F.size(xs) > 0, F.concat(F.lit(prefix), F.array_join(xs.cast("array<string>"), ", ")))
    label = F.concat_ws(", ", F.when(sheet != "", sheet), listed("p. ", pages), listed("row ", rows), listed("", columns))
    return F.when(label == "", "").otherwise(F.concat(F.lit(" "), label))


def without_quotes(text: Column) -> Column:
    return F.regexp_replace(text, '^"|"$', "")


def result_line(name: Column, score: Column, content: Column) -> Column:
    return F.format_string("[%s] (score: %.3f)\n%s", name, score.cast("double"), content)


def enum_array(literal: Column) -> Column:
    """{A,B} as an array; {} as an empty one."""
    inside = F.regexp_replace(literal, r"^\{|\}$", "")
    return F.when(inside == "", F.array().cast("array<string>")).otherwise(F.split(inside, ","))


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def protocol_line(line: Column) -> Column:
    """CODE:JSON as (code, payload); null without a colon."""
    at = F.instr(line, ":")
    return F.when(at > 0, F.struct(F.substring_index(line, ":", 1).alias("code"), F.substr(line, at + 1).alias("payload")))


def slack_permalink(team: Column, channel: Column, ts: Column) -> Column:
    return F.when(
        (F.coalesce(team, F.lit("")) != "") & (F.coalesce(ts, F.lit("")) != ""),
        F.concat(F.lit("https://"), team, F.lit(".slack.com/archives/"), channel, F.lit("/p"), F.regexp_replace(ts, r"^([^.]*)\.", "$1")),
    ).otherwise(F.concat(F.lit("https://slack.com/app_redirect?channel="), channel))


def name_parts(name: Column) -> Column:
    """First and last name, split at the first space."""
    at = F.instr(name, " ")
    return F.struct(F.when(at > 0, F.substr(name, F.lit(1), at - 1)).otherwise(name).alias("first_name"), F.when(at > 0, F.substr(name, at + 1)).otherwise(F.lit("")).alias("last_name"))


def member_name(first: Column, last: Column) -> Column:
    """System where there is no user; an empty string for a user without names."""
    return F.coalesce(F.trim(F.concat(first, F.lit(" "), last)), F.lit("System"))


def message_text(content: Column) -> Column:
    """Text of a stored message: plain, a JSON array of parts, or an envelope with parts, then content."""
    parsed = F.when(content.rlike(r"^[\{\[]"), F.try_parse_json(content))
    part = "array<struct<type string, text string>>"
    joined = lambda parts: F.array_join(F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"]), "")
    of_array = joined(F.try_variant_get(parsed, "$", part))
    of_parts = joined(F.try_variant_get(parsed, "$.parts", part))
    of_content = F.try_variant_get(parsed, "$.content", "string")
    return F.when(parsed.isNull(), content).when(content.startswith("["), F.coalesce(of_array, F.lit(""))).otherwise(F.coalesce(F.nullif(of_parts, F.lit("")), of_content, F.lit("")))


def stream_blocks(content: Column) -> Column:
    """(text, thinking, sources): fenced thinking and sources blocks taken out of a streamed answer.

    A fence at the end that may still become such a block is hidden; what has come of an open thinking
    block is kept. sources holds the JSON of each block.
    """
    whole = lambda name: f"```{name}\n([\\s\\S]*?)```"
    thinking = F.regexp_extract_all(content, F.lit(whole("thinking")), F.lit(1))
    rest = F.regexp_replace(content, whole("thinking"), "")
    sources = F.regexp_extract_all(rest, F.lit(whole("sources")), F.lit(1))
    rest = F.regexp_replace(rest, whole("sources"), "")
    prefixes = lambda word: "|".join(word[:i] for i in range(len(word), 0, -1))
    # the first fence or backtick run at a line start decides, as it does while the text streams
    after = F.regexp_extract(rest, r"(?s)^(?:|.*?\n)(`{1,3})(.*)$", 2)
    before = F.regexp_extract(rest, r"(?s)^(|.*?(?=\n`))\n?`{1,3}.*$", 1)
    name = F.substring_index(after, "\n", 1)
    body = F.when(F.instr(after, "\n") > 0, trimmed(F.substr(after, F.instr(after, "\n") + 1))).otherwise("")
    full = F.length(F.regexp_extract(rest, r"(?s)^(?:|.*?\n)(`{1,3}).*$", 1)) == 3
    found = rest.rlike(r"(?s)^(?:|.*?\n)`{1,3}.*$")
    hidden = found & F.when(full, (after == "") | name.rlike(f"^({prefixes('thinking')}|{prefixes('sources')}|)$")).otherwise(after == "")
    open_thought = F.when(found & full & (name == "thinking") & (body != ""), F.array(body)).otherwise(F.array().cast("array<string>"))
    thoughts = F.filter(F.transform(thinking, trimmed), lambda x: x != "")
    return F.struct(trimmed(F.when(hidden, before).otherwise(rest)).alias("text"), F.concat(thoughts, open_thought).alias("thinking"), F.transform(sources, trimmed).alias("sources"))


def once(df, name: str, value: Column):
    """df with a column that is worked out once: a filter on it isn't pushed below a generator, which would repeat the work."""
    return df.select("*", F.explode(F.array(value)).alias(name))
