"""Line dedup by site-relative frequency: lines on a large share of a host's pages are boilerplate."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free

#: A line is dropped if more than RATIO of its host's pages have it, and more than one.
RATIO = 0.3
#: Names of entities (the standard library's table), the usual ones first, and what an entity looks like behind its mark.
USUAL = ("lt", "gt", "quot", "nbsp", "copy", "middot")
NAMES = {name: chr(name2codepoint[name]) for name in (*USUAL, *sorted(set(name2codepoint) - set(USUAL)))}
INNER = "#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31}"
ENTITY = f"^({INNER});"
#: Stands for the mark of an entity while entities are replaced one after another; no character.
MARK = "\uffff"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without port; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def unescaped(text: Column) -> Column:
    """text with named and numeric entities as characters, once over; what isn't one stays, nbsp is a blank.

    A number that is no character (0, a surrogate, beyond the last one) is the replacement character. A text's
    different entities are few, so each is looked up once and replaced everywhere; marks of entities are
    told from other ampersands first, so nothing that a replacement brings is taken for one. A text with usual ones
    alone needs no look-up: none of their characters can make an entity of what is around it, and amp comes last.
    """
    names = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))

    def character(name: Column) -> Column:
        digits = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 7), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 7)).try_cast("long")
        code = F.when((digits == 0) | digits.between(0xD800, 0xDFFF) | (digits > 0x10FFFF), 0xFFFD).when(digits == 160, 32).otherwise(digits)
        number = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(name.startswith("#"), number).when(name == "nbsp", " ").otherwise(F.coalesce(F.try_element_at(names, name), F.concat(F.lit("&"), name, F.lit(";"))))

    def by_name(t: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(t, F.lit(f"&({INNER});"), F.lit(1)))
        marked = F.regexp_replace(t, f"&(?=(?:{INNER});)", MARK)
        return F.aggregate(found, marked, lambda x, name: F.replace(x, F.concat(F.lit(MARK), name, F.lit(";")), character(name)))

    def usual(t: Column) -> Column:
        for name in USUAL:
            t = F.replace(t, F.lit(f"&{name};"), F.lit(" " if name == "nbsp" else NAMES[name]))
        return F.replace(t, F.lit("&#39;"), F.lit("'"))

    rest = lambda t: _bound(usual(t), lambda u: F.when(u.rlike(f"&(?!amp;)(?:{INNER});"), by_name(t)).otherwise(F.replace(u, F.lit("&amp;"), F.lit("&"))))
    return _bound(text, rest)


def _bound(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def html_lines(html: Column) -> Column:
    """Text of a page, a line for each block: scripts, styles, comments and tags are taken out, entities decoded."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"[\s\x0B]{2,}|[\t\n\r\f\x0B]", " ")
    x = F.regexp_replace(x, r"(?i)<(?:/?(?:p|div|li|ul|ol|nav|article|section|header|footer|h[1-6]|table|tr|title|head|body|html|blockquote|pre)|br)\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", "")
    x = unescaped(x)
    return F.trim(F.regexp_replace(F.regexp_replace(x, r" {2,}", " "), r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def boilerplate(pages: DataFrame, host: str, lines: str, ratio: float = RATIO) -> DataFrame:
    """(host, drop): for each host, hashes of the trimmed lines on more than ratio of its pages.

    A page counts once for a line however often it has it, so counting needs no distinct over pages:
    a page's own lines are made distinct in its row, and sums are added up before the shuffle.
    A host has fewer than (mean lines a page) / ratio such lines, so the list of a host is short.
    """
    each = pages.select(F.col(host).alias("host"), F.explode(F.array_distinct(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.xxhash64(F.trim(x))))).alias("line"))
    counts = each.groupBy("host", "line").agg(F.count("*").alias("with"))
    total = pages.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("pages"))
    often = counts.where(F.col("with") > 1).join(total, "host").where(F.col("with") > F.col("pages") * F.lit(ratio))
    return often.groupBy("host").agg(F.collect_list("line").alias("drop"))


def drop_boilerplate_lines(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO) -> DataFrame:
    """pages with (site, clean_text, n_lines, n_dropped) after its own columns.

    Lines are split at newlines and compared without spaces around them; blank ones are never counted
    or dropped. A null text stays null with no lines, and counts as a page of its host. Pages without a
    host (null) keep all lines. Repeated rows count as pages of their own, so what the two pages of a host of two
    have in common goes. A long text's lines are one array, some three times its size. An empty table gives an
    empty one. Names that pages has already get underscores added.
    """
    site, clean, n_lines, n_dropped, lines, drop = free(pages, "site", "clean_text", "n_lines", "n_dropped", "site_lines", "site_drop")
    at = pages.withColumns({site: host, lines: F.split(text, "\n")})
    often = cut(boilerplate(at.where(F.col(site).isNotNull()), site, lines, ratio).select(F.col("host").alias(site), F.col("drop").alias(drop)), "boilerplate")
    marks = often.agg(F.sum(F.size(drop))).first()[0] or 0
    side = F.broadcast(often) if marks <= 500_000 else often  # at most 4 MB of hashes; else Spark may split a hot host's rows
    joined = at.join(side, site, "left")
    stays = lambda x: F.col(drop).isNull() | (F.trim(x) == "") | ~F.array_contains(drop, F.xxhash64(F.trim(x)))
    kept = F.filter(lines, stays)
    return joined.withColumn(drop, F.when(F.size(drop) > 0, F.col(drop))).select(
        *(joined[c] for c in pages.columns),
        F.col(site),
        F.when(F.col(drop).isNull(), F.array_join(lines, "\n")).otherwise(F.array_join(kept, "\n")).alias(clean),
        F.coalesce(F.size(F.filter(lines, lambda x: F.trim(x) != "")), F.lit(0)).cast("long").alias(n_lines),
        F.coalesce(F.when(F.col(drop).isNotNull(), F.size(lines) - F.size(kept)), F.lit(0)).cast("long").alias(n_dropped),
    )


def dedup_page_lines(pages: DataFrame) -> DataFrame:
    """(page_id, host, n_lines, n_dropped, clean_chars, clean_md5) of raw web pages, one row for each row.

    A null page has no lines and null for its text's length and digest; a page without a host keeps all lines. Other
    columns of pages are left out. An empty table gives an empty one.
    """
    p = cut(pages.select("page_id", "url", html_lines(F.col("html")).alias("page_text")), "texts")  # read twice
    out = drop_boilerplate_lines(p, host_of(F.col("url")), F.col("page_text"))
    return out.select("page_id", F.col("site").alias("host"), "n_lines", "n_dropped", F.length("clean_text").cast("long").alias("clean_chars"), F.md5("clean_text").alias("clean_md5"))


_MAP = "map {" + ", ".join(f"'{n}': chr({32 if n == 'nbsp' else ord(c)})" for n, c in NAMES.items()) + "}"


def sql_text(html: str, source: str, keep: str) -> str:
    """Chain of DuckDB queries t0..t5, the last with keep's columns and the page's text as x."""
    return rf"""
t0 as (select {keep}, regexp_replace(regexp_replace(regexp_replace(regexp_replace({html}, '(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '[\s\x0B]{{2,}}|[\t\n\r\f\x0B]', ' ', 'g'),
 '(?i)<(?:/?(?:p|div|li|ul|ol|nav|article|section|header|footer|h[1-6]|table|tr|title|head|body|html|blockquote|pre)|br)\b[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g') x from {source}),
t1 as (select *, string_split(x, '&') ps from t0),
t2 as (select *, {_MAP} names, list_transform(ps[2:], lambda p: {{'p': p, 'n': regexp_extract(p, '{ENTITY}', 1)}}) es from t1),
t3 as (select *, list_transform(es, lambda e: {{'p': e.p, 'n': e.n, 'd': case when regexp_matches(e.n, '^#[xX]') then cast('0x' || substr(e.n, 3) as bigint) when e.n like '#%' then cast(substr(e.n, 2) as bigint) end}}) ds from t2),
t4 as (select *, list_transform(ds, lambda e: {{'p': e.p, 'n': e.n, 'm': case when e.d is not null then chr(cast(case when e.d = 0 or e.d between 55296 and 57343 or e.d > 1114111 then 65533 when e.d = 160 then 32 else e.d end as integer)) when e.n <> '' then names[e.n] end}}) ms from t3),
t5 as (select {keep}, trim(regexp_replace(regexp_replace(ps[1] || array_to_string(list_transform(ms, lambda e: case when e.m is null then '&' || e.p else e.m || substr(e.p, length(e.n) + 2) end), ''), ' {{2,}}', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) x from t4)"""


ORACLE = rf"""
with a as (select page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') host, html from pages),
{sql_text('html', 'a', 'page_id, host')},
c as (select page_id, host, string_split(x, chr(10)) l from t5),
n as (select host, count(*) pages from c where host is not null group by host),
e as (select host, line, count(*) k from (select host, unnest(list_distinct(list_transform(list_filter(l, lambda x: trim(x) <> ''), lambda x: trim(x)))) line from c where host is not null) group by all),
o as (select e.host, list(line) o from e join n on e.host = n.host where k > 1 and k > pages * cast({RATIO} as double) group by e.host),
k as (select page_id, c.host, l, list_filter(l, lambda x: o.o is null or trim(x) = '' or not list_contains(o.o, trim(x))) q from c left join o on c.host = o.host)
select page_id, host, cast(coalesce(len(list_filter(l, lambda x: trim(x) <> '')), 0) as bigint) n_lines, cast(coalesce(len(l) - len(q), 0) as bigint) n_dropped,
 cast(length(array_to_string(q, chr(10))) as bigint) clean_chars, md5(array_to_string(q, chr(10))) clean_md5 from k
"""
