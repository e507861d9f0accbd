"""More registered queries: lookups, formats, parsers and small changes to tables."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids, scalars
from ..operators import cards, catalogue, dml, filters, search, usage
from ..operators.chunking import Size, csv_rows, group_messages
from ..session import scoped, write_scoped
from ..sources import connectors, files, formats, provider_source, webhooks
from ..store import folder
from ..streaming import jobs, sync, tables
from . import stand_ins as s
from .registry import ORACLES, WORD, query


@query("select event_id id from events where event_type = 'click' and event_id % 4 <> 0 and ts > timestamp '2024-01-20 00:00:00'")
def live_tokens(spark, sf):
    e = s.read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.when(F.col("event_id") % 4 == 0, F.col("ts")).alias("used_at"), F.col("ts").alias("expires_at"))
    return catalogue.live_tokens(e, "click", F.lit("2024-01-20").cast("timestamp_ntz")).select("id")


@query("select event_id id from events where event_id % 9 <> 0 and (event_id % 5 = 0 or user_id % 40 in (select user_id % 40 from events where user_id % 6 = 1))")
def visible_shares(spark, sf):
    e = s.read(spark, sf, "events")
    packed = ids.pack_id(F.col("user_id") % 40, F.lit(1704067200123), F.lit(ids.ENTITY_BYTES["SharedChat"]), F.col("event_id"))
    shares = e.select(F.col("event_id"), packed.alias("id"), (F.col("event_id") % 5 == 0).alias("is_public"), (F.col("event_id") % 9 == 0).alias("revoked"))
    members = e.select(packed.alias("id"), (F.col("user_id") % 6).alias("user_id"))
    return catalogue.visible_shares(shares, members, 1).select(F.col("event_id").alias("id"))


@query("select p_partkey id, p_partkey in (select l_partkey from lineitem where l_quantity >= 50) selected from part")
def marked_selected(spark, sf):
    return catalogue.marked_selected(s.read(spark, sf, "part").select(F.col("p_partkey").alias("id")), s.read(spark, sf, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("id")))


@query("select o_orderkey id from orders where o_orderstatus <> 'F'")
def usable_connections(spark, sf):
    o = s.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "DISCONNECTED").otherwise("ACTIVE").alias("status"))
    return catalogue.usable_connections(o).select("id")


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where (l_orderkey, l_linenumber) in (select o_orderkey, cast(o_orderkey % 3 + 1 as integer) from orders where o_totalprice > 300000)")
def keyed_rows(spark, sf):
    keys = s.read(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("l_linenumber"))
    return filters.keyed_rows(s.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), keys, ["l_orderkey", "l_linenumber"])


@query("select event_id id, ts created_at from events where user_id = 11 order by ts, event_id limit 50")
def history_page(spark, sf):
    e = s.read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("thread_id"), F.col("ts").alias("created_at"))
    return catalogue.history_page(e, 11, 50).select("id", "created_at")


_STATUS = "case when doc_id % 5 = 0 then 'UPLOADED' when doc_id % 6 = 0 then 'FAILED' when doc_id % 2 = 0 then 'READY' else 'PROCESSING' end"


def _outcomes(spark, sf):
    d = s.read(spark, sf, "documents").where("doc_id % 2 = 0")
    return d.select(F.col("doc_id").alias("data_source_id"), F.when(F.col("doc_id") % 6 == 0, "broken").alias("error"), F.when(F.col("doc_id") % 6 != 0, F.col("n_chars")).alias("page_count"))


@query(f"select doc_id id, {_STATUS} status, case when doc_id % 2 = 0 and doc_id % 6 <> 0 and doc_id % 5 <> 0 then n_chars end page_count, case when doc_id % 6 = 0 and doc_id % 5 <> 0 then 'broken' end as error from documents")
def processing_outcomes(spark, sf):
    status = F.when(F.col("doc_id") % 5 == 0, "UPLOADED").otherwise("PROCESSING")  # outcomes come too late for a fifth
    d = s.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), status.alias("status"), F.lit(None).cast("long").alias("page_count"))
    return dml.processed(d, _outcomes(spark, sf))


@query("select count(*) filter (doc_id % 6 <> 0) synced, count(*) filter (doc_id % 6 = 0) failed from documents where doc_id % 2 = 0")
def sync_counters(spark, sf):
    return dml.sync_counters(_outcomes(spark, sf))


@query("select event_id id, case when user_id % 3 <> 0 then user_id end user_id from events")
def orphans_unset(spark, sf):
    e = s.read(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id")
    users = s.read(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"))
    return dml.orphans_unset(e, users, "user_id")


@query("select p_partkey id, case when instr(p_name, ' ') > 0 then substr(p_name, 1, instr(p_name, ' ') - 1) else p_name end first_name, case when instr(p_name, ' ') > 0 then substr(p_name, instr(p_name, ' ') + 1) else '' end last_name from part")
def split_names(spark, sf):
    return s.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), scalars.name_parts(F.col("p_name")).alias("n")).select("id", "n.*")


@query("select doc_id, cast(strlen(text) as integer) bytes, trim(text) = '' as blank from documents")
def text_sizes(spark, sf):
    return s.read(spark, sf, "documents").select("doc_id", scalars.byte_length(F.col("text")).alias("bytes"), scalars.is_blank(F.col("text")).alias("blank"))


@query("select event_id, ' Sheet' || user_id || ', p. ' || event_id || ', ' || event_id + 1 || ', ' || event_type as label, printf('[%s] (score: %.3f)', event_type, value) || chr(10) || 'x' as line from events")
def labels_and_lines(spark, sf):
    e = s.read(spark, sf, "events")
    label = scalars.location_label(F.concat(F.lit("Sheet"), F.col("user_id").cast("string")), F.array(F.col("event_id"), F.col("event_id") + 1), F.array().cast("array<int>"), F.array("event_type"))
    return e.select("event_id", label.alias("label"), scalars.result_line(F.col("event_type"), F.col("value"), F.lit("x")).alias("line"))


@query(
    """select event_id, case when m < 1 then 'Just now' when m < 60 then m || 'm ago' when m // 60 < 24 then m // 60 || 'h ago' else m // 1440 || 'd ago' end ago
    from (select event_id, cast(floor(epoch(timestamp '2024-01-31 00:00:00' - ts) / 60) as bigint) m from events)"""
)
def relative_times(spark, sf):
    return s.read(spark, sf, "events").select("event_id", scalars.relative_time(F.col("ts").cast("timestamp"), F.lit("2024-01-31").cast("timestamp")).alias("ago"))


@query("select n_nationkey id, case when n_nationkey = 0 then 'Updates every 0 minutes' when n_nationkey = 1 then 'Updates every hour' else 'Updates every ' || n_nationkey || ' hours' end as label, n_name || '|X' as roles from nation")
def schedules_and_roles(spark, sf):
    n = s.read(spark, sf, "nation")
    return n.select(F.col("n_nationkey").alias("id"), scalars.schedule_label(F.col("n_nationkey") * 3_600_000).alias("label"), F.array_join(scalars.enum_array(F.concat(F.lit("{"), "n_name", F.lit(",X}"))), "|").alias("roles"))


@query("select event_id, '8' code, props payload, 'acme' as owner, 'web' as repo, event_id as number from events")
def protocol_lines(spark, sf):
    e = s.read(spark, sf, "events").select("event_id", scalars.protocol_line(F.concat(F.lit("8:"), "props")).alias("l"), scalars.issue_reference(F.concat(F.lit("acme/web#"), F.col("event_id").cast("string"))).alias("r"))
    return e.select("event_id", "l.code", "l.payload", "r.owner", "r.repo", "r.number")


@query("select conv_id, turn, case when turn % 3 = 1 then text || ' ' || role else text end as text from conversations")
def message_texts(spark, sf):
    c = s.read(spark, sf, "conversations")
    part = lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"))
    parts = F.to_json(F.array(part(F.col("text")), part(F.concat(F.lit(" "), "role"))))
    envelope = F.to_json(F.struct(F.array(part(F.col("text"))).alias("parts"), F.lit("other").alias("content")))
    stored = F.when(F.col("turn") % 3 == 1, parts).when(F.col("turn") % 3 == 2, envelope).otherwise(F.concat(F.lit(""), "text"))
    return c.select("conv_id", "turn", scalars.message_text(stored).alias("text"))


@query("select conv_id, turn, trim(role) as shown, trim(text) as thoughts from conversations where trim(text) <> ''")
def stream_blocks(spark, sf):
    c = s.read(spark, sf, "conversations").where(~scalars.is_blank(F.col("text")))
    made = F.concat(F.lit("```thinking\n"), "text", F.lit("```"), "role", F.lit("\n```sour"))
    return c.select("conv_id", "turn", scalars.stream_blocks(made).alias("b")).select("conv_id", "turn", F.col("b.text").alias("shown"), F.array_join("b.thinking", "|").alias("thoughts"))


@query(
    """select doc_id, case when doc_id % 4 = 3 then 'type' when doc_id % 4 = 2 and n_chars * 10000 > 20 * 1048576 or doc_id % 4 < 2 and n_chars * 10000 > 50 * 1048576 then 'size' end refused,
    case doc_id % 4 when 0 then 'CSV' when 1 then 'TXT' when 2 then 'IMAGE' end kind from documents"""
)
def checked_uploads(spark, sf):
    mime = F.get(F.array(F.lit("text/csv"), F.lit("text/plain"), F.lit("image/png"), F.lit("text/html")), (F.col("doc_id") % 4).cast("int"))
    u = s.read(spark, sf, "documents").select("doc_id", mime.alias("mime"), (F.col("n_chars") * 10_000).alias("file_size"))
    return files.checked_uploads(u).select("doc_id", "refused", "kind")


@query("select doc_id, cast(i as integer) as row, l as line from (select doc_id, unnest(string_split(text, chr(10))) l, unnest(range(1, len(string_split(text, chr(10))) + 1)) i from documents) where trim(l) <> ''")
def document_lines(spark, sf):
    d = s.read(spark, sf, "documents").select("doc_id", csv_rows(F.col("text")).alias("csv"))
    return d.select("doc_id", F.explode("csv.rows").alias("r")).select("doc_id", "r.row", F.col("r.text").alias("line"))


@query(
    """select e.event_id, c.c_custkey connection_id from events e join customer c on c.c_custkey = e.user_id where e.event_id % 2 = 0 and c.c_custkey % 4 <> 0
    union all select e.event_id, -1 - r_regionkey from events e, region where e.event_id % 2 = 1 and r_regionkey <> 2"""
)
def webhook_fan_out(spark, sf):
    """Of each GitHub installation its customer, of Slack (odd events) a connection for each region."""
    github, none = F.col("event_id") % 2 == 0, F.lit(None).cast("long")
    e = s.read(spark, sf, "events").select("event_id", F.when(github, "GITHUB").otherwise("SLACK").alias("provider"), F.when(github, F.col("user_id")).alias("installation_id"))
    c = s.read(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.lit("GITHUB").alias("provider"), F.when(F.col("c_custkey") % 4 == 0, "ERROR").otherwise("ACTIVE").alias("status"), F.col("c_custkey").alias("installation_id"))
    r = s.read(spark, sf, "region").select((-1 - F.col("r_regionkey")).cast("long").alias("id"), F.lit("SLACK").alias("provider"), F.when(F.col("r_regionkey") == 2, "ERROR").otherwise("ACTIVE").alias("status"), none.alias("installation_id"))
    return webhooks.fanned_out(e, c.unionByName(r)).select("event_id", "connection_id")


@query("select e.event_id, c.c_custkey connection_id from events e join customer c on c.c_custkey = e.user_id where c.c_custkey % 4 <> 0")
def webhook_fan_out_whole(spark, sf):
    e = s.read(spark, sf, "events").select("event_id", F.lit("GITHUB").alias("provider"), F.col("user_id").alias("installation_id"))
    c = s.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("GITHUB").alias("provider"), F.when(F.col("c_custkey") % 4 == 0, "ERROR").otherwise("ACTIVE").alias("status"), F.col("c_custkey").alias("installation_id"))
    return webhooks.fanned_out(e, c).select("event_id", "connection_id")


@query("select c_custkey id from customer where c_custkey % 4 in (0, 1) and (c_custkey % 7 = 0 or c_custkey % 7 > 3)")
def syncs_due(spark, sf):
    provider = F.get(F.array(F.lit("SLACK"), F.lit("NOTION"), F.lit("LINEAR"), F.lit("GITHUB")), (F.col("c_custkey") % 4).cast("int"))
    now = F.lit("2024-01-31").cast("timestamp")
    c = s.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), provider.alias("provider"), F.lit("ACTIVE").alias("status"), F.when(F.col("c_custkey") % 7 != 0, now - F.make_interval(mins=F.col("c_custkey").cast("int") % 7 * 17)).alias("last_synced_at"))
    return connectors.due(c, now).select("id")


@query(
    """with l as (select user_id, event_type, max(event_id) seq from events group by 1, 2)
    select cast(user_id as varchar) connection_id, event_type external_id, 'UPLOADED' status, 't' || seq as title from l where seq % 5 <> 0"""
)
def sync_merge(spark, sf):
    e = s.read(spark, sf, "events")
    b = e.select(F.col("user_id").cast("string").alias("connection_id"), F.col("event_type").alias("external_id"), F.when(F.col("event_id") % 5 == 0, "deleted").otherwise("updated").alias("action"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("title"), F.lit(True).alias("append_only"), F.col("event_id").alias("seq"))
    none = spark.createDataFrame([], "connection_id string, external_id string, status string, title string")
    return sync.merged_batch(none, b)


@query("select o_orderkey thread_id, cast(o_custkey as varchar) source, cast(o_custkey + 1 as varchar) target from orders where o_orderkey % 3 <> 0 and o_orderkey % 5 <> 0")
def valid_edges(spark, sf):
    o = s.read(spark, sf, "orders").select(F.col("o_orderkey").alias("thread_id"), F.col("o_custkey").cast("string").alias("source"), (F.col("o_custkey") + 1).cast("string").alias("target"))
    first, second = F.when(F.col("thread_id") % 3 != 0, F.col("source")), F.when(F.col("thread_id") % 5 != 0, F.col("target"))
    return cards.valid_edges(o, o.select("thread_id", F.explode(F.array(first, second)).alias("id")).where("id is not null"))


@query("select event_id, 'Issue E-' || event_id || ': ' || event_type || chr(10) || 'Status: Open | Team: T' || chr(10) || 'Labels: a, b' header, 'Comment on E-' || event_id || ' (' || event_type || ') | Open' as context from events")
def linear_headers(spark, sf):
    e = s.read(spark, sf, "events")
    given = {"identifier": F.concat(F.lit("E-"), F.col("event_id").cast("string")), "title": F.col("event_type"), "state": F.lit("Open"), "team": F.lit("T"), "labels": F.array(F.lit("a"), F.lit("b")), "children": F.lit(None).cast("array<struct<identifier string, title string, state string>>")}
    x = lambda n: given.get(n, F.lit(None).cast("string"))
    return e.select("event_id", formats.linear_header(x).alias("header"), formats.linear_comment_line(x).alias("context"))


@query("select conv_id, turn, case turn % 4 when 0 then '# ' || role when 1 then '- ' || role when 2 then '[x] ' || role else '---' end as block from conversations")
def block_texts(spark, sf):
    kind = F.get(F.array(F.lit("heading_1"), F.lit("numbered_list_item"), F.lit("to_do"), F.lit("divider")), (F.col("turn") % 4).cast("int"))
    none = F.lit(None).cast("string")
    return s.read(spark, sf, "conversations").select("conv_id", "turn", formats.block_text(kind, F.col("role"), F.lit(True), none, F.lit(None).cast("array<string>"), none).alias("block"))


@query("select o_custkey id, cast(count(*) filter (o_orderstatus = 'F') as integer) completed, max(o_totalprice) best from orders group by 1")
def checklist_and_best(spark, sf):
    o = s.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(F.struct(F.col("o_orderpriority").alias("text"), (F.col("o_orderstatus") == "F").alias("checked"))).alias("items"), F.collect_list(F.col("o_totalprice").cast("string")).alias("values"))
    return o.select("id", cards.completed(F.col("items")).alias("completed"), cards.best_value(F.concat("values", F.array(F.lit("n/a")))).alias("best"))


@query("select event_id, cast(epoch_us(ts) // 1000 as bigint) millis, user_id % 3 = 0 or user_id % 2 = 0 as one_org from events")
def id_times_and_orgs(spark, sf):
    e = s.read(spark, sf, "events")
    pack = lambda org: ids.pack_id(org, F.unix_millis(F.col("ts").cast("timestamp")), F.lit(ids.ENTITY_BYTES["Chunk"]), F.col("event_id"))
    three = F.array(pack(F.lit(7)), pack(F.when(F.col("user_id") % 3 == 0, 0).otherwise(7)), pack(F.when((F.col("user_id") % 3 == 0) | (F.col("user_id") % 2 == 0), 7).otherwise(8)))
    return e.select("event_id", F.unix_millis(ids.created_at(F.get(three, 0))).alias("millis"), ids.one_org(three).alias("one_org"))


@query("select event_id, event_type || ', x' || user_id as labels, case when event_id % 2 = 0 then 'T' || user_id else 'Untitled' end as title, event_type as bare from events")
def labels_and_titles(spark, sf):
    e = s.read(spark, sf, "events")
    labels = F.parse_json(F.format_string('[{"name":"%s"},"x%d",{"id":1}]', "event_type", "user_id"))
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("T"), F.col("user_id").cast("string"))).otherwise("")
    titles = F.array(F.lit(None).cast("string"), F.lit(""), text)
    return e.select("event_id", F.array_join(formats.label_names(labels), ", ").alias("labels"), formats.page_title(titles).alias("title"), scalars.without_quotes(F.concat(F.lit('"'), "event_type", F.lit('"'))).alias("bare"))


@query("select doc_id chunk_id from documents where lang <> 'de' and doc_id % 4 = 3 and doc_id % 6 = 3")
def filter_issue_of_tenant(spark, sf):
    """One issue's chunks, of one tenant of several."""
    d = s.read(spark, sf, "documents")
    meta = F.struct(F.when(F.col("doc_id") % 4 == 3, "LINEAR").otherwise("TXT").alias("type"), F.when(F.col("doc_id") % 4 == 3, F.concat(F.lit("I"), (F.col("doc_id") % 6).cast("string"))).alias("linearIssueId"))
    c = d.select(F.col("doc_id").alias("chunk_id"), F.when(F.col("lang") == "de", 2).when(F.col("lang").isNotNull(), 1).alias("org_id"), meta.alias("metadata"))
    return filters.filtered(c, 1, None, [{"field": "linearIssueId", "value": "I3"}]).select("chunk_id")


@query("select o_orderkey id, 'live' as kind from orders where o_orderstatus <> 'F' union all select o_orderkey, 'all' from orders")
def listed_keys(spark, sf):
    o = s.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("revoked_at"))
    return catalogue.live_keys(o).select("id", F.lit("live").alias("kind")).unionByName(catalogue.live_keys(o, True).select("id", F.lit("all").alias("kind")))


@query("select p_partkey id from part where contains(lower(p_name), 'ar')")
def names_containing(spark, sf):
    p = s.read(spark, sf, "part")
    return p.where(scalars.contains_ignoring_case(F.col("p_name"), "aR")).select(F.col("p_partkey").alias("id"))


@query(
    """select c_custkey id, case when c_custkey % 3 = 0 then c_name end team, case when c_custkey % 3 = 1 then c_nationkey end installation, cast(null as varchar) as bot from customer"""
)
def public_states(spark, sf):
    provider = F.get(F.array(F.lit("SLACK"), F.lit("GITHUB"), F.lit("OTHER")), (F.col("c_custkey") % 3).cast("int"))
    state = F.struct(F.col("c_name").alias("teamDomain"), F.col("c_nationkey").alias("installationId"), F.lit("B1").alias("botUserId"))
    out = catalogue.public_state(s.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), provider.alias("provider"), state.alias("provider_data")))
    kept = out.schema["provider_data"].dataType.fieldNames()
    return out.select("id", F.col("provider_data.teamDomain").alias("team"), F.col("provider_data.installationId").alias("installation"), (F.col("provider_data.botUserId") if "botUserId" in kept else F.lit(None)).cast("string").alias("bot"))


@query("select event_id, event_id % 3 <> 0 as genuine, event_id % 700 <= 300 as fresh from events")
def signed_events(spark, sf):
    """A third of the events carry the signature of another body; they came up to 699 seconds ago."""
    e = s.read(spark, sf, "events").select("event_id", F.coalesce("props", F.lit("")).alias("body"))
    mac = webhooks.hmac_sha256(F.lit("key"), F.when(F.col("event_id") % 3 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    now = F.lit("2024-01-31").cast("timestamp")
    sent = now - F.make_interval(secs=(F.col("event_id") % 700).cast("decimal(18,6)"))
    return e.select("event_id", webhooks.signed("key")(F.col("body"), F.concat(F.lit("sha256="), mac)).alias("genuine"), webhooks.fresh(sent, now).alias("fresh"))


@query("select conv_id seq, cast(turn as integer) pos, 'c' || conv_id || '-' || turn as chunk, text as content from conversations where turn % 3 <> 1 and conv_id % 2 = 0")
def sources_of_tools(spark, sf):
    """Results of searches that lack a field are left out, other tools' results too."""
    c = s.messages(spark, sf)
    name = F.when(F.col("pos") % 3 != 1, F.lit("n"))
    one = F.struct(F.concat(F.lit("c"), F.col("thread_id").cast("string"), F.lit("-"), F.col("pos").cast("string")).alias("chunkId"), F.col("text").alias("content"), F.lit(0.5).alias("score"), F.lit("d").alias("dataSourceId"), name.alias("dataSourceName"))
    g = c.select("thread_id", F.struct("pos", one.alias("r")).alias("x")).groupBy("thread_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias("results"), F.sort_array(F.collect_list("x.pos")).alias("places"))
    tools = g.select(F.col("thread_id").alias("seq"), F.when(F.col("thread_id") % 2 == 0, "rag-search").otherwise("other").alias("tool"), F.to_json(F.struct("results")).alias("result"))
    return search.tool_sources(tools).select("seq", "pos", F.col("chunkId").alias("chunk"), "content")


@query(
    """with x as (select o_orderkey id, o_totalprice requests from orders order by o_totalprice desc, o_orderkey limit 20 offset 20)
    select (select string_agg(id, ',' order by requests desc, id) from x) ids, (select count(*) from orders) total, 2 as page, 20 as "limit" """
)
def page_of_orders(spark, sf):
    o = s.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("requests"))
    p = catalogue.page_with_total(catalogue.sorted_rows(o, "requests", descending=True), 2, 20)
    return p.select(F.array_join(F.transform("items", lambda x: x["id"].cast("string")), ",").alias("ids"), "total", "page", "limit")


@query("select o_orderkey id, o_custkey org_id, o_totalprice price from orders where o_orderkey = 7 union all select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey = 8 and false")
def found_in_tenant(spark, sf):
    """Its own tenant finds an order; the next tenant doesn't find another one."""
    o = s.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("org_id"), F.col("o_totalprice").alias("price"))
    asked = o.where("id in (7, 8)").select("id", (F.col("org_id") + (F.col("id") - 7)).alias("org_id"))
    return filters.keyed_rows(o, asked, ["id", "org_id"])


@query(
    """select vec_id as "chunkId", 'text ' || vec_id content, cast(label as double) score, 'd' || label as "dataSourceId", null::varchar as "sourceUrl" from embeddings"""
)
def search_response(spark, sf):
    e = s.read(spark, sf, "embeddings")
    rows = e.select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("content"), F.col("label").cast("double").alias("score"), F.concat(F.lit("d"), F.col("label").cast("string")).alias("data_source_id"), F.lit(None).cast("string").alias("source_url"), F.lit(1).alias("chunk_index"))
    return search.response(rows)


@query("select doc_id chunk_id from documents where doc_id % 4 in (0, 2) and doc_id % 7 = 3 and doc_id % 4 = 2")
def tool_filters(spark, sf):
    """An agent's tool call for two types and an author, up to the filters of the search that it stands for."""
    r = search.tool_request(1, "q", [0.0], types=("PDF", "SLACK"), author="user3")
    return filters.filtered(s.chunks(spark, sf), r.org_id, list(r.collections), list(r.filters)).select("chunk_id")


@query(
    f"""with b as ({ORACLES["hybrid_search_word"]})
    select (select string_agg(chunk_id, ',' order by chunk_id) from b) ids, (select count(*) from b) total_results, null suggestion
    union all select '', 0, 'No results found. Consider searching with different terms or breaking the query into sub-queries.' from (select count(*) n from documents where lang = 'none') where n = 0"""
)
def tool_answers(spark, sf):
    """What a tool returns of a search that finds something, and of the same one in a collection without chunks."""
    out = None
    for collections in ((), ("none",)):
        request = search.Request(1, WORD, s.query_vector(spark, sf), collections)
        a = search.tool_answer(search.search(s.chunks(spark, sf), s.data_sources(spark, sf), request))
        row = a.select(F.array_join(F.array_sort(F.transform("results", lambda x: x["chunkId"])).cast("array<string>"), ",").alias("ids"), "total_results", "suggestion")
        out = row if out is None else out.unionByName(row)
    return out


@query("select doc_id, md5(case when doc_id % 3 = 0 or text is null or text = '' then 'query ' || doc_id else 'query ' || doc_id || chr(10) || chr(10) || substring(text, 1, 500) end) embedded_md5 from documents")
def expanded_queries(spark, sf):
    """What the vector leg embeds of queries to which a made-up passage was added, and of others."""
    d = s.read(spark, sf, "documents")
    query_text = F.concat(F.lit("query "), F.col("doc_id").cast("string"))
    return d.select("doc_id", F.md5(search.expanded_queries(query_text, F.when(F.col("doc_id") % 3 != 0, F.col("text")))).alias("embedded_md5"))


@query("select event_id, cast(case when event_id % 4 = 1 then 1 else 0 end + case when event_id % 5 = 2 then 1 else 0 end as integer) foreign_ids from events")
def requests_of_one_org(spark, sf):
    """How many ids of a request belong to another organisation; such requests are refused."""
    e = s.read(spark, sf, "events")
    packed = lambda org, seed: ids.pack_id(org, F.unix_millis(F.col("ts").cast("timestamp")), F.lit(ids.ENTITY_BYTES["Collection"]), seed)
    other = lambda n, k: F.col("user_id") + F.when(F.col("event_id") % n == k, 1).otherwise(0)
    asked = F.array(packed(F.col("user_id"), F.lit("a")), packed(other(4, 1), F.lit("b")), packed(other(5, 2), F.lit("c")))
    return e.select("event_id", F.size(catalogue.foreign_ids(asked, F.col("user_id"))).alias("foreign_ids"))


@query("select id, name, place from (select c_custkey id, c_name as name, cast(row_number() over (order by c_name desc, c_custkey) as integer) place from customer) where place <= 40")
def clicked_twice(spark, sf):
    """Two clicks on the head of a column of names: sorted from the last one, two pages."""
    by, descending = catalogue.toggled(*catalogue.toggled("created_at", True, "name"), "name")
    c = s.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    rows = catalogue.sorted_rows(c, by, descending)
    out = catalogue.page(rows, 1).unionByName(catalogue.page(rows, 2))
    return out.withColumn("place", F.row_number().over(W.orderBy(F.desc("name"), "id")))  # 40 rows


_WORDS = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]|\s+'))"


@query(
    rf"""with recursive m as (select p_size source, p_brand || ' ' || p_name as x, row_number() over (partition by p_size order by p_partkey) i, p_partkey k from part),
    n as (select *, {_WORDS.format("x")} n from m),
    f as (select source, i, n held, 0 chunk from n where i = 1
    union all select n.source, n.i, case when held + n.n + 1 > 60 then n.n + 1 else held + n.n + 1 end, chunk + (case when held + n.n + 1 > 60 then 1 else 0 end) from f join n on n.source = f.source and n.i = f.i + 1),
    g as (select f.source, chunk, max(held) held, case when chunk > 0 then chr(10) else '' end || string_agg(x, chr(10) order by f.i) as content, min(k) k from f join m on m.source = f.source and m.i = f.i group by 1, 2),
    e as (select *, max(chunk) over (partition by source) = chunk and chunk > 0 and held < 20 small from g),
    j as (select a.source, a.chunk, a.content || coalesce(chr(10) || b.content, '') as content, a.k, a.small from e a left join e b on b.source = a.source and b.chunk = a.chunk + 1 and b.small)
    select cast(source as varchar) data_source_id, cast(chunk as integer) chunk_index, md5(content) content_md5, 'p' || k source_url from j where not small"""
)
def grouped_messages(spark, sf):
    """Short messages of one context and no merged authors, up to 60 tokens a chunk; a last chunk below 20 joins the one before."""
    p = s.read(spark, sf, "part")
    m = p.select(F.col("p_size").alias("data_source_id"), F.col("p_partkey").alias("position"), F.concat_ws(" ", "p_brand", "p_name").alias("content"), F.lit("c").alias("context"), F.array(F.lit("a")).alias("authors"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("source_url"), F.lit(False).alias("merges"))
    return group_messages(m, Size(60, 0, 20)).select("data_source_id", "chunk_index", F.md5("content").alias("content_md5"), "source_url")


@query(
    """with d as (select doc_id, doc_id % 4 k, text from documents where text is not null), l as (select doc_id, unnest(string_split(text, chr(10))) t, unnest(range(1, len(string_split(text, chr(10))) + 1)) i from d where k = 0)
    select doc_id data_source_id, 'CSV' kind, cast(i as integer) part, md5(t) text_md5 from l where trim(t) <> '' union all select doc_id, 'TXT', 0, md5(text) from d where k = 1
    union all select doc_id, 'PDF', p, md5(p || ' ' || text) from d, (select unnest([1, 2]) p) where k = 2"""
)
def extracted_files(spark, sf):
    """A quarter each of tables, texts, documents with two pages, and files of no known kind."""
    mime = F.get(F.array(F.lit("text/csv"), F.lit("text/plain"), F.lit("application/pdf"), F.lit("text/html")), (F.col("doc_id") % 4).cast("int"))
    page = lambda n: F.struct(F.lit(n).alias("page"), F.concat(F.lit(f"{n} "), "text").alias("text"))
    f = s.read(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("data_source_id"), mime.alias("mime"), "text", F.array(page(1), page(2)).alias("pages"), F.lit(None).cast("string").alias("answer"))
    return files.extracted(f).select("data_source_id", "kind", "part", F.md5("text").alias("text_md5"))


@query("select cast(event_id as varchar) external_id, strftime(ts, '%Y%m%d%H%M%S') updated_at from events where strftime(ts, '%Y%m%d%H%M%S') > '20240110'")
def synced_items(spark, sf):
    """Events of a kind as a channel's pages of 50, taken behind a cursor by a stream of the provider's source."""
    e = s.read(spark, sf, "events")
    stamp = F.date_format("ts", "yyyyMMddHHmmss")
    payload = F.to_json(F.struct(F.lit("issue").alias("entity"), F.col("event_id").cast("string").alias("id"), stamp.alias("updated_at")))
    at = f"{folder(spark)}/{uuid.uuid4().hex}"
    provider_source.put_down(e.select(F.col("event_type").alias("channel"), stamp.alias("updated_at"), payload.alias("payload")), f"{at}/export")
    provider_source.sync_items(spark, f"{at}/export", "github", f"{at}/items", f"{at}/checkpoint", after="20240110").awaitTermination()
    return spark.read.parquet(f"{at}/items").select("external_id", "updated_at")


@query(
    """with t as (select conv_id, list({'content': text, 'id': 'd' || turn} order by turn) s from conversations where turn % 2 = 0 and conv_id % 3 <> 0 group by 1)
    select c.conv_id request_id, 'a' || c.conv_id answer, coalesce(array_to_string(list_transform(s, lambda x: x.id || ' ' || md5(x.content)), ','), '') sources, cast(c.conv_id * 2 + 7 as bigint) total
    from (select distinct conv_id from conversations) c left join t on c.conv_id = t.conv_id"""
)
def answers_with_sources(spark, sf):
    """Answers of requests, a third of which searched nothing, with the sources of their tools and the tokens spent."""
    c = s.messages(spark, sf).withColumnRenamed("thread_id", "request_id")
    one = F.struct(F.lit("c").alias("chunkId"), F.col("text").alias("content"), F.lit(0.5).alias("score"), F.concat(F.lit("d"), F.col("pos").cast("string")).alias("dataSourceId"), F.lit("n").alias("dataSourceName"))
    tools = c.where("pos % 2 = 0 and request_id % 3 <> 0").select("request_id", F.lit("rag-search").alias("tool"), F.to_json(F.struct(F.array(one).alias("results"))).alias("result"), F.col("pos").alias("seq"))
    a = c.select("request_id").distinct().select("request_id", F.concat(F.lit("a"), F.col("request_id").cast("string")).alias("text"), F.lit("m").alias("model"), (F.col("request_id") * 2).alias("input_tokens"), F.lit(7).alias("output_tokens"))
    out = search.answered(a, tools)
    return out.select("request_id", "answer", F.array_join(F.transform("sources", lambda x: F.concat(x["dataSource"]["id"], F.lit(" "), F.md5(x["content"]))), ",").alias("sources"), F.col("usage.totalTokens").alias("total"))


@query("select vec_id chunk_id, printf('[s%d] (score: %.3f)', label, label / 8.0) || chr(10) || 'text ' || vec_id as text from embeddings")
def result_texts(spark, sf):
    e = s.read(spark, sf, "embeddings")
    return search.result_texts(e.select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("s"), F.col("label").cast("string")).alias("data_source_name"), (F.col("label") / 8).alias("score"), F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("content")))


@query(
    """with n as (select n_nationkey id, n_name as name, n_regionkey r, (select count(*) from customer where c_nationkey = n_nationkey) s, (select count(*) from supplier where s_nationkey = n_nationkey) k from nation)
    select '[' || string_agg('{"id":' || id || ',"name":"' || name || '","description":' || case when r = 0 then 'null' else '"r' || r || '"' end || ',"sourceCount":' || s || ',"chunkCount":' || k || '}', ',' order by name) || ']' as text from n"""
)
def collection_list(spark, sf):
    n = s.read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") != 0, F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))).alias("description"))
    return search.collection_list(catalogue.collection_rollup(n, s.read(spark, sf, "customer").select(F.col("c_nationkey").alias("collection_id")), s.read(spark, sf, "supplier").select(F.col("s_nationkey").alias("collection_id"))))


@query("select c_custkey id, c_nationkey org_id from customer where c_nationkey = 3")
def tenant_rows(spark, sf):
    """One tenant's rows of a table stored by tenant: other tenants' files aren't read."""
    at = f"{folder(spark)}/{uuid.uuid4().hex}"
    write_scoped(s.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("org_id")), at)
    return scoped(spark.read.parquet(at), 3).select("id", F.col("org_id").cast("long").alias("org_id"))


@query(f"with {s.USAGE_SQL} select model, count(*) requests, cast(sum(cast(input_tokens as bigint) + output_tokens) as bigint) total_tokens from log group by 1")
def appended_log(spark, sf):
    """The log as two batches of calls were appended to it, with what is derived at that."""
    at = f"{folder(spark)}/{uuid.uuid4().hex}"
    calls = s.usage_calls(spark, sf)
    for half in (calls.where("id % 2 = 0"), calls.where("id % 2 = 1")):
        usage.append_log(half, at)
    return spark.read.parquet(at).groupBy("model").agg(F.count(F.lit(1)).alias("requests"), F.sum("total_tokens").cast("long").alias("total_tokens"))


@query("select n_nationkey id, 'name ' || n_name || chr(10) || 'in ' || n_regionkey as text from nation")
def read_texts(spark, sf):
    """Text files, each read as one text."""
    at = f"{folder(spark)}/{uuid.uuid4().hex}"
    s.read(spark, sf, "nation").select("n_nationkey", F.concat_ws("\n", F.concat(F.lit("name "), "n_name"), F.concat(F.lit("in "), F.col("n_regionkey").cast("string"))).alias("value")).write.partitionBy("n_nationkey").text(at)
    out = files.texts(spark, f"{at}/*/*.txt")
    return out.select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("long").alias("id"), F.rtrim(F.col("text"), F.lit("\n")).alias("text"))


@query(
    """select event_id, case when event_id % 3 = 0 then 'A ' || event_type else event_type || ' of u' || user_id || chr(10) || 'two' end || case when event_id % 3 = 1 then chr(10) || chr(10) || 'Visible text: v' || user_id else '' end
    || case when event_id % 3 > 0 then chr(10) || chr(10) || 'Tags: ' || event_type || ', x' else '' end as content from events"""
)
def image_texts(spark, sf):
    """Answers of a vision model: without labels, with visible text, and with none."""
    e = s.read(spark, sf, "events")
    labelled = F.format_string("DESCRIPTION: %s of u%d\ntwo\nTAGS: %s, , x\nTEXT: %s", "event_type", "user_id", "event_type", F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("v"), F.col("user_id").cast("string"))).otherwise("None"))
    answer = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" A "), "event_type")).otherwise(labelled)
    return e.select("event_id", files.image_text(answer)["content"].alias("content"))


@query("select event_id id, strftime(case when event_id % 3 = 0 then timestamp '2024-01-01 00:00:00' else ts end, '%Y-%m-%d %H:%M:%S') since from events")
def sync_starts(spark, sf):
    """Where syncs begin: after the last one, or 30 days back."""
    e = s.read(spark, sf, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 != 0, F.col("ts").cast("timestamp")).alias("last_synced_at"))
    return connectors.since_for(e, F.lit("2024-01-31").cast("timestamp")).select("id", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"))


@query(
    """with l as (select user_id, event_type, max(event_id) seq from events group by 1, 2)
    select cast(user_id as varchar) connection_id, event_type external_id, 'UPLOADED' status, 't' || seq as title from l where seq % 5 <> 0"""
)
def streamed_sync(spark, sf):
    """As sync_merge, but the items come as a stream of files, merged into a stored table batch by batch."""
    at = f"{folder(spark)}/{uuid.uuid4().hex}"
    e = s.read(spark, sf, "events")
    items = e.select(F.col("user_id").cast("string").alias("connection_id"), F.col("event_type").alias("external_id"), F.when(F.col("event_id") % 5 == 0, "deleted").otherwise("updated").alias("action"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("title"), F.lit(False).alias("append_only"), F.col("event_id").alias("seq"))
    items.repartitionByRange(3, "seq").write.parquet(f"{at}/items")
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/items")
    table = sync.VersionedTable(spark, f"{at}/table", "connection_id string, external_id string, status string, title string, seq long", leaf_bytes=64 << 10)

    def newest(old, batch):
        """Files of a stream come in no certain order, so an item only counts if nothing newer is stored, tombstones included."""
        kept = old.select("connection_id", "external_id", "title", "seq", F.when(F.col("status") == "GONE", "deleted").otherwise("updated").alias("action"))
        every = kept.unionByName(batch.select("connection_id", "external_id", "title", "seq", "action"))
        last = every.groupBy("connection_id", "external_id").agg(F.max_by(F.struct("title", "action", "seq"), "seq").alias("i"))
        return last.select("connection_id", "external_id", F.when(F.col("i.action") == "deleted", "GONE").otherwise("UPLOADED").alias("status"), "i.title", "i.seq")

    query = sync.sync_stream(stream, table, f"{at}/checkpoint", newest)
    query.awaitTermination()
    return table.read().where("status <> 'GONE'").drop("seq")


@query("select cast(event_id as varchar) job_id, case when event_id % 5 < 3 then 'DONE' else 'DEAD' end status, cast(least(event_id % 5 + 1, 3) as integer) attempts, event_id % 5 < 3 stored from events")
def job_attempts(spark, sf):
    """Events as jobs that fail as often as their id says, worked off as they arrive and whenever they are due."""
    at = f"{folder(spark)}/{uuid.uuid4().hex}"
    arrived = s.read(spark, sf, "events").select(F.col("event_id").cast("string").alias("job_id"), (F.col("event_id") % 5).cast("string").alias("payload"))
    held, target = jobs.job_table(spark, f"{at}/jobs"), tables.VersionedTable(spark, f"{at}/done", "job_id string", ["job_id"])
    handle = lambda todo: todo.select("job_id", F.when(F.col("attempts") < F.col("payload").cast("int"), "failed").alias("error"))
    start = datetime(2024, 1, 1)
    jobs.attempt(held, arrived, start, handle, target, jobs.replaced, "arrivals", 0)
    for seconds in (1, 3):
        jobs.work_due(held, start + timedelta(seconds=seconds), handle, target, jobs.replaced)
    stored = target.read().withColumn("stored", F.lit(True))
    return held.read().join(stored, "job_id", "left").select("job_id", "status", "attempts", F.coalesce("stored", F.lit(False)).alias("stored"))
