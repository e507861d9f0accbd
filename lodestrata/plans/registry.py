"""Registered queries over the benchmark tables, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fulltext, ids, scalars, trigram, vectors
from ..operators import cards, catalogue, chunking, dml, filters, search, usage
from ..sources import formats, webhooks
from ..streaming import canvas, sync
from . import stand_ins as s

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _recent(spark, sf):
    return usage.since(s.usage_log(spark, sf), s.NOW, s.DAYS)


_SUMS = "cast(coalesce(sum(input_tokens), 0) as bigint) input_tokens, cast(coalesce(sum(output_tokens), 0) as bigint) output_tokens, cast(coalesce(sum(total_tokens), 0) as bigint) total_tokens"


@query(f"with {s.USAGE_SQL} select count(*) requests, {_SUMS} from recent")
def usage_summary(spark, sf):
    return usage.summary(_recent(spark, sf))


@query(f"with {s.USAGE_SQL} select strftime(created_at, '%Y-%m-%d') date, count(*) requests, {_SUMS} from recent group by 1")
def usage_daily(spark, sf):
    return usage.daily(_recent(spark, sf))


@query(f"with {s.USAGE_SQL} select model, provider, count(*) requests, {_SUMS}, cast(sum(cost) as decimal(22, 8)) cost from recent group by 1, 2")
def usage_by_model(spark, sf):
    return usage.by_model(_recent(spark, sf))


@query(f"with {s.USAGE_SQL} select request_type, count(*) requests, cast(sum(total_tokens) as bigint) total_tokens from recent group by 1")
def usage_by_request_type(spark, sf):
    return usage.by_request_type(_recent(spark, sf))


@query(f"with {s.USAGE_SQL} select source, count(*) requests, {_SUMS} from recent group by 1")
def usage_by_source(spark, sf):
    return usage.by_source(_recent(spark, sf))


@query(f"with {s.USAGE_SQL} select user_id, coalesce(trim(split_part(c_name, '#', 1) || ' ' || split_part(c_name, '#', 2)), 'System') as name, count(*) requests, {_SUMS} from recent left join customer on user_id = c_custkey group by 1, 2")
def usage_by_member(spark, sf):
    return usage.by_member(_recent(spark, sf), s.users(spark, sf))


@query(
    f"""with {s.USAGE_SQL}, x as (select strftime(created_at, '%Y-%m-%d') as d, * from recent)
    select case grouping(d, model, request_type, source) when 15 then 'summary' when 7 then 'daily' when 11 then 'by_model' when 13 then 'by_request_type' else 'by_source' end section,
    coalesce(d, model, request_type, source) as key, count(*) requests, {_SUMS} from x group by grouping sets ((), (d), (model), (request_type), (source))"""
)
def usage_report_in_one_scan(spark, sf):
    return usage.report_in_one_scan(_recent(spark, sf))


@query(f"with {s.USAGE_SQL} select id, model, provider, total_tokens, cast(cost as double) as cost from recent")
def call_costs(spark, sf):
    return _recent(spark, sf).select("id", "model", "provider", "total_tokens", F.col("cost").cast("double").alias("cost"))


@query(
    """select n_nationkey id, n_name as name, count(distinct c_custkey) source_count, count(distinct s_suppkey) chunk_count
    from nation left join customer on c_nationkey = n_nationkey left join supplier on s_nationkey = n_nationkey group by 1, 2"""
)
def collection_rollup(spark, sf):
    n = s.read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return catalogue.collection_rollup(n, s.read(spark, sf, "customer").select(F.col("c_nationkey").alias("collection_id")), s.read(spark, sf, "supplier").select(F.col("s_nationkey").alias("collection_id")))


@query("select o_orderkey id, o_custkey user_id, c_name || '@example.org' email, split_part(c_name, '#', 1) first_name, split_part(c_name, '#', 2) last_name from orders join customer on o_custkey = c_custkey")
def members_join(spark, sf):
    m = s.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"))
    return catalogue.members(m, s.users(spark, sf)).select("id", "user_id", "email", "first_name", "last_name")


@query("select o_orderkey id, o_orderstatus status, n_name org_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_custkey = 7")
def organisations_of_member(spark, sf):
    m = s.read(spark, sf, "orders").join(s.read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("status"), F.col("c_nationkey").alias("org_id"))
    o = s.read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return catalogue.organisations_of(m, o, 7).select("id", "status", "org_name")


@query("select o_orderkey id, n_name org_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderdate > timestamp '1997-01-01'")
def open_invitations(spark, sf):
    i = s.read(spark, sf, "orders").join(s.read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("expires_at"), F.col("c_nationkey").alias("org_id"))
    o = s.read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return catalogue.open_invitations(i, o, F.lit("1997-01-01").cast("timestamp_ntz")).select("id", "org_name")


def _roles(spark, sf):
    c = s.read(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("org_id"), F.when(F.col("c_custkey") % 10 == 0, F.array(F.lit("OWNER"), F.lit("ADMIN"))).otherwise(F.array(F.lit("MEMBER"))).alias("roles"))


@query("select c_nationkey org_id, count(*) filter (c_custkey % 10 = 0) owners from customer group by 1")
def owners_of_orgs(spark, sf):
    return catalogue.owners(_roles(spark, sf))


@query("select c_custkey id, c_nationkey org_id from customer where c_custkey % 10 = 0")
def members_with_role(spark, sf):
    return catalogue.with_role(_roles(spark, sf), "ADMIN").select("id", "org_id")


@query("select count(*) filter (o_orderstatus <> 'F') active, count(*) filter (o_orderstatus = 'F') revoked from orders")
def key_counts(spark, sf):
    o = s.read(spark, sf, "orders")
    return catalogue.key_counts(o.select(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("revoked_at")))


@query("select user_id key_id, max(ts) last_used_at from events group by 1")
def keys_last_used(spark, sf):
    return catalogue.last_used(s.read(spark, sf, "events").select(F.col("user_id").alias("key_id"), F.col("ts").alias("used_at")))


@query("select o_orderkey id, o_custkey, row_number() over (order by o_totalprice desc nulls last, o_orderkey) + 0 as place from orders qualify place between 41 and 60")
def paged_orders(spark, sf):
    o = s.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_totalprice").alias("requests"))
    third = catalogue.page(catalogue.sorted_rows(o, "requests", descending=True), 3, 20)
    return third.withColumn("place", F.row_number().over(W.orderBy(F.desc("requests"), "id")) + F.lit(40).cast("long")).select("id", "o_custkey", "place")


@query("select source data_source_id, max(doc_id) last_index from documents group by 1")
def last_index_of_sources(spark, sf):
    return dml.last_index(s.read(spark, sf, "documents").select(F.col("source").alias("data_source_id"), F.col("doc_id").alias("chunk_index")))


def _numbered(spark, sf):
    d = s.read(spark, sf, "documents").select(F.col("source").alias("data_source_id"), F.col("doc_id").alias("position"))
    return d.where(F.col("position") % 3 != 0), d.where(F.col("position") % 3 == 0)


@query(
    """with o as (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 i from documents where doc_id % 3 <> 0),
    m as (select source, max(i) + 1 n from o group by 1)
    select source data_source_id, doc_id as position, cast(i as integer) chunk_index from o union all
    select d.source, doc_id, cast(row_number() over (partition by d.source order by doc_id) - 1 + coalesce(n, 0) as integer) from documents d left join m on d.source = m.source where doc_id % 3 = 0"""
)
def append_with_offset(spark, sf):
    old, new = _numbered(spark, sf)
    return dml.appended(dml.numbered(old).select("data_source_id", "position", "chunk_index"), new)


@query("select source data_source_id, doc_id as position, source in (select source from documents where doc_id % 50 = 1) as is_new from documents where source not in (select source from documents where doc_id % 50 = 1) or doc_id % 50 = 1")
def replace_upsert(spark, sf):
    d = s.read(spark, sf, "documents").select(F.col("source").alias("data_source_id"), F.col("doc_id").alias("position"))
    new = d.where(F.col("position") % 50 == 1).withColumn("is_new", F.lit(True))
    return dml.replaced(d.withColumn("is_new", F.lit(False)), new)


@query(
    """with e as (select doc_id id, source connection_id, cast(doc_id as varchar) external_id, 'READY' status, lang title from documents where doc_id % 2 = 0),
    i as (select source connection_id, cast(doc_id as varchar) external_id, 'new ' || lang title, doc_id % 4 = 0 append_only from documents where doc_id % 3 = 0)
    select e.id, coalesce(i.connection_id, e.connection_id) connection_id, coalesce(i.external_id, e.external_id) external_id,
    case when i.external_id is null then e.status when e.external_id is not null and append_only then 'READY' else 'UPLOADED' end status, coalesce(i.title, e.title) title
    from e full join i on e.connection_id = i.connection_id and e.external_id = i.external_id"""
)
def upsert_merge(spark, sf):
    d = s.read(spark, sf, "documents").withColumns({"connection_id": F.col("source"), "external_id": F.col("doc_id").cast("string")})
    e = d.where(F.col("doc_id") % 2 == 0).select(F.col("doc_id").alias("id"), "connection_id", "external_id", F.lit("READY").alias("status"), F.col("lang").alias("title"))
    i = d.where(F.col("doc_id") % 3 == 0).select("connection_id", "external_id", F.concat(F.lit("new "), "lang").alias("title"), (F.col("doc_id") % 4 == 0).alias("append_only"), F.col("doc_id").alias("seq"))
    return dml.upserted(e, i)


@query("select doc_id chunk_id, source data_source_id from documents where source not in ('src1', 'src2')")
def tombstones(spark, sf):
    d = s.read(spark, sf, "documents")
    gone = spark.createDataFrame([("src1",), ("src2",)], "id string")
    return dml.deleted_source(gone, s.data_sources(spark, sf), d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("data_source_id")))[1]


@query("select doc_id chunk_id, case when lang <> 'fr' then lang end collection_id from documents")
def collection_deleted(spark, sf):
    d = s.read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("collection_id"))
    return dml.deleted_collection(spark.createDataFrame([("fr",)], "id string"), d, d)[1]


@query("select c_custkey id, case when c_custkey % 3 = 0 then null else c_name end as name, case when c_custkey % 2 = 0 then 'HOUSE' else c_mktsegment end segment from customer")
def partial_update(spark, sf):
    c = s.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    present = F.filter(F.array(F.when(F.col("id") % 3 == 0, "name"), F.when(F.col("id") % 2 == 0, "segment")), lambda x: x.isNotNull())
    p = c.select("id", present.alias("present"), F.lit(None).cast("string").alias("name"), F.lit("HOUSE").alias("segment"))
    return dml.patched(c, p)


@query("select conv_id id, coalesce(case when conv_id % 5 = 0 then 'kept' end, substring(min_by(text, turn), 1, 100)) title from conversations group by conv_id")
def titled_threads(spark, sf):
    m = s.messages(spark, sf)
    threads = m.select(F.col("thread_id").alias("id")).distinct().withColumn("title", F.when(F.col("id") % 5 == 0, "kept"))
    return dml.titled(threads, m.select("thread_id", F.col("text").alias("content"), F.col("pos").alias("created_at"), F.col("pos").alias("id")))


@query("select doc_id chunk_id from documents where doc_id % 4 in (0, 2) and lang in ('en', 'fr')")
def filter_types(spark, sf):
    return filters.filtered(s.chunks(spark, sf), 1, ["en", "fr"], [{"field": "type", "operator": "in", "value": ["PDF", "SLACK"]}]).select("chunk_id")


@query("select doc_id chunk_id from documents where doc_id % 4 = 2 and doc_id % 7 = 3 and doc_id % 5 = 1")
def filter_authors(spark, sf):
    return filters.filtered(s.chunks(spark, sf), 1, None, [{"field": "slackAuthors", "value": "user3"}, {"field": "slackChannelId", "value": "C1"}]).select("chunk_id")


_COSINE = "list_dot_product(cast(e.embedding as double[]), cast(q.embedding as double[])) / (sqrt(list_dot_product(cast(e.embedding as double[]), cast(e.embedding as double[]))) * sqrt(list_dot_product(cast(q.embedding as double[]), cast(q.embedding as double[]))))"


@query(f"select e.vec_id id, round({_COSINE}, 6) score from embeddings e, embeddings q where q.vec_id = 3 order by {_COSINE} desc, e.vec_id limit 20")
def vector_topk(spark, sf):
    e = s.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.top_by_cosine(e, s.query_vector(spark, sf), 20).select("id", F.round("score", 6).alias("score"))


@query(f"select e.vec_id id, round({_COSINE}, 6) score from embeddings e, embeddings q where q.vec_id = 3 and e.label in (1, 2) order by {_COSINE} desc, e.vec_id limit 20")
def vector_topk_filtered(spark, sf):
    e = s.read(spark, sf, "embeddings").where("label in (1, 2)").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.top_by_cosine(e, s.query_vector(spark, sf), 20).select("id", F.round("score", 6).alias("score"))


@query(f"select e.vec_id id, round({_COSINE}, 6) score from embeddings e, embeddings q where q.vec_id = 3")
def vector_scores(spark, sf):
    e = s.read(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.round(vectors.cosine_to(s.query_vector(spark, sf))("embedding"), 6).alias("score"))


@query(
    r"""with w as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) w from documents),
    g as (select doc_id, unnest(list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))) g from w)
    select distinct doc_id, g trigram from g"""
)
def trigram_sets(spark, sf):
    return s.read(spark, sf, "documents").select("doc_id", F.explode(trigram.trigrams(F.col("text"))).alias("trigram"))


@query()
def trigram_topk(spark, sf):
    d = s.read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return search.trigram_leg(d, "thanedble eriner", 30)


@query(
    """with t as (select doc_id, lower(text) x from documents) select doc_id from t
    where regexp_matches(x, '(^|[^\\p{L}\\p{N}])worthless($|[^\\p{L}\\p{N}])') and not regexp_matches(x, '(^|[^\\p{L}\\p{N}])scum($|[^\\p{L}\\p{N}])')"""
)
def fulltext_match(spark, sf):
    terms = fulltext.Terms(all=("worthless",), none=("scum",))
    d = s.read(spark, sf, "documents").where(fulltext.maybe(F.col("text"), terms))
    return d.where(fulltext.matches(fulltext.analyzed(F.col("text")), terms)).select("doc_id")


@query()
def fulltext_topk(spark, sf):
    d = s.read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return search.text_leg(d, fulltext.Terms(any=(("worthless", "trash"),), all=("thing",)), 30)


@query()
def fulltext_postings(spark, sf):
    return fulltext.postings(s.read(spark, sf, "documents"), "doc_id", "text")


_LEGS = """v as (select vec_id chunk_id, row_number() over (order by label desc, vec_id) r from embeddings qualify r <= 30),
t as (select vec_id chunk_id, row_number() over (order by vec_id % 17 desc, vec_id) r from embeddings qualify r <= 30),
g as (select vec_id chunk_id, row_number() over (order by vec_id % 13 desc, vec_id) r from embeddings qualify r <= 30)"""
_FUSED = f"""{_LEGS}, k as (select chunk_id from v union select chunk_id from t union select chunk_id from g),
f as (select k.chunk_id, 0.0::double + coalesce(0.5::double / (60 + v.r), 0) + coalesce(0.3::double / (60 + t.r), 0) + coalesce(0.2::double / (60 + g.r), 0) rrf,
case when v.r is not null then 0 when t.r is not null then 1 else 2 end first_leg, coalesce(v.r, t.r, g.r) first_rank
from k left join v on k.chunk_id = v.chunk_id left join t on k.chunk_id = t.chunk_id left join g on k.chunk_id = g.chunk_id)"""


def _legs(spark, sf):
    e = s.read(spark, sf, "embeddings").withColumn("chunk_id", F.col("vec_id"))
    return [search.ranked(e.withColumn("score", c), "score", 30, i) for i, c in enumerate((F.col("label"), F.col("vec_id") % 17, F.col("vec_id") % 13))]


@query(f"with {_FUSED} select chunk_id, round(rrf, 12) rrf, cast(first_leg as integer) first_leg, cast(first_rank as integer) first_rank from f")
def rrf_fusion(spark, sf):
    return search.fused(_legs(spark, sf)).withColumn("rrf", F.round("rrf", 12))


@query(
    f"""with {_FUSED}, x as (select *, case when chunk_id % 5 <> 0 then chunk_id % 9 / 6.0::double - 0.2::double end semantic,
    row_number() over (order by rrf desc, first_leg, first_rank, chunk_id) - 1 place, count(*) over () total from f)
    select chunk_id, round(0.5::double * least(1, greatest(0, coalesce(semantic, 0))) + 0.3::double * rrf + 0.2::double * (1 - place::double / total), 9) score from x"""
)
def rerank_blend(spark, sf):
    f = search.fused(_legs(spark, sf)).withColumn("semantic", F.when(F.col("chunk_id") % 5 != 0, F.col("chunk_id") % 9 / F.lit(6.0) - F.lit(0.2)))
    return search.reranked(f).select("chunk_id", F.round("score", 9).alias("score"))


@query(
    """with c as (select * from conversations where not (conv_id % 3 = 0 and turn = 2))
    select c.conv_id, c.turn, substring(b.text, 1, 500) context_before, substring(a.text, 1, 500) context_after from c
    left join c b on b.conv_id = c.conv_id and b.turn = c.turn - 1 left join c a on a.conv_id = c.conv_id and a.turn = c.turn + 1"""
)
def neighbour_context(spark, sf):
    c = s.messages(spark, sf).where(~((F.col("thread_id") % 3 == 0) & (F.col("pos") == 2)))
    x = c.select((F.col("thread_id") * 1000 + F.col("pos")).alias("chunk_id"), F.col("thread_id").alias("data_source_id"), F.col("pos").alias("chunk_index"), F.col("text").alias("content"))
    return search.with_context(x.drop("content"), x).select(F.col("data_source_id").alias("conv_id"), F.col("chunk_index").alias("turn"), "context_before", "context_after")


def _request(spark, sf):
    return search.Request(1, "worthless thing thanedble", s.query_vector(spark, sf), filters=({"field": "type", "operator": "in", "value": ["PDF", "SLACK", "LINEAR"]},), limit=10, rerank=True, expand_context=True)


#: A word that is the only one with its stem: lexeme, trigrams and word then find the same texts, which SQL can find too.
WORD = "nicht"
_HITS = f"n as (select doc_id chunk_id, len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda x: x = '{WORD}')) n from documents)"


@query(f"with {_HITS} select chunk_id, cast(1 as integer) leg, cast(row_number() over (order by n desc, chunk_id) as integer) as rank from n where n > 0 order by n desc, chunk_id limit 20")
def fulltext_topk_word(spark, sf):
    return search.text_leg(s.chunks(spark, sf), fulltext.Terms(all=(WORD,)), 20)


@query(f"with {_HITS} select chunk_id, cast(2 as integer) leg, cast(row_number() over (order by chunk_id) as integer) as rank from n where n > 0 order by chunk_id limit 20")
def trigram_topk_word(spark, sf):
    return search.trigram_leg(s.chunks(spark, sf), WORD, 20)


@query(
    f"""with {_HITS},
    v as (select d.doc_id chunk_id, 0 leg, row_number() over (order by {_COSINE} desc, d.doc_id) r from documents d join embeddings e on e.vec_id = d.doc_id, embeddings q where q.vec_id = 3 qualify r <= 20),
    t as (select chunk_id, 1 leg, row_number() over (order by n desc, chunk_id) r from n where n > 0 qualify r <= 20),
    g as (select chunk_id, 2 leg, row_number() over (order by chunk_id) r from n where n > 0 qualify r <= 20),
    f as (select chunk_id, sum(case leg when 0 then 0.5::double when 1 then 0.3::double else 0.2::double end / (60 + r)) score, min(leg) first_leg, min(leg * 1000 + r) first from (from v union all from t union all from g) group by 1),
    b as (select * from f order by round(score, 15) desc, first_leg, first, chunk_id limit 10),
    c as (select doc_id, source, cast(floor(doc_id / 20) as bigint) i, substring(text, 1, 500) x from documents)
    select b.chunk_id, round(b.score, 12) score, 'Source ' || d.source data_source_name,
    (select md5(arg_max(x, doc_id)) from c where c.source = d.source and c.i = cast(floor(b.chunk_id / 20) as bigint) - 1) context_before,
    (select md5(arg_max(x, doc_id)) from c where c.source = d.source and c.i = cast(floor(b.chunk_id / 20) as bigint) + 1) context_after
    from b join documents d on d.doc_id = b.chunk_id"""
)
def hybrid_search_word(spark, sf):
    """A whole search, three legs, fusion, limit, names and context, for a word that SQL can look for as well."""
    r = search.Request(1, WORD, s.query_vector(spark, sf), expand_context=True)
    out = search.search(s.chunks(spark, sf), s.data_sources(spark, sf), r)
    return out.select("chunk_id", F.round("score", 12).alias("score"), "data_source_name", F.md5("context_before").alias("context_before"), F.md5("context_after").alias("context_after"))


@query()
def hybrid_search(spark, sf):
    return search.search(s.chunks(spark, sf), s.data_sources(spark, sf), _request(spark, sf)).withColumn("metadata", F.to_json("metadata"))


@query()
def hybrid_search_stored(spark, sf):
    """The same search over chunks that were stored with their lexemes and trigrams."""
    return search.search(s.stored_chunks(spark, sf), s.data_sources(spark, sf), _request(spark, sf)).withColumn("metadata", F.to_json("metadata"))


@query()
def chunk_documents(spark, sf):
    return chunking.chunk_texts(s.read(spark, sf, "documents").select("doc_id", "text"))


@query()
def page_chunks(spark, sf):
    c = s.read(spark, sf, "conversations")
    return chunking.chunk_pages(c.select(F.col("conv_id").cast("string").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), F.concat("text", F.lit("\n")).alias("text")))


_TOKENS = r"""len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]|\s+'))"""


@query(
    f"""with recursive r as (select p_size as file, p_partkey || ',' || p_name || ',' || p_brand as line, row_number() over (partition by p_size order by p_partkey) i from part),
    n as (select *, {_TOKENS.format("line")} n from r),
    f as (select file, i, n held, 0 chunk from n where i = 1
    union all select n.file, n.i, case when held + n.n > 60 then n.n else held + n.n + (case when held > 0 then 1 else 0 end) end, chunk + (case when held + n.n > 60 then 1 else 0 end)
    from f join n on n.file = f.file and n.i = f.i + 1)
    select f.file, cast(chunk as integer) chunk_index, cast(min(f.i) as integer) as row, string_agg(line, chr(10) order by f.i) as content from f join r on r.file = f.file and r.i = f.i group by f.file, chunk"""
)
def chunk_rows_packed(spark, sf):
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))), lambda x: x["line"]), "\n")
    p = s.read(spark, sf, "part").withColumn("line", F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name", "p_brand"))
    return chunking.chunk_csv(p.groupBy(F.col("p_size").alias("file")).agg(lines.alias("text")), most=60).drop("columns")


@query()
def group_messages(spark, sf):
    m = s.messages(spark, sf)
    return chunking.group_messages(m.select(F.col("thread_id").alias("data_source_id"), F.col("pos").alias("position"), F.col("text").alias("content"), F.concat(F.lit("C"), (F.floor(F.col("pos") / 5)).cast("string")).alias("context"), F.array("role").alias("authors"), F.concat(F.lit("p"), F.col("pos").cast("string")).alias("source_url"), F.lit(True).alias("merges")))


@query("select conv_id external_id, string_agg(role || ': ' || text, chr(10) || chr(10) order by turn) as content from conversations group by 1")
def string_join_items(spark, sf):
    m = s.messages(spark, sf).withColumn("text", F.concat("role", F.lit(": "), "text"))
    first = m.groupBy(F.col("thread_id").alias("external_id")).agg(F.min("pos").alias("p0"), F.min_by("text", "pos").alias("head_text"))
    rest = m.join(first.select(F.col("external_id"), "p0"), F.col("thread_id") == F.col("external_id")).where("pos > p0").select("external_id", "pos", "text")
    return formats.items(first.drop("p0"), rest).select("external_id", "content")


@query(
    """with x as (select conv_id, turn pos, case when turn % 3 = 0 then 'SLACK' when turn % 3 = 1 then 'PDF' else 'TXT' end type, turn % 4 ds from conversations),
    k as (select conv_id, case when type = 'SLACK' then type else 'UPLOAD' end kind, ds, min(pos) pos from x group by all)
    select conv_id message_id, kind as type, count(*) as count, min(pos) first_pos,
    case when kind = 'UPLOAD' and count(*) = 1 then 'file' || min_by(ds, pos) || ' p. ' || min(pos) when kind = 'UPLOAD' then count(*) || ' documents'
    when count(*) = 1 then 'file' || min_by(ds, pos) else 'Slack (' || count(*) || ' channels)' end as label from k group by 1, 2"""
)
def source_chips(spark, sf):
    m = s.messages(spark, sf)
    kind = F.when(F.col("pos") % 3 == 0, "SLACK").when(F.col("pos") % 3 == 1, "PDF").otherwise("TXT")
    x = m.select(F.col("thread_id").alias("message_id"), "pos", kind.alias("type"), (F.col("pos") % 4).cast("string").alias("data_source_id"), F.concat(F.lit("file"), (F.col("pos") % 4).cast("string")).alias("data_source_name"), F.lit(None).cast("string").alias("sheet"), F.array(F.col("pos").cast("int")).alias("pages"), F.lit(None).cast("array<int>").alias("rows"), F.lit(None).cast("array<string>").alias("columns"))
    return cards.source_chips(x)


@query(
    """with p as (select event_id, lower(printf('%08x%012x%02x', user_id, epoch_us(ts) // 1000, 18) || substr(sha256(cast(event_id as varchar)), 1, 10)) h from events)
    select event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) as id, user_id org, 'Chunk' as entity, true as valid
    from p join events using (event_id)"""
)
def packed_ids(spark, sf):
    e = s.read(spark, sf, "events")
    x = e.select("event_id", ids.pack_id(F.col("user_id"), F.unix_millis(F.col("ts").cast("timestamp")), F.lit(ids.ENTITY_BYTES["Chunk"]), F.col("event_id")).alias("id"))
    return x.select("event_id", "id", ids.org_number(F.col("id")).alias("org"), ids.entity_name(F.col("id")).alias("entity"), ids.is_packed_id(F.col("id")).alias("valid"))


@query("select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S UTC') stamp, 'https://team.slack.com/archives/C1/p' || replace(printf('%.6f', epoch(ts)), '.', '') link from events")
def slack_stamps(spark, sf):
    ts = F.format_string("%d.%06d", F.unix_seconds(F.col("ts").cast("timestamp")), F.unix_micros(F.col("ts").cast("timestamp")) % 1_000_000)
    return s.read(spark, sf, "events").select("event_id", scalars.slack_stamp(ts).alias("stamp"), scalars.slack_permalink(F.lit("team"), F.lit("C1"), ts).alias("link"))


@query("select event_id, case when v >= 1000 then printf('%d.%dK', (v * 10 + 500) // 10000, (v * 10 + 500) // 1000 % 10) else cast(v as varchar) end as short from (select event_id, cast(trunc(value) as bigint) * 37 as v from events)")
def abbreviated_numbers(spark, sf):
    return s.read(spark, sf, "events").select("event_id", scalars.abbreviated(F.col("value").cast("long") * 37).alias("short"))


@query(r"select conv_id, turn, trim(regexp_replace('<@U12AB> ' || text || ' <@W9>', '<@[A-Z0-9]+>', '', 'g')) as clean, replace(replace(replace(role || '_100%', '\', '\\'), '%', '\%'), '_', '\_') as pattern from conversations")
def cleaned_mentions(spark, sf):
    c = s.read(spark, sf, "conversations")
    return c.select("conv_id", "turn", scalars.without_mentions(F.concat(F.lit("<@U12AB> "), "text", F.lit(" <@W9>"))).alias("clean"), scalars.like_escaped(F.concat("role", F.lit("_100%"))).alias("pattern"))


@query("select conv_id thread_id, turn pos from (select *, row_number() over (partition by conv_id order by turn desc) n from conversations) where n <= 3")
def newest_messages(spark, sf):
    m = s.messages(spark, sf).withColumns({"created_at": F.col("pos"), "id": F.col("pos")})
    return cards.last_messages(m, 3).select("thread_id", "pos")


@query("select conv_id thread_id, coalesce(string_agg(case when role = 'assistant' then 'Assistant: ' else 'User: ' end || text, chr(10) order by turn) filter (n > 1), '') transcript from (select *, row_number() over (partition by conv_id order by turn desc) n from conversations) group by 1")
def transcripts(spark, sf):
    return formats.transcript(s.messages(spark, sf).withColumn("is_bot", F.col("role") == "assistant"))


@query(
    """with w as (select user_id as key, '1 second' period, time_bucket(interval 1 second, ts) window_start, count(*) requests, 10 most from events group by all
    union all select user_id, '60 seconds', time_bucket(interval 60 second, ts), count(*), 100 from events group by all
    union all select user_id, '3600 seconds', time_bucket(interval 3600 second, ts), count(*), 1000 from events group by all)
    select key, period, strftime(window_start, '%Y-%m-%d %H:%M:%S') window_start, requests, greatest(0, requests - most) blocked from w"""
)
def throttle_windows(spark, sf):
    e = s.read(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return usage.throttle(e).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("select user_id connection_id, event_type external_id, min(event_id) seq from events group by 1, 2")
def jobs_once(spark, sf):
    e = s.read(spark, sf, "events").select(F.col("user_id").alias("connection_id"), F.col("event_type").alias("external_id"), F.col("event_id").alias("seq"))
    return sync.jobs_once(e)


@query(
    """with f as (select source pull, doc_id pos, case when length(text) > 100000 then substring(text, 1, 100000) || chr(10) || '... (truncated)' else text end p from documents where text <> ''),
    r as (select *, sum(length(p)) over (partition by pull order by pos) t from f)
    select pull, pos, md5('File: x (new file, +1 -0)' || chr(10) || chr(10) || p) content_md5 from r where t <= 500000"""
)
def diff_budget(spark, sf):
    d = s.read(spark, sf, "documents").select(F.col("source").alias("pull"), F.col("doc_id").alias("pos"), F.col("text").alias("patch"), F.lit("added").alias("status"), F.lit("x").alias("filename"), F.lit(None).cast("string").alias("previous_filename"), F.lit(1).alias("additions"), F.lit(0).alias("deletions"))
    return formats.diff_messages(d).select("pull", "pos", F.md5("content").alias("content_md5"))


@query(
    """with m as (select conv_id, turn, row_number() over (partition by conv_id order by turn desc, turn) n from conversations where turn > 0)
    select conv_id channel_id, turn pos, 0 reply_pos, cast(turn as varchar) ts from conversations
    union all select m.conv_id, m.turn, k.k, m.turn || '.' || k.k from m, (select unnest([1, 2]) k) k where n <= 2"""
)
def threads_expanded(spark, sf):
    m = s.messages(spark, sf).select(F.col("thread_id").alias("channel_id"), "pos", F.col("pos").cast("string").alias("ts"), "text", F.col("pos").alias("reply_count"))
    r = m.select("channel_id", F.col("ts").alias("thread_ts"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("reply_pos"), "text").withColumn("ts", F.when(F.col("reply_pos") == 0, F.col("thread_ts")).otherwise(F.concat("thread_ts", F.lit("."), F.col("reply_pos").cast("string"))))
    return formats.threads_expanded(m, r, most=2).drop("text")


@query("select o_custkey writer_id, o_orderkey seq, max(o_orderkey % 1000 - n) over (partition by o_custkey order by o_orderkey) + n millis from (select *, row_number() over (partition by o_custkey order by o_orderkey) n from orders)")
def increasing_times(spark, sf):
    return sync.strictly_increasing(s.read(spark, sf, "orders").select(F.col("o_custkey").alias("writer_id"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 1000).alias("millis")))


@query("select l_orderkey card_id, l_linenumber, case when max(l_quantity) over (partition by l_orderkey) > 0 then greatest(l_quantity / max(l_quantity) over (partition by l_orderkey) * 100, 2) else 2 end width from lineitem")
def funnel_widths(spark, sf):
    x = s.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("card_id"), "l_linenumber", F.col("l_quantity").alias("value"))
    return cards.funnel(x).drop("value")


@query("select l_orderkey, l_linenumber, case when l_discount > 0 then cast(floor(l_tax / l_discount * 100 + 0.5) as bigint) else 0 end percent from lineitem")
def progress_percent(spark, sf):
    return s.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", cards.progress(F.col("l_tax"), F.col("l_discount")).alias("percent"))


@query("select 'GITHUB' provider, case when event_type = 'click' then 'created' when event_type = 'view' then 'deleted' else 'updated' end as action, 'org/repo#' || event_id external_id from events")
def webhook_events(spark, sf):
    action = F.when(F.col("event_type") == "click", "created").when(F.col("event_type") == "view", "deleted").otherwise("edited")
    body = F.to_json(F.struct(action.alias("action"), F.struct(F.lit("org/repo").alias("full_name")).alias("repository"), F.struct(F.col("event_id").alias("number")).alias("issue")))
    return webhooks.normalised(s.read(spark, sf, "events").select(F.lit("GITHUB").alias("provider"), body.alias("body"))).select("provider", "action", "external_id")


@query("select event_id, 'org/repo#' || event_id || ' (Issue): ' || event_type || chr(10) || 'State: open | Author: u' || user_id || chr(10) || 'Labels: ' || event_type || ', x' header from events")
def github_headers(spark, sf):
    e = s.read(spark, sf, "events")
    given = {"repo": F.lit("org/repo"), "number": F.col("event_id"), "kind": F.lit("Issue"), "title": F.col("event_type"), "state": F.lit("open"), "author": F.concat(F.lit("u"), F.col("user_id").cast("string")), "labels": F.array(F.col("event_type"), F.lit("x"))}
    none = F.lit(None).cast("string")
    x = lambda n: given.get(n, F.lit(None).cast("array<string>") if n == "assignees" else none)
    return e.select("event_id", formats.github_header(x).alias("header"))


@query("select user_id channel_id, max(strftime(ts, '%Y%m%d%H%M%S')) as cursor from events where event_type <> 'view' group by 1")
def sync_cursors(spark, sf):
    from ..sources.connectors import slack_cursors

    e = s.read(spark, sf, "events").select(F.col("user_id").alias("channel_id"), F.date_format("ts", "yyyyMMddHHmmss").alias("ts"), F.lit(None).cast("string").alias("thread_ts"), F.when(F.col("event_type") == "view", "B1").alias("bot_id"), F.lit("hi").alias("text"))
    return slack_cursors(e, "<@BOT>")


def _canvas_ops(spark, sf):
    e = s.read(spark, sf, "events")
    card = F.format_string('{"id":"c%d","position":{"x":%d,"y":0},"width":400,"height":300,"component":{"id":"k%d","type":"text","data":{"v":%d}},"sources":[]}', "event_id", F.col("event_id") % 1000, "event_id", "event_id")
    op = F.when(F.col("event_type") == "click", F.concat(F.lit('{"type":"add_card","cards":['), card, F.lit("]}"))).otherwise(F.format_string('{"type":"move_card","cardId":"c%d","width":%d}', F.col("event_id") - 1, F.col("event_id") % 97))
    return e.select(F.col("user_id").cast("string").alias("thread_id"), F.col("event_id").alias("seq"), op.alias("op"))


@query()
def canvas_fold(spark, sf):
    return canvas.fold(_canvas_ops(spark, sf))


@query(
    """with b as (select l_orderkey thread_id, l_quantity * 20 x1, l_linenumber * 100.0 y1, l_quantity * 20 + 400 x2, l_linenumber * 100.0 + 300 y2 from lineitem),
    xs as (select thread_id, x2 + 20 x from b union select thread_id, 0 from b), ys as (select thread_id, y2 + 20 y from b union select thread_id, 0 from b),
    f as (select xs.thread_id, x, y, row_number() over (partition by xs.thread_id order by x, y) place from xs join ys on xs.thread_id = ys.thread_id
    where not exists (select 1 from b where b.thread_id = xs.thread_id and x < x2 + 20 and x + 420 > x1 and y < y2 + 20 and y + 320 > y1))
    select thread_id, cast(place as integer) place, cast(x as double) x, cast(y as double) y from f where place <= 3"""
)
def free_slots(spark, sf):
    x = s.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("thread_id"), (F.col("l_quantity") * 20).alias("x"), (F.col("l_linenumber") * 100.0).alias("y"), F.lit(400.0).alias("width"), F.lit(300.0).alias("height"))
    return cards.free_slots(x)


@query("select user_id, cast(sum(cost) as decimal(22, 8)) as cost from (with " + s.USAGE_SQL + " select user_id, cost from recent) group by 1")
def cost_by_member(spark, sf):
    return usage.cost_by_member(_recent(spark, sf))

