"""Queries over chunks that are stored with their indexes, and the SQL that gives the same rows."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from ..functions import fulltext
from ..functions.sql import register
from ..indexes.search_store import SearchStore
from ..operators import filters
from ..sources import colocated
from ..store import folder, path_of
from ..streaming import stateful
from . import lookups  # noqa: F401  whose SQL is used again
from . import registry as r
from . import stand_ins as s


def store(spark, sf) -> SearchStore:
    """Documents as chunks with all indexes, written once a session."""
    at = f"{folder(spark)}/search-{zlib.crc32(sf.encode()):08x}"
    fs, done = path_of(spark, f"{at}/vectors/cells/_SUCCESS")
    held = SearchStore(spark, at, parts=16, buckets=16)
    if not fs.exists(done):
        held.append(s.texts(spark, sf), s.chunks(spark, sf))
    return held


@r.query(r.ORACLES["fulltext_match"])
def fulltext_match_lists(spark, sf):
    return store(spark, sf).word_matches(1, fulltext.Terms(all=("worthless",), none=("scum",))).select(F.col("chunk_id").alias("doc_id"))


@r.query(r.ORACLES["fulltext_topk_word"])
def fulltext_topk_lists(spark, sf):
    return store(spark, sf).word_leg(1, fulltext.Terms(all=(r.WORD,)), 20)


#: Two words that stand beside each other in some texts; each is the only one with its stem.
PHRASE = ("de", "la")


@r.query(
    f"""with t as (select doc_id, lower(coalesce(text, '')) x from documents) select doc_id from t
    where regexp_matches(x, '(^|[^\\p{{L}}\\p{{N}}]){PHRASE[0]}[^\\p{{L}}\\p{{N}}]+{PHRASE[1]}($|[^\\p{{L}}\\p{{N}}])')"""
)
def fulltext_phrase_lists(spark, sf):
    """Two words one behind the other: lists joined by chunk, positions by their distance."""
    return store(spark, sf).word_matches(1, fulltext.Terms(phrases=(PHRASE,))).select(F.col("chunk_id").alias("doc_id"))


@r.query(r.ORACLES["trigram_topk_word"])
def trigram_topk_lists(spark, sf):
    return store(spark, sf).trigram_leg(1, r.WORD, 20)


@r.query(
    f"""with t as (select doc_id, lower(coalesce(text, '')) x from documents) select doc_id chunk_id, 1.0::double word_similarity from t
    where regexp_matches(x, '(^|[^\\p{{L}}\\p{{N}}])({PHRASE[0]}[^\\p{{L}}\\p{{N}}]+{PHRASE[1]}|{PHRASE[1]}[^\\p{{L}}\\p{{N}}]+{PHRASE[0]})($|[^\\p{{L}}\\p{{N}}])')"""
)
def trigram_two_words_lists(spark, sf):
    """Texts that have a stretch with all trigrams of two words and no others."""
    return store(spark, sf).trigram_matches(1, " ".join(PHRASE), threshold=1.0)


@r.query(r.ORACLES["vector_topk"].replace("from embeddings e, embeddings q where q.vec_id = 3", "from documents d join embeddings e on e.vec_id = d.doc_id, embeddings q where q.vec_id = 3"))
def vector_topk_cells(spark, sf):
    """Exact: the cells near the query, then those that may hold a nearer vector than the twentieth."""
    near = store(spark, sf).cells.nearest(1, s.query_vector(spark, sf), 20, exact=True)
    return near.select(F.col("chunk_id").alias("id"), F.round("score", 6).alias("score"))


@r.query(r.ORACLES["hybrid_search_word"])
def hybrid_search_lists(spark, sf):
    request = r.search.Request(1, r.WORD, s.query_vector(spark, sf), expand_context=True)
    out = store(spark, sf).search(s.data_sources(spark, sf), request, exact=True)
    return out.select("chunk_id", F.round("score", 12).alias("score"), "data_source_name", F.md5("context_before").alias("context_before"), F.md5("context_after").alias("context_after"))


@r.query()
def hybrid_search_indexed(spark, sf):
    """hybrid_search by way of the indexes, its vector leg exact; tests hold the two against each other."""
    return store(spark, sf).search(s.data_sources(spark, sf), r._request(spark, sf), exact=True).withColumn("metadata", F.to_json("metadata"))


def _once(spark, sf, name: str, write) -> str:
    """A table of the session's catalogue, written if it isn't there."""
    table = f"{name}_{zlib.crc32(f'{sf} {spark.sparkContext.applicationId}'.encode()):08x}"
    if not spark.catalog.tableExists(table):
        write(table)
    return table


@r.query(r.ORACLES["neighbour_context"])
def neighbour_context_placed(spark, sf):
    """Neighbours of all rows of a table that is stored by source and place."""
    c = s.messages(spark, sf).where(~((F.col("thread_id") % 3 == 0) & (F.col("pos") == 2)))
    x = c.select((F.col("thread_id") * 1000 + F.col("pos")).alias("chunk_id"), F.col("thread_id").alias("data_source_id"), F.col("pos").alias("chunk_index"), F.col("text").alias("content"))
    table = _once(spark, sf, "placed", lambda name: colocated.write_placed(x, name, 8, stretch=4))
    return colocated.neighbours(spark, table).select(F.col("data_source_id").alias("conv_id"), F.col("chunk_index").alias("turn"), "context_before", "context_after")


@r.query(r.ORACLES["keyed_rows"])
def keyed_rows_bucketed(spark, sf):
    """Rows and keys that are stored in the same buckets."""
    on = ["l_orderkey", "l_linenumber"]
    keys = s.read(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("l_linenumber"))
    rows = _once(spark, sf, "lines", lambda name: colocated.write_bucketed(s.read(spark, sf, "lineitem").select(*on, "l_quantity"), name, on, 8))
    wanted = _once(spark, sf, "line_keys", lambda name: colocated.write_bucketed(keys, name, on, 8))
    return filters.keyed_rows(spark.table(rows), spark.table(wanted), on)


@r.query("select event_id id, user_id org_id, cast(round(value * 100) as bigint) cents from events where event_id in (7, 4321) union all select 0, 0, 0 where false")
def found_by_id(spark, sf):
    """Rows by id within their tenant, of a table whose row groups have Bloom filters of ids; another tenant doesn't find them."""
    e = s.read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("org_id"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    at = f"{folder(spark)}/lookup-{zlib.crc32(sf.encode()):08x}"
    fs, done = path_of(spark, f"{at}/_SUCCESS")
    if not fs.exists(done):
        colocated.write_lookup(e, at)
    stored = spark.read.parquet(at).select("id", F.col("org_id").cast("long").alias("org_id"), "cents")
    asked = e.where("id in (7, 4321)").select("id", "org_id").unionByName(e.where("id in (8, 99)").select("id", (F.col("org_id") + 1).alias("org_id")))
    return filters.keyed_rows(stored.where(F.col("id").isin(7, 8, 99, 4321)), asked, ["id", "org_id"])


@r.query(
    """with recursive p as (select * from (values (3600), (86400)) p(period)), t as (select user_id, ts, count(*) n from events group by all),
    s as (select period, user_id, min(ts) st from t, p group by all union all select s.period, s.user_id, min(t.ts) from s join t on t.user_id = s.user_id and t.ts >= s.st + to_seconds(s.period) group by 1, 2, s.st)
    select cast(period as integer) period, cast(s.user_id as varchar) as key, strftime(st, '%Y-%m-%d %H:%M:%S') window_start, cast(sum(n) as bigint) requests, cast(greatest(0, sum(n) - 5) as bigint) blocked
    from s join t on t.user_id = s.user_id and t.ts >= st and t.ts < st + to_seconds(period) group by period, s.user_id, st"""
)
def first_hit_windows(spark, sf):
    """Five an hour, and five a day, counted from each user's first request."""
    e = s.read(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    out = None
    for period in (3600, 86400):
        x = stateful.first_hit_windows(e, period).select(F.lit(period).alias("period"), "key", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests", "blocked")
        out = x if out is None else out.unionByName(x)
    return out


@r.query(
    """with l as (select doc_id, unnest(string_split(text, chr(10))) x, unnest(range(1, len(string_split(text, chr(10))) + 1)) page from documents where text is not null),
    p as (select doc_id, page, sum(length(x) + 1) over w - length(x) - 1 a, sum(length(x) + 1) over w b from l window w as (partition by doc_id order by page)),
    c as (select doc_id, unnest(range(0, (length(text) + 699) // 700)) i, length(text) n from documents where text is not null)
    select c.doc_id, cast(i as integer) chunk_index, string_agg(page, ',' order by page) pages from c join p on p.doc_id = c.doc_id and a < least(n, (i + 1) * 700) and b > greatest(0, i * 700 - 100) group by c.doc_id, i"""
)
def page_ranges(spark, sf):
    """Lines of documents that stretches of 700 characters touch, each led by the last 100 of the one before."""
    d = s.read(spark, sf, "documents").where("text is not null")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "x")).select("doc_id", (F.col("at") + 1).alias("page"), F.length("x").alias("n"))
    own = r.W.partitionBy("doc_id").orderBy("page")
    spans = lines.withColumn("page_end", F.sum(F.col("n") + 1).over(own)).withColumn("page_start", F.col("page_end") - F.col("n") - 1)
    n = F.length("text")
    i = d.where("length(text) > 0").select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / 700).cast("int"))).alias("chunk_index"))
    ranges = i.select("doc_id", "chunk_index", F.greatest(F.lit(0), F.col("chunk_index") * 700 - 100).alias("start"), F.least("n", (F.col("chunk_index") + 1) * 700).alias("end"))
    return r.chunking.pages_touched(ranges, spans).select("doc_id", "chunk_index", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"))


@r.query(r.ORACLES["packed_ids"])
def packed_ids_in_sql(spark, sf):
    """Packed ids by the session's SQL functions."""
    register(spark)
    ids = spark.sql("select event_id, pack_id(user_id, unix_millis(cast(ts as timestamp)), 18, cast(event_id as string)) as id from {events}", events=s.read(spark, sf, "events"))
    return spark.sql("select event_id, id, id_org(id) as org, case id_entity(id) when 18 then 'Chunk' end as entity, is_packed_id(id) as valid from {ids}", ids=ids)


@r.query()
def chunks_in_sql(spark, sf):
    """Chunks of documents by a table function; the same rows as chunk_documents, to which tests hold it."""
    register(spark)
    return spark.sql("select d.doc_id, c.chunk_index, c.content from {docs} d, lateral text_chunks(d.text) c", docs=s.read(spark, sf, "documents"))
