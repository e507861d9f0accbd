"""The engine's logical tables made from the benchmark tables, for the registered queries."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pricing import MODELS, PRICES
from ..operators.search import indexed
from ..operators.usage import log_rows
from ..session import scoped, write_scoped
from ..store import folder, path_of

NOW, DAYS = "2024-01-25 12:00:00", 14
REQUEST_TYPES = ("CHAT", "EMBEDDING", "RERANK", "HYDE")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_rows(usage_calls(spark, sf_dir))


def usage_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls as they come in, before anything is derived."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 3).alias("org_id"),
        F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("user_id"),
        _pick(MODELS, F.col("user_id") % 5).alias("model"),
        _pick(REQUEST_TYPES, F.col("event_id") % 4).alias("request_type"),
        F.col("event_type").alias("source"),
        F.col("value").cast("int").alias("input_tokens"),
        F.get_json_object("props", "$.k").cast("int").alias("output_tokens"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.split_part("c_name", F.lit("#"), F.lit(1)).alias("first_name"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("last_name"), F.concat("c_name", F.lit("@example.org")).alias("email"))


def _listed(values) -> str:
    return "[" + ", ".join(repr(x) for x in values) + "][user_id % 5 + 1]"


USAGE_SQL = f"""
log as (select event_id id, user_id % 3 org_id, case when event_id % 7 <> 0 then user_id end user_id,
 {_listed(PRICES)} model,
 {_listed(p for p, _, _ in PRICES.values())} provider,
 ['CHAT', 'EMBEDDING', 'RERANK', 'HYDE'][event_id % 4 + 1] request_type, event_type source,
 cast(trunc(value) as integer) input_tokens, cast(json_extract_string(props, '$.k') as integer) output_tokens, ts created_at,
 {_listed(i for _, i, _ in PRICES.values())} pi, {_listed(o for _, _, o in PRICES.values())} po from events),
recent as (select *, input_tokens + output_tokens total_tokens,
 cast(cast(input_tokens as double) / 1000000 * cast(pi as double) + cast(output_tokens as double) / 1000000 * cast(po as double) as decimal(12, 8)) cost
 from log where created_at >= timestamp '2024-01-25 12:00:00' - interval 14 days)
"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks without vectors: by doc_id within their source, in the collection of their language."""
    d = read(spark, sf_dir, "documents")
    kinds = ["PDF", "CSV", "SLACK", "LINEAR"]
    kind = _pick(kinds, F.col("doc_id") % 4)
    author = F.concat(F.lit("user"), (F.col("doc_id") % 7).cast("string"))
    meta = F.struct(kind.alias("type"), F.when(kind == "SLACK", F.concat(F.lit("C"), (F.col("doc_id") % 5).cast("string"))).alias("slackChannelId"), F.when((kind == "SLACK") & (F.col("doc_id") % 3 != 0), F.array(author, F.lit("bot"))).alias("slackAuthors"), F.when((kind == "SLACK") & (F.col("doc_id") % 3 == 0), author).alias("slackAuthor"), F.when(kind == "LINEAR", F.concat(F.lit("L"), (F.col("doc_id") % 9).cast("string"))).alias("linearIssueId"), F.lit(None).cast("string").alias("notionPageId"))
    return d.select(F.col("doc_id").alias("chunk_id"), F.lit(1).alias("org_id"), F.col("text").alias("content"), F.floor(F.col("doc_id") / 20).cast("int").alias("chunk_index"), meta.alias("metadata"), F.col("source").alias("data_source_id"), F.col("lang").alias("collection_id"), F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("source_url"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the embedding of their id."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    t = texts(spark, sf_dir)
    return t.join(e, "chunk_id", "left").select(*t.columns[:5], "embedding", *t.columns[5:])


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ingest stores them: with lexemes and trigrams, by tenant; written once a session."""
    at = f"{folder(spark)}/chunks-{zlib.crc32(sf_dir.encode()):08x}"
    fs, path = path_of(spark, f"{at}/_SUCCESS")
    if not fs.exists(path):
        write_scoped(indexed(chunks(spark, sf_dir)), at, "overwrite")
    return scoped(spark.read.parquet(at), 1)


def data_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("source").alias("id")).distinct().select("id", F.concat(F.lit("Source "), "id").alias("title"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 3) -> list[float]:
    return [float(x) for x in read(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first().embedding]


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("pos"), "role", "text")
