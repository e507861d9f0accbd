"""Tables stored so that what is joined lies together: buckets of a key, stretches of a source, ids that are looked up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Places of a source that lie together; bytes of a row group of a table for look-ups.
STRETCH, GROUP_BYTES = 4096, 8 << 20


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int = 32) -> None:
    """Store a table in buckets of keys, a sorted file each: two such tables are joined on them without an exchange."""
    df.repartition(buckets, *keys).sortWithinPartitions(*keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def write_placed(chunks: DataFrame, table: str, buckets: int = 32, stretch: int = STRETCH) -> None:
    """Store chunks by (source, stretch of places) and place. The first and last places of a stretch lie in the one beside it as well.

    So the neighbours of each chunk are in its own bucket, whatever the size of its source: a source that has a third of all chunks is many
    stretches.
    """
    i = F.col("chunk_index")
    own = F.coalesce(F.floor(i / stretch), F.lit(0))
    at = lambda n, edge: F.struct(n.alias("stretch"), F.lit(edge).alias("edge"))
    none = F.lit(None).cast("struct<stretch: bigint, edge: boolean>")
    every = F.array(at(own, False), F.when(i % stretch == 0, at(own - 1, True)).otherwise(none), F.when(i % stretch == stretch - 1, at(own + 1, True)).otherwise(none))
    rows = chunks.withColumn("in", F.explode(F.filter(every, lambda x: x.isNotNull()))).select(*chunks.columns, "in.stretch", "in.edge")
    keys = ["data_source_id", "stretch"]
    rows.repartition(buckets, *keys).sortWithinPartitions(*keys, "chunk_index").write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys, "chunk_index").saveAsTable(table)


def neighbours(spark: SparkSession, table: str, key: str = "chunk_id", preview: int = 500) -> DataFrame:
    """(key, data_source_id, chunk_index, context_before, context_after) of every chunk of a placed table, without an exchange.

    As search.with_context(): only neighbours at exactly one place apart count, of several at one place the one with the largest id.
    """
    own = W.partitionBy("data_source_id", "stretch").orderBy("chunk_index")
    beside = lambda d: F.when(F.col("chunk_index").isNotNull() & F.col("data_source_id").isNotNull(), F.max_by(F.substring("content", 1, preview), key).over(own.rangeBetween(d, d)))
    rows = spark.table(table).select(key, "data_source_id", "chunk_index", "edge", beside(-1).alias("context_before"), beside(1).alias("context_after"))
    return rows.where("not edge").drop("edge")


def write_lookup(df: DataFrame, path: str, ids: str = "id", tenant: str = "org_id", group_bytes: int = GROUP_BYTES) -> None:
    """Store a table for look-ups of an id within its tenant: sorted by tenant and id, with small row groups that have Bloom filters of their ids.

    Many small tenants share a file and its row groups, a large one has many; both ranges are known of each row group. A filter is
    as large as its row group's ids ask for: a file a tenant with a filter of full size took a megabyte for each tenant.
    """
    out = df.repartitionByRange(tenant, ids).sortWithinPartitions(tenant, ids).write.mode("append")
    out.option(f"parquet.bloom.filter.enabled#{ids}", "true").option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.block.size", group_bytes).parquet(path)
