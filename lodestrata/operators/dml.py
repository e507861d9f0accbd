"""Changes to stored tables, as whole-table expressions and partition overwrites.

A change is a DataFrame of the table as it is afterwards. Sinks that must survive a replay write by
partition, so writing the same batch again leaves the same table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def replaced(existing: DataFrame, new: DataFrame, key: str = "data_source_id") -> DataFrame:
    """existing with all rows of the keys in new replaced by new's. Doing it twice changes nothing more."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def replace_partitions(new: DataFrame, path: str, by: Sequence[str] = ("org_id", "data_source_id")) -> None:
    """The same for a table stored by these columns: only the partitions that new touches are rewritten."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def numbered(new: DataFrame, existing: DataFrame | None = None, key: str = "data_source_id", order: str = "position", at: str = "chunk_index") -> DataFrame:
    """new with running numbers for each key, after those that the key has already."""
    w = W.partitionBy(key).orderBy(order)
    out = new.withColumn(at, F.row_number().over(w) - 1)
    if existing is None:
        return out
    offset = last_index(existing, key, at).select(key, (F.col("last_index") + 1).alias("offset"))
    return out.join(offset, key, "left").withColumn(at, F.col(at) + F.coalesce("offset", F.lit(0))).drop("offset")


def last_index(rows: DataFrame, key: str = "data_source_id", at: str = "chunk_index") -> DataFrame:
    """(data_source_id, last_index): the largest number that a source's chunks have."""
    return rows.groupBy(key).agg(F.max(at).alias("last_index"))


def appended(existing: DataFrame, new: DataFrame, key: str = "data_source_id", order: str = "position", at: str = "chunk_index") -> DataFrame:
    return existing.unionByName(numbered(new, existing, key, order, at).select(existing.columns))


def upserted(existing: DataFrame, items: DataFrame, keys: Sequence[str] = ("connection_id", "external_id"), order: str = "seq") -> DataFrame:
    """Sources after a sync: items update those with their key and add the others.

    Of several items with one key the last by order counts. An item that only appends leaves an
    existing source READY; any other, and a new source, is UPLOADED and will be built in full.
    """
    last = items.groupBy(*keys).agg(F.max_by(F.struct(*items.columns), order).alias("i")).select("i.*")
    e, i = existing.alias("e"), last.alias("i")
    on = [F.col(f"e.{k}") == F.col(f"i.{k}") for k in keys]
    new, old = F.col(f"i.{keys[0]}").isNotNull(), F.col(f"e.{keys[0]}").isNotNull()
    columns = []
    for c in existing.columns:
        if c == "status":
            columns.append(F.when(new & old & F.col("i.append_only"), F.lit("READY")).when(new, F.lit("UPLOADED")).otherwise(F.col("e.status")).alias(c))
        elif c in last.columns:
            columns.append(F.coalesce(f"i.{c}", f"e.{c}").alias(c))
        else:
            columns.append(F.col(f"e.{c}").alias(c))
    return e.join(i, on, "full_outer").select(*columns)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows whose key isn't among gone's: tombstones, and the children of deleted parents."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def orphans_unset(children: DataFrame, parents: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """children whose parent is gone have null there."""
    alive = parents.select(F.col(key).alias(foreign)).distinct().withColumn("parent_alive", F.lit(True))
    out = children.join(alive, foreign, "left")
    return out.withColumn(foreign, F.when(F.col("parent_alive"), F.col(foreign))).select(children.columns)


def patched(rows: DataFrame, patches: DataFrame, key: str = "id") -> DataFrame:
    """rows with the fields of patches set that its array column present names, null as a value included."""
    fields = [c for c in patches.columns if c not in (key, "present")]
    p = patches.select(key, "present", *(F.col(f).alias(f"new_{f}") for f in fields))
    out = rows.join(p, key, "left")
    return out.select(*(F.when(F.array_contains("present", c), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns))


def titled(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """Threads without a title get the first 100 characters of their first message."""
    first = messages.groupBy("thread_id").agg(F.min_by("content", F.struct("created_at", "id")).alias("first_message"))
    out = threads.join(first.withColumnRenamed("thread_id", "id"), "id", "left")
    return out.withColumn("title", F.coalesce("title", F.substring("first_message", 1, 100))).select(threads.columns)


#: Status of a source: from -> to that are allowed; a source that only grows stays READY meanwhile.
STEPS = {"UPLOADED": ("PROCESSING",), "PROCESSING": ("READY", "FAILED"), "READY": ("UPLOADED", "PROCESSING"), "FAILED": ("UPLOADED", "PROCESSING")}


def may_step(status: Column, to: Column) -> Column:
    """Whether a source may go from one status to another."""
    steps = F.create_map(*(x for a, b in STEPS.items() for x in (F.lit(a), F.array(*map(F.lit, b)))))
    return F.coalesce(F.array_contains(F.try_element_at(steps, status), to), F.lit(False))


def processed(sources: DataFrame, outcomes: DataFrame) -> DataFrame:
    """sources after their documents were worked on: READY with a page count, or FAILED with the error of that document.

    An outcome that comes for a source whose status doesn't lead there (it was replaced meanwhile, say) changes nothing.
    """
    out = sources.join(outcomes.select(F.col("data_source_id").alias("id"), F.col("error").alias("failure"), F.col("page_count").alias("pages")), "id", "left")
    to = F.when(F.col("failure").isNotNull(), "FAILED").when(F.col("pages").isNotNull(), "READY")
    out = out.withColumn("to", F.when(may_step(F.col("status"), to), to))
    came = F.col("to").isNotNull()
    changed = {"status": F.coalesce("to", "status"), "page_count": F.when(came, F.coalesce("pages", "page_count")).otherwise(F.col("page_count"))}
    return out.select(*(changed.get(c, F.col(c)).alias(c) for c in sources.columns), F.when(came, F.col("failure")).alias("error"))


def sync_counters(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.count_if(F.col("error").isNull()).alias("synced"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def deleted_source(source_ids: DataFrame, sources: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, chunks) without the named sources: their chunks go with them."""
    ids = source_ids.select("id")
    return without(sources, ids, "id"), without(chunks, ids.withColumnRenamed("id", "data_source_id"), "data_source_id")


def deleted_collection(gone: DataFrame, sources: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, chunks) after collections went: both stay, outside any collection."""
    ids = gone.select(F.col("id").alias("collection_id")).distinct().withColumn("gone", F.lit(True))
    unset = lambda df: df.join(ids, "collection_id", "left").withColumn("collection_id", F.when(F.col("gone").isNull(), F.col("collection_id"))).select(df.columns)
    return unset(sources), unset(chunks)


def key_of(*parts: Column) -> Column:
    """A token that follows from what it stands for, in place of drawing random ones until one is free."""
    return F.sha2(F.concat_ws("|", *parts), 256)
