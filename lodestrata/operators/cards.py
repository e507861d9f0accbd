"""Small computations behind chat sources, cards and canvases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import location_label, rounded

# fixed values: providers, their names and what one of their sources is called
PROVIDERS = {"SLACK": ("Slack", "channel"), "LINEAR": ("Linear", "issue"), "GITHUB": ("GitHub", "item"), "NOTION": ("Notion", "page")}


def source_chips(sources: DataFrame, key: str = "message_id") -> DataFrame:
    """(message_id, type, label, count): an answer's sources by provider, uploads together, each source once.

    The first mention of a source counts; groups come in the order of first mention.
    """
    kind = F.when(F.col("type").isin(list(PROVIDERS)), F.col("type")).otherwise("UPLOAD")
    once = sources.withColumn("kind", kind).groupBy(key, "kind", "data_source_id").agg(F.min_by(F.struct("data_source_name", "sheet", "pages", "rows", "columns"), "pos").alias("s"), F.min("pos").alias("pos"))
    g = once.groupBy(key, "kind").agg(F.count(F.lit(1)).alias("count"), F.min_by("s", "pos").alias("s"), F.min("pos").alias("pos"))
    many = F.concat(F.col("count").cast("string"), F.lit(" "))
    upload = F.when(F.col("count") == 1, F.concat("s.data_source_name", location_label(F.col("s.sheet"), F.col("s.pages"), F.col("s.rows"), F.col("s.columns")))).otherwise(F.concat(many, F.lit("documents")))
    provider = F.when(F.col("count") == 1, F.col("s.data_source_name")).otherwise(F.concat(F.try_element_at(F.create_map(*(F.lit(x) for p, n in PROVIDERS.items() for x in (p, n[0]))), F.col("kind")), F.lit(" ("), many, F.try_element_at(F.create_map(*(F.lit(x) for p, n in PROVIDERS.items() for x in (p, n[1]))), F.col("kind")), F.lit("s)")))
    return g.select(key, F.col("kind").alias("type"), F.when(F.col("kind") == "UPLOAD", upload).otherwise(provider).alias("label"), "count", F.col("pos").alias("first_pos"))


def funnel(steps: DataFrame, key: str = "card_id", value: str = "value") -> DataFrame:
    """steps with their width in percent of the largest, at least 2."""
    top = F.max(value).over(W.partitionBy(key))
    return steps.withColumn("width", F.when(top > 0, F.greatest(F.col(value) / top * 100, F.lit(2.0))).otherwise(F.lit(2.0)))


def progress(value: Column, most: Column) -> Column:
    """Whole percent, 0 if most isn't positive."""
    return F.when(most > 0, rounded(value / most * 100)).otherwise(F.lit(0)).cast("long")


def progress_shown(value: Column, most: Column) -> Column:
    return F.least(progress(value, most), F.lit(100))


def completed(items: Column) -> Column:
    """How many of an array of (text, checked) are checked."""
    return F.size(F.filter(items, lambda x: x["checked"]))


def best_value(values: Column) -> Column:
    """The largest of those of an array of texts that are numbers."""
    return F.array_max(F.filter(F.transform(values, lambda v: v.try_cast("double")), lambda x: x.isNotNull()))


GAP, WIDTH, HEIGHT = 20, 400, 300


def free_slots(cards: DataFrame, key: str = "thread_id", most: int = 3) -> DataFrame:
    """(thread_id, place, x, y): the first places, left to right and then down, where a new card overlaps none.

    Places to try follow from the right and lower ends of a thread's cards. Below all cards every x has a free place,
    so the first most of them are all that is looked at. For each of these a sweep goes down over the stretches that cards block, in order of
    their upper ends: a place is free if none that began above it still goes on. Cards and places are rows, so
    a thread of many cards is sorted and not one row. If no place is free, one right of everything and one below.
    """
    d = lambda c: F.col(c).cast("double")
    box = cards.select(key, d("x").alias("x1"), d("y").alias("y1"), (F.col("x") + F.col("width")).cast("double").alias("x2"), (F.col("y") + F.col("height")).cast("double").alias("y2"))
    origin = box.select(key).distinct()
    ends = lambda side, name: box.select(key, (F.col(side) + GAP).alias(name)).unionByName(origin.withColumn(name, F.lit(0.0))).distinct()
    first = ends("x2", "x").withColumn("n", F.row_number().over(W.partitionBy(key).orderBy("x"))).where(F.col("n") <= most).drop("n")
    none = F.lit(None).cast("double")
    tried = first.join(ends("y2", "y"), key).select(key, "x", F.col("y").alias("at"), F.lit(0).alias("kind"), none.alias("until"))
    near = box.join(first, key).where((F.col("x") < F.col("x2") + GAP) & (F.col("x") + WIDTH + GAP > F.col("x1")))
    blocks = near.select(key, "x", (F.col("y1") - HEIGHT - GAP).alias("at"), F.lit(1).alias("kind"), (F.col("y2") + GAP).alias("until"))
    down = W.partitionBy(key, "x").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, -1)
    swept = tried.unionByName(blocks).withColumn("until", F.max("until").over(down))
    free = swept.where((F.col("kind") == 0) & (F.col("until").isNull() | (F.col("until") <= F.col("at")))).select(key, "x", F.col("at").alias("y"))
    spare = box.groupBy(key).agg((F.max("x2") + GAP).alias("right"), (F.max("y2") + GAP).alias("low")).join(free.select(key).distinct(), key, "left_anti")
    spare = spare.select(key, F.posexplode(F.array(F.struct(F.col("right").alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(0.0).alias("x"), F.col("low").alias("y")))).alias("place", "at"))
    places = free.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("x", "y"))).where(F.col("place") <= most)
    return places.select(key, "place", "x", "y").unionByName(spare.select(key, F.col("place") + 1, "at.x", "at.y").toDF(key, "place", "x", "y"))


def valid_edges(edges: DataFrame, cards: DataFrame, key: str = "thread_id") -> DataFrame:
    """Edges whose two cards exist."""
    ids = cards.select(key, F.col("id").alias("card")).distinct()
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("card", end), [key, end], "left_semi")
    return edges


def last_messages(messages: DataFrame, n: int = 20, key: str = "thread_id") -> DataFrame:
    """The newest n messages of each thread."""
    w = W.partitionBy(key).orderBy(F.desc_nulls_last("created_at"), F.desc("id"))
    return messages.withColumn("at", F.row_number().over(w)).where(F.col("at") <= n).drop("at")
