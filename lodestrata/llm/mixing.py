"""Mixing sources to target weights.

Every source gets a share of all words by weight, at most max_epochs times its own. Each document gets
a key by hash; keys are cut into ranges. Words are summed by source and range, the sums are added up
over the ranges of a source, and then within each range over its documents: a prefix sum over a source
of any size without one task holding it. Equal rows have one key; a key with more rows than a range holds is
cut into ranges of its own by the rows' places. What lies before the source's budget is taken, whole epochs
first. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, small

#: Documents that a range of keys holds on average.
RANGE = 2_000


def word_count(col) -> Column:
    """Words of a text, by counting where they start; null has none."""
    t = F.concat(F.lit(" "), F.coalesce(col, F.lit("")))
    return F.regexp_count(t, F.lit(r"[\x20\x09-\x0D][^\x20\x09-\x0D]")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Sources by code point, null last, weigh weights in turn and share the total. A target stops at
    max_epochs times its source's size and the rest is shared again by weight, until none is above:
    with sources in order of size/weight, the first few are full and the others share what is left.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("at", (F.row_number().over(order) - 1) % len(weights)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("at") + 1).cast("long"))
    full = W.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = full.rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    limit = F.col("source_size").cast("decimal(38,0)") * max_epochs  # a long overflows with very many sources
    w = (
        w.withColumn("total", F.sum("source_size").over(all_rows).cast("decimal(38,0)"))
        .withColumn("left", F.col("total") - F.coalesce(F.sum(limit).over(before), F.lit(0)))
        .withColumn("heavy", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("full", F.col("left") * F.col("weight") >= limit * F.col("heavy"))
        .withColumn("first_left", F.min(F.when(~F.col("full"), F.struct((F.col("source_size") / F.col("weight")).alias("r"), F.col("source").isNull().alias("z"), F.coalesce("source", F.lit("")).alias("s"), "left", "heavy"))).over(all_rows))
    )
    share = F.col("first_left.left").cast("double") * F.col("weight") / F.col("first_left.heavy")
    return w.select("source", "source_size", "weight", F.when(F.col("full"), limit.cast("double")).otherwise(share).alias("target"))


def _cells(sized: DataFrame, by_range: DataFrame) -> DataFrame:
    """sized with the cell of its range that a row belongs to: null, or (key, number) if its key alone overflows a range.

    Keys are random, so only a range with such a key can hold several times what it should.
    """
    over = by_range.where(F.col("held") > 4 * RANGE).select("source", "bin")
    if over.isEmpty():
        return sized.withColumn("cell", F.lit(None).cast("struct<key: bigint, part: bigint>"))
    at = _matched(sized.select("source", "bin", "key"), over, "source", "bin")
    hot = at.groupBy("source", "key").agg(F.ceil(F.count("*") / RANGE).alias("cells")).where(F.col("cells") > 1)
    cell = F.when(F.col("cells").isNotNull(), F.struct("key", F.pmod(F.xxhash64("row"), F.col("cells")).alias("part")))
    return _matched(sized, small(cut(hot, "hot_keys")), "source", "key", how="left").withColumn("cell", cell).drop("cells")


def _matched(a: DataFrame, b: DataFrame, *on: str, how: str = "inner") -> DataFrame:
    """a joined with b on columns of both, null equal to null."""
    same = F.lit(True)
    for c in on:
        same = same & a[c].eqNullSafe(b[c])
    return a.join(b, same, how).select(*(a[c] for c in a.columns), *(b[c] for c in b.columns if c not in on))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, epochs) for every row of docs, and keep's columns behind them.

    A source's taken words sum to its target, rounded down; at most one of its documents is cut.
    taken counts repeats. Order within a source is by hash of the id and the text, so a rerun agrees;
    rows alike in both are alike in everything that matters, and it's open which of them is cut. A null text has no
    words and takes none; null is a source of its own, as is a null id an id. An empty table gives an empty one.
    A text of any length is one number here. Columns of docs that keep doesn't name are left out, whatever their names.
    """
    kept = [f"kept_{c}" for c in keep]
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col)).alias("key"),
        F.monotonically_increasing_id().alias("row"),
        *(F.col(c).alias(k) for c, k in zip(keep, kept)),
    )
    sized = cut(sized, "sized")
    ranges = max(1, sized.count() // RANGE)
    sized = sized.withColumn("bin", F.shiftright(F.shiftrightunsigned("key", 33) * F.lit(ranges), 31))  # ranges of the unsigned key
    by_range = cut(sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"), F.count("*").alias("held")), "ranges")
    goals = targets(by_range.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, max_epochs)
    sized = _cells(sized, by_range)
    by_bin = cut(sized.groupBy("source", "bin", "cell").agg(F.sum("size").alias("bin_size")), "bins")
    # a source has as many ranges as documents/RANGE, so they are added up in two steps as well
    wide = max(1, int(ranges**0.5))
    strips = by_bin.withColumn("strip", F.floor(F.col("bin") / wide))
    before_strip = W.partitionBy("source").orderBy("strip").rowsBetween(W.unboundedPreceding, -1)
    strip_sums = strips.groupBy("source", "strip").agg(F.sum("bin_size").alias("strip_size")).withColumn("strip_before", F.coalesce(F.sum("strip_size").over(before_strip), F.lit(0))).drop("strip_size")
    before_bin = W.partitionBy("source", "strip").orderBy("bin", F.col("cell").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    placed = _matched(strips.withColumn("in_strip", F.coalesce(F.sum("bin_size").over(before_bin), F.lit(0))), strip_sums, "source", "strip")
    placed = placed.select("source", "bin", "cell", (F.col("strip_before") + F.col("in_strip")).alias("bin_before"))
    placed = _matched(placed, goals.select("source", "source_size", "target"), "source")
    inside = W.partitionBy("source", "bin", "cell").orderBy("key", F.col("doc_id").asc_nulls_first(), "size", "row").rowsBetween(W.unboundedPreceding, -1)
    j = _matched(sized.withColumn("in_bin", F.coalesce(F.sum("size").over(inside), F.lit(0))), placed, "source", "bin", "cell").withColumn("start", F.col("bin_before") + F.col("in_bin"))
    budget = F.floor(F.col("target") + F.lit(1e-6)).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - whole * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    taken = (whole * F.col("size") + last).cast("long")
    epochs = (whole + F.when((F.col("size") > 0) & (2 * last >= F.col("size")), 1).otherwise(0)).cast("int")
    return j.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), epochs.alias("epochs"), *(F.col(k).alias(c) for c, k in zip(keep, kept)))


def mixed_sources(docs: DataFrame) -> DataFrame:
    """(source, source_size, target, taken) of the mix, by source."""
    return mix_sources(docs).groupBy("source").agg(F.max("source_size").alias("source_size"), F.round(F.max("target"), 6).alias("target"), F.sum("taken").alias("taken"))


ORACLE = r"""
with z as (select source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) n from documents group by 1),
w as (select source, cast(n as bigint) n, [1, 2, 3][(row_number() over (order by source nulls last) - 1) % 3 + 1] w from z),
f as (select *, sum(n) over () - coalesce(sum(3 * n) over b, 0) open, sum(w) over () - coalesce(sum(w) over b, 0) heavy from w
 window b as (order by n / w, source nulls last rows between unbounded preceding and 1 preceding)),
o as (select *, open * w >= 3 * n * heavy as filled from f),
x as (select open, heavy from o where not filled order by n / w, source nulls last limit 1),
t as (select source, n, case when filled then 3.0 * n else cast((select open from x) as double) * w / (select heavy from x) end target from o)
select source, n source_size, round(cast(target as double), 6) target, cast(floor(target + 1e-6) as bigint) taken from t
"""
