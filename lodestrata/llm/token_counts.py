"""Exact length histogram: totals, quantiles and truncated totals for every context limit.

Texts are encoded once and each task sends one row for each length it has met, so what is shuffled is
bounded by distinct lengths. Sums over all longer lengths then answer every limit: with S documents
longer than L, truncating at L leaves the tokens of the others plus S * L.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, readable
from .tokens import tokenizer

#: Lengths summed together first, so that no window holds all of them.
STRIP = 1_024


def length_histogram(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """(length, docs): how many rows of docs have each number of token ids; null counts as length 0."""

    def run(batches):
        seen = Counter()
        for batch in batches:
            n, k = np.unique(tokenizer(path).encode(batch.column(0))[1], return_counts=True)
            seen.update(dict(zip(n.tolist(), k.tolist())))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], names=["length", "docs"])

    return docs.select(readable(text_col).alias(text_col)).mapInArrow(run, "length long, docs long").groupBy("length").agg(F.sum("docs").alias("docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For each length L of the histogram, taken as a limit: docs of that length, docs and tokens at or below it
    (with their share of the whole), docs above it, tokens left if longer documents are cut at L, and
    tokens in pieces of at most L with the pieces' number. An empty histogram gives an empty table."""
    h = histogram.withColumn("strip", F.floor(F.col("length") / STRIP)).withColumn("tokens", F.col("length") * F.col("docs"))
    strips = h.groupBy("strip").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    above = W.orderBy(F.col("strip").desc()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = strips.select("strip", *(F.coalesce(F.sum(x).over(above), F.lit(0)).alias(f"{x}_above") for x in "dt"), *(F.sum(x).over(whole).alias(f"{x}_all") for x in "dt"))
    longer = W.partitionBy("strip").orderBy(F.col("length").desc()).rowsBetween(W.unboundedPreceding, -1)
    j = h.join(s, "strip").withColumns({"longer": F.col("d_above") + F.coalesce(F.sum("docs").over(longer), F.lit(0)), "longer_tokens": F.col("t_above") + F.coalesce(F.sum("tokens").over(longer), F.lit(0))})
    return j.select(
        F.col("length").alias("context_limit"),
        "docs",
        (F.col("d_all") - F.col("longer")).alias("docs_within"),
        F.col("longer").alias("docs_above"),
        (F.col("t_all") - F.col("longer_tokens")).alias("tokens_within"),
        (F.col("t_all") - F.col("longer_tokens") + F.col("longer") * F.col("length")).alias("tokens_truncated"),
        F.col("t_all").alias("tokens_total"),
        ((F.col("d_all") - F.col("longer")).cast("double") / F.col("d_all")).alias("quantile"),
    )


def truncated_total(limits: DataFrame, limit: int) -> Column:
    """Aggregate over context_limits: tokens left if every document is cut at any limit, also one between two lengths."""
    below = F.max(F.when(F.col("context_limit") <= limit, F.struct("context_limit", "tokens_within", "docs_above")))
    return F.coalesce(below["tokens_within"] + below["docs_above"] * limit, limit * F.sum("docs"))


def quantile_length(limits: DataFrame, q: float) -> Column:
    """Aggregate over context_limits: the least length that a share q of the documents doesn't exceed."""
    return F.min(F.when(F.col("quantile") >= q, F.col("context_limit")))


def token_counts(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """What every context limit means for docs; see context_limits().

    A null or empty text has length 0; bytes that aren't UTF-8 count as replacement characters; repeated rows count each. A long text is encoded in parts, and its ids are
    held at once. An empty table gives an empty one; other columns of docs are left out, whatever their names.
    """
    return context_limits(cut(length_histogram(docs, text_col, path), "histogram"))
