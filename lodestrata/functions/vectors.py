"""Dense vectors: similarity as an expression, exact top-k, and a stand-in embedder."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSION = 64


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for null or zero vectors, an error for different widths."""
    same = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different widths")).cast("double"))
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.coalesce(same, F.when(norms > 0, _dot(a, b) / norms))


def cosine_to(query: list[float]):
    """The same against one vector over Arrow batches: one matrix product for each batch."""
    q = np.asarray(query, np.float64)
    q = q / np.linalg.norm(q)

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        ok = v.notna()
        out = pd.Series(np.nan, index=v.index)
        if ok.any():
            x = np.stack(v[ok].to_numpy()).astype(np.float64)
            n = np.linalg.norm(x, axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                out[ok] = np.where(n > 0, x @ q / n, np.nan)
        return out.where(out.notna(), None)

    return score


def top_by_cosine(rows: DataFrame, query: list[float], k: int, vector: str = "embedding", key: str = "id") -> DataFrame:
    """The k rows nearest to query, each task sending at most k; rows without a score never rank."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return rows.withColumn("score", cosine(F.col(vector), q)).where(F.col("score").isNotNull()).orderBy(F.desc("score"), key).limit(k)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def embedding(text: pd.Series) -> pd.Series:
    """Stand-in for a model: words hashed into signed bins, scaled to length one; zeros for no words."""

    def one(t):
        v = np.zeros(DIMENSION)
        for w in re.findall(r"\w+", (t or "").lower()):
            h = zlib.crc32(w.encode())
            v[h % DIMENSION] += 1 if h >> 31 else -1
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()

    return text.map(one)
