"""Session settings that results depend on, and readers scoped to one tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "lodestrata", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in {**SETTINGS, **more}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scoped(df: DataFrame, org_id: str | int, column: str = "org_id") -> DataFrame:
    """Rows of one tenant. Tables are stored partitioned by the column, so this prunes partitions."""
    if org_id is None:
        raise ValueError("a tenant is required")
    return df.where(F.col(column) == F.lit(org_id))


def write_scoped(df: DataFrame, path: str, mode: str = "append", column: str = "org_id") -> None:
    """Store a table so that scoped() reads one tenant's files only."""
    df.write.mode(mode).partitionBy(column).parquet(path)
