"""A table for look-ups is about as large as its rows, however many tenants they belong to."""

import os

from pyspark.sql import functions as F

from lodestrata.operators import catalogue
from lodestrata.sources import colocated


def test_many_small_tenants_take_little_room(spark, tmp_path):
    rows = spark.range(3_000).select(F.col("id"), (F.col("id") % 1_000).alias("org_id"), (F.col("id") * 7).alias("cents"))
    colocated.write_lookup(rows, str(tmp_path / "t"))
    files = [os.path.join(d, x) for d, _, names in os.walk(tmp_path / "t") for x in names if x.endswith(".parquet")]
    assert len(files) < 100 and sum(map(os.path.getsize, files)) < 1_000_000  # 1,000 files of a megabyte before
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert stored.count() == 3_000
    assert [r.cents for r in catalogue.found(stored, 7, 2_007).collect()] == [14_049] and catalogue.found(stored, 8, 2_007).count() == 0
