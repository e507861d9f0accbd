"""What several of the operators share: reading tables, cutting lineage, word patterns."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import cut, delete, folder, scratch, shared_dir  # noqa: F401

#: ASCII white space splits words; everything else belongs to them (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df with a broadcast hint when it is counted to have few rows of fixed width; otherwise as it is."""
    return F.broadcast(df) if df.count() <= most else df


def give_back() -> None:
    """Return what a task has freed to the system: a worker lives on, next to the JVM that needs the memory in later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every libc has it
        ctypes.CDLL(None).malloc_trim(0)


def few_rows(batches, most: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of a task in slices, so that what is made of long texts is held for few of them; memory is given back at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)
    give_back()


def few_bytes(batches, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Like few_rows, by so many bytes of a column's texts, or one text."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end
    give_back()


def words(col) -> F.Column:
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(WORD), F.lit(0))


def readable(text) -> F.Column:
    """A text column with replacement characters for bytes that aren't UTF-8, which a crawl's files may hold and Python can't read."""
    return F.make_valid_utf8(F.col(text) if isinstance(text, str) else text)


def free(frame: DataFrame, *names: str) -> list[str]:
    """names, each with underscores added until no column of frame is called that."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII text, which is null for null."""
    step = "list_reduce(list_prepend(xor(crc, byte), [cast(0 as bigint) for i in range(8)]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295, [cast(ascii(c) as bigint) for c in string_split({text}, '')]), lambda crc, byte: {step}), 4294967295)"
