"""Functions for queries in SQL: chunks as a table function, packed ids as SQL functions of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import Size, split_text
from .ids import UUID_PATTERN


@F.udtf(returnType="chunk_index int, content string", useArrow=True)
class TextChunks:
    """text_chunks(text, most, overlap, least): a row for each chunk of a text, none for a null one."""

    def eval(self, text: str, most: int = 400, overlap: int = 80, least: int = 40):
        if text is not None:
            yield from enumerate(split_text(text, Size(most, overlap, least)))


_DIGITS = "replace(id, '-', '')"
#: Name, parameters, result and expression of each SQL function.
FUNCTIONS = (
    ("pack_id", "org BIGINT, millis BIGINT, entity INT, seed STRING", "STRING", "regexp_replace(concat(lpad(lower(hex(org)), 8, '0'), lpad(lower(hex(millis)), 12, '0'), lpad(lower(hex(entity)), 2, '0'), substring(sha2(seed, 256), 1, 10)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '$1-$2-$3-$4-$5')"),
    ("id_org", "id STRING", "BIGINT", f"cast(conv(substring({_DIGITS}, 1, 8), 16, 10) as bigint)"),
    ("id_entity", "id STRING", "INT", f"cast(conv(substring({_DIGITS}, 21, 2), 16, 10) as int)"),
    ("id_time", "id STRING", "TIMESTAMP", f"timestamp_millis(cast(conv(substring({_DIGITS}, 9, 12), 16, 10) as bigint))"),
    ("is_packed_id", "id STRING", "BOOLEAN", f"id rlike '{UUID_PATTERN}'"),
)


def register(spark: SparkSession) -> None:
    """Make text_chunks and FUNCTIONS known to a session; they go with it."""
    spark.udtf.register("text_chunks", TextChunks)
    for name, parameters, result, expression in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {expression}")
