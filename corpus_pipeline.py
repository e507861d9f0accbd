"""A training corpus from documents: five stages, each one of the numbered operators.

Every stage works on all that its predecessor kept, and is written and read again before the next. All but the
last return the columns of documents; other columns of a stage's input are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import cut, delete, scratch, shared_dir
from lodestrata.llm.line_dedup import drop_boilerplate_lines
from lodestrata.llm.mixing import mix_sources
from lodestrata.llm.ngram_join import ngram_jaccard_join
from lodestrata.llm.packing import pack
from lodestrata.llm.quality import STANDARD, ledger, passes

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the standard policy."""
    return ledger(docs, keep=COLUMNS[1:]).where(passes(STANDARD)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that a large share of their source's documents has; n_chars as the text is now.

    A document of nothing else stays, with an empty text.
    """
    out = drop_boilerplate_lines(docs.select(*COLUMNS), F.col("source"), F.col("text"))
    return out.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.when(F.col("n_dropped") > 0, F.length("clean_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, written so that it stays: ids may be null or repeated."""
    return cut(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "keyed")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id (the first, of several), null ids last.

    Rows are told apart by themselves, not by doc_id: rows that share an id but aren't near copies all stay. Texts
    without words are copies of nothing and stay.
    """
    keyed = _keyed(docs)
    found = ngram_jaccard_join(keyed, id_col="row").select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    best = found.join(keyed.select("row", "doc_id"), "row").groupBy("component_id").agg(F.min(order).alias("best")).select("best.row")
    return keyed.join(best, "row", "left_semi").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it; the one cut at a source's budget counts if half of it is taken.

    Null and repeated ids are rows like others. Rows without words have nothing to take and go.
    """
    keyed = _keyed(docs)
    times = mix_sources(keyed, keep=("row",)).where("epochs > 0").select("row", "epochs")
    return keyed.join(times, "row").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("epochs")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4096 token ids, copies made by mixing in different ones."""
    return pack(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", ngram_jaccard), ("mixing", mixing), ("packing", packing)]

#: Token ids and BM25 have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage cut is deleted when its rows are written, those when the next has read them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/lodestrata-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        if i:
            delete(spark, f"{base}/{i - 1}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
