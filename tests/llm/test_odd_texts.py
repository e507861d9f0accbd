"""Texts that aren't UTF-8, very long ones, and columns called like Spark's own, through operators and pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrata.llm import compaction, langid, line_dedup, mixing, packing, token_counts, warc
from lodestrata.llm.ngram_join import ngram_jaccard_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """As a crawl's Parquet files hold them: two copies with bytes that aren't UTF-8, and others."""
    rows = spark.createDataFrame([(i, f"{WORDS} {i % 4}", ("en", "de")[i % 2], "s", 1) for i in range(8)], SCHEMA)
    bad = spark.range(2).select((F.col("id") + 100).alias("doc_id"), F.concat(F.expr("cast(unhex('61ff62') as string)"), F.lit(" " + WORDS)).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    at = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    rows.unionByName(bad).write.parquet(at)
    return spark.read.parquet(at)


def test_bytes_that_are_not_utf8(spark, odd):
    joined = {r.doc_id: r for r in ngram_jaccard_join(odd).collect()}
    assert len(joined) == 10 and joined[100].component_id == joined[101].component_id and joined[100].n_shingles == 57
    assert {r.doc_id for r in langid.language_id(odd).collect()} == {*range(8), 100, 101}
    pieces = packing.pack(odd).collect()
    assert {r.doc_id for r in pieces} == {*range(8), 100, 101}
    assert sum(r.length for r in pieces if r.doc_id == 100) == next(r.doc_tokens for r in pieces if r.doc_id == 100)
    assert token_counts.token_counts(odd).agg(F.max("docs_above")).first() is not None


def test_pipeline_takes_them(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_columns_called_like_sparks_own(spark, odd):
    docs = odd.where("doc_id < 8").withColumns({"_metadata": F.lit(1), "arrival": F.lit(2)})
    got = compaction.size_tiered_compaction(docs).collect()
    assert len(got) == 8 and all(r.shard.endswith(".parquet") for r in got)


def test_counts_of_terms_are_those_of_all_tasks(spark, odd):
    """However the rows are dealt to tasks."""
    docs = odd.select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("salt"), F.lit(1).cast("long").alias("size"), F.make_valid_utf8("text").alias("text"))
    one = packing._corpus(packing._encoded(docs.repartition(1), None))
    many = packing._corpus(packing._encoded(docs.repartition(7), None))
    assert one.n == many.n == 10 and one.mean == many.mean and (one.df == many.df).all() and one.df.max() >= 10


def test_very_long_texts(spark):
    """Some megabytes in one row."""
    long = "a line of some words\nanother line here\n" * 60_000
    docs = spark.createDataFrame([(1, long, "en", "s", 1), (2, "short text", "en", "s", 1), (3, None, None, None, None)], SCHEMA)
    assert sorted((r.doc_id, r.n_chars) for r in compaction.size_tiered_compaction(docs).collect() if r.n_chars) == [(1, len(long)), (2, 10)]
    assert {r.doc_id: r.size for r in mixing.mix_sources(docs).collect()} == {1: 8 * 60_000, 2: 2, 3: 0}
    pages = spark.createDataFrame([(1, "http://a.example/x", f"<html><body><p>{'text and more. ' * 200_000}</p></body></html>"), (2, "http://a.example/y", "<p>one</p>")], "page_id long, url string, html string")
    kept = {r.page_id: r for r in line_dedup.dedup_page_lines(pages).collect()}
    assert kept[1].n_lines == 1 and kept[1].clean_chars == len("text and more. " * 200_000) - 1
    assert warc.page_derivatives(pages).count() >= 4
