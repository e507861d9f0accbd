"""One query for each numbered operator: production parameters, whole tables, full results."""

from __future__ import annotations

from . import ann, compaction, conversations, langid, licenses, line_dedup, mixing, ngram_join, packing, quality, runs, token_counts, warc
from .common import table
from .mixing import mix_sources
from .ngram_join import ngram_jaccard_join


def op1_ngram_jaccard_join(spark, sf_dir):
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op2_size_tiered_sharding(spark, sf_dir):
    return compaction.size_tiered_compaction(table(spark, sf_dir, "documents"))


def op3_language_id(spark, sf_dir):
    return langid.language_id(table(spark, sf_dir, "documents"))


def op4_retrieval_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_warc_derivatives(spark, sf_dir):
    return warc.page_derivatives(table(spark, sf_dir, "pages"))


def op6_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark, sf_dir):
    return line_dedup.dedup_page_lines(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark, sf_dir):
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


def quality_ablations(spark, sf_dir):
    return quality.quality_ablations(table(spark, sf_dir, "documents"))


def mixed_sources(spark, sf_dir):
    return mixing.mixed_sources(table(spark, sf_dir, "documents"))


def sharded_rows(spark, sf_dir):
    return compaction.sharded_rows(table(spark, sf_dir, "documents"))


def op9_cross_polytope(spark, sf_dir):
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op10_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op11_periodic_runs(spark, sf_dir):
    return runs.documents_runs(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark, sf_dir):
    return conversations.conversation_repairs(table(spark, sf_dir, "conversations"))


def op13_license_scan(spark, sf_dir):
    return licenses.documents_licenses(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_size_tiered_sharding, op3_language_id, op4_retrieval_packing, op5_warc_derivatives, op6_token_counts, op7_line_dedup, op8_quality_rules, op9_cross_polytope, op10_mixing, op11_periodic_runs, op12_conversation_repair, op13_license_scan, quality_ablations, mixed_sources, sharded_rows)}
ORACLES = {"op1_ngram_jaccard_join": ngram_join.ORACLE, "op11_periodic_runs": runs.ORACLE, "op12_conversation_repair": conversations.ORACLE, "op13_license_scan": licenses.ORACLE, "mixed_sources": mixing.ORACLE, "sharded_rows": compaction.ORACLE, "op5_warc_derivatives": warc.ORACLE, "op7_line_dedup": line_dedup.ORACLE, "op8_quality_rules": quality.ORACLE, "quality_ablations": quality.ABLATIONS}
