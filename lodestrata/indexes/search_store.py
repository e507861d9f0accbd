"""Chunks stored for search: contents by place, words and trigrams by term, vectors by cell.

A search reads the lists of its words and trigrams, the cells near its vector, and then the stretches of contents that its
results and their neighbours lie in; what it reads doesn't grow with the number of a tenant's chunks but with
what its terms have in common with them.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fulltext, trigram
from ..operators import filters, search
from ..store import path_of
from .term_lists import TermLists, lexeme_rows, trigram_rows, trigram_candidates, word_matches, word_scores
from .vector_cells import VectorCells

#: Places of a source that lie in one stretch; candidates whose stretches are named when a query is planned, at most.
PLACES, NAMED = 256, 2_000
_KEYS = ("chunk_id", "part")
#: What filters of a search look at.
_FILTERED = ("collection_id", "data_source_id", "metadata")


class SearchStore:
    """A store below a path. parts is how many partitions a tenant's contents have: about one for each GB of them."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 32, buckets: int = 32):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts
        self.words = TermLists(spark, f"{self.path}/words", buckets)
        self.grams = TermLists(spark, f"{self.path}/trigrams", buckets)
        self.cells = VectorCells(spark, f"{self.path}/vectors")

    def part(self, source, index) -> Column:
        """Partition of a place: neighbours within a stretch share one, and a source of any size has many."""
        return (F.crc32(F.concat_ws(":", source.cast("string"), F.floor(index / PLACES).cast("string"))) % self.parts).cast("int")

    def slot(self, key: str) -> Column:
        return (F.crc32(F.col(key).cast("string")) % self.parts).cast("int")

    def _part(self, source, index: int) -> int:
        return zlib.crc32(f"{source}:{index // PLACES}".encode()) % self.parts

    def append(self, chunks: DataFrame, embedded: DataFrame | None = None) -> None:
        """Store new chunks (as search.search takes them); the first ones also train the vectors' cells.

        A null source or index counts as an empty one. A replaced chunk is a new id, and the old one is forgotten. embedded
        has the same chunks where their vectors come from a join, so that contents aren't shuffled for it: chunks has no vectors then.
        """
        embedded = chunks if embedded is None else embedded
        placed = chunks.withColumn("part", self.part(F.coalesce(F.col("data_source_id").cast("string"), F.lit("")), F.coalesce("chunk_index", F.lit(0))))
        order = ["org_id", "part", "data_source_id", "chunk_index"]
        placed.drop("embedding").repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").option("compression", "zstd").partitionBy("org_id", "part").parquet(f"{self.path}/contents")
        slots = placed.select("org_id", "chunk_id", "part", self.slot("chunk_id").alias("slot"))
        slots.repartition("org_id", "slot").sortWithinPartitions("slot", "chunk_id").write.mode("append").partitionBy("org_id", "slot").parquet(f"{self.path}/places")
        self.words.append(lexeme_rows(placed, keys=_KEYS))
        self.grams.append(trigram_rows(placed, keys=_KEYS))
        vectors = embedded.select("org_id", "chunk_id", "embedding", *_FILTERED)
        if not self.cells.exists():
            self.cells.train(vectors)
        self.cells.append(vectors)

    def forget(self, ids: DataFrame) -> None:
        """Chunks (org_id, chunk_id) that no search finds any more; ids aren't used again."""
        ids.select("org_id", "chunk_id").distinct().write.mode("append").partitionBy("org_id").parquet(f"{self.path}/gone")

    def gone(self, org_id) -> DataFrame | None:
        fs, at = path_of(self.spark, f"{self.path}/gone")
        return self.spark.read.parquet(f"{self.path}/gone").where(F.col("org_id") == F.lit(org_id)).select("chunk_id") if fs.exists(at) else None

    def contents(self, org_id, parts: Sequence[int] | None = None) -> DataFrame:
        """A tenant's chunks, of some partitions or all."""
        at = self.spark.read.parquet(f"{self.path}/contents").where(F.col("org_id") == F.lit(org_id))
        return at if parts is None else at.where(F.col("part").isin(sorted(set(parts))))

    def _narrowed(self, found: DataFrame, org_id, collections: Sequence, chosen: Sequence[dict]) -> DataFrame:
        """found without what is gone or what the filters exclude; their columns are read, contents aren't."""
        gone = self.gone(org_id)
        found = found if gone is None else found.join(gone, "chunk_id", "left_anti")
        if not collections and not chosen:
            return found
        kept = filters.filtered(self.contents(org_id).select("org_id", *_KEYS, *_FILTERED), org_id, list(collections), list(chosen))
        return found.join(kept.select(*_KEYS), list(_KEYS), "left_semi")

    def word_leg(self, org_id, terms: fulltext.Terms, k: int, collections: Sequence = (), chosen: Sequence[dict] = ()) -> DataFrame:
        scored = word_scores(self.words, org_id, terms, ("part",))
        return search.ranked(self._narrowed(scored, org_id, collections, chosen), "score", k, 1)

    def word_matches(self, org_id, terms: fulltext.Terms, collections: Sequence = (), chosen: Sequence[dict] = ()) -> DataFrame:
        """(chunk_id) of all chunks that satisfy the terms."""
        return self._narrowed(word_matches(self.words, org_id, terms, ("part",)).drop("lex"), org_id, collections, chosen).select("chunk_id")

    def trigram_matches(self, org_id, query: str, threshold: float = trigram.THRESHOLD, collections: Sequence = (), chosen: Sequence[dict] = ()) -> DataFrame:
        """(chunk_id, word_similarity) at or above the threshold; contents are read of candidates alone."""
        found = self._narrowed(trigram_candidates(self.grams, org_id, query, threshold, ("part",)), org_id, collections, chosen)
        few = found.limit(NAMED + 1).collect()
        if len(few) <= NAMED:  # their partitions and ids are known when the contents are read
            rows = self.contents(org_id, [r.part for r in few]).where(F.col("chunk_id").isin([r.chunk_id for r in few]))
        else:
            rows = self.contents(org_id).join(found, list(_KEYS), "left_semi")
        return trigram.trigram_matches(rows.select("chunk_id", "content"), query, "content", threshold).select("chunk_id", "word_similarity")

    def trigram_leg(self, org_id, query: str, k: int, threshold: float = trigram.THRESHOLD, collections: Sequence = (), chosen: Sequence[dict] = ()) -> DataFrame:
        return search.ranked(self.trigram_matches(org_id, query, threshold, collections, chosen), "word_similarity", k, 2)

    def vector_leg(self, org_id, query: Sequence[float], k: int, collections: Sequence = (), chosen: Sequence[dict] = (), exact: bool = False) -> DataFrame:
        only = [F.col("collection_id").isin(list(collections))] if collections else []
        only += [filters.condition(f["field"], f.get("operator", "eq"), f["value"]) for f in chosen]
        near = self.cells.nearest(org_id, query, k, exact, reduce(lambda a, b: a & b, only) if only else None, self.gone(org_id))
        return search.ranked(near, "score", k, 0)

    def chunks(self, org_id, ids: Sequence) -> DataFrame:
        """A tenant's chunks by id: their places are looked up in the slots of their ids, then those partitions are read."""
        ids = sorted(set(ids))
        slots = sorted({zlib.crc32(str(i).encode()) % self.parts for i in ids})
        at = self.spark.read.parquet(f"{self.path}/places").where((F.col("org_id") == F.lit(org_id)) & F.col("slot").isin(slots) & F.col("chunk_id").isin(ids))
        parts = [r.part for r in at.select("part").distinct().collect()]
        return self.contents(org_id, parts).where(F.col("chunk_id").isin(ids)).select(*search.PAYLOAD)

    def search(self, sources: DataFrame, request: search.Request, scorer=None, exact: bool = False) -> DataFrame:
        """What search.search() gives over the same chunks, by way of the lists and cells; the vector leg is exact if asked for.

        The ranks of the legs, 9 * limit rows at most, pass the driver, which names the partitions of the results.
        """
        org, chosen = request.org_id, (request.collections, request.filters)
        k = request.fetched()
        legs = [self.vector_leg(org, request.vector, k, *chosen, exact=exact), self.word_leg(org, request.wanted(), k, *chosen), self.trigram_leg(org, request.query, k, trigram.THRESHOLD, *chosen)]
        found = search.fused(legs)
        schema, held = found.schema, [tuple(r) for r in found.collect()]
        ids = [r[0] for r in held]
        payload = self.chunks(org, ids)

        def around(top: DataFrame) -> DataFrame:
            places = [(r.data_source_id, r.chunk_index + d) for r in top.select("data_source_id", "chunk_index").collect() if r.chunk_index is not None for d in (-1, 1)]
            near = self.contents(org, [self._part(s or "", i) for s, i in places]).where(F.col("data_source_id").isin(sorted({s for s, _ in places if s is not None})) & F.col("chunk_index").isin(sorted({i for _, i in places})))
            gone = self.gone(org)
            return near if gone is None else near.join(gone, "chunk_id", "left_anti")

        return search.assembled(self.spark.createDataFrame(held, schema), payload, sources, request, scorer, around)
