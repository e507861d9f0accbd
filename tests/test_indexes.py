"""Stored indexes against searches that read everything: same rows, and only what a query names is read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import fulltext, trigram, vectors
from lodestrata.indexes.search_store import SearchStore
from lodestrata.indexes.term_lists import TermLists, lexeme_rows, trigram_candidates, trigram_rows, word_matches
from lodestrata.indexes.vector_cells import VectorCells, probes_needed, train_centroids, unit
from lodestrata.operators import search
from lodestrata.plans import stand_ins, stored


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files_read(df):
    """Files that the scans of a plan without exchanges opened."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def clustered(spark, n, width=24, groups=40, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(groups, width))[rng.integers(0, groups, n)] + 0.35 * rng.normal(size=(n, width))
    rows = [(1 + (i % 5 == 0), i, [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "org_id int, chunk_id long, embedding array<float>"), x


@pytest.mark.parametrize("n", [2_000, 12_000])
def test_probed_cells_find_nearly_all_neighbours(spark, tmp_path, n):
    rows, x = clustered(spark, n)
    index = VectorCells(spark, str(tmp_path / "v"))
    index.train(rows)
    index.append(rows)
    x = x.astype(np.float32).astype(np.float64)
    tenant = np.array([1 + (i % 5 == 0) for i in range(n)])
    rng, hits = np.random.default_rng(2), 0
    centroids, probes = index.model()
    assert probes < len(centroids) / 2  # clustered vectors need few cells
    some = rng.choice(np.flatnonzero(tenant == 1), 12, replace=False)
    for i in some:
        q = unit(x[i] + 0.1 * rng.normal(size=x.shape[1]))
        score = np.where(tenant == 1, unit(x) @ q, -2)
        true = set(np.argsort(-score, kind="stable")[:10].tolist())
        hits += len(true & {r.chunk_id for r in index.nearest(1, q, 10).collect()})
    assert hits / (10 * len(some)) >= 0.95


def test_exact_search_and_pruned_partitions(spark, tmp_path):
    rows, x = clustered(spark, 3_000)
    index = VectorCells(spark, str(tmp_path / "v"))
    index.train(rows, sample=1_000, cells=50)
    index.append(rows.where("chunk_id < 2000"))
    index.append(rows.where("chunk_id >= 2000"))
    for i in (3, 77, 1234):
        q = [float(v) for v in x[i] + 0.3]
        want = vectors.top_by_cosine(rows.where("org_id = 1").withColumnRenamed("chunk_id", "id"), q, 15).select("id", "score").collect()
        got = index.nearest(1, q, 15, exact=True, probes=1).collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert index.vectors().count() == 3_000
    plan = plan_of(index.rows_of(2, [3, 7]))
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1].split("]")[0]
    assert 0 < files_read(index.rows_of(1, [3])) < files_read(index.vectors()) / 10
    # fewer than k in the probed cells: the others are read too
    assert index.nearest(2, q, 1000, probes=1).count() == 600
    assert index.nearest(1, q, 5, only=F.col("chunk_id") < 3, probes=1).count() == 2


def test_vectors_without_direction_and_widths(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, None), (1, 2, [0.0, 0.0]), (1, 3, [1.0, None]), (1, 4, [float("nan"), 1.0]), (1, 5, [1.0, 0.0]), (1, 6, [1.0, 0.0])], "org_id int, chunk_id long, embedding array<float>")
    index = VectorCells(spark, str(tmp_path / "v"))
    index.train(rows)
    index.append(rows)
    assert [r.chunk_id for r in index.nearest(1, [2.0, 0.0], 5).collect()] == [5, 6] and index.nearest(9, [1.0, 0.0], 5).count() == 0
    with pytest.raises(Exception, match="widths"):
        index.append(spark.createDataFrame([(1, 7, [1.0, 0.0, 0.0])], rows.schema))
    with pytest.raises(ValueError, match="widths"):
        index.nearest(1, [1.0], 5)


def test_more_probes_for_vectors_without_clusters():
    rng = np.random.default_rng(3)
    x = unit(rng.normal(size=(3000, 32)))
    c = train_centroids(x, 60)
    assert probes_needed(x, c) > 15 and len(np.unique(np.round(c, 9), axis=0)) == 60


WORDS = ["stormy", "storm", "sea", "seas", "sailor", "running", "runs", "run", "harbour", "light", "night", "knight", "the", "of"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(6)
    rows = [(1 + (i % 7 == 0), i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(12)))) for i in range(600)]
    rows += [(1, 1000 + i, "common word" if i % 2 else "Common, WORD sea") for i in range(400)] + [(1, 2000, None), (1, 2001, "")]
    return spark.createDataFrame(rows, "org_id int, chunk_id long, content string")


@pytest.fixture(scope="module")
def lists(spark, texts, tmp_path_factory):
    at = tmp_path_factory.mktemp("lists")
    words, grams = TermLists(spark, str(at / "w"), 8), TermLists(spark, str(at / "g"), 8)
    for part in (texts.where("chunk_id % 2 = 0"), texts.where("chunk_id % 2 = 1")):
        words.append(lexeme_rows(part))
        grams.append(trigram_rows(part))
    return words, grams


TERMS = [
    fulltext.Terms(all=("sea", "night")), fulltext.Terms(all=("run",), none=("storms",)), fulltext.Terms(any=(("sailors", "knights"), ("light", "harbour"))), fulltext.Terms(phrases=(("stormy", "seas"),)),
    fulltext.Terms(phrases=(("sea", "of", "night"),), none=("run",)), fulltext.Terms(all=("absent", "sea")), fulltext.Terms(all=("the",)), fulltext.Terms(none=("sea",)), fulltext.Terms(all=("common",), any=(("sea", "word"),)),
]


@pytest.mark.parametrize("terms", TERMS)
def test_word_lists_match_as_texts_do(texts, lists, terms):
    want = texts.where("org_id = 1").where(fulltext.matches(fulltext.analyzed(F.col("content")), terms))
    assert sorted(r.chunk_id for r in word_matches(lists[0], 1, terms).collect()) == sorted(r.chunk_id for r in want.collect())


@pytest.mark.parametrize("query", ["stormy sea", "knigt", "harbor lights", "common word", "zzz", "?!", "sailing the sea of night"])
@pytest.mark.parametrize("threshold", [0.3, 0.6, 1.0])
def test_trigram_lists_lose_no_match(texts, lists, query, threshold):
    own = texts.where("org_id = 1")
    want = {r.chunk_id: r.word_similarity for r in trigram.trigram_matches(own, query, "content", threshold).collect()}
    found = own.join(trigram_candidates(lists[1], 1, query, threshold), "chunk_id", "left_semi")
    got = {r.chunk_id: r.word_similarity for r in trigram.trigram_matches(found, query, "content", threshold).collect()}
    assert got == want


def test_only_the_lists_of_the_query_are_read(spark, texts, lists):
    counts = lists[0].counts(1, ["sea", "common", "absent"])
    own = texts.where("org_id = 1")
    assert counts == {w: own.where(fulltext.has(fulltext.analyzed(F.col("content")), w)).count() for w in ("sea", "common")}
    plan = plan_of(lists[0].lists(1, ["sea"]))
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in filters and "org_id" in filters and "term" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert 0 < files_read(lists[1].lists(1, ["sea"])) < files_read(spark.read.parquet(f"{lists[1].path}/lists")) / 4


def test_a_store_answers_as_a_scan_does(spark, sf, tmp_path):
    """Also after chunks came in two loads and some were forgotten, with filters, and for another tenant."""
    chunks = stand_ins.chunks(spark, sf).cache()
    sources = stand_ins.data_sources(spark, sf)
    other = chunks.limit(20).withColumns({"org_id": F.lit(2), "chunk_id": F.col("chunk_id") + 10_000})
    store = SearchStore(spark, str(tmp_path / "s"), parts=8, buckets=8)
    store.append(chunks.where("chunk_id % 3 <> 0"))
    store.append(chunks.where("chunk_id % 3 = 0").unionByName(other))
    store.forget(chunks.where("chunk_id % 11 = 5"))
    left = chunks.where("chunk_id % 11 <> 5")
    q = stand_ins.query_vector(spark, sf)
    kinds = ({"field": "type", "operator": "in", "value": ["PDF", "SLACK"]},)
    for request in (
        search.Request(1, "nicht die", q, expand_context=True),
        search.Request(1, "the thing", q, filters=kinds, rerank=True, expand_context=True, limit=5),
        search.Request(1, "the", q, collections=("en", "fr"), terms=fulltext.Terms(any=(("nicht", "thing"),))),
    ):
        want = search.search(left, sources, request).collect()
        got = store.search(sources, request, exact=True)
        assert sorted(got.columns) == sorted(search.search(left, sources, request).columns)
        assert [r.asDict() for r in got.collect()] == [{k: r[k] for k in r.asDict()} for r in want]
    assert {r.chunk_id for r in store.search(sources, search.Request(2, "the", q)).collect()} <= {r.chunk_id for r in other.collect()}
    few = store.chunks(1, [7])
    assert [r.chunk_id for r in few.collect()] == [7] and files_read(few) <= 2


def test_indexed_search_is_the_search(spark, sf):
    from lodestrata.plans.registry import QUERIES

    rows = lambda name: [{k: str(v) for k, v in sorted(r.asDict().items())} for r in QUERIES[name](spark, sf).collect()]
    assert rows("hybrid_search_indexed") == rows("hybrid_search") == rows("hybrid_search_stored")
    assert stored.store(spark, sf).gone(1) is None
