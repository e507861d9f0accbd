"""Words and trigrams of many texts: grouped in Arrow's form, in bounded memory, and stored as terms of stretches of chunks."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import fulltext, trigram
from lodestrata.indexes import packed
from lodestrata.indexes.term_lists import TermLists, lexeme_rows, trigram_rows

LISTED = pa.list_(pa.string())


def peak(f):
    tracemalloc.start()
    f()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6


def batch(rows=3_000, words=1_000):
    rng = np.random.default_rng(1)
    known = ["word7", *(f"q{i}es" for i in range(5_000))]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows * words + 1, words, dtype=np.int32)), pa.array(known).take(pa.array(rng.integers(0, len(known), rows * words))))


def test_a_batch_of_many_words_is_stemmed_in_little_memory():
    words = batch()
    assert peak(lambda: fulltext._stemmed.func(words)) < 250  # 3 million words


def test_similarity_of_many_words_takes_little_memory():
    words, score = batch(), []
    assert peak(lambda: score.append(trigram.scorer("word7", 0.6)(words))) < 250
    assert score[0].to_numpy().max() == 1.0 and 0 < (score[0].to_numpy() > 0).sum() < 3_000


def test_lexemes_as_one_text_at_a_time():
    rng = random.Random(5)
    some = ["storms", "the", "running", "naïve", "ß𝒳", "7up", "sea", "of"]
    texts = [[rng.choice(some) for _ in range(rng.randrange(12))] for _ in range(300)]

    def one(words):
        found = {}
        for i, w in enumerate(words):
            if w not in fulltext.STOP:
                found.setdefault(fulltext.stem(w), []).append(i + 1)
        return [{"lexeme": k, "positions": v} for k, v in sorted(found.items())]

    got = fulltext._stemmed.func(pa.array(texts, LISTED).slice(3))
    assert got.to_pylist() == [one(t) for t in texts[3:]]
    assert fulltext._stemmed.func(pa.array([], LISTED)).to_pylist() == [] and fulltext._stemmed.func(pa.array([[], ["the"]], LISTED)).to_pylist() == [[], []]


def test_numbers_as_bytes():
    rng = np.random.default_rng(3)
    for top in (3, 300, 2**62):
        edge = np.array([0, 0, 4, 4, 9, 50, 50])
        v = rng.integers(-top, top, 50)
        coded = packed.packed(packed.steps(v, edge), edge)
        found, at = packed.unpacked(coded)
        assert at.tolist() == edge.tolist() and packed.walked(found, at).tolist() == v.tolist()
        assert packed.walked(*packed.unpacked(coded.slice(3, 2))).tolist() == v[4:50].tolist()


@pytest.mark.parametrize("kind", ["long", "string"])
def test_stored_lists_have_every_row(spark, tmp_path, kind):
    """Also of null keys and texts, of keys that aren't numbers, of several tenants in a stretch; with far fewer stored rows than pairs of chunk and term."""
    rng = random.Random(2)
    some = "storm sea seas the running naïve ß𝒳 7up of a night".split()
    rows = [(1 + i % 3, str(i) if kind == "string" else None if i == 17 else i * 1_000_003 - 5_000_000, i % 5, " ".join(rng.choice(some) for _ in range(rng.randrange(9))) if i % 11 else None) for i in range(600)]
    chunks = spark.createDataFrame(rows, f"org_id int, chunk_id {kind}, part int, content string").repartition(2)
    each = {
        "words": (lexeme_rows, F.explode(fulltext.analyzed(F.col("content"))), ["x.lexeme as term", "chunk_id", "part", "x.positions"]),
        "grams": (trigram_rows, F.explode(trigram.trigrams(F.col("content"))), ["x as term", "chunk_id", "part"]),
    }
    for name, (stored, exploded, columns) in each.items():
        lists = TermLists(spark, str(tmp_path / name), 4)
        lists.append(stored(chunks, keys=("chunk_id", "part")))
        pairs = chunks.select("org_id", "chunk_id", "part", exploded.alias("x")).selectExpr("org_id", *columns).cache()
        terms = [r.term for r in pairs.select("term").distinct().collect()]
        plain = lambda df: sorted(repr(r) for r in df.collect())
        for org in (1, 2, 3):
            own = pairs.where(F.col("org_id") == org).drop("org_id")
            assert plain(lists.lists(org, terms).select(*own.columns)) == plain(own)
            assert lists.counts(org, terms) == {r.term: r["count"] for r in own.groupBy("term").count().collect()}
        assert spark.read.parquet(f"{lists.path}/lists").count() < pairs.count() / 5


def test_trigrams_of_stored_texts(spark):
    rows = spark.createDataFrame([("Storm sea, storm",), (None,), ("",), ("ß𝒳 7up a",), ("?!",)], "t string")
    got = rows.select(trigram.trigrams(F.col("t")).alias("a"), trigram.listed(F.col("t")).alias("b")).collect()
    assert [sorted(r.a) for r in got] == [sorted(r.b) for r in got]


def test_best_begin_is_the_first_of_the_best():
    """Against every begin of the stretch, from the front, after each gram of the query."""
    rng = random.Random(4)

    def plain(query, grams):
        kept, best = [], 0.0
        for g in grams:
            kept = [x for x in kept if x != g] + [g]
            if g not in query:
                continue
            score = [len(query & set(kept[i:])) / len(query | set(kept[i:])) for i in range(len(kept))]
            best = max(best, *score)
            kept = kept[score.index(max(score)) :]
        return best

    for _ in range(2_000):
        letters = "abcdefgh"[: rng.randrange(2, 9)]
        some = lambda n: [rng.choice(letters) + rng.choice(letters) for _ in range(n)]
        query, grams = set(some(rng.randrange(1, 9))), some(rng.randrange(60))
        assert trigram.best_extent(query, grams) == plain(query, grams)
