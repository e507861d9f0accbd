"""Periodic runs against every period tried in turn, and edges of the operator and its query."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import runs


def every_period(w, shortest):
    """Runs of a list by comparing it with itself at each distance."""
    out = set()
    for q in range(1, len(w) // 2 + 1):
        same = [i for i in range(len(w) - q) if w[i] == w[i + q]]
        for i in same:
            if i and i - 1 in set(same):
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, n = i, j - i + q
            if n >= max(shortest, 2 * q) and not any(all(w[x] == w[x + p] for x in range(s, s + n - p)) for p in range(1, q)):
                out.add((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("shortest", [2, 12])
def test_all_runs_of_random_texts(shortest):
    rng, texts = random.Random(shortest), []
    for _ in range(400):
        n, k = rng.randrange(50), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.4:
            a = rng.randrange(n)
            p = rng.randrange(1, n - a + 1)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        texts.append(w)
    rows = runs.runs_of(np.array([x for w in texts for x in w]), np.array([len(w) for w in texts]), shortest)
    got = [[] for _ in texts]
    for t, s, n, q in rows.tolist():
        got[t].append((s, n, q))
    assert got == [every_period(w, shortest) for w in texts]
    assert sum(map(len, got)) > 100


def test_filter_of_texts_loses_none():
    rng = random.Random(3)
    texts = [[b"%d" % rng.randrange(2) for _ in range(rng.randrange(40))] for _ in range(300)]
    assert [list(map(tuple, x.tolist())) for x in runs.find_runs(texts)] == [every_period(w, 12) for w in texts]


def test_edges(spark):
    again = "a b c " * 5
    rows = [(1, again, "x"), (1, again, "x"), (2, None, "y"), (3, "", None), (None, " \t\n ", "z"), (5, "p q " * 12, "w"), (6, "one two three", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = runs.periodic_runs(docs, keep=("doc_id", "runs")).collect()
    by = {(r.doc_id, r.runs): r for r in got}
    assert len(got) == 7 and sum(r.doc_id == 1 for r in got) == 2
    assert [tuple(x) for x in by[1, "x"].runs_] == [(0, 15, 3)] and by[1, "x"].collapsed == "a b c"
    assert [tuple(x) for x in by[5, "w"].runs_] == [(0, 12, 1)] and by[5, "w"].collapsed == "p q"
    for key in ((2, "y"), (3, None), (None, "z")):
        assert by[key].n_words == 0 and by[key].runs_ == [] and by[key].collapsed == ""
    assert by[6, "v"].runs_ == [] and by[6, "v"].collapsed == "one two three"
    assert runs.documents_runs(docs.limit(0)).count() == 0
    digests = {r.doc_id: r for r in runs.documents_runs(docs).collect()}
    assert digests[2].n_runs == 0 and digests[2].start is None and digests[2].exponent_milli is None
    assert digests[None].collapsed_sha256 == hashlib.sha256(b"").hexdigest()


def test_texts_that_are_not_utf8(spark):
    docs = spark.range(1).select(F.lit(1).alias("doc_id"), F.expr("cast(unhex(repeat('ff206120', 9)) as string)").alias("text"))
    row = runs.periodic_runs(docs).select("n_words", "runs", F.hex(F.col("collapsed").cast("binary")).alias("x")).first()
    assert row.n_words == 18 and [tuple(x) for x in row.runs] == [(0, 18, 2)] and row.x == "FF2061"


def test_very_long_text(spark):
    """300,000 words: a random part, then 600 words over and over."""
    rng = random.Random(5)
    w = [f"w{rng.randrange(5000)}" for _ in range(100_600)]
    text = " ".join(w + w[-600:] * 333)
    docs = spark.createDataFrame([(3, text)], "doc_id long, text string")
    row = runs.periodic_runs(docs).first()
    assert (100_000, 600 * 334, 600) in [tuple(x) for x in row.runs] and row.collapsed == " ".join(w)


def test_ends_repeat_as_the_id_says(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.col("id")), lambda x: x.cast("string")), "  ").alias("text"))
    import zlib

    for r in docs.withColumn("new", runs.repeating_ends(F.col("doc_id"), F.col("text"))).collect():
        w, h = r.text.split(), zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert r.new.split() == w
