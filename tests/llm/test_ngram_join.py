import random
import re

import numpy as np
import pytest

from lodestrata.llm import ngram_join
from lodestrata.llm import shingles as shingles_
from lodestrata.llm.ngram_join import ngram_jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for j in range(i):
            b, y = sets[j]
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                up[root(i)] = root(j)
    best = {}
    for i, (a, _) in enumerate(sets):
        if a is not None:
            best[root(i)] = min(a, best.get(root(i), a))
    return sorted(((a, len(s), best.get(root(i)) if a is not None else None) for i, (a, s) in enumerate(sets)), key=str)


def found(spark, rows, schema="doc_id long, text string"):
    out = ngram_jaccard_join(spark.createDataFrame(rows, schema))
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str)


def test_families_of_near_copies(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocab, k=60)
    rows = []
    for size in (3, 6, 12, 40, 150, 400):
        for _ in range(3):
            base = rng.choices(vocab, k=size)
            for _ in range(14):
                text = list(base)
                for _ in range(rng.randint(0, max(1, size // 25))):
                    text[rng.randrange(len(text))] = rng.choice(vocab)
                if rng.random() < 0.4:
                    at = rng.randrange(len(text))
                    text = text[:at] + passage + text[at:]
                if rng.random() < 0.3:
                    text = text[: -max(1, len(text) // 8)]
                rows.append((len(rows), " ".join(text).upper() if rng.random() < 0.5 else "\n".join(text)))
    rng.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_small_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(spark, rows) == brute(rows)


def test_links_are_all_counted(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for size in (60, 200):
        base = rng.choices(vocab, k=size)
        for _ in range(60):
            text = list(base)
            for _ in range(rng.randint(0, size // 40)):
                text[rng.randrange(size)] = rng.choice(vocab)
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows), rows[0][1]), (len(rows) + 1, "alone"), (5, rows[5][1]), (None, rows[6][1])]
    sets = {shingles(t) for i, t in rows if i is not None}
    want = {i: sum(100 * len(s & x) >= 75 * len(s | x) for x in sets if x != s) for i, t in rows for s in [shingles(t)] if i is not None}
    assert {r.doc_id: r.links for r in ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id is not None} == want
    assert max(want.values()) > 40


def test_sets_of_two_bands_share_a_symbol():
    bands, pairs = ngram_join.Bands(), 60_000
    rng = np.random.default_rng(7)
    for small, large in ((4, 5), (6, 8), (7, 9)):
        big = np.sort(rng.integers(0, 1 << 64, (pairs, large), dtype=np.uint64), axis=1)
        sets = np.concatenate([np.sort(big[:, :small], axis=1).ravel(), big.ravel()])
        sizes = np.repeat([small, large], pairs)
        keys = [(symbols, owner) for symbols, owner, _, _ in ngram_join.keys(sets, sizes, None, bands)]
        symbols, owner = (np.concatenate(x) for x in zip(*keys))
        seen = np.unique(np.stack([symbols, (owner % pairs).astype(np.uint64), (owner // pairs).astype(np.uint64)], 1), axis=0)
        same = (seen[1:, 0] == seen[:-1, 0]) & (seen[1:, 1] == seen[:-1, 1])
        assert len(np.unique(seen[1:, 1][same])) == pairs


def test_words_alike_in_letters_differ():
    a, b = "a", "b"
    for _ in range(10):  # such words have one sum of powers modulo 2^64
        a, b = a + b, b + a
    words = [a, b, "ab" * 4, "ab" * 8, "abcdefgh" + "ijklmnop", "ijklmnop" + "abcdefgh", "x", "xx", "x" * 8, "x" * 9, "x" * 16, "x\0", "\0"]
    hashes = shingles_.word_hashes([w.encode() for w in words])[0]
    assert len(set(hashes.tolist())) == len(words)
    assert shingles_.word_hashes([a.upper().encode()])[0] == hashes[0]


def test_long_texts_are_hashed_in_parts(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join("w" * rng.randint(1, 30) + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 80))) + rng.choice(["", "\n", " \t "]) for _ in range(30)]
    whole = [(a, b.tolist(), c.tolist()) for a, b, c in shingles_.shingle_sets(texts)]
    counts = shingles_.word_hashes([t.encode() for t in texts])[1].tolist()
    assert counts == [sum(len(WORD.findall(t)) for t in texts[:i]) for i in range(31)]
    monkeypatch.setattr(shingles_, "CHUNK", 50)
    h, n = shingles_.word_hashes([t.encode() for t in texts])
    assert n.tolist() == counts
    parts = [(b.tolist(), c.tolist()) for _, b, c in shingles_.shingle_sets(texts)]
    assert sum((b for b, _ in parts), []) == whole[0][1] and sum((c for _, c in parts), []) == whole[0][2]


def test_edges(spark):
    long = " ".join(f"x{i % 997}y{i % 1009}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one"), (7, "É é"), (8, "é é"), (9, long), (10, long + " tail"), (9, long), (11, "a b c d e"), (12, "a b c d e")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 0, 0, 0), (2, "a b", 0, 0, 0)], "doc_id long, text string, sig int, n int, component_id int")
    assert {r.component_id for r in ngram_jaccard_join(df).collect()} == {1}


@pytest.mark.parametrize("bad", [0.5, 1.2])
def test_bounds(spark, bad):
    with pytest.raises(ValueError):
        ngram_jaccard_join(spark.createDataFrame([], "doc_id long, text string"), bad)


def test_sets_that_share_a_name_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "NAME_BITS", 5)
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(40):
        base = rng.choices(vocab, k=60)
        for _ in range(3):
            text = list(base)
            text[rng.randrange(60)] = rng.choice(vocab)
            rows.append((len(rows), " ".join(text)))
    rows += [(200, rows[3][1]), (None, rows[4][1]), (None, "in no other row"), (201, "")]
    assert found(spark, rows) == brute(rows)


def test_components_of_a_family_are_joined_by_a_forest():
    """Sets in a chain that all share one symbol: the links between them are as many as join them, whatever the pairs."""
    import pyarrow as pa

    base = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sets = [np.sort(base[10 * i : 10 * i + 200]) for i in range(12)]
    rows = pa.table({"sig": pa.array(range(12), pa.int64()), "n": [200] * 12, "comp": pa.array(range(12), pa.int64()), "block": [0] * 12, "lo": [0] * 12, "hi": [0] * 12})
    rows = rows.append_column("members", pa.array([s.tobytes() for s in sets])).append_column("sketch", pa.array([ngram_join.bit_sketch(s) for s in sets]))
    out = ngram_join._across(ngram_join.Bands())(rows)
    assert out.num_rows == 11
    assert all(abs(a - b) <= 2 for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist()))
