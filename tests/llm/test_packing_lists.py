"""Look-ups of packing: as many rows as seeds ask for, bounded memory, and the lists of brute force whatever isn't scored."""

import gc
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.llm import packing, tokens
from lodestrata.llm.packing import B, K1, Corpus, Index, Lists


def words(rng, n):
    """Texts in three vocabularies that share some words, short and long ones, some twice in another order."""
    docs = []
    for i in range(n):
        docs.append(np.where(rng.random(size := int(rng.choice([2, 20, 80, 300]))) < 0.1, rng.integers(3, 13, size), 20 + 300 * (i % 3) + np.minimum(rng.zipf(1.2, size), 299)))
    return docs + [x[::-1] for x in docs[:20]]


def test_rows_do_not_grow_with_indexes(spark):
    rng = np.random.default_rng(2)
    rows = [(i, bytearray(x.astype(np.uint16).tobytes())) for i, x in enumerate(words(rng, 400))]
    entries = spark.createDataFrame(rows, "c long, ids binary").repartition(3)
    texts = [np.frombuffer(bytes(x), np.uint16) for _, x in rows]
    df = np.bincount(np.concatenate([np.unique(x) for x in texts]), minlength=1000)
    corpus = Corpus(df, len(texts), sum(map(len, texts)))
    seeds = entries.where("c % 10 = 0")
    one, many = ({(r.seed, r.c) for r in packing.lists(entries, seeds, corpus, 5, np.uint16, most).collect()} for most in (1 << 20, 500))
    assert one == many and len(one) <= 5 * seeds.count()


def test_rows_are_bounded_with_many_short_texts():
    rng = np.random.default_rng(3)
    n, each = 120_000, 20
    ids = rng.integers(3, 203, n * each).astype(np.uint16)
    df = np.full(203, n // 10)
    assert Index(ids, np.full(n, each), Corpus(df, n, n * each)).rows.size <= packing.CELLS <= 16 << 20


@pytest.mark.parametrize("asked", [3, 64])
def test_what_is_not_scored_is_on_no_list(monkeypatch, asked):
    monkeypatch.setattr(packing, "ASKED", asked)
    rng = np.random.default_rng(5)
    docs = words(rng, 500)
    pairs = [np.unique(x, return_counts=True) for x in docs]
    df = np.bincount(np.concatenate([t for t, _ in pairs]), minlength=1000)
    size = np.array([len(x) for x in docs])
    corpus = Corpus(df, len(docs), size.sum())
    seeds = sorted(rng.choice(len(docs), 150, replace=False).tolist(), key=lambda i: (i % 3, len(pairs[i][0])))
    got = Lists(np.array(seeds), [pairs[i][0] for i in seeds], 7)
    for part in np.array_split(rng.permutation(len(docs)), 6):
        got.ask(Index.of([pairs[i][0] for i in part], [pairs[i][1] for i in part], corpus), part)
    weight = np.zeros((len(docs), 1000))
    for i, (t, tf) in enumerate(pairs):
        weight[i, t] = np.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[i] / size.mean()))
    for at, i in enumerate(seeds):
        score = weight[:, pairs[i][0]].sum(1)
        score[i] = -1
        want = [j for j in sorted(range(len(docs)), key=lambda j: (-round(score[j], 4), j)) if score[j] > 0][:7]
        found = got.c[at][got.score[at] > 0]
        assert len(found) == len(want) and np.allclose(got.score[at][: len(want)], score[want], rtol=1e-4)
        assert i not in found and np.allclose(score[found], score[want], rtol=1e-4)


def test_tokenizing_keeps_little_memory():
    """A worker lives on next to the JVM, so what it remembers of words must be small."""
    tk = tokens.WordTokenizer()
    tk.encode(pa.array(["warm up"]))
    rng = np.random.default_rng(7)
    texts = pa.array([" ".join("".join(map(chr, x)) for x in rng.integers(97, 123, (500, 9))) for _ in range(120)])
    gc.collect()
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    ids, counts = tk.encode(texts)
    want = [tk.library.encode(texts[i].as_py(), add_special_tokens=False).ids for i in (0, 119)]
    assert ids[: counts[0]].tolist() == want[0] and ids[-counts[-1] :].tolist() == want[1]
    del ids, counts, want
    gc.collect()
    kept = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert kept < 60_000 * 60


def test_remembered_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 50)
    monkeypatch.setattr(tokens, "SLICE", 200)
    tk = tokens.WordTokenizer()
    texts = [" ".join(f"{w}{i % 7}{w}é x{w}日 " for w in ("ab", "cde", "fghi", "don't")) for i in range(60)] + [None, "", " "]
    ids, counts = tk.encode(pa.array(texts))
    edge = np.cumsum(counts)
    for text, e, n in zip(texts, edge, counts):
        assert ids[e - n : e].tolist() == tk.library.encode(text or "", add_special_tokens=False).ids
    assert len(tk.known) == len(tk.coded) <= 50
