"""Token ids against the library itself; packing as an exact round trip; limits against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.llm import tokens
from lodestrata.llm.packing import B, INDEX, K1, Corpus, Index, _corpus, _encoded, _entries, _windows, neighbours, pack
from lodestrata.llm.token_counts import quantile_length, token_counts, truncated_total
from lodestrata.llm.tokens import tokenizer, vocabulary_path

TOPICS = "apple banana bridge camera castle church coffee cotton desert doctor dragon engine forest garden guitar hammer harbor island jacket jungle kitchen ladder lemon marble mirror monkey ocean orange palace pencil pepper planet pocket rabbit river rocket silver temple tiger violin".split()
ODD = [None, "", " \n\t ", "Don't 'S 123 a1b2 x--y!?", "<|endoftext|> a<|startoftext|>b <|", "ΑΣ ΟΔΟΣ. ß İstanbul", "é ́x a\xa0b x\x1cy\x85z", "日本語 text 😀😀", "ﬁ ª²³ ǅ ɐ", "a" * 5000, "word\n" * 20000]


def library_ids(texts):
    return [tokenizer().library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_ids(spark, sf):
    texts = ODD + [f"{chr(c)} {chr(c)}{chr(c)}a 1{chr(c)}'{chr(c)}'s ({chr(c)})" for c in range(0x251)] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    ids, counts = tokenizer(vocabulary_path()).encode(pa.array(texts, pa.string()))
    edge = np.cumsum(counts)
    for t, e, n, want in zip(texts, edge, counts, library_ids(texts)):
        assert ids[e - n : e].tolist() == want, t
    assert len(tokenizer().encode(pa.array([], pa.string()))[1]) == 0


@pytest.mark.parametrize("shard", [20_000, 4 << 20])
def test_packing_round_trip(spark, sf, shard):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    got = pack(df, shard_bytes=shard).collect()
    whole = {i: np.array([*x, 2], "<u4") for (i, _), x in zip(rows, library_ids([t for _, t in rows]))}
    parts, sequences = {}, {}
    for r in got:
        assert r.doc_tokens == len(whole[r.doc_id]) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(whole[r.doc_id][r.start : r.start + r.length].tobytes())
        parts.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_tokens, r.padded_to))
    assert set(parts) == set(whole)
    for ranges, size in ((parts[d], len(whole[d])) for d in whole):
        at = 0
        for start, length in sorted(ranges):
            assert start == at
            at += length
        assert at == size
    short = 0
    for pieces in sequences.values():
        at = 0
        for offset, length, _, _ in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096 and {p[2] for p in pieces} == {at}
        (padded,) = {p[3] for p in pieces}
        assert at <= padded < 2 * at + 1 and padded & (padded - 1) == 0
        short += at < 4096
    assert short <= len({s >> 32 for s in sequences})


def test_packing_edges(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    got = pack(df).collect()
    assert sorted(r.doc_tokens for r in got) == [1, 2, 3, 3] and sum(r.doc_id is None for r in got) == 1
    assert pack(df.limit(0)).count() == 0


def test_neighbours_share_words(spark):
    rows = [(i, " ".join(f"topic{i % 5} alpha{i % 5} beta{i % 5} gamma{i % 5}" for _ in range(60))) for i in range(200)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.seed_id % 5 == r.doc_id % 5 for r in got) > 0.7 * len(got)


def test_topics_meet_over_many_shards(spark):
    rng = random.Random(3)
    rows = [(i, " ".join([f"w{rng.randrange(90)}" for _ in range(60)] + [f"{TOPICS[i * 7919 % 40]} " * 4])) for i in range(2000)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string"), window=512, shard_bytes=20_000).collect()
    assert len({r.sequence_id >> 32 for r in got}) > 10
    topic = lambda i: i * 7919 % 40
    assert sum(topic(r.seed_id) == topic(r.doc_id) for r in got) > 0.8 * len(got)


def test_neighbours_by_all_terms():
    rng = np.random.default_rng(4)
    docs = [np.append(rng.integers(3, 400, rng.integers(100, 300)), 2) for _ in range(60)]
    sets = [set(d[:-1].tolist()) for d in docs]
    df = np.bincount(np.concatenate([list(x) for x in sets]), minlength=400)
    mean = sum(len(d) - 1 for d in docs) / 60
    counts = np.array([len(d) - 1 for d in docs])
    index = Index(np.concatenate([d[:-1] for d in docs]), counts, Corpus(df, 60, counts.sum()))
    for seed in range(5):
        score = np.zeros(60)
        for j in range(60):
            for t in sets[seed] & sets[j]:
                tf = (docs[j] == t).sum()
                score[j] += np.log(1 + (60 - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (len(docs[j]) - 1) / mean))
        want = sorted(np.flatnonzero(score), key=lambda j: -score[j])
        own = np.array(sorted(sets[seed]))
        found, got = index.nearest([own], 60)[0]
        assert found.tolist() == want and np.allclose(got, score[want])
        (few, _), (none, _) = index.nearest([own, np.array([1])], 7)
        assert few.tolist() == want[:7] and len(none) == 0


@pytest.mark.parametrize("index_tokens", [INDEX, 400_000])
def test_recall_over_shards(spark, index_tokens):
    """The lists are the true ten nearest by all terms of all documents, but for ties and roundings, however many shards are asked."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    dtype = tokenizer().dtype
    encoded = _encoded(docs.selectExpr("doc_id id", "doc_id salt", "1L size", "text"), None)
    corpus = _corpus(encoded)
    entries = _entries(encoded.where("n is null").selectExpr("id", "salt", "size", "ids", "xxhash64(ids) c"), corpus, 4096, dtype)
    rows = sorted((r.c, bytes(r.ids)) for r in entries.select("c", "ids").collect())
    texts = [np.frombuffer(x, dtype).astype(np.int64) for _, x in rows]
    of = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    pair, tf = np.unique(of << 32 | np.concatenate(texts), return_counts=True)
    of, term = pair >> 32, pair & 0xFFFFFFFF
    size = np.array([len(x) for x in texts])
    weight = np.log(1 + (corpus.n - corpus.df[term] + 0.5) / (corpus.df[term] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[of] / corpus.mean))
    seeds = [i for i in range(0, len(texts), len(texts) // 100) if len(texts[i])]
    asked = entries.where(entries.c.isin([rows[i][0] for i in seeds]))
    got: dict = {}
    for r in neighbours(entries, asked, corpus, 10, dtype, index_tokens).collect():
        got.setdefault(r.seed, {})[r.rank] = r.c
    hits = 0
    for i in seeds:
        own = np.zeros(len(corpus.df))
        own[texts[i]] = 1
        score = np.bincount(of, weight * own[term], len(texts))
        score[i] = -1
        assert sorted(got[rows[i][0]]) == list(range(1, 11))
        hits += len({rows[j][0] for j in np.argsort(-score)[:10]} & set(got[rows[i][0]].values()))
    assert hits >= 0.99 * 10 * len(seeds), hits / len(seeds)


def plain_windows(docs, names, window):
    """The windows of one stretch in plain Python: passes over the texts in order, one copy of each that the window doesn't hold."""
    texts = [d.tobytes() for d in docs]
    turn = [sum((texts[j], names[j]) == (texts[i], names[i]) for j in range(i)) for i in range(len(docs))]
    waiting = {t: sorted((i for i in range(len(docs)) if texts[i] == t), key=lambda i: (turn[i], i)) for t in texts}
    out, held, at = [], [], 0  # at: tokens laid out, padding included
    while any(waiting.values()):
        ready = [t for t in waiting if waiting[t]]
        some = False
        for t in ready + ready[:1]:
            last = t is ready[0] and some is None
            if not last and t in {texts[h] for h in held}:
                some = None if t is ready[-1] and not some else some
                continue
            if last and names[waiting[t][0]] is not None and any((texts[h], names[h]) == (t, names[waiting[t][0]]) for h in held):
                at, held = -(-at // window) * window, []
                continue
            if t is ready[0] and some:
                continue
            doc = waiting[t].pop(0)
            some, start = True, 0
            held.append(doc)
            while start < len(docs[doc]):
                take = min(len(docs[doc]) - start, window - at % window)
                out.append((doc, start, take, at // window, at % window))
                start, at = start + take, at + take
                if at % window == 0:
                    held = [doc] if start < len(docs[doc]) else []
    return out


@pytest.mark.parametrize("copies", [0, 1])
def test_windows_by_plain_python(copies):
    rng = np.random.default_rng(8 + copies)
    docs = [np.append(np.minimum(rng.zipf(1.4, rng.integers(3, 60)) + 2, 400), 2) for _ in range(70)]
    names = list(range(70))
    if copies:
        again = rng.integers(0, 30, 40)
        docs, names = docs[:30] + [docs[i] for i in again], list(range(30)) + [int(i) if i % 3 else None if i % 2 else 100 + int(i) for i in again]
    assert _windows(docs, names, 128) == plain_windows(docs, names, 128)


def test_copies_never_share_a_window(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 0").limit(60)
    got = pack(docs.crossJoin(spark.range(3).select("id")).select("doc_id", "text")).collect()
    begun = Counter((r.doc_id, r.sequence_id) for r in got if r.start == 0)
    assert set(begun.values()) == {1} and sum(begun.values()) == 180
    assert sum(r.padded_to for r in {(x.sequence_id, x.padded_to): x for x in got}.values()) < 1.1 * sum(r.length for r in got)


def test_equal_rows_are_dealt_over_shards(spark):
    df = spark.createDataFrame([(None, "one two three four five " * 4)], "doc_id long, text string").crossJoin(spark.range(5000)).select("doc_id", "text").repartition(3)
    got = pack(df, shard_bytes=40_000).collect()
    sizes = Counter(r.sequence_id >> 32 for r in got if r.start == 0)
    assert len(sizes) > 10 and sum(sizes.values()) == 5000
    assert max(sizes.values()) < 2 * 5000 / len(sizes)


def test_long_texts_in_parts(monkeypatch):
    text = "Don't stop\n<|endoftext|> now, 12 ΑΣ İstanbul x--y!?\t" * 40 + "z" * 300 + " end"
    whole = library_ids([text])[0]
    monkeypatch.setattr(tokens, "SLICE", 100)
    ids, counts = tokens.WordTokenizer().encode(pa.array([None, text, "", text, "a b"]))
    assert counts.tolist() == [0, len(whole), 0, len(whole), 2]
    assert ids[: len(whole)].tolist() == whole == ids[len(whole) : 2 * len(whole)].tolist()


def test_limits_edges(spark):
    df = spark.createDataFrame([("a b", 7, 1)] * 3 + [(None, 8, 1)], "text string, length long, docs long")
    assert sorted((r.context_limit, r.docs, r.tokens_total) for r in token_counts(df).collect()) == [(0, 1, 6), (2, 3, 6)]


def test_limits(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    lengths = [len(x) for x in library_ids([r.text for r in docs.collect()])]
    out = token_counts(docs)
    rows = out.collect()
    assert [r.context_limit for r in sorted(rows)] == sorted(set(lengths))
    for r in rows:
        n = r.context_limit
        assert r.docs == lengths.count(n) and r.docs_within == sum(x <= n for x in lengths) and r.docs_above == len(lengths) - r.docs_within
        assert r.tokens_within == sum(x for x in lengths if x <= n) and r.tokens_total == sum(lengths)
        assert r.tokens_truncated == sum(min(x, n) for x in lengths)
    for n in (0, 7, 500, 10**6):
        assert out.agg(truncated_total(out, n)).first()[0] == sum(min(x, n) for x in lengths)
    assert out.agg(quantile_length(out, 0.5)).first()[0] == sorted(lengths)[-(-len(lengths) // 2) - 1]
    assert token_counts(docs.limit(0)).count() == 0
