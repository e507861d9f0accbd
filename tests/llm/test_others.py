"""Sharding round trips, language ID accuracy, WARC links, neighbour recall."""

import gzip
import hashlib
import math
import re
import threading
import zlib
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import ann, langid, warc
from lodestrata.llm.compaction import Conflict, ShardTable, size_tiered_compaction


def same_rows(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_sharding(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(3).unionByName(spark.createDataFrame([(None, None, None, None, None), (7, "", "en", None, 0), (7, "", "en", None, 0)], docs.schema))
    t = ShardTable(spark, str(tmp_path / "t"), target=1 << 20, fanout=3, smallest=16 << 10)
    assert t.version() == 0 and t.compact()["runs"] == []
    t.append(odd)
    for i in range(6):
        t.append(docs.where(F.col("doc_id") % 6 == i))
    before = t.manifest()
    whole = docs.unionByName(odd)
    assert before["version"] == 7 and same_rows(t.read(), whole)
    after = t.compact()
    assert same_rows(t.read(), whole) and same_rows(t.read(7), whole)
    tiers = [r["tier"] for r in after["runs"]]
    assert max(map(tiers.count, tiers)) < 3 and len(after["runs"]) < 7
    with pytest.raises(Conflict):
        t.commit(before, [])
    assert t.vacuum() > 0 and same_rows(t.read(), whole) and t.version() == after["version"]


def test_runs_of_target_sized_files_stay(spark, tmp_path):
    t = ShardTable(spark, str(tmp_path / "t"), target=20_000, fanout=2, smallest=1_000)
    rows = spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("x"))
    for lo in range(0, 40_000, 5_000):
        t.append(rows.limit(5_000).repartition(40))
    first = t.compact()
    assert all(t.settled(r) for r in first["runs"]) or len(first["runs"]) < 2
    written = {r["id"] for r in first["runs"]}
    assert t.compact()["version"] == first["version"] and {r["id"] for r in t.manifest()["runs"]} == written
    sizes = [f.stat().st_size for r in written for f in (tmp_path / "t/runs" / r).glob("*.parquet")]
    assert max(sizes) < 2.5 * 20_000 and t.read().count() == 40_000


def test_only_one_of_many_writers_commits_a_version(spark, tmp_path):
    tables = [ShardTable(spark, str(tmp_path / "t")) for _ in range(8)]
    tables[0].commit({"version": 0, "runs": []}, [])
    with ThreadPoolExecutor(8) as pool:
        for turn in range(25):
            base = tables[0].manifest()
            gate = threading.Barrier(8)

            def write(i, base=base, gate=gate):
                gate.wait()
                try:
                    return tables[i].commit(base, [{"id": f"r{i}", "bytes": 1, "files": 1, "tier": 0}])
                except Conflict:
                    return None

            won = [x for x in pool.map(write, range(8)) if x]
            assert len(won) == 1 and tables[0].manifest() == won[0] and won[0]["version"] == turn + 2
    assert [f.name for f in (tmp_path / "t/manifests").iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")] == []


def test_sharding_query(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("arrival", F.lit(1))
    got = size_tiered_compaction(docs, 5).collect()
    assert sorted((r.doc_id, r.text_md5) for r in got) == sorted((r.doc_id, hashlib.md5(r.text.encode()).hexdigest()) for r in docs.collect())
    assert size_tiered_compaction(docs.limit(0)).count() == 0


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.language_id(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    for r in rows:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= got[r.doc_id].score <= 1
    out = [r for r in rows if got[r.doc_id].held_out and r.lang]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in out) > 0.97 * len(out)


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !! 456", "de"), (4, "the cat and the dog " * 40, "en"), (5, "der hund und die katze " * 40, "de"), (6, "the dog", None), (8, "le chat et le chien " * 9000, "fr"), (9, "日本", None), (None, "die katze", None), (4, "the cat", "en")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    out = langid.identify(df, langid.fit(df), keep=("doc_id",)).collect()
    got = {r.doc_id: r.lang_pred for r in out}
    assert len(out) == len(rows) and [got[i] for i in (1, 2, 3, 5, 6, 8, None)] == ["und", "und", "und", "de", "en", "fr", "de"]
    assert langid.language_id(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.mark.parametrize("n", [2, 3, 4, 6, 7, 8, 10, 30, 200, 700])
def test_codewords(n):
    m = langid.codewords(n)
    apart = (m[:, None] != m[None]).sum(2) + 10**6 * np.eye(n, dtype=int)
    assert m.shape[0] == n and apart.min() >= (2 if n in (3, 4) or n > 6 else 1)
    assert ((m.sum(0) > 0) & (m.sum(0) < n)).all()
    splits = {min(c.tobytes(), (1 - c).tobytes()) for c in np.ascontiguousarray(m.T)}
    assert len(splits) == m.shape[1]


def made_up(languages, rows, seed=1):
    """(text, language) in languages with letters of their own, words of mixed length, and sizes that differ tenfold."""
    rng = np.random.default_rng(seed)
    letters = list("abcdefghijklmnopqrstuvwxyzäöüßéèñçøåαβγδ")
    tongues = []
    for i in range(languages):
        p = rng.dirichlet(np.full(len(letters), 0.4))
        tongues.append(["".join(rng.choice(letters, rng.integers(2, 9), p=p)) for _ in range(300)])
    share = np.linspace(1, 10, languages)
    return [(" ".join(rng.choice(tongues[i], rng.integers(5, 60))), f"l{i}") for i in rng.choice(languages, rows, p=share / share.sum())]


@pytest.mark.parametrize("languages", [3, 9, 12])
def test_languages_by_plain_python(spark, languages):
    rows = made_up(languages, 900)
    learned, asked = rows[:600], rows[600:]
    model = langid.fit(spark.createDataFrame(learned, "text string, lang string").repartition(5))
    names = sorted({x for _, x in learned})
    codes = langid.codewords(len(names))

    def bins(text):
        fold = lambda c: c | 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32
        b = bytes(map(fold, f" {text} ".encode()))
        b = re.sub(b" +", b" ", b)
        for n in (2, 3, 4):
            for i in range(len(b) - n + 1):
                g = 0
                for c in b[i : i + n]:
                    g = (g * 257 + c) % 2**32
                yield ((g * 2654435761 + n) % 2**32 >> 17) % langid.BINS

    held = Counter(x for _, x in learned)
    most = max(held.values())
    sides = [[Counter(), Counter()] for _ in codes.T]
    for text, lang in learned:
        own = list(bins(text))
        for k, code in enumerate(codes.T):
            side = sides[k][code[names.index(lang)]]
            for x in own:
                side[x] += most / held[lang] / math.sqrt(len(own))
    weights, middle, scale = [], [], []
    for zero, one in sides:
        share = [np.array([c[x] + 0.5 for x in range(langid.BINS)]) for c in (zero, one)]
        zero, one = (x / x.sum() for x in share)
        w = np.log(one / zero)
        weights.append(w)
        middle.append(((one * w).sum() + (zero * w).sum()) / 2)
        scale.append(((one * w).sum() - (zero * w).sum()) / 2)
    right = 0
    for text, lang in asked:
        own = list(bins(text))
        margins = [(sum(w[x] for x in own) / len(own) - m) / s for w, m, s in zip(weights, middle, scale)]
        assert model.margins(text) == pytest.approx(margins, rel=1e-3, abs=1e-3)
        loss = [sum(s * math.log1p(math.exp(max(-60, min(60, (-4 if c else 4) * m)))) for s, c, m in zip(scale, word, margins)) / sum(scale) for word in codes]
        order = np.argsort(loss)
        found = model.predict(text)
        assert found[0] == names[order[0]] or loss[order[1]] - loss[order[0]] < 1e-3
        right += found[0] == lang
    assert right > 0.95 * len(asked)


def test_many_labels_and_long_texts(spark, monkeypatch):
    rows = [(t, x if i % 2 else f"dirt{i}") for i, (t, x) in enumerate(made_up(4, 3000, 2))]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.languages) == 1504 and len(model.scale) < 100
    text = rows[1][0] * 50
    whole = langid.ngram_vector(text)
    monkeypatch.setattr(langid, "SLICE", 64)
    assert (langid.ngram_vector(text)[0] == whole[0]).all() and langid.ngram_vector(text)[1] == whole[1]


def test_warc(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet").unionByName(spark.createDataFrame([(-1, None, None), (None, "http://x/", ""), (-2, "u", '<title> A\n b </title><a class="k" href="q?a=1">L</a><p>x &amp;lt; y</p>')], "page_id long, url string, html string"))
    source = {r.record_id: r for r in warc.responses_from_pages(pages).collect()}
    records = warc.page_derivatives(pages)
    rows = records.collect()
    assert len(rows) == 2 * len(source)
    by = {r.record_id: r for r in rows}
    assert len(by) == len(rows)
    for r in rows:
        s = source[r.refers_to]
        assert (r.target_uri, r.warc_date, r.source_headers) == (s.target_uri, s.warc_date, s.http_headers)
        assert by[r.concurrent_to].concurrent_to == r.record_id and by[r.concurrent_to].warc_type != r.warc_type
        assert r.content_length == len(r.block.encode())
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        assert r.source_payload_digest == "sha256:" + hashlib.sha256(s.payload.encode()).hexdigest()
    odd = {(r.page_id, r.warc_type): r.block for r in rows}
    assert odd[-2, "metadata"] == "title: A b\noutlink: q?a=1" and odd[-2, "conversion"] == "A b\nL\nx &lt; y"
    assert odd[-1, "conversion"] == "" and odd[-1, "metadata"] == "title: "
    warc.write_warc(records.repartition(2), str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert len(back) == len(rows) and all(r.whole for r in back)
    assert {r.headers["WARC-Record-ID"]: r.block.decode() for r in back} == {f"<{r.record_id}>": r.block for r in rows}
    assert warc.page_derivatives(pages.limit(0)).count() == 0


def record(version, kind, number, block, length=None):
    head = f"WARC/{version}\r\nWARC-Type: {kind}\r\nwarc-record-id: <urn:x:{number}>\r\nWARC-Date: 2024-05-0{number}T00:00:00Z\r\nWARC-Target-URI: http://h/{number}\r\nX-Folded: a\r\n b\r\nContent-Length: {len(block) if length is None else length}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("version", ["1.0", "1.1"])
def test_responses_of_files(spark, tmp_path, version):
    torn = "<p>x</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc é &copy;\r\n\r\n".encode()
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    blocks = [(1, "warcinfo", b"i"), (2, "response", http + torn), (3, "request", b"GET"), (4, "response", b"\xff no head"), (5, "response", b"")]
    data = [record(version, kind, n, block) for n, kind, block in blocks]
    (tmp_path / "a.warc").write_bytes(b"".join(data))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))
    (tmp_path / "none.warc").write_bytes(b"")
    read = warc.read_warc(spark, str(tmp_path)).cache()
    assert {(r.file[-3:], r.block, r.whole) for r in read.collect()} == {(end, b, True) for end in ("arc", ".gz") for _, _, b in blocks}
    assert {r.headers["X-Folded"] for r in read.collect()} == {"a b"}
    got = warc.responses(read)
    want = [("urn:x:2", "2024-05-02T00:00:00Z", "http://h/2", "HTTP/1.1 200 OK\r\nA: b", torn.decode()), ("urn:x:4", "2024-05-04T00:00:00Z", "http://h/4", None, "\ufffd no head"), ("urn:x:5", "2024-05-05T00:00:00Z", "http://h/5", None, "")]
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(want * 2, key=lambda r: r[0])
    out = warc.derive(got, keep=("file",)).where("warc_type = 'conversion'").collect()
    assert {(r.refers_to, r.block.split("\n")[-1][-5:]) for r in out if r.refers_to == "urn:x:2"} == {("urn:x:2", "c é ©")}
    (tmp_path / "a.warc").write_bytes(record(version, "response", 1, b"cut", 99) + data[1] + record(version, "response", 3, b"last")[:-9])
    spark.catalog.clearCache()
    assert [(r.block[:3], r.whole) for r in warc.read_warc(spark, str(tmp_path / "a.warc")).collect()] == [(b"cut", False), (b"HTT", True), (b"", False)]


def test_warc_edges(spark):
    rows = [("a", "2024", "http://x/\r\nEvil: 1", "h", '<a href="q\r\n?a=1">x</a>', "k")] * 2
    df = spark.createDataFrame(rows, "record_id string, warc_date string, target_uri string, http_headers string, payload string, block string")
    out = warc.derive(df, keep=("block", "payload")).cache()
    assert out.columns[:2] == ["block_", "payload"] and out.count() == 4 and {r.block_ for r in out.collect()} == {"k"}
    assert {r.block for r in out.where("warc_type = 'metadata'").collect()} == {"title: \noutlink: q?a=1"}
    assert all("\r\nEvil" not in r[0] for r in out.select(warc.serialized(out)).collect())


def exact(rows, k=10, is_query=lambda i: i % 100 == 0):
    out = {}
    for q, x in rows:
        if is_query(q):
            d = sorted((math.dist(x, y), i) for i, y in rows if i != q)
            out[q] = d[:k]
    return out


@pytest.mark.parametrize("sf, long", [("0.01", False), ("0.1", False), ("0.1", True)])
def test_recall(spark, sf, long):
    """At two sizes, and where vectors are of any length, so that nearness and direction differ."""
    df = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    if long:
        df = df.withColumn("size", F.exp(F.pmod(F.xxhash64("vec_id"), F.lit(1000)) / 700)).select("vec_id", F.transform("embedding", lambda x: x * F.col("size")).alias("embedding"))
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    want = {}
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want[ids[q]] = [(d[i], ids[i]) for i in np.lexsort((ids, d))[:10]]
    got = ann.nearest_neighbours(df).collect()
    assert len(got) == 10 * len(want)
    hit = sum(r.vec_id in {i for _, i in want[r.query_id]} for r in got)
    assert hit >= 0.93 * len(got)
    for r in got:
        near = want[r.query_id][r.rank - 1][0]
        assert r.score == pytest.approx(near, rel=1e-12) or r.score > near


def test_two_axes_name_a_bucket(spark):
    """Clustered vectors, with buckets named by two axes as for many rows: the fit reaches its recall."""
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(60, 24))
    x = (middle[:, None] + 0.25 * rng.normal(size=(60, 25, 24))).reshape(-1, 24)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = exact([(i, v.tolist()) for i, v in enumerate(x)], is_query=lambda i: i % 50 == 0)
    old, ann.CROWD = ann.CROWD, 8
    try:
        assert ann.axes_per_table(1500, 24) == 2
        got = ann.search(df, lambda i: i % 50 == 0).collect()
    finally:
        ann.CROWD = old
    assert sum(r.vec_id in {i for _, i in want[r.query_id]} for r in got) >= 0.93 * len(got) == 0.93 * 300
    assert [ann.axes_per_table(n, 64) for n in (10**5, 10**6, 10**8, 10**10)] == [1, 2, 3, 4]


def test_widths_and_sizes_of_numbers(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=3 + 2 * (i % 2)).tolist()) for i in range(60)]
    rows += [(100 + i, (1e200 * rng.normal(size=7)).tolist()) for i in range(30)] + [(200 + i, (1e-200 * rng.normal(size=9)).tolist()) for i in range(30)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 10 < 2).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q, x in rows:
        if q % 10 < 2:
            top = max(map(abs, x))
            near = sorted((math.dist([v / top for v in x], [v / top for v in y]), i) for i, y in rows if i != q and len(y) == len(x))[:10]
            assert [i for i, _ in got[q]] == [i for _, i in near]
            assert [d / top for _, d in got[q]] == pytest.approx([d for d, _ in near], rel=1e-9)


def test_neighbour_edges(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(60)] + [(200, rows[1][1]), (300, [2.0 * v for v in rows[1][1]])]
    bad = [(400, None), (500, [0.0] * 6), (600, [float("nan")] * 6), (700, [None] * 6), (800, [float("inf")] * 6), (None, rows[2][1]), (900, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + bad + rows[3:5]], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in ann.nearest_neighbours(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = exact(rows)
    assert set(got) == set(want) == {0, 100, 200, 300}
    for q, found in got.items():
        assert [(i, round(d, 9)) for _, i, d in sorted(found)] == [(i, round(d, 9)) for d, i in want[q]]
    few = df.where("vec_id in (0, 1, 2)")
    assert len(ann.nearest_neighbours(few).collect()) == 2
    assert ann.nearest_neighbours(df.limit(0)).count() == 0


def test_queries_of_a_bucket_are_cut_and_merged(spark):
    """Every row asks, many of one cluster and a third of them equal: with all buckets probed and small blocks the answer is exact."""
    rng = np.random.default_rng(8)
    rows = [(i, (1 + 0.01 * rng.normal(size=8)).tolist()) for i in range(200)]
    rows += [(200 + i, rows[7][1]) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = exact(rows, is_query=lambda i: True)
    got = {}
    for r in ann.search(df, lambda i: i >= 0, tables=1, probes=16, block=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: [(i, round(d, 9)) for _, i, d in found] for q, found in got.items()} == {q: [(i, round(d, 9)) for d, i in near] for q, near in want.items()}
    assert all([rank for rank, _, _ in found] == list(range(1, 11)) for found in got.values())
