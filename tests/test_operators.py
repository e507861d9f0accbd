"""Chunking, search, filters, changes to tables and cards against worked examples and properties."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions.tokenize import PatternTokenizer
from lodestrata.operators import cards, catalogue, chunking, dml, filters, search, usage
from lodestrata.operators.chunking import Size, split_text
from lodestrata.session import scoped, write_scoped

TEXT = "one two three. four five six. seven eight\n\nnine ten"


@pytest.mark.parametrize(
    "size,want",
    [
        (Size(8, 0, 2), ["one two three. ", "four five six. ", "seven eight\n\nnine ten"]),
        (Size(8, 3, 2), ["one two three. ", "three. four five six. ", "six. seven eight\n\nnine ten"]),
    ],
)
def test_split(size, want):
    assert split_text(TEXT, size) == want


def test_split_edges():
    assert split_text("a b", Size(8, 3, 4)) == [] and split_text("   ", Size(8, 0, 0)) == []
    assert split_text("a-b-c-d-e-f", Size(4, 0, 1)) == ["a-b-", "c-d-", "e-f"]


@settings(max_examples=150, deadline=None)
@given(st.text("ab .\n;?!", max_size=200), st.integers(2, 12), st.integers(0, 5), st.integers(0, 6))
def test_split_properties(text, most, overlap, least):
    tok = PatternTokenizer()
    base = split_text(text, Size(most, 0, least))
    if len(tok.encode(text)) > most:
        assert "".join(base) == text
    for x in base:
        assert len(tok.encode(x)) <= most
    led = split_text(text, Size(most, overlap, least))
    assert len(led) == len(base) and all(len(tok.encode(x)) <= most + overlap for x in led)


def test_chunk_texts(spark):
    df = spark.createDataFrame([(1, TEXT, "x"), (2, None, "y"), (3, "a", "z")], "doc_id long, text string, extra string")
    got = chunking.chunk_texts(df, size=Size(8, 3, 2)).orderBy("chunk_index").collect()
    assert [(r.doc_id, r.extra, r.chunk_index, r.content) for r in got] == [(1, "x", i, c) for i, c in enumerate(split_text(TEXT, Size(8, 3, 2)))]


def test_csv(spark):
    df = spark.createDataFrame([("f", "id,name\n1,ann\n\n2,bob\n3,a b c d e f\n4,cy\n"), ("empty", "")], "file string, text string")
    got = [(r.file, r.chunk_index, r.row, r.content) for r in chunking.chunk_csv(df, most=7).orderBy("chunk_index").collect()]
    assert got == [("f", 0, 1, "id,name\n1,ann"), ("f", 1, 4, "2,bob"), ("f", 2, 5, "3,a b c d e f"), ("f", 3, 6, "4,cy")]


def test_group_messages(spark):
    rows = [("hi all", "C1", "u1", "p1"), ("yo", "C1", "u2", "p2"), ("a b c d e f g", "C2", "u3", "p3"), ("next one here", "C3", "u4", "p4"), ("x", "C3", "u1", "p5"), ("  ", "C9", "u9", "p9")]
    df = spark.createDataFrame([(s, i, c, ch, [a], u, True) for s in ("s1", "s2") for i, (c, ch, a, u) in enumerate(rows)], "data_source_id string, position int, content string, context string, authors array<string>, source_url string, merges boolean")
    want = [("hi all\nyo", "C1", ["u1", "u2"], "p1"), ("\na b c ", "C2", ["u3"], "p3"), ("c d e f g", "C2", ["u3"], "p3"), ("next one here\n\nx", "C2", ["u3", "u4", "u1"], "p3")]
    got = chunking.group_messages(df, Size(8, 2, 3)).orderBy("data_source_id", "chunk_index").collect()
    assert [(r.content, r.context, r.authors, r.source_url) for r in got] == want * 2
    assert chunking.group_messages(df.limit(0)).count() == 0


def test_pages(spark):
    rng = random.Random(4)
    pages = [("d", p, " ".join(rng.choices(["alpha", "beta", "gamma."], k=rng.randint(0, 14))) + "\n") for p in (1, 2, 4, 5, 9)]
    got = chunking.chunk_pages(spark.createDataFrame(pages, "doc_id string, page int, text string"), size=Size(12, 3, 2)).orderBy("chunk_index").collect()
    whole = "".join(t for _, _, t in pages)
    base = split_text(whole, Size(12, 0, 2))
    assert [r.content for r in got] == split_text(whole, Size(12, 3, 2))
    at, spans = 0, []
    for _, p, t in pages:
        spans.append((p, at, at + len(t)))
        at += len(t)
    start = 0
    for r, b in zip(got, base):
        lead = len(r.content) - len(b)
        assert r.pages == [p for p, s, e in spans if s < start + len(b) and e > start - lead]
        start += len(b)


def test_fusion_and_rerank(spark):
    lists = [["A", "B", "C"], ["B", "D"], ["C", "A"]]
    legs = [spark.createDataFrame([(x, i, r) for r, x in enumerate(xs, 1)], "chunk_id string, leg int, rank int") for i, xs in enumerate(lists)]
    f = search.fused(legs)
    got = {r.chunk_id: r.rrf for r in f.collect()}
    assert got == {"B": 0.012982548915917505, "A": 0.011422527763088313, "C": 0.0112151964610981, "D": 0.004838709677419354}
    scores = spark.createDataFrame([("B", 0.2), ("A", 1.4), ("C", None), ("D", -0.5)], "chunk_id string, semantic double")
    got = {r.chunk_id: r.score for r in search.reranked(f.join(scores, "chunk_id")).collect()}
    assert got == {k: pytest.approx(v, abs=1e-15) for k, v in {"A": 0.6534267583289265, "B": 0.3038947646747753, "C": 0.10336455893832944, "D": 0.05145161290322581}.items()}
    few = scores.withColumn("semantic", F.when(F.col("chunk_id") == "A", F.lit(1.0)))
    got = {r.chunk_id: r.score for r in search.reranked(f.join(few, "chunk_id")).collect()}
    assert got["B"] > got["A"] and got["B"] == pytest.approx(0.012982548915917505)


def corpus(spark):
    rows = []
    for i, (text, kind, author, org) in enumerate([("alpha beta report", "PDF", None, 1), ("alpha reports of gamma", "SLACK", "ann", 1), ("delta", "SLACK", "bob", 1), ("alpha beta gamma", "TXT", None, 2), ("beta alpha summary", "CSV", None, 1)]):
        rows.append((i, org, text, i, (kind, [author] if author and i % 2 else None, author if author and not i % 2 else None, None, None, None), [1.0, float(i)], "ds", "c1" if i < 3 else "c2", f"u{i}"))
    return spark.createDataFrame(rows, "chunk_id long, org_id int, content string, chunk_index int, metadata struct<type string, slackAuthors array<string>, slackAuthor string, slackChannelId string, linearIssueId string, notionPageId string>, embedding array<double>, data_source_id string, collection_id string, source_url string")


def test_search(spark):
    c, sources = corpus(spark), spark.createDataFrame([("ds", "Doc")], "id string, title string")
    run = lambda **k: search.search(c, sources, search.Request(1, "alpha report", [1.0, 0.0], **k)).collect()
    got = run(expand_context=True)
    assert got[0].chunk_id == 0 and {r.chunk_id for r in got} == {0, 1, 2, 4} and got[0].data_source_name == "Doc"
    assert got[0].context_before is None and got[0].context_after == "alpha reports of gamma"
    assert [r.chunk_id for r in run(filters=({"field": "slackAuthors", "value": "bob"},))] == [2]
    assert {r.chunk_id for r in run(filters=({"field": "slackAuthors", "value": "ann"},))} == {1}
    assert {r.chunk_id for r in run(collections=("c2",))} == {4}
    assert len(run(limit=1, rerank=True)) == 1
    for bad in ({"limit": 0}, {"limit": 51}):
        with pytest.raises(ValueError):
            run(**bad)
    assert search.expanded_query("q", "p" * 600) == "q\n\n" + "p" * 500 and search.expanded_query("q", None) == "q"


def test_search_over_stored_columns(spark, tmp_path):
    c, sources = corpus(spark), spark.createDataFrame([("ds", "Doc")], "id string, title string")
    search.indexed(c).write.parquet(str(tmp_path / "c"))
    kept = spark.read.parquet(str(tmp_path / "c"))
    for terms in (None, search.fulltext.Terms(any=(("reports", "gammas"),), phrases=(("alpha", "beta"),)), search.fulltext.Terms(all=("summaries",), none=("delta",))):
        r = search.Request(1, "alpha report", [1.0, 0.0], terms=terms)
        plain, stored = (search.search(x, sources, r) for x in (c, kept))
        assert plain.collect() == stored.collect()
        assert "_stemmed" not in stored._jdf.queryExecution().toString() and "_stemmed" in plain._jdf.queryExecution().toString()


def test_maybe_passes_every_match(spark, sf):
    words = ["abilities", "hopping", "happiness", "skies", "dying", "gently", "nationalization", "tied", "sensibility", "running"]
    rows = [(w, f"x {w} y") for w in words + ["hop", "happy", "sky", "die", "gentle", "national", "tie", "sense", "run", "able", "ability"]]
    df = spark.createDataFrame(rows, "word string, content string")
    lex = df.select("word", "content", search.fulltext.analyzed(F.col("content")).alias("lex")).cache()
    for w in words:
        t = search.fulltext.Terms(all=(w,))
        assert lex.where(search.fulltext.matches(F.col("lex"), t) & ~search.fulltext.maybe(F.col("content"), t)).isEmpty()


def test_tool_call():
    r = search.tool_request(1, "q", [0.0], types=("PDF",), author="ann")
    assert r.limit == 5 and r.rerank and r.expand_context
    assert [f["operator"] for f in r.filters] == ["eq", "eq"] and search.tool_request(1, "q", [0.0]).filters == ()
    assert search.tool_request(1, "q", [0.0], 7, ("PDF", "CSV")).filters[0]["operator"] == "in"


def test_filter_commutes(spark):
    c = corpus(spark)
    f = [{"field": "type", "operator": "in", "value": ["PDF", "CSV"]}]
    assert sorted(r.chunk_id for r in filters.filtered(c, 1, ["c1"], f).collect()) == [0]
    with pytest.raises(ValueError):
        filters.condition("other", "eq", 1)
    with pytest.raises(ValueError):
        filters.condition("slackChannelId", "in", [1])
    assert set(filters.LEGAL) == set(filters.TYPES) and all(set(v) <= set(filters.FIELDS) for v in filters.LEGAL.values())


def test_legal_metadata(spark):
    df = spark.range(1).select(*(F.lit(None).cast(t).alias(n) for n, t in (x.split(" ", 1) for x in filters.METADATA.split(", "))))
    ok = df.withColumns({"type": F.lit("PDF"), "pages": F.array(F.lit(1))}).select(F.struct("*").alias("metadata"))
    bad = df.withColumns({"type": F.lit("TXT"), "pages": F.array(F.lit(1))}).select(F.struct("*").alias("metadata"))
    none = df.select(F.struct("*").alias("metadata"))
    assert [x.select(filters.legal_metadata()).first()[0] for x in (ok, bad, none)] == [True, False, False]


def test_context_ignores_gaps(spark):
    c = spark.createDataFrame([(1, "s", 0, "a"), (2, "s", 2, "b"), (3, "s", 3, "c"), (4, "s", 3, "d"), (5, "t", 1, "e")], "chunk_id int, data_source_id string, chunk_index int, content string")
    got = {r.chunk_id: (r.context_before, r.context_after) for r in search.with_context(c.drop("content"), c).collect()}
    assert got == {1: (None, None), 2: (None, "d"), 3: ("b", None), 4: ("b", None), 5: (None, None)}


def test_changes(spark, tmp_path):
    old = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "data_source_id string, chunk_index int")
    new = spark.createDataFrame([("a", 7), ("c", 0)], "data_source_id string, chunk_index int")
    once = dml.replaced(old, new)
    assert sorted(map(tuple, once.collect())) == [("a", 7), ("b", 0), ("c", 0)] == sorted(map(tuple, dml.replaced(once, new).collect()))
    more = spark.createDataFrame([("a", 5), ("a", 9), ("d", 1)], "data_source_id string, position int")
    got = dml.numbered(more, old)
    assert sorted((r.data_source_id, r.chunk_index) for r in got.collect()) == [("a", 2), ("a", 3), ("d", 0)]
    parted = old.withColumn("org_id", F.lit(1))
    dml.replace_partitions(parted, str(tmp_path / "t"))
    for _ in range(2):
        dml.replace_partitions(new.withColumn("org_id", F.lit(1)), str(tmp_path / "t"))
    assert sorted((r.data_source_id, r.chunk_index) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("a", 7), ("b", 0), ("c", 0)]


def test_upsert_states(spark):
    e = spark.createDataFrame([(1, "c", "x", "READY", "t"), (2, "c", "y", "FAILED", "t")], "id int, connection_id string, external_id string, status string, title string")
    i = spark.createDataFrame([("c", "x", "old", True, 1), ("c", "x", "new", True, 2), ("c", "z", "z", True, 3)], "connection_id string, external_id string, title string, append_only boolean, seq int")
    got = {r.external_id: (r.status, r.title) for r in dml.upserted(e, i).collect()}
    assert got == {"x": ("READY", "new"), "y": ("FAILED", "t"), "z": ("UPLOADED", "z")}


def test_outcomes(spark):
    s = spark.createDataFrame([(1, "PROCESSING", None), (2, "PROCESSING", None), (3, "UPLOADED", 4)], "id int, status string, page_count int")
    o = spark.createDataFrame([(1, None, 9), (2, "broken", None)], "data_source_id int, error string, page_count int")
    assert {r.id: (r.status, r.page_count, r.error) for r in dml.processed(s, o).collect()} == {1: ("READY", 9, None), 2: ("FAILED", None, "broken"), 3: ("UPLOADED", 4, None)}
    assert tuple(dml.sync_counters(o).first()) == (1, 1)


def test_orphans(spark):
    kids = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "id int, user_id int")
    users = spark.createDataFrame([(10,)], "id int")
    assert {r.id: r.user_id for r in dml.orphans_unset(kids, users, "user_id").collect()} == {1: 10, 2: None, 3: None}


def test_scope(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "org_id int, x string")
    write_scoped(df, str(tmp_path / "s"))
    one = scoped(spark.read.parquet(str(tmp_path / "s")), 1)
    assert [r.x for r in one.collect()] == ["a"] and "PartitionFilters: [isnotnull(org_id" in one._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        scoped(df, None)


def test_catalogue(spark):
    rows = spark.createDataFrame([(1, "b"), (2, None), (3, "A"), (4, "a"), (5, "B")], "id int, title string")
    assert [r.title for r in catalogue.sorted_rows(rows, "title").collect()] == ["a", "A", "b", "B", None]
    assert [r.title for r in catalogue.sorted_rows(rows, "title", True).collect()] == ["B", "b", "A", "a", None]
    assert [r.id for r in catalogue.page(catalogue.sorted_rows(rows, "title"), 2, 2).collect()] == [1, 5]
    assert catalogue.toggled("a", False, "a") == ("a", True) and catalogue.toggled("a", True, "b") == ("b", False)
    for bad in (lambda: catalogue.sorted_rows(rows, "id; drop"), lambda: catalogue.page(rows, 0), lambda: catalogue.one_org_only(["0000002b-018c-c251-f47b-120102030405"], 42)):
        with pytest.raises((ValueError, PermissionError)):
            bad()
    keys = spark.createDataFrame([(1, None, 1), (2, 5, 2)], "id int, revoked_at int, created_at int")
    assert [r.id for r in catalogue.live_keys(keys).collect()] == [1] and [r.id for r in catalogue.live_keys(keys, True).collect()] == [2, 1]
    tokens = spark.createDataFrame([(1, "RESET", None, 9), (2, "RESET", 1, 9), (3, "RESET", None, 2), (4, "X", None, 9)], "id int, type string, used_at int, expires_at int")
    assert [r.id for r in catalogue.live_tokens(tokens, "RESET", F.lit(5)).collect()] == [1]
    marked = catalogue.marked_selected(keys, keys.where("id = 2"))
    assert {r.id: r.selected for r in marked.collect()} == {1: False, 2: True}


def test_shares(spark):
    a, b = "0000002a-018c-c251-f47b-340102030405", "0000002b-018c-c251-f47b-340102030405"
    shares = spark.createDataFrame([(a, "t1", False, False), (b, "t2", False, False), (b, "t3", True, False), (a, "t4", True, True)], "id string, share_token string, is_public boolean, revoked boolean")
    m = spark.createDataFrame([("0000002a-018c-c251-f47b-030102030405", 7)], "id string, user_id int")
    assert sorted(r.share_token for r in catalogue.visible_shares(shares, m, 7).collect()) == ["t1", "t3"]
    assert catalogue.live_share(shares, "t4").count() == 0 and catalogue.live_share(shares, "t1").count() == 1


def test_public_state(spark):
    df = spark.createDataFrame([("SLACK", ("T", "B", ["c"])), ("LINEAR", ("T", "B", None))], "provider string, provider_data struct<teamDomain string, slackBotUserId string, selectedChannelIds array<string>>")
    got = catalogue.public_state(df).collect()
    assert got[0].provider_data.asDict() == {"teamDomain": "T", "selectedChannelIds": ["c"]} and not any(got[1].provider_data)


def test_cards(spark):
    l = F.lit  # noqa: E741
    got = spark.range(1).select(cards.progress(l(1), l(3)).alias("a"), cards.progress(l(5), l(0)).alias("b"), cards.progress_shown(l(5), l(2)).alias("c"), cards.best_value(F.array(l("3"), l("x"), l("10.5"))).alias("d")).first()
    assert tuple(got) == (33, 0, 100, 10.5)
    done = spark.createDataFrame([([("a", True), ("b", False)],)], "items array<struct<text string, checked boolean>>")
    assert done.select(cards.completed(F.col("items"))).first()[0] == 1
    boxes = spark.createDataFrame([("t", 0.0, 0.0, 400.0, 300.0)], "thread_id string, x double, y double, width double, height double")
    assert [(r.x, r.y) for r in cards.free_slots(boxes).orderBy("place").collect()] == [(0.0, 320.0), (420.0, 0.0), (420.0, 320.0)]
    edges = spark.createDataFrame([("t", "a", "b"), ("t", "a", "x")], "thread_id string, source string, target string")
    ids = spark.createDataFrame([("t", "a"), ("t", "b")], "thread_id string, id string")
    assert cards.valid_edges(edges, ids).count() == 1


def test_usage_edges(spark, tmp_path):
    empty = spark.createDataFrame([], "model string, input_tokens int, output_tokens int, org_id int")
    assert tuple(usage.summary(usage.log_rows(empty)).first()) == (0, 0, 0, 0)
    with pytest.raises(ValueError):
        usage.since(empty, "2024-01-01", 91)
    calls = spark.createDataFrame([("openai/gpt-4o-mini", 10, 5, 1)], empty.schema)
    for _ in range(2):
        usage.append_log(calls, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
