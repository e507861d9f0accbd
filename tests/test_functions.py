"""Identifiers, formatting, prices, trigrams and full text against worked examples."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import fulltext, ids, pricing, scalars, trigram, vectors
from lodestrata.functions.tokenize import PatternTokenizer, last_tokens, token_count


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_packed_id(spark):
    x = one(spark, ids.dashed(F.lit("0000002a018cc251f47b120102030405")))
    assert x == "0000002a-018c-c251-f47b-120102030405"
    got = spark.range(1).select(ids.org_number(F.lit(x)).alias("o"), ids.entity_byte(F.lit(x)).alias("b"), ids.entity_name(F.lit(x)).alias("n"), ids.created_at(F.lit(x)).cast("string").alias("t"), ids.is_packed_id(F.lit(x)).alias("v")).first()
    assert tuple(got) == (42, 0x12, "Chunk", "2024-01-01 00:00:00.123", True)
    rows = [(o, m, e, f"s{o}{m}") for o in (0, 1, 42, 2**31 - 1) for m in (0, 1704067200123, 2**47) for e in (1, 0x12, 0x51)]
    df = spark.createDataFrame(rows, "o long, m long, e int, s string").withColumn("id", ids.pack_id(F.col("o"), F.col("m"), F.col("e"), F.col("s")))
    back = df.select("o", "m", "e", ids.org_number(F.col("id")).alias("o2"), F.unix_millis(ids.created_at(F.col("id"))).alias("m2"), ids.entity_byte(F.col("id")).alias("e2")).collect()
    assert all((r.o, r.m, r.e) == (r.o2, r.m2, r.e2) for r in back)
    a, b, g = "0000002a" + x[8:], "0000002b" + x[8:], "00000000" + x[8:]
    assert one(spark, ids.share_org(F.lit(a), F.lit(x))) and not one(spark, ids.share_org(F.lit(b), F.lit(x)))
    assert one(spark, ids.one_org(F.array(F.lit(a), F.lit(g), F.lit(x)))) and not one(spark, ids.one_org(F.array(F.lit(a), F.lit(b))))
    assert one(spark, ids.belongs_to(F.lit(a), F.lit(42))) and not one(spark, ids.is_packed_id(F.lit("x")))
    assert one(spark, ids.entity_name(F.lit("0000002a-018c-c251-f47b-ff0102030405"))) is None


@pytest.mark.parametrize("model,want", [("openai/gpt-4o-mini", "0.00052530"), ("openai/text-embedding-3-small", "0.00002468"), (pricing.MODELS[4], "0.00325520")])
def test_cost(spark, model, want):
    assert f"{one(spark, pricing.cost(F.lit(model), F.lit(1234), F.lit(567))):.8f}" == want
    assert one(spark, pricing.cost(F.lit("none"), F.lit(1), F.lit(1))) is None


def test_formats(spark):
    l = F.lit  # noqa: E741
    cases = [
        (scalars.slack_stamp(l("1704164645.678900")), "2024-01-02 03:04:05 UTC"),
        (scalars.iso_stamp(l("2024-01-02T03:04:05.678Z")), "2024-01-02 03:04:05 UTC"),
        (scalars.trimmed(l("  \n a b ﻿")), "a b"),
        (scalars.without_mentions(l(" <@U1> hi <@B2>")), "hi"),
        (scalars.issue_reference(l("a/b/c#12")), ("a", "b/c", 12)),
        (scalars.issue_reference(l("a#12")), None),
        (scalars.like_escaped(l("5%_\\")), "5\\%\\_\\\\"),
        (scalars.abbreviated(l(999)), "999"),
        (scalars.abbreviated(l(1249)), "1.2K"),
        (scalars.abbreviated(l(2_550_000)), "2.6M"),
        (scalars.rounded(l(2.5)), 3),
        (scalars.rounded(l(-2.5)), -2),
        (scalars.schedule_label(l(3_600_000)), "Updates every hour"),
        (scalars.schedule_label(l(7_200_000)), "Updates every 2 hours"),
        (scalars.schedule_label(l(600_000)), "Updates every 10 minutes"),
        (scalars.without_quotes(l('"a"b"')), 'a"b'),
        (scalars.result_line(l("n"), l(0.12345), l("c")), "[n] (score: 0.123)\nc"),
        (scalars.enum_array(l("{A,B}")), ["A", "B"]),
        (scalars.enum_array(l("{}")), []),
        (scalars.byte_length(l("aé😀")), 7),
        (scalars.protocol_line(l('0:{"a":1}')), ("0", '{"a":1}')),
        (scalars.protocol_line(l("nothing")), None),
        (scalars.slack_permalink(l("t"), l("C1"), l("12.34")), "https://t.slack.com/archives/C1/p1234"),
        (scalars.slack_permalink(l(None), l("C1"), l("12.34")), "https://slack.com/app_redirect?channel=C1"),
        (scalars.name_parts(l("Ann B C")), ("Ann", "B C")),
        (scalars.name_parts(l("Ann")), ("Ann", "")),
        (scalars.member_name(l(None), l(None)), "System"),
        (scalars.member_name(l(""), l("")), ""),
        (scalars.location_label(l("S"), F.array(l(1), l(2)), F.array(l(3)), F.array(l("a"))), " S, p. 1, 2, row 3, a"),
        (scalars.location_label(l(None), F.array().cast("array<int>"), F.array().cast("array<int>"), F.array().cast("array<string>")), ""),
    ]
    for c, want in cases:
        got = one(spark, c)
        assert (tuple(got) if isinstance(want, tuple) else got) == want, c


@pytest.mark.parametrize("seconds,want", [(59, "Just now"), (60, "1m ago"), (3599, "59m ago"), (3600, "1h ago"), (86400 * 3, "3d ago")])
def test_relative_time(spark, seconds, want):
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    assert one(spark, scalars.relative_time(F.timestamp_seconds(F.lit(1_700_000_000 - seconds)), now)) == want


@pytest.mark.parametrize(
    "content,want",
    [
        ("plain", "plain"),
        ("{broken", "{broken"),
        ('[{"type":"text","text":"a"},{"type":"tool","x":1},{"type":"text","text":"b"}]', "ab"),
        ('{"parts":[{"type":"text","text":"p"}],"content":"c"}', "p"),
        ('{"parts":[],"content":"c"}', "c"),
        ('{"other":1}', ""),
        ("", ""),
    ],
)
def test_message_text(spark, content, want):
    assert one(spark, scalars.message_text(F.lit(content))) == want


@pytest.mark.parametrize(
    "content,want",
    [
        ("a\n```thinking\n one \n```\nb", ("a\n\nb", ["one"], [])),
        ("x ```sources\n[1]\n``` y", ("x  y", [], ["[1]"])),
        ("hello\n```thin", ("hello", [], [])),
        ("hello\n```thinking\nso far", ("hello", ["so far"], [])),
        ("hello\n``", ("hello", [], [])),
        ("hello\n```", ("hello", [], [])),
        ("hello\n```python\ncode", ("hello\n```python\ncode", [], [])),
        ("```so", ("", [], [])),
        ("plain `code` text", ("plain `code` text", [], [])),
    ],
)
def test_stream_blocks(spark, content, want):
    got = one(spark, scalars.stream_blocks(F.lit(content)))
    assert (got.text, got.thinking, got.sources) == want


def test_trigrams(spark):
    assert sorted(one(spark, trigram.trigrams(F.lit("Word")))) == ["  w", " wo", "ord", "rd ", "wor"]
    rows = spark.createDataFrame([(1, "two words"), (2, "nothing here"), (3, None), (4, "a word"), (5, "")], "chunk_id long, content string")
    got = {r.chunk_id: r.word_similarity for r in trigram.trigram_matches(rows, "word").collect()}
    assert got == {1: pytest.approx(0.8), 4: 1.0}
    assert trigram.trigram_matches(rows, "!!").count() == 0


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("abc ", min_size=1, max_size=30), st.text("abc ", min_size=1, max_size=6))
def test_similarity_bound(text, q):
    def grams(t):
        return [p[i : i + 3] for w in re.findall(r"\w+", t) for p in [f"  {w} "] for i in range(len(p) - 2)]

    wanted, own = set(grams(q)), grams(text)
    if wanted:
        s = trigram.best_extent(wanted, own)
        assert 0 <= s <= len(wanted & set(own)) / len(wanted) + 1e-12
        best = max((len(wanted & set(own[i:j])) / len(wanted | set(own[i:j])) for i in range(len(own)) for j in range(i + 1, len(own) + 1)), default=0)
        assert s <= best + 1e-12


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ties", "tie"), ("cries", "cri"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("conditional", "condit"), ("generously", "generous"), ("happiness", "happi"), ("national", "nation"), ("running", "run"), ("agreed", "agre"), ("consistency", "consist"), ("skies", "sky"), ("controlling", "control"), ("knightly", "knight"), ("by", "by"), ("dying", "die")])
def test_stems(word, want):
    assert fulltext.stem(word) == want


def test_fulltext(spark):
    T = fulltext.Terms
    rows = spark.createDataFrame([(1, "The quick brown foxes jumped over the lazy dog"), (2, "A brown dog and a quick fox"), (3, "dogs"), (4, None)], "id long, t string")
    lex = fulltext.analyzed(F.col("t"))
    first = {x.lexeme: x.positions for x in rows.where("id = 1").select(lex.alias("l")).first().l}
    assert first == {"quick": [2], "brown": [3], "fox": [4], "jump": [5], "lazi": [8], "dog": [9]}
    found = lambda t: [r.id for r in rows.where(fulltext.matches(lex, t)).orderBy("id").collect()]
    assert found(T(all=("dog",))) == [1, 2, 3]
    assert found(T(all=("dog",), none=("lazy",))) == [2, 3]
    assert found(T(phrases=(("brown", "fox"),))) == [1]
    assert found(T(phrases=(("jumped", "over", "the", "lazy"),))) == [1]
    assert found(T(any=(("jump", "quick"),))) == [1, 2]
    assert found(T(all=("the",))) == []
    ranks = {r.id: r.s for r in rows.where("id < 3").select("id", fulltext.rank(lex, T(all=("quick", "fox"))).alias("s")).collect()}
    assert ranks == {1: pytest.approx(0.05), 2: pytest.approx(0.1)}


def test_cover_density():
    assert fulltext.cover_density([(1, 0), (5, 1), (6, 0)], 2) == pytest.approx(0.1 / 4 + 0.1)
    assert fulltext.cover_density([(1, 0)], 2) == 0.0
    assert fulltext.cover_density([(3, 0), (9, 0)], 1) == pytest.approx(0.2)


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [2.0, 0.0])], "id long, embedding array<double>")
    got = vectors.top_by_cosine(df, [1.0, 0.0], 10).collect()
    assert [(r.id, round(r.score, 6)) for r in got] == [(1, 1.0), (5, 1.0), (2, 0.707107)]
    fast = {r.id: r.s for r in df.select("id", vectors.cosine_to([1.0, 0.0])("embedding").alias("s")).collect()}
    assert fast[3] is None and fast[4] is None and fast[2] == pytest.approx(2**-0.5)
    e = spark.createDataFrame([("a b",), ("b a",), ("",), (None,)], "t string").select(vectors.embedding("t").alias("v")).collect()
    assert e[0].v == e[1].v and sum(x * x for x in e[0].v) == pytest.approx(1) and not any(e[2].v) and not any(e[3].v)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_tokens_join(text):
    t = PatternTokenizer()
    assert t.decode(t.encode(text)) == text


def test_token_columns(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab é,.\n 😀1", k=40)) for _ in range(30)]
    t = PatternTokenizer()
    for r in spark.createDataFrame([(x,) for x in texts], "t string").select("t", token_count(F.col("t")).alias("n"), last_tokens(F.col("t"), 5).alias("l")).collect():
        assert r.n == len(t.encode(r.t)) and r.l == "".join(t.encode(r.t)[-5:])
