"""Quality rules, mixing and line dedup against plain Python."""

import html
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import line_dedup, mixing, quality
from lodestrata.llm.mixing import mix_sources

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def test_measures(spark):
    rng = random.Random(3)
    texts = [None, "", " \n ", "a b c a b c", "a a a a a a", "x y z", "a b", "é#*\né#*\n\né#* q", "😀 😀 😀 😀"]
    texts += ["\n".join(" ".join(rng.choices("abcdefg%<", k=rng.randint(0, 9))) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts.append(" ".join(f"w{i % 977}" for i in range(60000)))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a b c")], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in quality.quality_verdicts(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()}
    for i, t in enumerate(texts):
        m = measured(t)
        base = m[0] < 50 or 100 * m[4] > 50 * m[0]
        assert got[i][:6] == (*m, base), t
        assert not (base and got[i][6])
    assert quality.quality_verdicts(df.limit(0)).count() == 0


def test_ablations(spark, sf):
    book = quality.ledger(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    bits = [r.failed for r in book.collect()]
    for r in quality.ablations(book).collect():
        p, one = quality.POLICIES[r.version], 1 << quality.RULES[r.rule][0]
        assert r.rows == len(bits)
        assert r.kept == sum(b & p.mask == 0 for b in bits)
        assert r.failing == sum(b & one != 0 for b in bits)
        assert r.only == sum(b & p.mask == one for b in bits)
    assert {r.kept for r in quality.ablations(book.limit(0)).collect()} == {0}


def test_ledger_edges(spark):
    df = spark.createDataFrame([(None, "a b", 1, 2), (None, "a b", 1, 2)], "doc_id long, text string, n_words int, failed int")
    out = quality.ledger(df, keep=("n_words", "failed", "text"))
    assert [c for c in out.columns if c in ("n_words_", "failed_", "text")] == ["n_words_", "failed_", "text"]
    assert [(r.n_words, r.n_words_, r.failed_) for r in out.where(quality.passes(quality.Policy(9, ("shouting",)))).collect()] == [(2, 1, 2)] * 2
    lines = ["- a", "* b", "• c", " - d", "x...", "y…"]
    out = quality.ledger(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).first()
    assert (out.n_lines, out.n_bullet_lines, out.n_ellipsis_lines) == (6, 4, 2)


def plain_mix(rows, goal, ranges, hot=frozenset()):
    """What each row takes, with rows as (key, doc_id, source, size) in the order of the mix."""
    out = Counter()
    for s in {r[2] for r in rows}:
        total = sum(r[3] for r in rows if r[2] == s)
        budget = int(goal[s] + 1e-6)
        whole = budget // total if total else 0
        left = budget - whole * total
        place = lambda k: (((k % 2**64) >> 33) * ranges >> 31, k in hot, k)
        for k, i, _, n in sorted((r for r in rows if r[2] == s), key=lambda r: (*place(r[0]), r[1] is not None, r[1] or 0, r[3])):
            last = max(0, min(n, left))
            left -= last
            out[i, s, n, whole * n + last] += 1
    return out


@pytest.mark.parametrize("copies", [0, 700])
def test_taken_by_plain_python(spark, monkeypatch, copies):
    monkeypatch.setattr(mixing, "RANGE", 50)
    rng = random.Random(9)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 30))), rng.choice("aab")) for i in range(900)] + [(None, "x y z", "b")] * copies
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keyed = [tuple(r) for r in df.select(F.xxhash64(F.lit(17), "doc_id", "text"), "doc_id", "source", mixing.word_count(F.col("text"))).collect()]
    sizes = Counter()
    for r in keyed:
        sizes[r[2]] += r[3]
    hot = {k for k, n in Counter(r[0] for r in keyed).items() if n > 50}
    want = plain_mix(keyed, water(dict(sizes)), len(rows) // 50, hot)
    for parts in (2, 5):
        assert Counter((r.doc_id, r.source, r.size, r.taken) for r in mix_sources(df.repartition(parts)).collect()) == want


def test_equal_rows_are_cut_into_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 50)
    sized = spark.range(4000).select(F.lit("s").alias("source"), F.lit(0).cast("long").alias("bin"), F.lit(7).cast("long").alias("key"), F.col("id").alias("row"))
    by_range = spark.createDataFrame([("s", 0, 1, 4000)], "source string, bin long, bin_size long, held long")
    cells = [r["count"] for r in mixing._cells(sized, by_range).groupBy("cell").count().collect()]
    assert len(cells) == 80 and max(cells) < 100


def water(sizes, weights=(1, 2, 3), most=3):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    done, total = {}, sum(sizes.values())
    while True:
        left = total - sum(done.values())
        open_ = [s for s in order if s not in done]
        heavy = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] > most * sizes[s] * heavy]
        if not over:
            return done | {s: left * w[s] / heavy if heavy else 0.0 for s in open_}
        done |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("n", [0, 1, 5, 400])
def test_mixing(spark, n):
    rng = random.Random(n)
    names = ["b", "a", None, "é", "Z", "hot", "tiny"]
    rows = [(i if i % 50 else None, " ".join("w" for _ in range(rng.randint(0, 40))) if i % 11 else None, rng.choices(names, weights=(5, 9, 3, 3, 2, 30, 0.3))[0], 1) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    got = mix_sources(df).collect()
    assert len(got) == n
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    goal = water(dict(sizes)) if n else {}
    took = Counter()
    for r in got:
        took[r.source] += r.taken
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        assert abs(r.target - goal[r.source]) < 1e-6
    for s in sizes:
        assert abs(took[s] - goal[s]) <= 1
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    assert sorted(map(key, mix_sources(df.repartition(3)).collect())) == sorted(map(key, got))


def test_line_dedup(spark):
    rows = [(1, "h", "menu\nalpha\n menu \n\nfoot"), (2, "h", "menu\nbeta\nfoot"), (3, "h", "gamma\n\n"), (4, "h", None), (5, "h", "beta\nmenu"), (6, None, "menu\nfoot"), (7, "alone", "menu"), (8, "h", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, site string")
    out = line_dedup.drop_boilerplate_lines(df, F.col("source"), F.col("text"), ratio=0.4)
    got = {r.doc_id: (r.clean_text, r.n_lines, r.n_dropped) for r in out.collect()}
    assert got == {1: ("alpha\n\nfoot", 4, 2), 2: ("beta\nfoot", 3, 1), 3: ("gamma\n\n", 1, 0), 4: (None, 0, 0), 5: ("beta", 2, 1), 6: ("menu\nfoot", 2, 0), 7: ("menu", 1, 0), 8: ("", 0, 0)}
    assert out.columns[:4] == df.columns and out.limit(0).count() == 0
    empty = line_dedup.drop_boilerplate_lines(df.limit(0), F.col("source"), F.col("text"))
    assert empty.count() == 0


def test_page_edges(spark):
    rows = [(1, "http://h/1", "<p>menu</p><p>one &amp; all</p>", "x"), (2, "http://h/2", None, "x"), (3, "http://h/3", "<p>menu</p>", "x"), (None, None, "<p>menu</p>", "x"), (4, "http://h/4", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.n_lines, r.n_dropped, r.clean_chars) for r in line_dedup.dedup_page_lines(df).collect()}
    assert got == {1: ("h", 2, 1, 9), 2: ("h", 0, 0, None), 3: ("h", 1, 1, 0), None: (None, 1, 0, 4), 4: ("h", 0, 0, 0)}
    assert line_dedup.dedup_page_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("pages", [2, 3, 4])
def test_small_hosts(spark, pages):
    """What more than one page of a small host has, and more than the ratio, is boilerplate as on a large one."""
    rows = [(i, "h", f"menu\nown {i}\n{'both' if i < 2 else 'x'}\nown {i}") for i in range(pages)] * 1
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r.clean_text for r in line_dedup.drop_boilerplate_lines(df, F.col("source"), F.col("text")).collect()}
    assert got == {i: f"own {i}" + ("\n" if i < 2 or pages == 4 else "\nx\n") + f"own {i}" for i in range(pages)}
    again = line_dedup.drop_boilerplate_lines(df.limit(1).unionByName(df.limit(1)), F.col("source"), F.col("text"))
    assert [r.clean_text for r in again.collect()] == [""] * 2  # repeated rows are two pages with all in common


def test_entities(spark):
    texts = ["&copy;&middot; &eacute;&Eacute;&hellip;", "&#233;&#xe9;&#XE9; &#128512;", "&amp;lt; &lt;b&gt; &quot;&#39;", "&nope; & &; &#; &#x; a&b;c &amp", "x&nbsp;y&#160;z", "plain", "", None, "&#0;&#55296;&#1114112;", "&#9999999; &#1;"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(line_dedup.unescaped(F.col("t"))).collect()]
    for t, x in zip(texts[:4], got):
        known = "&amp" if t.endswith("&amp") else ""
        assert x == html.unescape(t.removesuffix("&amp")) + known
    assert got[4:] == ["x y z", "plain", "", None, "\ufffd" * 3, "\ufffd \x01"]


def test_hosts(spark):
    urls = ["http://A.b.com:80/x", "https://u:p@c.org?q", "ftp://d", "no host", None, "http:///x"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(line_dedup.host_of(F.col("url"))).collect()] == ["a.b.com", "c.org", "d", None, None, None]
