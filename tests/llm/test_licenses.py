"""Notices with edits against every stretch of words compared by edit distance, and edges."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import licenses
from lodestrata.llm.licenses import BASE, NOTICES, Notice


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def every_stretch(text, notice):
    """(fewest edits, places without any) of a notice over all stretches of words; None where all have too many."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    best, exact = None, []
    for i in range(len(w)):
        for j in range(i + 1, len(w) + 1):
            s = " ".join(w[i:j])
            if abs(len(s) - len(notice.text)) > notice.edits:
                continue
            d = distance(s, notice.text)
            if d <= notice.edits:
                best = d if best is None else min(best, d)
            if not d:
                exact.append(i)
    return best, exact


def damaged(rng, text, n):
    t = list(text)
    for _ in range(n):
        i = rng.randrange(len(t))
        t[i : i + 1] = rng.choice(["", rng.choice("abcxyz q"), t[i] + rng.choice("abcxyz")])
    return "".join(t) or "x"


def test_pieces_cover_a_notice():
    for n in NOTICES:
        assert len(n.pieces()) == n.edits + 1 and "".join(p for _, p in n.pieces()) == n.text
        assert all(n.text[o : o + len(p)] == p for o, p in n.pieces())


def test_damaged_notices(spark):
    rng, texts = random.Random(8), []
    for k in range(240):
        n = NOTICES[k % len(NOTICES)]
        words = [rng.choice(("the", "under", "license", "of", "mit", "général", "x9", "public", "version", "2")) for _ in range(rng.randrange(8))]
        parts = [damaged(rng, n.text, rng.randrange(n.edits + 3)) if rng.random() < 0.8 else n.text, n.text.upper() if rng.random() < 0.3 else "", *words]
        rng.shuffle(parts)
        texts.append(rng.choice([" ", "\n", ", ", " -- "]).join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = hit = 0
    for r in licenses.license_scan(docs).collect():
        for n in NOTICES:
            at = [m for m in r.matches if m.notice == n.text and m.exact == (n.edits == 0)]
            best, exact = every_stretch(texts[r.doc_id], n)
            assert (min((m.edits for m in at), default=None)) == best, (texts[r.doc_id], n)
            if n in BASE:
                assert sorted(m.first_word for m in at) == exact
            found += bool(at)
            hit += any(m.edits for m in at)
    assert found > 200 and hit > 50


def test_spans_and_repeated_notices(spark):
    text = "Under the MIT\nLicense; under the mit license under the mit license. CC-BY-NC, cc by ncd. Released under the M1T License!"
    row = licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [m.first_word for m in row.matches if m.exact and m.label == "mit"] == [0, 4, 8]
    assert [m.first_word for m in row.matches if m.label == "cc-by-nc"] == [12] and row.n_words == 23
    assert [(m.first_word, m.n_words, m.edits) for m in row.matches if m.notice.startswith("released")] == [(18, 5, 1)]


def test_edges(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "!?", 7), (4, "under the mit license", 8), (4, "under the mit license", 8), (None, "all rights reserved", 9), (5, "under the mit licenseé", 1), (6, "UNDER  THE_MIT\x00LICENSE", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, matches int")
    got = licenses.license_scan(docs, keep=("doc_id", "matches")).collect()
    assert [r.n_words for r in sorted(got, key=lambda r: r.matches)] == [4, 4, 0, 0, 0, 4, 4, 3]
    assert licenses.documents_licenses(docs.limit(0)).count() == 0
    by = {r.doc_id: r for r in licenses.documents_licenses(docs).collect()}
    for k in (1, 2, 3):
        assert (by[k].n_words, by[k].n_base, by[k].first_word, by[k].base_labels, by[k].labels, by[k].score) == (0, 0, None, "", "", 0.0)
    assert by[4].labels == by[4].base_labels == "mit" and by[4].score == 1.0 and by[6].n_base == 1
    assert by[None].labels == "reserved" and by[None].n_base == 0
    assert by[5].n_base == 0  # a letter that isn't ASCII belongs to the word
    odd = spark.range(1).select(F.lit(1).alias("doc_id"), F.expr("concat(cast(unhex('ff62') as string), ' under the mit license')").alias("text"))
    row = licenses.documents_licenses(odd).first()
    assert (row.n_words, row.first_word) == (5, 1)


def test_very_long_text(spark):
    text = "lorem ipsum license " * 200_000 + "under the mit license " * 1000
    row = licenses.documents_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_words, row.n_base, row.first_word, row.last_word, row.labels) == (604_000, 1000, 600_000, 603_996, "mit")


@pytest.mark.parametrize("text", ["a b a b a", "a"])
def test_own_notices(spark, text):
    df = licenses.license_scan(spark.createDataFrame([(text,)], "text string"), keep=(), notices=(Notice("x", "a b", 0),))
    assert df.columns == ["n_words", "matches"] and [m.first_word for m in df.first().matches] == ([0, 2] if len(text) > 1 else [])
