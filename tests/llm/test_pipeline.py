"""The corpus pipeline stage by stage, each on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lodestrata import store
from lodestrata.llm.mixing import mix_sources
from tests.llm.test_native import WORD, measured
from tests.llm.test_ngram_join import brute


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    home, out = tmp_path_factory.mktemp("stages"), [docs]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, out[-1], sf).write.parquet(f"{home}/{i}")
        out.append(spark.read.parquet(f"{home}/{i}"))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    for df in stages[:-1]:
        assert df.columns == list(pipeline.COLUMNS)


def test_quality(spark, sf, stages):
    before, after = texts(stages[0]), texts(stages[1])
    for i, t in before.items():
        m = measured(t)
        if m[0] < 50 or 100 * m[4] > 50 * m[0] or 10 * m[2] > m[0]:
            assert i not in after
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    long = [i for i in good if len(WORD.findall(before[i] or "")) >= 60]
    assert sum(i in after for i in long) >= 0.97 * len(long)


def test_lines(stages):
    before, after = texts(stages[1]), texts(stages[2])
    assert set(before) == set(after)
    for i, t in after.items():
        kept, own = t.split("\n"), iter(before[i].split("\n"))
        assert all(any(x == y for y in own) for x in kept)


def test_near_duplicates(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    assert sorted(texts(stages[3])) == sorted({c if c is not None else i for i, _, c in brute(rows)})


def test_mixing(stages):
    times = {r.doc_id: r.epochs for r in mix_sources(stages[3]).collect()}
    got = {}
    for r in stages[4].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: n for i, n in times.items() if n}


def test_packing(stages):
    copies = {r.doc_id: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    for r in stages[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect():
        assert r.n == r.d * copies.pop(r.doc_id)
    assert not copies


def test_run_and_edges(spark, sf, tmp_path):
    text = " ".join(chr(97 + i // 26) + chr(97 + i % 26) + "q" for i in range(80))
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "word " * 80, "en", "s", 400), (2, text, "en", None, 0), (2, text, "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (odd, odd.limit(0)):
        docs = rows
        for i, (_, stage) in enumerate(pipeline.STAGES):
            path = f"{tmp_path}/{rows is odd}-{i}"
            stage(spark, docs, sf).write.parquet(path)
            docs = spark.read.parquet(path)
        assert {r.doc_id for r in docs.collect()} == ({2} if rows is odd else set())


def text(seed, n=80, change=()):
    return " ".join(("new" if i in change else "w") + str((i * 7919 + seed * 104729) % 99991) for i in range(n))


def test_rows_of_one_id_that_are_no_copies_stay(spark, sf):
    rows = [(5, text(1)), (5, text(2)), (1, text(1)), (None, text(3)), (None, text(3, change={70})), (7, text(3)), (None, text(4)), (9, None), (9, "")]
    df = spark.createDataFrame([(*r, "en", "s", 1, "more") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row string")
    got = pipeline.ngram_jaccard(spark, df, sf)
    assert got.columns == list(pipeline.COLUMNS)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(5, text(2)), (1, text(1)), (7, text(3)), (None, text(4)), (9, None), (9, "")], key=str)


def test_mixing_keeps_rows_without_id(spark, sf):
    rows = [(None, text(i), "en", s, 1) for i, s in enumerate("aabbbb")] + [(3, text(7), "en", "b", 1), (3, text(8), "en", "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.mixing(spark, df, sf)
    want = sum(r.epochs for r in mix_sources(df).collect())
    assert got.count() == want and want == 8 and {r.source for r in got.collect()} == {"a", "b"}


def test_copies_made_by_mixing_go_to_different_windows(stages):
    begun = stages[5].where("start = 0").groupBy("doc_id", "sequence_id").count()
    assert begun.where("count > 1").isEmpty()
    assert stages[4].groupBy("doc_id").count().where("count > 1").count() > 5


def test_run_leaves_its_result_only(spark, sf, tmp_path, monkeypatch):
    for at in (store, pipeline):
        monkeypatch.setattr(at, "shared_dir", lambda _: str(tmp_path))
    assert pipeline.run(spark, sf).count() > 0
    assert [sorted(p.name for p in x.iterdir()) for x in tmp_path.iterdir()] == [["4"]]
