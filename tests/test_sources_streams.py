"""Files, provider formats, webhooks, connectors and streams."""

import hashlib
import hmac
import io
import json
import os
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestrata.sources import connectors, files, formats, webhooks
from lodestrata.streaming import canvas, sync


def docx(xml):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def xlsx(cells):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>na,me</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def test_docx_and_xlsx(spark, tmp_path):
    xml = '<w:p><w:t>Hello &amp; </w:t><w:t xml:space="preserve">you</w:t></w:p><w:br w:type="x" type="page"/><w:p></w:p><w:lastRenderedPageBreak/><w:p><w:t>third</w:t></w:p>'
    (tmp_path / "a.docx").write_bytes(docx(xml))
    (tmp_path / "b.docx").write_bytes(b"not a zip")
    got = files.read_docx(spark, str(tmp_path)).orderBy("path", "page").collect()
    assert [(r.page, r.text) for r in got if not r.error] == [(1, "Hello &amp; you\n"), (3, "third\n")]
    assert [r.path[-6:] for r in got if r.error] == ["b.docx"]
    (tmp_path / "c.xlsx").write_bytes(xlsx('<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row r="3"><c r="B3" t="inlineStr"><is><t>x</t></is></c></row><row r="4"><c r="A4" t="b"><v>1</v></c></row>'))
    got = files.read_xlsx(spark, str(tmp_path)).orderBy("row").collect()
    assert [(r.sheet, r.row, r.text) for r in got] == [("One", 1, '"na,me",,5'), ("One", 3, ",x,"), ("One", 4, "TRUE,,")]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,ann\n\n2,b\n")
    got = files.csv_lines(files.texts(spark, str(tmp_path))).collect()
    assert [(r.row, r.line) for r in got] == [(1, "id,name"), (2, "1,ann"), (4, "2,b")] and got[0].columns == ["id", "name"]


def test_uploads(spark):
    rows = [("text/csv", 1, None, "CSV"), ("image/png", 21 << 20, "size", "IMAGE"), ("text/html", 1, "type", None), ("application/pdf", 200 << 20, None, "PDF")]
    got = {r.mime: (r.refused, r.kind) for r in files.checked_uploads(spark.createDataFrame([r[:2] for r in rows], "mime string, file_size long")).collect()}
    assert got == {m: (w, k) for m, _, w, k in rows}


@pytest.mark.parametrize("answer,want", [("DESCRIPTION: a cat\nTAGS: x, , y\nTEXT: hi", "a cat\n\nVisible text: hi\n\nTags: x, y"), ("DESCRIPTION: a\nTAGS:\nTEXT: None", "a"), (" free ", "free")])
def test_image_text(spark, answer, want):
    assert spark.range(1).select(files.image_text(F.lit(answer)).alias("x")).first().x.content == want


def header(spark, fn, **given):
    none = F.lit(None).cast("string")
    x = lambda n: given.get(n, F.lit(None).cast("array<string>") if n in ("labels", "assignees") else F.lit(None).cast("array<struct<identifier string, title string, state string>>") if n == "children" else none)
    return spark.range(1).select(fn(x).alias("h")).first().h


def test_headers(spark):
    l, arr = F.lit, lambda *x: F.array(*map(F.lit, x))
    assert header(spark, formats.github_header, repo=l("o/r"), number=l(3), title=l("T")) == "o/r#3: T"
    assert header(spark, formats.github_header, repo=l("o/r"), number=l(3), title=l("T"), kind=l("PR"), state=l("open"), author=l("ann"), labels=arr("a", "b"), assignees=arr("x"), head=l("f"), base=l("main")) == "o/r#3 (PR): T\nState: open | Author: ann | Assignees: x\nBranches: f -> main\nLabels: a, b"
    kids = F.array(F.struct(l("E-2").alias("identifier"), l("kid").alias("title"), l("Done").alias("state")))
    assert header(spark, formats.linear_header, identifier=l("E-1"), title=l("T"), state=l("Open"), priority_label=l("High"), parent_identifier=l("E-0"), parent_title=l("P"), children=kids) == "Issue E-1: T\nStatus: Open | Priority: High\nParent: E-0 P\nSub-issues: E-2 kid (Done)"
    assert header(spark, formats.linear_comment_line, identifier=l("E-1"), title=l("T"), state=l("Open")) == "Comment on E-1 (T) | Open"
    assert spark.range(1).select(formats.comment_text(l("c"), l("2024-01-02T03:04:05Z"), l(None).cast("string"), l("b")).alias("x")).first().x == "c\n[2024-01-02 03:04:05 UTC] unknown: b"


BLOCKS = [("paragraph", "p", "p"), ("heading_2", "h", "## h"), ("bulleted_list_item", "i", "- i"), ("to_do", "t", "[x] t"), ("code", "c", "```py\nc\n```"), ("divider", None, "---"), ("table_row", None, "a | b"), ("child_page", None, "[Child Page: T]"), ("image", None, "[image]"), ("odd", "o", "")]


def test_blocks(spark):
    df = spark.createDataFrame([(k, t) for k, t, _ in BLOCKS], "kind string, t string")
    got = {r.kind: r.x for r in df.select("kind", formats.block_text(F.col("kind"), F.col("t"), F.lit(True), F.lit("py"), F.array(F.lit("a"), F.lit("b")), F.lit("T")).alias("x")).collect()}
    assert got == {k: w for k, _, w in BLOCKS}
    tree = spark.createDataFrame([("a", "P", "P", 0), ("b", "P", "P", 1), ("a1", "a", "P", 0), ("a11", "a1", "P", 0), ("a111", "a11", "P", 0), ("deep", "a111", "P", 0)], "id string, parent_id string, page_id string, pos int")
    assert [r.id for r in formats.block_tree(tree).orderBy("path").collect()] == ["a", "a1", "a11", "a111", "b"]
    assert spark.range(1).select(formats.page_title(F.array(F.lit(""), F.lit("T"))).alias("x"), formats.page_title(F.array(F.lit(""))).alias("y")).first()[:] == ("T", "Untitled")


def test_labels(spark):
    x = spark.range(1).select(formats.label_names(F.parse_json(F.lit('["a",{"name":"b"},{"x":1},3]'))).alias("x")).first().x
    assert x == ["a", "b"]


EVENTS = [
    ("SLACK", {"event": {"type": "message", "channel": "C1"}}, ("created", "C1")),
    ("SLACK", {"event": {"type": "message", "subtype": "message_deleted", "channel": "C1"}}, ("deleted", "C1")),
    ("SLACK", {"event": {"type": "reaction", "channel": "C1"}}, None),
    ("GITHUB", {"action": "opened", "repository": {"full_name": "o/r"}, "issue": {"number": 4}}, ("created", "o/r#4")),
    ("GITHUB", {"action": "closed", "repository": {"full_name": "o/r"}, "pull_request": {"number": 5, "merged": False}}, ("deleted", "o/r#5")),
    ("GITHUB", {"action": "closed", "repository": {"full_name": "o/r"}, "pull_request": {"number": 5, "merged": True}}, ("updated", "o/r#5")),
    ("GITHUB", {"action": "opened", "repository": {"full_name": "o/r"}, "discussion": {"number": 6}}, ("updated", "o/r#6")),
    ("LINEAR", {"action": "update", "type": "Comment", "data": {"id": "c", "issueId": "i"}}, ("updated", "i")),
    ("LINEAR", {"action": "remove", "type": "Issue", "data": {"id": "i"}}, ("deleted", "i")),
    ("LINEAR", {"action": "other", "type": "Issue", "data": {"id": "i"}}, None),
    ("NOTION", {"type": "page.deleted", "entity": {"id": "p"}}, ("deleted", "p")),
    ("NOTION", {"type": "page.undeleted", "entity": {"id": "p"}}, ("updated", "p")),
    ("NOTION", {"type": "other", "entity": {"id": "p"}}, None),
    ("NOTION", None, None),
]


def test_fan_out_joins_on_installations(spark):
    conns = spark.createDataFrame([("k1", "GITHUB", "ACTIVE", 7), ("k2", "GITHUB", "ACTIVE", 8), ("k3", "GITHUB", "ACTIVE", None), ("k4", "LINEAR", "ACTIVE", 7), ("k5", "LINEAR", "ERROR", 7)], "id string, provider string, status string, installation_id long")
    ev = spark.createDataFrame([(1, "GITHUB", 7), (2, "GITHUB", None), (3, "LINEAR", 9), (4, None, 7)], "e int, provider string, installation_id long")
    out = webhooks.fanned_out(ev, conns)
    assert out.columns == ["provider", "e", "installation_id", "connection_id"]
    assert sorted((r.e, r.connection_id) for r in out.collect()) == [(1, "k1"), (2, "k1"), (2, "k2"), (2, "k3"), (3, "k4")]
    assert re.search(r"Join \[[^\]]*installation_id", out._jdf.queryExecution().sparkPlan().toString())


def test_webhooks(spark):
    df = spark.createDataFrame([(i, p, json.dumps(b) if b else "no json") for i, (p, b, _) in enumerate(EVENTS)], "i int, provider string, body string")
    got = {r.i: (r.action, r.external_id) for r in webhooks.normalised(df).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(EVENTS) if w}
    conns = spark.createDataFrame([("k1", "GITHUB", "ACTIVE", 7), ("k2", "GITHUB", "ACTIVE", 8), ("k3", "SLACK", "ERROR", None), ("k4", "LINEAR", "ACTIVE", None)], "id string, provider string, status string, installation_id long")
    ev = spark.createDataFrame([("GITHUB", 7), ("LINEAR", None), ("SLACK", None)], "provider string, installation_id long")
    assert sorted(r.connection_id for r in webhooks.fanned_out(ev, conns).collect()) == ["k1", "k4"]
    sig = "sha256=" + hmac.new(b"s", b"body", hashlib.sha256).hexdigest()
    s = spark.createDataFrame([("body", sig), ("body", "x"), ("body", None)], "b string, s string")
    assert [r[0] for r in s.select(webhooks.signed("s")("b", "s")).collect()] == [True, False, False]


def test_connector(spark, tmp_path):
    lines = [{"entity": "channel", "id": "C1"}, {"entity": "message", "ts": "2.0", "text": "a"}, {"entity": "message", "ts": "1.0"}, {"entity": "odd", "id": "x"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, lines)))
    got = connectors.provider_items(spark, str(tmp_path / "in"), "slack", after="1.0").collect()
    assert sorted((r.entity, r.external_id) for r in got) == [("channel", "C1"), ("message", "2.0")]
    q = connectors.provider_items(spark, str(tmp_path / "in"), "slack", stream=True).writeStream.format("memory").queryName("slack_items").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("slack_items").count() == 3
    m = spark.createDataFrame([("C", "3", None, None, "hi"), ("C", "9", None, "B", "hi"), ("C", "8", "3", None, "hi"), ("C", "7", None, None, "<@BOT> x")], "channel_id string, ts string, thread_ts string, bot_id string, text string")
    old = spark.createDataFrame([("C", "2"), ("D", "5")], "channel_id string, cursor string")
    assert {r.channel_id: r.cursor for r in connectors.slack_cursors(m, "<@BOT>", old).collect()} == {"C": "3", "D": "5"}
    conns = spark.createDataFrame([(1, "SLACK", "ACTIVE", None), (2, "GITHUB", "ACTIVE", None), (3, "NOTION", "ERROR", None)], "id int, provider string, status string, last_synced_at timestamp")
    now = F.lit("2024-02-01").cast("timestamp")
    assert [r.id for r in connectors.due(conns, now).collect()] == [1]
    assert connectors.since_for(conns, now).first().since.isoformat()[:10] == "2024-01-02"


def card(i):
    return {"id": f"c{i}", "position": {"x": 0, "y": 0}, "width": 1, "height": 1, "component": {"id": f"k{i}", "type": "text", "data": {"a": 1}}, "sources": []}


OPS = [
    {"type": "add_card", "cards": [card(1), card(2), card(3)]},
    {"type": "add_edge", "edge": {"id": "e1", "source": "c1", "target": "c2"}},
    {"type": "add_edge", "edge": {"id": "e2", "source": "c2", "target": "c1"}},
    {"type": "move_card", "cardId": "c9", "width": 5},
    {"type": "move_card", "cardId": "c1", "width": 5, "title": "", "zIndex": 3},
    {"type": "delete_edge", "edgeId": "nothing"},
    {"type": "update_component", "cardId": "c1", "componentId": "k1", "data": {"b": 2}},
    {"type": "update_component", "cardId": "c1", "componentId": "k2", "data": {}},
    {"type": "batch", "operations": [{"op": "remove_card", "cardId": "c3"}, {"op": "remove_card", "cardId": "c3"}]},
    {"type": "batch", "operations": [{"op": "remove_card", "cardId": "c2"}]},
]


def test_canvas(spark):
    df = spark.createDataFrame([(t, i, json.dumps(o)) for t in ("t1", "t2") for i, o in enumerate(OPS)], "thread_id string, seq long, op string")
    for r in canvas.fold(df.orderBy(F.rand(1))).collect():
        state = json.loads(r.state)
        assert [c["id"] for c in state["cards"]] == ["c1", "c3"] and state["edges"] == []
        c1 = state["cards"][0]
        assert (c1["width"], c1["title"], c1["zIndex"], c1["component"]["data"]) == (5, None, 3, {"a": 1, "b": 2})
        assert json.loads(r.errors) == ["card c9", "component k2", "card c3"]
    out = canvas.resolved([{"op": "add_card", "cards": [{"id": "$a", "component": {"id": "$k"}}]}, {"op": "move_card", "cardId": "$a", "width": 1}], iter(["1", "2"]).__next__)
    assert out[1]["cardId"] == "1" and out[0]["cards"][0]["component"]["id"] == "2"
    with pytest.raises(canvas.Rejected):
        canvas.resolved([{"op": "move_card", "cardId": "$z"}], lambda: "1")
    with pytest.raises(canvas.Rejected):
        canvas.resolved([{"op": "move_card", "cardId": "no id"}], lambda: "1")
    packed = "00000001-0000-0000-0000-310000000000"
    assert canvas.resolved([{"op": "move_card", "cardId": packed}], lambda: "1") == [{"op": "move_card", "cardId": packed}]
    assert canvas.applied(None, json.dumps(OPS[3]), lenient=True)[1] is None


def test_canvas_stream_is_fold(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()
    for i, o in enumerate(OPS):
        (tmp_path / f"in/{i:03d}.json").write_text(json.dumps({"thread_id": "t", "seq": i, "op": json.dumps(o)}))
        os.utime(tmp_path / f"in/{i:03d}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken by age
    s = spark.readStream.schema("thread_id string, seq long, op string").option("maxFilesPerTrigger", 4).json(str(tmp_path / "in"))
    q = canvas.canvas_stream(s).writeStream.format("memory").queryName("canvases").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    last = [json.loads(r.state) for r in spark.table("canvases").collect()][-1]
    want = json.loads(canvas.fold(spark.read.schema("thread_id string, seq long, op string").json(str(tmp_path / "in"))).first().state)
    assert last == want


def test_sync_stream(spark, tmp_path):
    rng = random.Random(2)
    items = [("k", f"x{rng.randint(0, 5)}", rng.choice(["created", "updated", "deleted"]), f"t{i}", False, i) for i in range(24)]
    (tmp_path / "in").mkdir()
    for b in range(4):
        (tmp_path / f"in/{b}.json").write_text("\n".join(json.dumps(dict(zip(("connection_id", "external_id", "action", "title", "append_only", "seq"), x))) for x in items[b * 6 : b * 6 + 6]))
        os.utime(tmp_path / f"in/{b}.json", (1_700_000_000 + b, 1_700_000_000 + b))
    s = spark.readStream.schema("connection_id string, external_id string, action string, title string, append_only boolean, seq long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    table = sync.VersionedTable(spark, str(tmp_path / "t"), "id long, connection_id string, external_id string, status string, title string")
    q = sync.sync_stream(s, table, str(tmp_path / "cp"))
    assert q.awaitTermination(180)
    want = {}
    for _, x, action, title, _, _ in items:
        want.pop(x, None) if action == "deleted" else want.update({x: title})
    assert {r.external_id: r.title for r in table.read().collect()} == want
    # a batch that is in changes nothing when it is replayed
    last = spark.read.schema(s.schema).json(str(tmp_path / "in/3.json"))
    stream, number = next(iter(table.state()["batches"].items()))
    assert number == 3 and table.versions() == [3, 4]
    assert not table.merge(last, sync.merged_batch, stream, 3) and table.versions() == [3, 4]
    assert {r.external_id: r.title for r in table.read().collect()} == want
    # no folder stays that no version names
    stored = {f for v in table.versions() for f, *_ in table.state(v)["leaves"].values() if f}
    on_disk = {str(tmp_path / "t/data" / d / b) for d in os.listdir(tmp_path / "t/data") for b in os.listdir(tmp_path / "t/data" / d) if b.startswith("leaf=")}
    assert on_disk == stored


def test_times_and_diffs(spark):
    m = spark.createDataFrame([("w", i, t) for i, t in enumerate([5, 5, 4, 20, 20, 1])], "writer_id string, seq int, millis long")
    assert [r.millis for r in sync.strictly_increasing(m).orderBy("seq").collect()] == [5, 6, 7, 20, 21, 22]
    f = spark.createDataFrame([("p", i, x, "modified", "f", None, 1, 2) for i, x in enumerate(["a" * 300_000, None, "", *["b" * 99_000] * 5, "c"])], "pull string, pos int, patch string, status string, filename string, previous_filename string, additions int, deletions int")
    got = formats.diff_messages(f).orderBy("pos").collect()
    assert [r.pos for r in got] == [0, 3, 4, 5, 6] and got[0].content.endswith("\n... (truncated)") and got[1].content.startswith("File: f (modified, +1 -2)\n\nb")


def test_throttled_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"key": "a", "ts": f"2024-01-01T00:00:{i:02d}Z"} for i in range(12)]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    s = spark.readStream.schema("key string, ts timestamp").json(str(tmp_path / "in"))
    q = sync.throttled_stream(s, "10 seconds", 5).writeStream.format("memory").queryName("limits").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted((r.requests, r.blocked) for r in spark.table("limits").collect()) == [(2, 0), (10, 5)]
