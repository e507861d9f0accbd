"""Repairs against a search through all edits, stretches of any length, and edges."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"


def search(rows):
    """(cost, letters, repaired rows) of the cheapest edits, least letters first, tried out in order of cost."""
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, letters, i, roles, out = heapq.heappop(heap)
        if not re.fullmatch("s?(ua)*u?", roles) or len(out) > len(rows) + 2:
            continue
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, letters, out
        for own in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, letters + "I", i, roles + own[0], (*out, (own, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            more = 3 * (fault == "broken")
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, roles, out))
            if fault not in ("blank", "again"):
                heapq.heappush(heap, (cost + more, letters + "K", i + 1, roles + (role[:1] or "-"), (*out, (role, text))))
                for own in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + more, letters + "R", i + 1, roles + own[0], (*out, (own, text))))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]", "", text)[-1:]
        out.append("blank" if not last else "again" if (role, text) in seen else "fine" if last in ".!?" else "broken")
        seen.add((role, text))
    return out


def expected(rows):
    """What the query says of one conversation's rows (turn, role, text), in order, after damage."""
    pairs = [(r or " ", " " if t is None else t) for _, r, t in rows]
    kinds = faults(pairs)
    cost, letters, out = search([(r, t, f) for (r, t), f in zip(pairs, kinds)])
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for r, _ in pairs]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("blank"), kinds.count("again"), kinds.count("broken"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, letters, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    )


def random_rows(rng, conversations, most):
    rows = []
    for c in range(conversations):
        for turn in range(rng.randrange(most + 1)):
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", None))
            rows.append((c, 2 * turn if rng.random() < 0.9 else turn * 100, role, rng.choice(("a.", "b", "c!", "", " \n", "d? ", None, "e", "f."))))
    return [r for i, r in enumerate(rows) if i == 0 or rows[i - 1][:2] != r[:2]]


def damage(rows):
    for c, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            yield from ((c, *row),) * (1 + (kind == 3))


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("most", [1, 2, C.ROWS])
def test_all_edits(spark, most):
    """Also with stretches of one or two rows, so that conversations go over many."""
    rows = random_rows(random.Random(most), 60, 6)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in C.conversation_repairs(spark.createDataFrame(rows, SCHEMA), most).collect()}
    by = {}
    for c, *r in damage(rows):
        by.setdefault(c, []).append(tuple(r))
    assert set(got) == {r[0] for r in rows}
    for c, x in got.items():
        assert x == expected(sorted(by.get(c, []), key=lambda r: r[0])), by.get(c)


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(4)
    big = [(7, t, rng.choice(("user", "assistant")), rng.choice((f"{t}.", f"{t}", "again."))) for t in range(6000)]
    rows = big + [(c, t, ("user", "assistant")[t % 2], "x.") for c in range(200) for t in range(4) if c != 7]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    one = {r.conv_id: r for r in C.conversation_repairs(docs, 10_000).collect()}
    many = {r.conv_id: r for r in C.conversation_repairs(docs, 50).collect()}
    assert one == many and len(one) == 200
    stretches = C.stretches(docs, 50)
    assert stretches.where("conv_id = 7").count() >= 120 and stretches.agg(F.max("n")).first()[0] == 50
    least = C.conversation_repairs(docs).where("conv_id = 7").first()
    assert least.audit == one[7].audit and set(least.audit) == set("DIKR") and least.audit.replace("I", "") == "".join(x for x in least.audit if x != "I")


def test_edges(spark):
    rows = [(None, None, None, None), (None, 3, "user", "q?"), (None, 3, "user", "q?"), (1, None, "user", "a."), (1, 1, "assistant", "b."), (2, 0, "system", "s."), (3, 5, "", "x.")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", whole int")
    one, more = C.repair(docs)
    at = {r.conv_id: r for r in one.unionByName(more).collect()}
    assert at[None].n == 3 and at[None].n_blank == 1 and at[None].n_again == 1 and at[None].letters == "DKDI"
    assert at[1].letters == "KK" and at[1].cost == 0 and at[2].letters == "D" and at[3].letters == "D"
    kept = C.repaired_rows(docs)
    assert [(r.role, r.text) for r in kept.where("conv_id is null").orderBy("part", "stretch", "place").collect()] == [("user", "q?"), ("assistant", "")]
    assert C.conversation_repairs(docs.limit(0)).count() == 0
    all_dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    lost = C.conversation_repairs(spark.createDataFrame([(all_dropped, 0, "user", "x.")], SCHEMA)).first()
    assert tuple(lost) == (all_dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_and_odd_texts(spark):
    long = "word " * 2_000_000 + "end."
    docs = spark.createDataFrame([(1, 1, "user", long), (1, 2, "assistant", "y."), (1, 3, "user", long)], SCHEMA)
    one, more = C.repair(docs)
    rows = one.unionByName(more).orderBy("part", "stretch").collect()
    assert "".join(r.letters for r in rows) == "KKD" and sum(r.cost for r in rows) == 4
    odd = spark.sql("select 1L conv_id, 1L turn, 'user' role, cast(unhex('61ff2e') as string) text")
    one, more = C.repair(odd)
    assert more.first().letters == "KI" and more.first().out[0].text == "a�."
