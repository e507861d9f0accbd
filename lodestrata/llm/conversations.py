"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate.

A conversation's rows and what may be done with them make a graph: a node for each row and state of the pattern
`(s?(ua)+)?`, an arc for each edit. Least costs from the start and to the end are worked out from both sides; an arc is tight
if what leads to it, its own cost and what follows add up to the least of all. Every walk over tight arcs is a cheapest
repair, and the frontier takes the least letter that a tight arc out of it has, step by step.

Rows are sorted over the whole table and cut into stretches, each of them one row of the stored table. Most
conversations are one stretch. Of one that goes on over several, each stretch is summed up as least costs between
its states, 16 numbers, which are put together in order; so no task ever has to walk a whole conversation to repair it.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, crc32_sql, cut, small

#: Costs of edits; what an undeleted truncated row adds.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: First faults of rows, in the order in which they count.
FINE, BLANK, AGAIN, BROKEN = range(4)
INITIALS = "sua"
#: States of the pattern: nothing yet, after s, after u, after a. ROW: state that the initial at each place of INITIALS leads to.
STATES, ACCEPTED = range(4), (0, 3)
ROW = ((1, 2, None), (None, 2, None), (None, None, 3), (None, 2, None))
#: State that a user or assistant row of our own leads to, and that row's role.
OWN = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE = {2: "user", 3: "assistant"}
INF = 1 << 60
START = (0, INF, INF, INF)
#: Rows and bytes of text of a stretch at most; at least one row.
ROWS, BYTES = 4096, 4 << 20
BLANKS = " \t\n\x0b\f\r"


@functools.cache
def arcs(code: int) -> tuple[tuple[str, int, int, int], ...]:
    """(letter, cost, from, to) of what may be done with a row of code = 4 * fault + place of its initial; letters in order."""
    fault, initial = divmod(code, 4)
    out = [("D", DELETE, s, s) for s in STATES]
    if fault not in (BLANK, AGAIN):
        more = TRUNCATED * (fault == BROKEN)
        out += [("K", more, s, ROW[s][initial]) for s in STATES if initial < 3 and ROW[s][initial] is not None]
        out += [("R", REROLE + more, s, t) for s, t in OWN.items()]
    return tuple(out)


@functools.cache
def inserted(costs: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs forward if rows may be inserted first."""
    for _ in range(2):
        costs = tuple(min([costs[t], *(costs[s] + INSERT for s in OWN if OWN[s] == t and costs[s] < INF)]) for t in STATES)
    return costs


@functools.cache
def _forward(costs: tuple[int, ...], code: int) -> tuple[int, ...]:
    costs, out = inserted(costs), [INF] * 4
    for _, cost, s, t in arcs(code):
        if costs[s] < INF:
            out[t] = min(out[t], costs[s] + cost)
    return tuple(out)


@functools.cache
def _backward(code: int | None, after: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs to the end before a row, or with None before inserts alone, from those behind it."""
    out = list(after) if code is None else [INF] * 4
    for _, cost, s, t in () if code is None else arcs(code):
        out[s] = min(out[s], after[t] + cost)
    for _ in range(2):
        out = [min(out[s], out[OWN[s]] + INSERT) for s in STATES]
    return tuple(min(x, INF) for x in out)


#: Least costs from each state behind the last row.
END = _backward(None, tuple(0 if s in ACCEPTED else INF for s in STATES))


def _based(costs: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """(least, costs above it): there are few different ones, so steps are remembered."""
    least = min(costs)
    return least, tuple(x - least if x < INF else INF for x in costs)


def forward(costs: tuple[int, ...], codes: bytes) -> list[tuple[int, ...]]:
    """Least costs of all states before each row and behind the last one."""
    base, at = _based(costs)
    out = [costs]
    for c in codes:
        more, at = _based(_forward(at, c))
        base += more
        out.append(tuple(x + base if x < INF else INF for x in at))
    return out


def backward(codes: bytes, after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Least costs to the end from all states before each row, inserts included, and behind the last one."""
    base, at = _based(after)
    out = [after]
    for c in reversed(codes):
        more, at = _based(_backward(c, at))
        base += more
        out.append(tuple(x + base if x < INF else INF for x in at))
    return out[::-1]


def walk(codes: bytes, before: tuple[int, ...], after: tuple[int, ...], state: int, ends: bool) -> tuple[str, int]:
    """(letters, state reached) of the least walk over tight arcs from a state before the first row.

    before and after are least costs up to the first row and from behind the last one. Rows that are
    inserted behind the last row belong to it only where the conversation ends.
    """
    there, back = forward(before, codes), backward(codes, after)
    least = min(a + b for a, b in zip(inserted(there[0]), back[0]))
    there = [inserted(x) for x in there]
    letters, i, frontier = [], 0, {state}
    while i < len(codes) or ends:
        tight = [(letter, t) for letter, cost, s, t in (arcs(codes[i]) if i < len(codes) else ()) if s in frontier and there[i][s] + cost + back[i + 1][t] == least]
        tight += [("I", OWN[s]) for s in frontier if there[i][s] + INSERT + back[i][OWN[s]] == least and back[i][s] == INSERT + back[i][OWN[s]]]
        if not tight:
            break
        letter = min(x for x, _ in tight)
        frontier = {t for x, t in tight if x == letter}
        letters.append(letter)
        i += letter != "I"
    (state,) = frontier
    return "".join(letters), state


def repaired(roles: list[str], texts: list[str], letters: str, state: int, codes: bytes) -> Iterator[tuple[str, str]]:
    """(role, text) of the rows that letters leave, from the state before the first."""
    i = 0
    for letter in letters:
        if letter == "I":
            state = OWN[state]
            yield ROLE[state], ""
            continue
        if letter == "K":
            state = ROW[state][codes[i] % 4]
            yield roles[i], texts[i]
        elif letter == "R":
            state = OWN[state]
            yield ROLE[state], texts[i]
        i += 1


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as the crc32 of conv_id:turn says: rows dropped, emptied, broken off, repeated, given to the user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", "turn", kind.alias("kind"), role.alias("role"), text.alias("text")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


_STRETCH = (
    "conv_id bigint, part int, stretch int, whole boolean, n bigint, n_blank bigint, n_again bigint, n_broken bigint, illegal bigint, turns bigint, "
    "least_turn bigint, largest_turn bigint, first_turn bigint, last_turn bigint, first_initial int, last_initial int, codes binary, costs array<bigint>, roles array<string>, texts array<string>"
)
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def stretches(rows: DataFrame, most: int = ROWS) -> DataFrame:
    """Rows in order, a stretch of one conversation in each row of the result; (part, stretch) is the order of all.

    A stretch has most rows at most; whole tells that it is all of its conversation for certain.
    """
    at = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    at = at.withColumns({"digest": F.md5("text"), "at": F.struct(F.col("turn").isNotNull().alias("known"), "turn")})
    often = at.groupBy("conv_id", "role", "digest").agg(F.count("*").alias("times"), F.min("at").alias("first")).where("times > 1")
    often = small(often.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first"))
    marked = at.join(often, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("hash")]
    ready = marked.select(
        "conv_id", "turn", "role", "text", F.xxhash64("text").alias("hash"), place.alias("initial"), (~F.col("text").rlike(WORD)).alias("blank"),
        F.coalesce(F.col("at") > F.col("first"), F.lit(False)).alias("again"), (~last.isin(".", "!", "?")).alias("broken"),
    )

    def pack(batches):
        part, k, held, size, before, begun = TaskContext.get().partitionId(), 0, [], 0, None, 0

        def out(whole: bool) -> tuple:
            nonlocal k, held, size
            conv, turns, roles, texts, codes = (held[0][0], *([r[i] for r in held] for i in (1, 2, 3, 4)))
            codes, known = bytes(codes), sorted({t for t in turns if t is not None})
            # a whole conversation needs no costs between its states
            costs = None if whole else [x for s in STATES for x in forward(tuple(0 if t == s else INF for t in STATES), codes)[-1]]
            initials = [c % 4 for c in codes]
            faults = [c // 4 for c in codes]
            row = (
                conv, part, k, whole, len(held), *(faults.count(x) for x in (BLANK, AGAIN, BROKEN)), sum(p not in _LEGAL for p in zip(initials, initials[1:])), len(known),
                known[0] if known else None, known[-1] if known else None, turns[0], turns[-1], initials[0], initials[-1], codes, costs, roles, texts,
            )
            k, held, size = k + 1, [], 0
            return row

        def batch_of(some: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.int64()] * 10, pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some), kinds)], names=[f.split()[0] for f in _STRETCH.split(", ")])

        for batch in batches:
            done = []
            for conv, turn, role, text, _, initial, blank, again, broken in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (conv != held[0][0] or len(held) >= most or size >= BYTES):
                    goes_on = conv == held[0][0]
                    done.append(out(not goes_on and begun > 0 and held[0][5]))
                    begun += not goes_on
                same = before is not None and before == (conv, turn, role, text)
                fault = BLANK if blank else AGAIN if again or same else BROKEN if broken else FINE
                first = before is None or before[0] != conv  # with begun > 0: the conversation's first row
                before = (conv, turn, role, text)
                held.append((conv, turn, role, text, 4 * fault + initial, first))
                size += len(text)
            if done:
                yield batch_of(done)
        if held:
            yield batch_of([out(False)])

    return cut(_utf8(ready).repartitionByRange(*keys).sortWithinPartitions(*keys, "text").mapInArrow(pack, _STRETCH), "stretches")


def _utf8(rows: DataFrame) -> DataFrame:
    """Bytes that aren't UTF-8 as replacement characters, before texts become Python's."""
    return rows.withColumns({c: F.when(F.is_valid_utf8(c), F.col(c)).otherwise(F.make_valid_utf8(c)) for c in ("role", "text")})


def _in_order(segments: DataFrame, fold, schema: str) -> DataFrame:
    """fold(list of rows) -> rows, over the few light rows that each conversation has, in order."""

    def run(batches):
        held: list[dict] = []
        names = [f.split()[0] for f in schema.split(", ")]
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
        types = [kinds[f.split()[1]] for f in schema.split(", ")]
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if held and held[0]["conv_id"] != row["conv_id"]:
                    done += fold(held)
                    held = []
                held.append(row)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[n] for d in done], t) for n, t in zip(names, types)], names=names)
        if held:
            done = fold(held)
            yield pa.RecordBatch.from_arrays([pa.array([d[n] for d in done], t) for n, t in zip(names, types)], names=names)

    return segments.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "stretch").mapInArrow(run, schema)


def _sides(held: list[dict]) -> list[dict]:
    """Least costs up to and from behind each stretch, and whether it is its conversation's last."""
    before, out = START, []
    for row in held:
        out.append({"part": row["part"], "stretch": row["stretch"], "conv_id": row["conv_id"], "before": list(before), "ends": row is held[-1]})
        c = row["costs"]
        before = tuple(min(min(before[s] + c[4 * s + t] for s in STATES), INF) for t in STATES)
    after = END
    for row, x in zip(reversed(held), reversed(out)):
        x["after"] = list(after)
        c = row["costs"]
        after = tuple(min(min(c[4 * s + t] + after[t] for t in STATES), INF) for s in STATES)
    return out


def _entries(held: list[dict]) -> list[dict]:
    """State in which the least walk comes to each stretch."""
    state, out = 0, []
    for row in held:
        out.append({"part": row["part"], "stretch": row["stretch"], "state": state})
        state = row["exits"][state]
    return out


def _exits(sided: DataFrame) -> DataFrame:
    """For each stretch, the state that the least walk leaves it in from each state it may come in; -1 from others."""

    def run(batches):
        for batch in batches:
            rows, exits = batch.to_pylist(), []
            for r in rows:
                before, after = tuple(r["before"]), tuple(r["after"])
                back = backward(r["codes"], after)[0]
                ready = [a + b for a, b in zip(before, back)]
                exits.append([walk(r["codes"], before, after, s, r["ends"])[1] if ready[s] == min(ready) else -1 for s in STATES])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), batch.column("stretch"), pa.array(exits, pa.list_(pa.int64()))], names=["conv_id", "part", "stretch", "exits"])

    return sided.select("conv_id", "part", "stretch", "codes", "before", "after", "ends").mapInArrow(run, "conv_id bigint, part int, stretch int, exits array<bigint>")


_REPAIRED = "letters string, cost bigint, out array<struct<role: string, text: string>>"


def _solved(planned: DataFrame) -> DataFrame:
    """Stretches with (letters, cost, out): the edits in order, what they cost, and the rows they leave."""
    light = [c for c in planned.columns if c not in ("codes", "costs", "roles", "texts", "before", "after", "ends", "state")]
    fields = ", ".join(f"`{n}` {t}" for n, t in planned.select(*light).dtypes)

    def run(batches):
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            letters, costs, out = [], [], []
            for codes, before, after, ends, state, roles, texts in zip(*(batch.column(c).to_pylist() for c in ("codes", "before", "after", "ends", "state", "roles", "texts"))):
                x, _ = walk(codes, tuple(before), tuple(after), state, ends)
                letters.append(x)
                broken, done = 0, x.replace("I", "")
                for c, letter in zip(codes, done):
                    broken += letter != "D" and c // 4 == BROKEN
                costs.append(DELETE * x.count("D") + INSERT * x.count("I") + REROLE * x.count("R") + TRUNCATED * broken)
                out.append([{"role": r, "text": t} for r, t in repaired(roles, texts, x, state, codes)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in light), pa.array(letters, pa.string()), pa.array(costs, pa.int64()), pa.array(out, kind)], names=[*light, "letters", "cost", "out"])

    return planned.mapInArrow(run, f"{fields}, {_REPAIRED}")


def repair(rows: DataFrame, most: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(conversations of one stretch, stretches of the others), each with what stretches() counts and letters, cost and out.

    rows have conv_id, turn, role and text; further columns are left out. Null roles and texts are one blank; rows without conv_id are
    one conversation. Rows stand by turn, null first, and within a turn by role and a hash of the text. A role counts by its first
    letter, small or not at all; an empty one matches nothing. Empty and blank texts, and rows
    whose role and text came before, are deleted. Bytes that aren't UTF-8 become replacement characters. Very long texts
    are stretches of their own, held some six times by a task. An empty table gives empty results.
    """
    packed = stretches(rows, most)
    whole = packed.where("whole").withColumns({"before": F.array(*map(F.lit, START)).cast("array<bigint>"), "after": F.array(*map(F.lit, END)).cast("array<bigint>"), "ends": F.lit(True), "state": F.lit(0)})
    parts = packed.where("not whole")
    sides = cut(_in_order(parts.select("conv_id", "part", "stretch", "costs"), _sides, "conv_id bigint, part int, stretch int, before array<bigint>, after array<bigint>, ends boolean"), "sides")
    exits = _exits(parts.select("part", "stretch", "codes").join(sides, ["part", "stretch"]))
    entries = _in_order(exits, _entries, "part int, stretch int, state int")
    planned = parts.join(sides.drop("conv_id"), ["part", "stretch"]).join(entries, ["part", "stretch"])
    return _solved(whole), cut(_solved(planned), "repaired")


def repaired_rows(rows: DataFrame, most: int = ROWS) -> DataFrame:
    """(conv_id, part, stretch, place, role, text): the rows that repair() leaves; (part, stretch, place) is their order."""
    one, more = repair(rows, most)
    return one.unionByName(more).select("conv_id", "part", "stretch", F.posexplode("out").alias("place", "row")).select("conv_id", "part", "stretch", "place", "row.role", "row.text")


_SUMS = ("n", "n_blank", "n_again", "n_broken", "illegal", "turns", "cost")


def _digests(solved: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of stretches that come in order."""
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")

    def run(batches):
        at = None  # of the conversation that goes on: its sums, letters and hash so far

        def result():
            gaps = at["largest"] - at["least"] + 1 - at["turns"] if at["least"] is not None else 0
            return at["conv_id"], gaps, at["n_blank"], at["n_again"], at["n_broken"], at["illegal"], at["cost"], "".join(at["letters"]), at["hash"].hexdigest()

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if n in names[-2:] else pa.int64()) for n, x in zip(names, zip(*rows))], names=names)

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if at is None or at["conv_id"] != r["conv_id"]:
                    if at is not None:
                        done.append(result())
                    at = {"conv_id": r["conv_id"], "least": None, "largest": None, "letters": [], "hash": hashlib.sha256(), "rows": 0} | dict.fromkeys(_SUMS, 0)
                else:
                    at["illegal"] += (at["initial"], r["first_initial"]) not in _LEGAL
                    at["turns"] -= r["first_turn"] is not None and r["first_turn"] == at["turn"]
                for k in _SUMS:
                    at[k] += r[k]
                if r["least_turn"] is not None:
                    at["least"] = r["least_turn"] if at["least"] is None else at["least"]
                    at["largest"] = r["largest_turn"]
                at["initial"], at["turn"] = r["last_initial"], r["last_turn"]
                at["letters"].append(r["letters"])
                for x in r["out"]:
                    at["hash"].update(f"{chr(10) if at['rows'] else ''}{x['role']}:{x['text']}".encode())
                    at["rows"] += 1
            if done:
                yield batch_of(done)
        if at is not None:
            yield batch_of([result()])

    return solved.select("conv_id", *_SUMS, "least_turn", "largest_turn", "first_turn", "last_turn", "first_initial", "last_initial", "letters", "out").mapInArrow(run, "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")


def conversation_repairs(conversations: DataFrame, most: int = ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conv_id, after damaged().

    Nulls, blank and long texts, repeated rows and empty tables as in repair(); a conversation that lost all rows has zeros, no
    letters and the hash of nothing. The hash of a conversation's repaired texts is a fold over them in order, so a conversation of
    many stretches is hashed by one task, which holds one stretch and the letters.
    """
    one, more = repair(damaged(conversations), most)
    ordered = more.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "stretch")
    found = _digests(one).unionByName(_digests(ordered)).withColumnRenamed("conv_id", "id")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id")
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.withColumns(zeros | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))})


def _sql_arcs() -> str:
    """All ways over one row, rows inserted first included: (code, from, to, cost, letters, user rows put in, way of the row, its role)."""
    rows = []
    for code in [*range(16), -1]:
        for s in STATES:
            for n in range(3):
                at, put = s, ""
                for _ in range(n):
                    at = OWN[at]
                    put += f"{ROLE[at]}:|"
                if code < 0:
                    rows.append((code, s, at, INSERT * n, "I" * n, put, "", ""))
                else:
                    rows += [(code, s, t, INSERT * n + cost, "I" * n + letter, put, letter, ROLE.get(t, "")) for letter, cost, f, t in arcs(code) if f == at]
    return ", ".join(f"({c}, {s}, {t}, {cost}, '{letters}', '{put}', '{way}', '{role}')" for c, s, t, cost, letters, put, way, role in rows)


_BLANKS = r"[\x20\x09-\x0D]"
#: Row by row, the cheapest and then least letters up to each state; no two of a state and cost begin alike, so the least stay least.
ORACLE = rf"""
with recursive a as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32_sql("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 kind from conversations),
b as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(case when kind = 3 then [0, 1] else [0] end) from a where kind <> 0),
o as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) i, count(*) over (partition by conv_id) n from b),
c as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 again from o),
d as (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then {BLANK} when again then {AGAIN} when not regexp_matches(text, '[.!?]{_BLANKS}*$') then {BROKEN} else {FINE} end fault,
  case when role[1] in ('s', 'u', 'a') then instr('{INITIALS}', role[1]) - 1 else 3 end initial from c),
e as materialized (select * from d union all select distinct conv_id, null, null, null, n + 1, n, null, null, null from d),
v as materialized (select * from (values {_sql_arcs()}) v(code, f, t, cost, letters, put, way, own)),
w as (select conv_id, cast(0 as bigint) i, 0 s, 0 cost, '' audit, '' x from (select distinct conv_id from d)
  union all select conv_id, i, s, cast(m[1:9] as integer), substr(m, 10), x from (
   select w.conv_id, e.i, v.t s, min(lpad(cast(w.cost + v.cost as varchar), 9, '0') || w.audit || v.letters) m,
    arg_min(w.x || v.put || case v.way when 'K' then e.role || ':' || e.text || '|' when 'R' then v.own || ':' || e.text || '|' else '' end, lpad(cast(w.cost + v.cost as varchar), 9, '0') || w.audit || v.letters) x
   from w join e on w.conv_id is not distinct from e.conv_id and e.i = w.i + 1 join v on v.f = w.s and v.code = coalesce(4 * e.fault + e.initial, -1) group by 1, 2, 3)),
r as (select w.conv_id, cost, audit, replace(x[:-2], '|', chr(10)) x from w join (select conv_id, max(i) i from e group by 1) l on w.conv_id is not distinct from l.conv_id and w.i = l.i where s in {ACCEPTED}
  qualify row_number() over (partition by w.conv_id order by lpad(cast(cost as varchar), 9, '0') || audit) = 1),
p as (select *, role[1] || lead(role[1]) over (partition by conv_id order by i) pair from d),
q as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count_if(fault = {BLANK}) blank, count_if(fault = {AGAIN}) duplicate, count_if(fault = {BROKEN}) truncated, count_if(pair is not null and pair not in ('su', 'ua', 'au')) illegal from p group by 1)
select k.conv_id, cast(coalesce(gaps, 0) as bigint) gaps, cast(coalesce(blank, 0) as bigint) blank, cast(coalesce(duplicate, 0) as bigint) duplicate, cast(coalesce(truncated, 0) as bigint) truncated, cast(coalesce(illegal, 0) as bigint) illegal,
 cast(coalesce(cost, 0) as bigint) cost, coalesce(audit, '') audit, sha256(coalesce(x, '')) repaired_sha256
from (select distinct conv_id from conversations) k left join q on k.conv_id is not distinct from q.conv_id left join r on k.conv_id is not distinct from r.conv_id
"""
