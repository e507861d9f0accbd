"""Periodic runs of words by the runs theorem.

A run is a stretch of words with smallest period q, twice as long as q or longer, that can't be extended. By the runs
theorem every run has a root which is the longest Lyndon word at its start, under some order of the words or under the
opposite one. The longest Lyndon word at a place ends where the next suffix that is smaller begins, so the next smaller values
of the inverse suffix array give all roots; each is extended to both sides by longest common extensions,
which are minima of the array of longest common prefixes, looked up in a sparse table.

Suffixes are sorted by prefix doubling, for many texts at once; what is told apart is not sorted again.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_sql, free, words

#: Words of the shortest run; words that equal stretches a period apart have at least: a run of q < 6 has SHORTEST - q > 6, one of q >= 6 has q.
SHORTEST = 12
SEED = SHORTEST // 2
#: Bytes of text cut into words at once; words whose suffixes are sorted at once, unless one text has more.
SLICE, HELD = 1 << 20, 1 << 18


def suffix_ranks(codes: np.ndarray, end: np.ndarray, last: bool) -> np.ndarray:
    """Place of each suffix among all in order. codes differ between texts; end is where each place's text ends.

    A suffix that another goes on from stands before it, or with last behind it.
    """
    n = len(codes)
    rank = np.empty(n, np.int64)
    todo, key = np.arange(n), codes
    base = np.zeros(n, np.int64)
    step = 0
    while len(todo):
        by = np.argsort(key, kind="stable")
        todo, key, base = todo[by], key[by], base[by]
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(head, len(key)))
        group = np.flatnonzero(np.concatenate(([True], base[1:] != base[:-1])))
        within = np.arange(len(key)) - np.repeat(group, np.diff(np.append(group, len(key))))
        rank[todo] = np.repeat(base[head] + within[head], size)
        todo = todo[np.repeat(size > 1, size)]
        step = max(1, 2 * step)
        to = todo + step
        base = rank[todo]
        follow = np.where(to < end[todo], rank[np.minimum(to, n - 1)] + 1, n + 1 if last else 0)
        key = base * (n + 2) + follow
    return rank


def common_prefixes(codes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each place in order, how many words the suffix there has in common with the one before; one walk over the words."""
    n = len(codes)
    before = np.empty(n + 1, np.int64)
    before[rank + 1] = np.arange(n)
    before[0] = n
    s, out, h = [*codes.tolist(), -1], [0] * n, 0
    for i, (r, j) in enumerate(zip(rank.tolist(), before[rank].tolist())):
        while s[i + h] == s[j + h] and j < n:
            h += 1
        out[r] = h
        if h:
            h -= 1
    return np.array(out, np.int64)


def next_smaller(values: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each place, the next one of its text with a smaller value, or the text's end."""
    v, e = values.tolist(), end.tolist()
    out = [0] * len(v)
    for i in range(len(v) - 1, -1, -1):
        j, stop, x = i + 1, e[i], v[i]
        while j < stop and v[j] > x:
            j = out[j]
        out[i] = j
    return np.array(out, np.int64)


def range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo..hi] for each pair, by a sparse table of which one level is held at a time."""
    level = np.frexp(hi - lo + 1)[1] - 1
    out, table = np.zeros(len(lo), np.int64), values
    by = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[by], np.arange(level.max() + 2)) if len(by) else [0]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        q = by[a:b]
        out[q] = np.minimum(table[lo[q]], table[hi[q] - (1 << k) + 1])
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def _extensions(codes: np.ndarray, end: np.ndarray, rank: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that the suffixes at i and j of one text, j > i, have in common; 0 where j is the text's end."""
    shared, out = common_prefixes(codes, rank), np.zeros(len(i), np.int64)
    inside = np.flatnonzero(j < end[i])
    a, b = rank[i[inside]], rank[j[inside]]
    out[inside] = range_minima(shared, np.minimum(a, b) + 1, np.maximum(a, b))
    return out


def runs_of(codes: np.ndarray, sizes: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """Rows (text, start, length, period), in that order of sorting but for length, of texts one after another, sizes words each."""
    if not len(codes):
        return np.zeros((0, 4), np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    stop = np.cumsum(sizes)
    end, begin = np.repeat(stop, sizes), np.repeat(stop - sizes, sizes)
    codes = np.unique(text * (codes.max() + 1) + codes, return_inverse=True)[1].astype(np.int64)
    n = len(codes)
    low = suffix_ranks(codes, end, False)
    roots = np.concatenate((next_smaller(low, end), next_smaller(-suffix_ranks(codes, end, True), end)))
    i = np.tile(np.arange(n), 2)
    i, j = np.unique(np.stack((i, roots), 1), axis=0).T
    right = _extensions(codes, end, low, i, j)
    back, back_end = codes[::-1], n - begin[::-1]
    left = _extensions(back, back_end, suffix_ranks(back, back_end, False), n - j, n - i) if n else right
    left[i == begin[i]] = 0
    start, length, period = i - left, j + right - i + left, j - i
    found = length >= np.maximum(shortest, 2 * period)
    rows = np.stack((text[i], start - begin[i], period, length), 1)[found]
    return np.unique(rows, axis=0)[:, [0, 1, 3, 2]]


def may_repeat(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether SEED words of a text are found twice in it, as in every text with a run; a few others pass as well."""
    n = len(codes) - SEED + 1
    stop = np.cumsum(sizes)
    if n <= 0:
        return np.zeros(len(sizes), bool)
    text = np.repeat(np.arange(len(sizes)), sizes)
    whole = text[:n] == text[SEED - 1 :]
    h = text[:n].astype(np.uint64)
    for k in range(SEED):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + codes[k : n + k].astype(np.uint64)
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    by = np.argsort(h[whole], kind="stable")
    at, h = text[:n][whole][by], h[whole][by]
    out = np.zeros(len(stop), bool)
    out[at[1:][(h[1:] == h[:-1]) & (at[1:] == at[:-1])]] = True
    return out


def find_runs(texts: list[list[bytes]], shortest: int = SHORTEST) -> list[np.ndarray]:
    """For each text, given as its words, rows (start, length, period) of its runs by start and period."""
    none = np.zeros((0, 3), np.int64)
    out, held, size = [none] * len(texts), [], 0
    ids = defaultdict(count().__next__)
    codes = [np.fromiter(map(ids.__getitem__, w), np.int64, len(w)) for w in texts]

    def solve():
        rows = runs_of(np.concatenate([codes[k] for k in held]), np.array([len(codes[k]) for k in held]), shortest)
        cuts = np.searchsorted(rows[:, 0], np.arange(len(held) + 1))
        for k, a, b in zip(held, cuts, cuts[1:]):
            out[k] = rows[a:b, 1:]

    for k in np.flatnonzero(may_repeat(np.concatenate(codes), np.array([len(w) for w in texts]))) if texts else ():
        if held and size + len(codes[k]) > HELD:
            solve()
            held, size = [], 0
        held.append(k)
        size += len(codes[k])
    if held:
        solve()
    return out


def collapsed(text: list[bytes], runs: np.ndarray) -> bytes:
    """A text's words without those that a run contains after its first period."""
    if not len(runs):
        return b" ".join(text)
    step = np.zeros(len(text) + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(text[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0))


def periodic_runs(docs: DataFrame, text: Column | str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns, then n_words, runs and collapsed, for each row of docs.

    Words are runs of anything but ASCII white space, in bytes: texts that aren't UTF-8 are taken as they are. runs is an
    array of (start, length, period), words numbered from 0, by start and period. collapsed has the words that
    no run contains after its first period, a blank between two. A null or empty text has no words, no runs and an empty
    collapsed text. Repeated rows are worked on one by one; an empty table gives an empty one. keep's columns that are called like new
    ones stay and the new ones get underscores. A text is worked on whole in one task, which needs some 500 bytes a word for
    texts that repeat six words and some 100 for others.
    """
    n_words, runs, short, held = free(docs.select(*keep), "n_words", "runs", "collapsed", "runs_text")
    at = docs.select(*keep, (F.col(text) if isinstance(text, str) else text).cast("binary").alias(held))

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            size = np.cumsum([0, *(x or 0 for x in pa.compute.binary_length(batch.column(batch.num_columns - 1)).to_pylist())])
            first = 0
            while first < batch.num_rows:
                stop = max(first + 1, int(np.searchsorted(size, size[first] + SLICE, "right")) - 1)
                some = batch.slice(first, stop - first)
                texts = [(x or b"").split() for x in some.column(some.num_columns - 1).to_pylist()]
                found = find_runs(texts)
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
                column = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], fields=list(kind.value_type)))
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(c) for c in range(some.num_columns - 1)), pa.array([len(w) for w in texts], pa.int64()), column, pa.array([collapsed(w, r) for w, r in zip(texts, found)], pa.binary())],
                    names=[*some.schema.names[:-1], n_words, runs, short],
                )
                first = stop

    fields = ", ".join(f"`{n}` {t}" for n, t in at.dtypes[:-1])
    out = at.mapInArrow(run, ", ".join(x for x in (fields, f"`{n_words}` bigint, `{runs}` array<struct<start: bigint, length: bigint, period: bigint>>, `{short}` binary") if x))
    return out.withColumn(short, F.col(short).cast("string"))


def repeating_ends(doc_id: Column, text: Column) -> Column:
    """text, or for one id in ten the text whose words repeat with a period from some word on, as the crc32 of the id says.

    A null id has no crc32 and its text stays.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def end(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.concat(F.slice(w, 1, a), F.transform(F.sequence(a, n - 1), lambda i: F.get(w, a + (i - a) % p))), " ")

    whole = F.transform(F.array(words(text)), lambda w: F.when(F.size(w) > 0, end(w)).otherwise(text))
    return F.when(h % 10 == 0, F.get(whole, 0)).otherwise(text)


def documents_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, n_words) of every row of documents.

    Texts with repeating_ends; the longest run (ties: smallest start, then period) is named, with nulls where there is none.
    Nulls, empty and long texts, repeated rows and empty tables as in periodic_runs; other columns of docs are left out.
    """
    found = periodic_runs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), repeating_ends(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    b = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
    start, length, period = -F.col("b.start"), F.col("b.length"), -F.col("b.period")
    return b.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")


_W = r"[^\x20\x09-\x0D]+"
#: Every run gives pairs of equal SEED words a period apart; their stretches, extended, are runs unless a divisor of the period is one too.
ORACLE = rf"""
with d as (select row_number() over () k, doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') w, {crc32_sql('cast(doc_id as varchar)')} h from documents),
e as (select *, len(w) n, h // 10 g from d),
f as (select *, case when h % 10 = 0 and n > 0 then g % n end a, case when h % 10 = 0 and n > 0 then 1 + (n - g % n) // (3 + g % 8) end p from e),
t as materialized (select k, doc_id, n, case when a is null then w else list_transform(range(0, n), lambda i: case when i < a then w[i + 1] else w[a + (i - a) % p + 1] end) end w from f),
s as (select k, w, unnest(range(1, n - {SEED} + 2)) i from t where n >= {SHORTEST}),
x as (select k, i, hash(array_to_string(w[i : i + {SEED} - 1], ' ')) g from s),
y as (select x.k, y.i - x.i q, x.i from x join x y on x.k = y.k and x.g = y.g and x.i < y.i),
z as (select k, q, i, i - row_number() over (partition by k, q order by i) part from y),
r as materialized (select k, min(i) - 1 s, count(*) + {SEED} - 1 + q l, q from z group by k, q, part having count(*) + {SEED} - 1 + q >= greatest({SHORTEST}, 2 * q)),
runs as materialized (select * from r where not exists (select 1 from r o where o.k = r.k and o.q < r.q and o.s <= r.s and o.s + o.l >= r.s + r.l)),
b as (select k, count(*) n_runs, first(s order by l desc, s, q) s, first(l order by l desc, s, q) l, first(q order by l desc, s, q) q, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) x,
  list_distinct(flatten(list(range(s + q, s + l)))) gone from runs group by k)
select doc_id, cast(coalesce(n_runs, 0) as bigint) n_runs, cast(s as bigint) as start, cast(l as bigint) length, cast(q as bigint) period, cast(1000 * l // q as bigint) exponent_milli,
 sha256(coalesce(x, '')) runs_sha256, sha256(case when n_runs is null then array_to_string(w, ' ') else array_to_string(list_filter(w, lambda v, i: not list_contains(gone, i - 1)), ' ') end) collapsed_sha256, cast(n as bigint) n_words
from t left join b using (k)
"""
