"""Lexical retrieval packing: windows filled with a seed document and its BM25 neighbours.

Document counts of all terms and the mean length are taken over all documents in one pass. Different texts are
the entries of inverted indexes with postings by term and weights of the whole corpus. One entry in SEEDS,
chosen by hash, is a seed, or as many as there are windows if that is fewer; every seed asks every index, range of entries by range, and the ranges' lists are merged to
its nearest entries in the corpus. An entry on several lists goes to the seed that has it first; entries on none are asked
again among themselves, and what no list holds then is a seed by itself. Entries are left unscored only where their
weight in all terms asked for shows that they are on no list, so a seed's list is that of brute force, however the entries
are dealt. The price is work that grows with seeds times entries: see the README for figures.

Seeds lie in the order of their heaviest term that a window's worth of documents has, and within it of the second
one; this order, each seed with its documents by rank, is cut into stretches of bounded size, which are packed
each by one task: a seed, its unused neighbours, the next seed, cut where a window is full. A seed whose documents
(copies) exceed a stretch has them dealt by hash over several. Equal texts are dealt to different windows
while there is anything else; two copies of one document (same id and text) never share a window. So only a stretch's
last window, and one that just copies of what it holds are left for, has padding, up to the next power of two.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, few_bytes, few_rows, give_back, readable, small
from .tokens import SLICE, binary, tokenizer

WINDOW, END_ID = 4096, 2
#: Bytes of text in a stretch on average, and documents at most; BM25's constants.
SHARD, DOCUMENTS, K1, B = 4 << 20, 50_000, 1.2, 0.75
#: Ids whose terms are counted at once; terms that one in COMMON texts of an index has are kept as whole rows, of CELLS numbers in all; ids and texts
#: of an index; seeds that are looked up at once; rounds of seeds, and how many times its share of the entries a seed asks for.
RUN, COMMON, CELLS, INDEX, TEXTS, ASKED, ROUNDS, LISTED = 1 << 20, 50, 8 << 20, 6 << 20, 16_000, 512, 2, 4
#: Ranges that entries are dealt to; token ids of the seeds in a task, an entry of a list for eight; texts that order the work; what rounding may take from a bound;
#: rows that are broadcast.
RANGES, BLOCK, LEADERS, SURE, BROADCAST = 6, 32 << 20, 32, 1.0001, 1_000_000
#: Entries of which one is a seed in the first round, half as many in each later one; fewer seeds if a window holds more of them.
SEEDS = 20
#: Rows that fewer of the asked seeds have are added one by one.
FEW = 0.01
#: Stretches of the vocabulary whose counts are added up apart, each in so many groups of tasks first.
PARTS, SALTS = 32, 64

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_to long, seed_id long"


def terms(ids: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts, ids given one after another: (first text, texts, owner, term, times), sorted by owner and term."""
    edge = np.concatenate(([0], np.cumsum(counts)))
    first = 0
    while first < len(counts):
        last = max(first + 1, int(np.searchsorted(edge, edge[first] + RUN, "right")) - 1)
        key = np.repeat(np.arange(last - first, dtype=np.int64) << 32, counts[first:last]) | ids[edge[first] : edge[last]].astype(np.int64)
        key.sort()
        new = np.flatnonzero(np.concatenate((key[:1] == key[:1], key[1:] != key[:-1])))
        yield first, last - first, key[new] >> 32, key[new] & 0xFFFFFFFF, np.diff(np.append(new, len(key)))
        first = last


class Corpus:
    """What BM25 needs of all documents: how many have each term, how many there are, their mean length."""

    def __init__(self, df: np.ndarray, n: int, tokens: int):
        self.df, self.n, self.mean = df, n, max(tokens / max(n, 1), 1.0)
        self.idf = np.log(1 + (n - df + 0.5) / (df + 0.5))

    def weights(self, term: np.ndarray, tf: np.ndarray, length) -> np.ndarray:
        return self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))

    def places(self, ids: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
        """Each document's two heaviest terms of those that fill a window, or else of those that it shares; -1 for none."""
        out = np.full((len(counts), 2), -1, np.int64)
        for first, n, owner, term, tf in terms(ids, counts):
            if not len(owner):
                continue
            df = self.df[term]
            weight = self.weights(term, tf, counts[first + owner]) + np.where(df * self.mean >= window, 1e6, 0)
            weight[df < 2] = 0
            begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            size, own = np.diff(np.append(begin, len(owner))), owner[begin]
            for place in range(2):
                best = np.maximum.reduceat(weight, begin)
                at = np.flatnonzero(weight == np.repeat(best, size))
                at = at[np.concatenate(([True], owner[at[1:]] != owner[at[:-1]]))]
                some = best > 0
                out[first + own[some], place] = term[at[some]]
                weight[at] = 0
        return out


class Index:
    """BM25 over the token ids of some texts: postings by term, and for terms that many have rows that are multiplied for many seeds at once."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, corpus: Corpus):
        runs = [(first + owner, term, tf) for first, _, owner, term, tf in terms(ids, counts)]
        self._fill(*(np.concatenate(x) for x in zip(*runs)), counts, corpus)

    @classmethod
    def of(cls, own: list[np.ndarray], times: list[np.ndarray], corpus: Corpus) -> Index:
        """From each text's distinct terms and how often it has them."""
        index, tf = cls.__new__(cls), np.concatenate(times).astype(np.int64)
        owner = np.repeat(np.arange(len(own)), [len(x) for x in own])
        index._fill(owner, np.concatenate(own).astype(np.int64), tf, np.bincount(owner, tf, len(own)), corpus)
        return index

    def _fill(self, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, length: np.ndarray, corpus: Corpus) -> None:
        n = self.n = len(length)
        weight = corpus.weights(term, tf.astype(np.float64), length[owner]).astype(np.float32)
        df = np.bincount(term, minlength=len(corpus.df))
        common = np.argsort(-df, kind="stable")[: CELLS // max(n, 1)]
        common = common[df[common] * COMMON > n]
        self.row = np.full(len(df), -1)
        self.row[common] = np.arange(len(common))
        inside = self.row[term] >= 0
        self.rows = np.zeros((len(common), n), np.float32)
        self.rows[self.row[term[inside]], owner[inside]] = weight[inside]
        owner, term, weight = (x[~inside] for x in (owner, term, weight))
        order = np.argsort(term, kind="stable")
        self.postings, self.posted = owner[order], weight[order]
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(df)))))

    def posts(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in term, text, weight) of all postings of some terms."""
        size = self.begin[term + 1] - self.begin[term]
        at = np.repeat(self.begin[term] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.repeat(np.arange(len(term)), size), self.postings[at], self.posted[at]

    def nearest(self, seeds: list[np.ndarray], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(texts, scores) of the k best of each seed, given by its distinct terms: by BM25 over all of them, best first, ties in order."""
        lists = Lists(np.full(len(seeds), -1), seeds, k)
        lists.ask(self, np.arange(self.n))
        some = lists.score > 0
        return [(c[x], score[x].astype(np.float64)) for c, score, x in zip(lists.c, lists.score, some)]


class Lists:
    """The k best texts of each seed, while indexes of different texts are asked one after another; a seed isn't on its own list.

    A text that has too little weight in all terms of ASKED seeds together to get on the list of one of them isn't scored.
    """

    def __init__(self, seeds: np.ndarray, own: list[np.ndarray], k: int):
        self.seeds, self.k = seeds, k
        self.edge = np.concatenate(([0], np.cumsum([len(x) for x in own])))
        self.terms = np.concatenate(own)
        self.c, self.score = np.zeros((len(seeds), k), np.int64), np.zeros((len(seeds), k), np.float32)

    def ask(self, index: Index, names: np.ndarray) -> None:
        place = np.full(index.n, -1)
        for first in range(0, len(self.seeds), ASKED):
            last = min(first + ASKED, len(self.seeds))
            term = self.terms[self.edge[first] : self.edge[last]].astype(np.int64)
            of, row = np.repeat(np.arange(last - first), np.diff(self.edge[first : last + 1])), index.row[term]
            inside = row >= 0
            has = np.zeros((last - first, len(index.rows)), np.float32)
            has[of[inside], row[inside]] = 1
            of, term = of[~inside], term[~inside]
            _, text, weight = index.posts(np.unique(term))
            most = has.max(0, initial=0) @ index.rows + np.bincount(text, weight, index.n)
            least = self.score[first:last, -1]
            reach = np.flatnonzero((most > 0) & (most * SURE >= least.min()))
            if not len(reach):
                continue
            score = self._product(has, index.rows if len(reach) > 0.9 * index.n else index.rows[:, reach])
            if score.shape[1] == index.n:
                reach = np.arange(index.n)
            place[reach] = np.arange(len(reach))
            self._add(score, index, of, term, place)
            place[reach] = -1
            self._merge(first, score, names[reach], least)

    @staticmethod
    def _product(has: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """has @ rows: seeds of one vocabulary have few of the rows of texts of another."""
        often = np.count_nonzero(has, 0) > FEW * len(has)
        if often.sum() > 0.8 * len(rows):
            return has @ rows
        score = has[:, often] @ rows[often]
        rare = np.flatnonzero(~often)
        for seed, row in zip(*np.nonzero(has[:, rare])):
            score[seed] += rows[rare[row]]
        return score

    @staticmethod
    def _add(score: np.ndarray, index: Index, of: np.ndarray, term: np.ndarray, place: np.ndarray) -> None:
        """The weights of terms that aren't rows, in runs of at most RUN postings or of one term."""
        edge = np.concatenate(([0], np.cumsum(index.begin[term + 1] - index.begin[term])))
        first = 0
        while first < len(term):
            last = max(first + 1, int(np.searchsorted(edge, edge[first] + RUN, "right")) - 1)
            at, text, weight = index.posts(term[first:last])
            text = place[text]
            kept = np.flatnonzero(text >= 0)
            np.add.at(score.reshape(-1), of[first:last][at[kept]] * score.shape[1] + text[kept], weight[kept])
            first = last

    def _merge(self, first: int, score: np.ndarray, names: np.ndarray, least: np.ndarray) -> None:
        n, k = score.shape[1], self.k
        least = np.maximum(least, np.finfo(np.float32).tiny)
        at = np.flatnonzero(score >= least[:, None])
        if len(at) > 2 * k * len(least) and n > k + 1:  # all that are as good as the k-th but for the seed itself, so that ties are cut in order
            least = np.maximum(least, np.partition(score, n - k - 1)[:, n - k - 1])
            at = at[score.reshape(-1)[at] >= least[at // n]]
        seed, text = np.divmod(at, n)
        other = names[text] != self.seeds[first + seed]
        seed, text = seed[other], text[other]
        if not len(seed):
            return
        changed = np.unique(seed)
        of = np.concatenate((np.repeat(changed, k), seed))
        c = np.concatenate((self.c[first + changed].ravel(), names[text]))
        new = np.concatenate((self.score[first + changed].ravel(), score[seed, text]))
        order = np.lexsort((c, -new, of))
        begin = np.searchsorted(of[order], changed)
        best = order[begin[:, None] + np.arange(k)]  # each has k at least, those it had
        self.c[first + changed], self.score[first + changed] = c[best], new[best]


def _windows(docs: list[np.ndarray], names: list, window: int):
    """(document, start, length, sequence, offset) of every piece; documents are in the order that windows are filled in."""
    known: dict[bytes, int] = {}
    of = [known.setdefault(d.tobytes(), len(known)) for d in docs]
    times: Counter = Counter()
    turns = []
    for c, name in zip(of, names):  # first copies of all documents come before second ones
        times[c, name] += 1
        turns.append(times[c, name])
    waiting: list[list[int]] = [[] for _ in known]
    for i in sorted(range(len(docs)), key=lambda i: (turns[i], i), reverse=True):
        waiting[of[i]].append(i)
    left = OrderedDict.fromkeys(range(len(waiting)))
    held: dict[int, set] = {}
    sequence = offset = 0
    out = []

    def place(text: int) -> None:
        nonlocal sequence, offset, held
        doc = waiting[text].pop()
        if not waiting[text]:
            del left[text]
        held.setdefault(text, set()).add(names[doc])
        start, size = 0, len(docs[doc])
        while start < size:
            take = min(size - start, window - offset)
            out.append((doc, start, take, sequence, offset))
            start, offset = start + take, offset + take
            if offset == window:
                sequence, offset = sequence + 1, 0
                held = {text: {names[doc]}} if start < size else {}

    while left:
        before = len(out)
        for text in list(left):  # one copy of each text that the window doesn't hold
            if text not in held:
                place(text)
        if len(out) == before:  # copies of what the window holds are all that is left
            text = next(iter(left))
            if names[waiting[text][-1]] is not None and names[waiting[text][-1]] in held[text]:
                sequence, offset, held = sequence + 1, 0, {}
            else:
                place(text)
    return out


def _encoded(docs: DataFrame, path: str | None) -> DataFrame:
    """(id, salt, size, ids, c) of every row, c being the hash of ids, and a row (df, n, tokens) of every task with its counts."""

    def run(batches):
        df, n, tokens = None, 0, 0
        for batch in few_bytes(batches, "text", SLICE):
            t = tokenizer(path)
            df = np.zeros(len(t.ends), np.int64) if df is None else df
            ids, counts = t.encode(batch.column("text"))
            for _, _, _, term, _ in terms(ids, counts):
                df += np.bincount(term, minlength=len(df))
            n, tokens = n + len(counts), tokens + len(ids)
            none = pa.nulls(batch.num_rows, pa.int64())
            yield from few_rows([pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "salt", "size")), binary(ids, counts), pa.nulls(batch.num_rows, pa.binary()), none, none], names=names)])
        if n:
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(1, pa.binary()), pa.array([df.tobytes()], pa.binary()), pa.array([n]), pa.array([tokens])], names=names)

    names = ["id", "salt", "size", "ids", "df", "n", "tokens"]
    out = docs.mapInArrow(run, "id long, salt long, size long, ids binary, df binary, n long, tokens long")
    return cut(out.withColumn("c", F.xxhash64("ids")), "encoded")  # where ids aren't asked for, they aren't read


def _corpus(encoded: DataFrame) -> Corpus:
    """Counts of all tasks, added up by stretches of the vocabulary: the driver gets one number a term."""

    def run(batches):
        df, n, tokens = 0, 0, 0
        for batch in batches:
            for x in batch.column("df"):
                df = df + np.frombuffer(x.as_buffer(), np.int64)
            n, tokens = n + sum(batch.column("n").to_pylist()), tokens + sum(batch.column("tokens").to_pylist())
        if n:
            parts = [x.tobytes() for x in np.array_split(df, PARTS)]
            own = lambda x: pa.array([x, *[0] * (PARTS - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([0] * PARTS, pa.int32()), pa.array(parts, pa.binary()), own(n), own(tokens)], names=["part", "salt", "df", "n", "tokens"])

    def total(table: pa.Table) -> pa.Table:
        df = np.sum([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("df")], 0)
        sums = [pa.array([pc.sum(table.column(c)).as_py()], pa.int64()) for c in ("n", "tokens")]
        return pa.table([table.column("part").slice(0, 1).combine_chunks(), table.column("salt").slice(0, 1).combine_chunks(), pa.array([df.tobytes()], pa.binary()), *sums], names=["part", "salt", "df", "n", "tokens"])

    schema = "part int, salt int, df binary, n long, tokens long"
    counts = encoded.where("n is not null").select("df", "n", "tokens").mapInArrow(run, schema)
    some = counts.withColumn("salt", F.spark_partition_id() % SALTS).groupBy("part", "salt").applyInArrow(total, schema)
    rows = sorted(some.withColumn("salt", F.lit(0)).groupBy("part", "salt").applyInArrow(total, schema).collect())  # together a number a term
    return Corpus(np.concatenate([np.frombuffer(r.df, np.int64) for r in rows]), rows[0].n, rows[0].tokens) if rows else Corpus(np.zeros(1, np.int64), 0, 0)


def _heads(rows: DataFrame, corpus: Corpus, window: int, dtype) -> DataFrame:
    """(c, salt, id, size, times, t1, t2) of each different text: its hash, one of its rows, smallest id, bytes and number of all its rows, heaviest terms.

    Texts of one hash of 64 bits would be one entry: they would be packed next to each other, and nothing else.
    """

    def places(batches):
        for batch in few_rows(batches):
            at = corpus.places(*_unpacked(batch.column("ids"), dtype), window)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(at[:, 0]), pa.array(at[:, 1])], names=[*names, "t1", "t2"])

    names = ["c", "salt", "id", "size", "times"]
    each = cut(rows.groupBy("c").agg(F.min("salt").alias("salt"), F.min("id").alias("id"), F.sum("size").alias("size"), F.count("*").alias("times")), "texts")
    whole = rows.select("c", "salt", "ids").join(small(each), ["c", "salt"])
    return cut(whole.select(*names, "ids").mapInArrow(places, "c long, salt long, id long, size long, times long, t1 long, t2 long"), "heads")


def _entries(rows: DataFrame, corpus: Corpus, window: int, dtype) -> DataFrame:
    """(c, ids) and the other columns of _heads of each different text."""
    return _with_ids(rows, _heads(rows, corpus, window, dtype))


def _with_ids(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Read from rows each time as long as heads can be broadcast; beyond that written once."""
    n = heads.count()
    out = rows.select("c", "salt", "ids").join(small(heads), ["c", "salt"])
    return out if n <= BROADCAST else cut(out, "entries")


def _unpacked(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    counts = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(column.to_pylist()), dtype), counts


class Order:
    """Texts by the leader they share most with, leaders next to ones like them, so that seeds of like terms are looked up together among texts of like terms.

    Leaders are a bounded sample; they order the work and nothing else: all texts are asked, whatever leader they have.
    """

    def __init__(self, leaders: list[np.ndarray], corpus: Corpus):
        shared = np.zeros((len(leaders), len(corpus.df)), np.float32)
        for x, own in zip(shared, leaders):
            x[own] = corpus.idf[own]
            x /= max(np.sqrt((x * x).sum()), 1e-9)
        near, chain, left = shared @ shared.T, [0], set(range(1, len(leaders)))
        while left:
            chain.append(max(left, key=lambda i: near[chain[-1], i]))
            left.remove(chain[-1])
        self.shared = np.ascontiguousarray((shared * corpus.idf.astype(np.float32))[chain].T) if leaders else np.zeros((len(corpus.df), 1), np.float32)

    def places(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Each text's distinct terms, how often it has them, and its place. No text is empty."""
        for _, n, owner, term, tf in terms(ids, counts):
            begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            near = np.concatenate([np.add.reduceat(self.shared[term[lo:hi]], begin[i : i + 256] - lo) for i in range(0, n, 256) for lo, hi in [(begin[i], begin[i + 256] if i + 256 < n else len(term))]])
            for lo, hi, place in zip(begin, [*begin[1:], len(term)], near.argmax(1).tolist()):
                yield term[lo:hi], tf[lo:hi], place


def lists(entries: DataFrame, seeds: DataFrame, corpus: Corpus, k: int, dtype, index_tokens: int = INDEX) -> DataFrame:
    """(seed, c, score): of every seed the k nearest entries of each range of the entries, both (c, ids), by BM25.

    The entries are dealt to at most RANGES ranges and the seeds to blocks, and a task has one block and one range. It holds its block's terms and
    lists, as many as fit BLOCK, and the index of index_tokens token ids after another. So a seed has k rows a range,
    however many indexes are asked; what is shuffled are the entries' distinct terms once a block and the seeds' once a range.
    """
    tokens = corpus.n * corpus.mean
    ranges = max(1, min(RANGES, math.ceil(tokens / RUN)))
    docs, asked = (x.where(F.length("ids") > 0).select("c", "ids") for x in (entries, seeds))
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()
    blocks = max(1, math.ceil((size / np.dtype(dtype).itemsize + 8 * n * k) / BLOCK))
    sample = F.pmod(F.xxhash64(F.lit(11), "c"), F.lit(max(1, corpus.n // (16 * LEADERS)))) == 0
    leaders = docs.where(sample & (F.length("ids") <= 1 << 16)).limit(LEADERS).collect()
    order = Order([np.unique(np.frombuffer(r.ids, dtype)) for r in leaders], corpus)

    def bags(batches):
        for batch in few_rows(batches):
            if batch.num_rows:
                own, times, place = zip(*order.places(*_unpacked(batch.column("ids"), dtype)))
                some = [pa.array([x.astype(dtype).tobytes() for x in own], pa.binary()), pa.array([x.astype(_bytes(x)).tobytes() for x in times], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(place, pa.int32()), pa.array([len(x) for x in own], pa.int32()), *some], names=["c", "place", "n", "terms", "times"])

    def look_up(batches):
        names, own, times, held, found, lot = [], [], [], 0, None, 0

        def ask():
            nonlocal names, own, times, held
            if names and found is not None:
                found.ask(Index.of(own, times, corpus), np.array(names, np.int64))
            names, own, times, held = [], [], [], 0

        for batch in batches:
            kind = batch.column("kind").to_numpy()
            for row, c, mine, tf in zip(kind, batch.column("c").to_pylist(), batch.column("terms"), batch.column("times")):
                if row and found is None:
                    if not names:
                        return
                    found = Lists(np.array(names, np.int64), own, k)
                    names, own = [], []
                if row != lot:
                    ask()
                    lot = row
                names.append(c)
                own.append(np.frombuffer(mine.as_buffer(), dtype))
                if row:
                    times.append(_times(tf.as_buffer(), len(own[-1])))
                    held += int(times[-1].sum())
                    if held >= index_tokens or len(names) >= TEXTS:
                        ask()
        if found is None:
            return
        ask()
        step = max(1, (1 << 16) // k)
        for at in range(0, len(found.seeds), step):
            score = found.score[at : at + step]
            seed, rank = np.nonzero(score > 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found.seeds[at + seed], found.c[at + seed, rank], score[seed, rank])], names=["seed", "c", "score"])
        found = None
        give_back()

    schema = "c long, place int, n int, terms binary, times binary"
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    hashed = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "c"), F.lit(n)).cast("int")
    rows = docs.mapInArrow(bags, schema).select(hashed(13, ranges).alias("range"), every(blocks).alias("block"), F.when(hashed(19, 16) == 0, 1).otherwise(2).alias("kind"), "*")  # a mixed lot first, so that lists have what a text must reach
    wanted = asked.mapInArrow(bags, schema).withColumn("times", F.lit(b"")).select(every(ranges).alias("range"), hashed(17, blocks).alias("block"), F.lit(0).alias("kind"), "*")
    both = rows.unionByName(wanted).repartitionById(blocks * ranges, F.col("block") * ranges + F.col("range"))
    return both.sortWithinPartitions("kind", "place", "n", "c").select("kind", "c", "terms", "times").mapInArrow(look_up, "seed long, c long, score float")


def _bytes(times: np.ndarray) -> type:
    most = times.max()
    return np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32


def _times(x, n: int) -> np.ndarray:
    return np.frombuffer(x, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(memoryview(x)) // n])


def neighbours(entries: DataFrame, seeds: DataFrame, corpus: Corpus, k: int, dtype, index_tokens: int = INDEX) -> DataFrame:
    """(seed, c, score, rank): the k nearest entries of every seed, both (c, ids), by BM25 over all entries; see lists."""
    found = lists(entries, seeds, corpus, k, dtype, index_tokens)
    return found.withColumn("rank", F.row_number().over(W.partitionBy("seed").orderBy(F.desc("score"), "c"))).where(F.col("rank") <= k)


def _claims(entries: DataFrame, n: int, corpus: Corpus, window: int, dtype, index_tokens: int) -> DataFrame:
    """(c, seed, rank): the seed that each entry is packed with; see the top."""
    share = max(1 / (1 << 20), min(1.0, corpus.n / max(n, 1) * min(1 / SEEDS, (corpus.mean + 1) / window)))  # of rows: few texts with many copies are all seeds
    left, claimed = entries.select("c", "ids"), []
    for turn in range(ROUNDS):
        part = share if turn == 0 else share / 2
        k = max(10, math.ceil(LISTED / part))
        is_seed = F.pmod(F.xxhash64(F.lit(turn), F.col("c")), F.lit(1 << 20)) < math.ceil(part * (1 << 20))
        seeds = left.where(is_seed)
        near = neighbours(left, seeds, corpus, k, dtype, index_tokens).where(~is_seed)
        taken = near.groupBy("c").agg(F.min(F.struct("rank", "seed")).alias("best")).select("c", "best.seed", "best.rank")
        claimed.append(cut(taken.unionByName(seeds.select("c", F.col("c").alias("seed"), F.lit(0).alias("rank"))), "claims"))
        left = left.join(small(claimed[-1].select("c")), "c", "left_anti")
        left = cut(left, "left") if turn + 1 < ROUNDS and n > BROADCAST else left
    alone = left.select("c", F.col("c").alias("seed"), F.lit(0).alias("rank"))
    for x in claimed:
        alone = alone.unionByName(x)
    return alone


def _placed(entries: DataFrame, claims: DataFrame, shard_bytes: int) -> DataFrame:
    """(c, seed, rank, seed_id, times, at, spread): where each entry lies in the order of seeds, in bytes, and how far its copies are dealt."""
    heads = entries.select(F.col("c").alias("seed"), F.col("id").alias("seed_id"), "t1", "t2")
    rows = cut(claims.join(entries.select("c", "size", "times"), "c").join(heads, "seed"), "seeded")
    pairs = cut(rows.groupBy("t1", "t2").agg(F.sum("size").alias("pair")), "pairs")
    # one row a term of the vocabulary
    tops = sorted(map(tuple, pairs.groupBy("t1").agg(F.sum("pair")).collect()))
    starts = np.cumsum([0, *(x[1] for x in tops)]).tolist()
    tops = F.broadcast(entries.sparkSession.createDataFrame([(t, x, n) for (t, n), x in zip(tops, starts)], "t1 long, start long, whole long"))
    order = W.partitionBy("t1").orderBy("t2").rowsBetween(W.unboundedPreceding, -1)
    hot = cut(pairs.join(tops.where(F.col("whole") > shard_bytes), "t1").select("t1", "t2", "pair", F.coalesce(F.sum("pair").over(order), F.lit(0)).alias("before")), "hot")
    # not more than a seed for each shard_bytes of the input
    big = cut(rows.groupBy("seed").agg(F.sum("size").alias("group")).where(F.col("group") > shard_bytes), "big")
    lo, size = F.col("start") + F.coalesce("before", F.lit(0)), F.coalesce("pair", "whole")
    inside = F.pmod(F.xxhash64("seed"), F.lit(1 << 20)) / F.lit(1 << 20)  # seeds of one pair of terms stay whole
    dealt = F.col("group").isNotNull()
    at = lo + size * F.when(dealt, 0.0).when(size > shard_bytes, inside).otherwise(0.5)
    out = rows.join(tops, "t1").join(small(hot), ["t1", "t2"], "left").join(small(big), "seed", "left")
    return cut(out.select("c", "seed", "rank", "seed_id", "times", at.alias("at"), F.when(dealt, size).otherwise(0).alias("spread")), "placed")


def _sharded(rows: DataFrame, placed: DataFrame, n: int, shard_bytes: int) -> DataFrame:
    """(id, salt, ids, seed, rank, seed_id, at, shard) of every row. Texts of which there are many copies, a thousand at most, are joined by broadcast."""
    hot = F.col("times") * 1000 > max(n, 1_000_000)
    few = F.broadcast(placed.where(hot))
    joined = rows.join(few, "c").unionByName(rows.join(few.select("c"), "c", "left_anti").join(small(placed.where(~hot)), "c"))
    share = F.pmod("salt", F.lit(1 << 20)) / F.lit(1 << 20)
    return joined.select("id", "salt", "ids", "seed", "rank", "seed_id", "at", F.floor((F.col("at") + F.col("spread") * share) / shard_bytes).alias("shard"))


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD, index_tokens: int = INDEX) -> DataFrame:
    """One row for each piece of a document; see PIECES.

    Every row of docs is packed, repeated rows each for themselves and never two in one window, a null text as
    the end id alone; bytes that aren't UTF-8 are read as replacement characters; a null id stays null, and rows with one may meet. Each id lies in exactly one piece, and a
    sequence's offsets have no gaps. sequence_id holds the stretch in its upper half. A text longer than a stretch is a
    stretch of its own, so a task needs some ten times the size of the longest text. An empty table gives an empty
    one; other columns of docs are left out, whatever their names.
    """
    id_, text = F.col(id_col).cast("long"), readable(text_col)
    each = -(-shard_bytes // DOCUMENTS)
    salt = F.xxhash64(F.lit(5), id_, text, F.monotonically_increasing_id())  # the place tells equal rows apart
    encoded = _encoded(docs.select(id_.alias("id"), salt.alias("salt"), (F.coalesce(F.octet_length(text), F.lit(0)) + each).cast("long").alias("size"), text.alias("text")), path)
    corpus = _corpus(encoded)
    dtype = tokenizer(path).dtype
    rows = encoded.where("n is null").select("id", "salt", "size", "ids", "c")
    heads = _heads(rows, corpus, window, dtype)
    placed = _placed(heads, _claims(_with_ids(rows, heads.select("c", "salt")), heads.count(), corpus, window, dtype, index_tokens), shard_bytes)

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([(x, "ascending") for x in ("at", "seed", "rank", "id", "salt")])
        docs = [np.append(np.frombuffer(x.as_buffer(), dtype), dtype(end_id)) for x in table.column("ids")]
        pieces = _windows(docs, table.column("id").to_pylist(), window)
        doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces))
        base = table.column("shard")[0].as_py() << 32
        crc = [zlib.crc32(docs[d][s : s + n].astype("<u4").tobytes()) for d, s, n in zip(doc, start, length)]
        tokens = np.bincount(sequence, length).astype(np.int64)[sequence]
        ids, seeds = (table.column(x).combine_chunks().take(pa.array(doc)) for x in ("id", "seed_id"))
        padded = np.where(tokens == window, window, 1 << np.ceil(np.log2(np.maximum(tokens, 1))).astype(np.int64))
        return pa.table([ids, start, length, crc, [len(docs[d]) for d in doc], base + sequence, offset, tokens, np.minimum(padded, window), seeds], names=[x.split()[0] for x in PIECES.split(", ")])

    return _sharded(rows, placed, corpus.n, shard_bytes).groupBy("shard").applyInArrow(fill, PIECES)
