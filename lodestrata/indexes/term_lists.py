"""Stored lists of chunks by term, for words and trigrams: a search reads the lists of its own terms and nothing else.

A list's rows lie in the partition of its term's bucket, sorted by term, so a search names its buckets when it is planned and
skips pages by term. A row is a term's part of a stretch of about a million words: the keys and positions
of the stretch's chunks that have it, as bytes, so the rows that are shuffled and sorted are terms a stretch, not terms a chunk.
Their numbers of chunks tell beforehand which lists are short. The lists of frequent terms are cut into as many files as they need.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fulltext, trigram
from . import packed as p

#: Rows of a stored file at most; ids that are sent to all tasks at most; lists read beyond what the threshold needs; entries unpacked at once.
FILE_ROWS, SENT, MORE, ENTRIES = 200_000, 1_000_000, 2, 200_000
#: Keys of these types are stored as bytes, unless a stretch has a null; others as arrays.
WHOLE = ("tinyint", "smallint", "int", "bigint")


class TermLists:
    """lists/ (tenant, bucket: term, chunks, keys, positions of words) below a path."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, key: str = "chunk_id", tenant: str = "org_id"):
        self.spark, self.path, self.buckets, self.key, self.tenant = spark, path.rstrip("/"), buckets, key, tenant

    def append(self, rows: DataFrame) -> None:
        """Store what lexeme_rows() or trigram_rows() give, beside what is there."""
        at = rows.withColumn("bucket", (F.crc32("term") % self.buckets).cast("int"))
        out = at.hint("rebalance", self.tenant, "bucket").sortWithinPartitions(self.tenant, "bucket", "term")
        out.write.mode("append").option("maxRecordsPerFile", FILE_ROWS).option("compression", "zstd").partitionBy(self.tenant, "bucket").parquet(f"{self.path}/lists")

    def _rows(self, tenant, terms: Iterable[str]) -> DataFrame:
        terms = sorted(set(terms))
        buckets = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        at = self.spark.read.parquet(f"{self.path}/lists")
        return at.where((F.col(self.tenant) == F.lit(tenant)) & F.col("bucket").isin(buckets) & F.col("term").isin(terms))

    def lists(self, tenant, terms: Iterable[str]) -> DataFrame:
        """(term, key and other columns, positions of words): a row for each chunk and term."""
        return _unpacked(self._rows(tenant, terms))

    def counts(self, tenant, terms: Iterable[str]) -> dict[str, int]:
        """Chunks of each term that has any: a row a term reaches the driver. Deleted chunks still count."""
        g = self._rows(tenant, terms).groupBy("term").agg(F.sum("chunks").alias("chunks"))
        return {r.term: r.chunks for r in g.collect()}


def _unpacked(rows: DataFrame) -> DataFrame:
    words = "positions" in rows.columns
    keys = {f.name: f.dataType.elementType.simpleString() for f in rows.schema["plain"].dataType.fields}

    def entries(some: pa.RecordBatch, coded: bool) -> pa.RecordBatch:
        term, n, bytes_, plain = some.columns
        n = n.to_numpy()
        values, edge = p.unpacked(bytes_)
        at = edge[:-1].copy()
        out = [term.take(pa.array(np.repeat(np.arange(len(n)), n)))]
        for i in range(len(keys)):
            out.append(pa.array(p.walked(*p.taken(values, at, n))).cast(plain.type.field(i).type.value_type) if coded else plain.field(i).flatten())
        if words:
            each, _ = p.taken(values, at, n)
            own = np.concatenate(([0], np.cumsum(each.astype(np.int64))))
            total = np.diff(own[np.concatenate(([0], np.cumsum(n)))])
            places = p.walked(p.taken(values, at, total)[0], own)
            out.append(pa.ListArray.from_arrays(pa.array(own.astype(np.int32)), pa.array(places.astype(np.int32))))
        return pa.RecordBatch.from_arrays(out, names=["term", *keys, *["positions"] * words])

    def run(batches):
        for batch in batches:
            for coded in (True, False):
                own = batch.filter(pc.is_null(batch.column(3)) if coded else pc.is_valid(batch.column(3)))
                total, first = np.cumsum(own.column(1).to_numpy()), 0
                while first < len(total):
                    last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + ENTRIES, "right")))
                    yield entries(own.slice(first, last - first), coded)
                    first = last

    fields = ", ".join(f"`{n}` {t}" for n, t in {"term": "string", **keys, **({"positions": "array<int>"} if words else {})}.items())
    return rows.select("term", "chunks", "positions" if words else "entries", "plain").mapInArrow(run, fields)


def _packed(chunks: DataFrame, tenant: str, keys: tuple[str, ...], text: str, words: bool) -> DataFrame:
    """(tenant, term, chunks, entries or positions, plain): a row for each term of a stretch of chunks.

    entries has its chunks' keys as distances; positions also each chunk's number of positions, then these. plain has the keys if they aren't whole numbers.
    """
    name = "positions" if words else "entries"
    rows = chunks.select(tenant, *keys, fulltext.tokens(F.col(text)).alias("words"))
    types = dict(rows.dtypes)
    whole = all(types[k] in WHOLE for k in keys)

    def block(some: pa.RecordBatch) -> pa.RecordBatch:
        listed = some.column(len(keys) + 1)
        if words:  # by lexeme and row, of which the positions stay in order
            row, at, gram, terms = fulltext.lexeme_entries(listed)
            order = np.argsort(gram, kind="stable")
            row, at, gram = row[order], at[order], gram[order]
            begin = np.flatnonzero(np.diff(gram.astype(np.int64) * len(some) + row, prepend=-1))
            each = np.diff(np.append(begin, len(row)))
            row, gram = row[begin], gram[begin]
        else:
            row, gram, terms = trigram.trigram_entries(listed)
        whose = some.column(0).dictionary_encode()
        if len(whose.dictionary) + whose.null_count > 1:  # by tenant first
            owner = whose.indices.fill_null(len(whose.dictionary)).to_numpy(zero_copy_only=False)[row]
            order = np.argsort(owner, kind="stable")
            if words:
                to = np.repeat(begin[order] - (np.cumsum(each[order]) - each[order]), each[order]) + np.arange(len(at))
                at, each = at[to], each[order]
            row, gram, owner = row[order], gram[order], owner[order]
            first = np.flatnonzero((np.diff(gram, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
        else:
            first = np.flatnonzero(np.diff(gram, prepend=-1))
        edge = np.append(first, len(row)).astype(np.int64)
        out = {tenant: some.column(0).take(pa.array(row[first])), "term": pa.array(terms, pa.string()).take(pa.array(gram[first])), "chunks": pa.array(np.diff(edge).astype(np.int32))}
        columns = some.columns[1 : len(keys) + 1]
        coded = whole and not any(c.null_count for c in columns)
        lists = [(p.steps(c.to_numpy()[row], edge), edge) for c in columns] if coded else []
        if words:
            own = np.concatenate(([0], np.cumsum(each)))
            lists += [(each, edge), (p.steps(at, own), own[edge])]
        out[name] = p.packed(*p.joined(lists)) if lists else pa.array([b""] * len(first), pa.binary())
        if coded:
            out["plain"] = pa.nulls(len(first), pa.struct([(k, pa.list_(c.type)) for k, c in zip(keys, columns)]))
        else:
            out["plain"] = pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), c.take(pa.array(row))) for c in columns], names=list(keys))
        return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    def run(batches):
        for batch in batches:
            for first, last in fulltext.slices(batch.column(len(keys) + 1)):
                yield block(batch.slice(first, last - first))

    plain = ", ".join(f"`{k}`: array<{types[k]}>" for k in keys)
    return rows.mapInArrow(run, f"`{tenant}` {types[tenant]}, term string, chunks int, {name} binary, plain struct<{plain}>")


def lexeme_rows(chunks: DataFrame, tenant: str = "org_id", keys: tuple[str, ...] = ("chunk_id",), text: str = "content") -> DataFrame:
    """What is stored of chunks for search by words: keys and positions by term, many chunks a row."""
    return _packed(chunks, tenant, keys, text, True)


def trigram_rows(chunks: DataFrame, tenant: str = "org_id", keys: tuple[str, ...] = ("chunk_id",), text: str = "content") -> DataFrame:
    return _packed(chunks, tenant, keys, text, False)


def word_matches(lists: TermLists, tenant, terms: fulltext.Terms, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep's columns, lex) of the chunks that satisfy the terms; lex has the query's lexemes with their positions.

    Chunks of the rarest word that all matches have are looked for in the other lists; where its list is known to be
    short it is sent to all tasks, else lists meet by key. No content is read.
    """
    key = [lists.key, *keep]
    wanted = terms.wanted()
    every = sorted({*wanted, *fulltext.Terms.lexemes(terms.none)})
    needed = sorted({*fulltext.Terms.lexemes(terms.all), *(x for p in terms.phrases for x in fulltext.Terms.lexemes(p))})
    rows = lists.lists(tenant, every)
    count = lists.counts(tenant, needed)
    if needed:
        rarest = min(needed, key=lambda t: (count.get(t, 0), t))
        ids = rows.where(F.col("term") == rarest).select(lists.key)
        rows = rows.join(F.broadcast(ids) if count.get(rarest, 0) <= SENT else ids, lists.key, "left_semi")
    else:  # words that no match may have don't make one
        rows = rows if wanted else rows.limit(0)
    lex = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("term").alias("lexeme"), "positions"))).alias("lex"))
    return lex.where(fulltext.matches(F.col("lex"), terms))


def word_scores(lists: TermLists, tenant, terms: fulltext.Terms, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep's columns, score): the cover density of every match."""
    return word_matches(lists, tenant, terms, keep).withColumn("score", fulltext.rank(F.col("lex"), terms)).drop("lex")


def trigram_candidates(lists: TermLists, tenant, query: str, threshold: float = trigram.THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep's columns) of the chunks that may match: all that have enough of the query's trigrams, and few others.

    A match has at least threshold of the query's trigrams. Of the rarest lists only as many are read as that
    asks for, and MORE; a chunk that is on fewer of them than a match must be isn't one, whatever the frequent lists say.
    """
    wanted = trigram.query_trigrams(query)
    count = lists.counts(tenant, wanted)
    there = sorted((t for t in wanted if count.get(t)), key=lambda t: (count[t], t))
    least = math.ceil(threshold * len(wanted) - 1e-9)
    if not wanted or len(there) < least:
        return lists.lists(tenant, wanted or ("",)).select(lists.key, *keep).limit(0)
    read = min(len(there), len(there) - least + 1 + MORE)
    rows = lists.lists(tenant, there[:read])
    on = rows.groupBy(lists.key, *keep).agg(F.count(F.lit(1)).alias("on"))
    return on.where(F.col("on") >= least - (len(there) - read)).drop("on")
