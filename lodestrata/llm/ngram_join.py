"""N-gram Jaccard join by parity sketches.

A text's set of word shingles is cut by hash into K parts, and each part is folded by XOR into one
64-bit symbol. A shingle in one set only changes one symbol, so the number of differing symbols is at
most the symmetric difference; at a similarity of t that is at most (a + b)(1 - t)/(1 + t). With more
filled parts than that, similar sets share a filled symbol (pigeonhole), whatever the rest holds.
K depends on the size, so sets meet in the band of the smaller one; a set also goes to the band
below if a partner can be there.

Of its symbols a set keeps as many as it may differ in plus one, rarest first. The rarest symbol that
two similar sets share is among those of both, so nothing is lost, while what many texts share (a
licence, a menu) is hardly ever kept. Within a kept symbol every set is first held against one pivot,
and links found so far join sets into components; then only pairs across components are compared, once
for all symbols around a component and in blocks, by a second sketch with one bit a shingle, whose Hamming distance again bounds the difference
from below. What passes is verified on the sets in the same task, which sends on only links that join components. Equal sets count as one from the start.

Links lie within components, so their numbers are then counted there: components of which not every pair
is a verified link are cut into blocks, two blocks of member sets meet in one task, and only counts leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import readable, cut, small
from .components import components
from .shingles import U, mix, shingle_sets

#: Symbols that a task gathers before it sorts and sends them, and that one group gets on average.
GATHER, GROUP = 1 << 19, 1 << 20
#: Sets held against each other at once in one task, and shingles of those.
BLOCK, MEMBERS = 1024, 1 << 20
#: Bits of a set's name; those that happen to share one are told apart by 64 further bits.
NAME_BITS = 61


class Bands:
    """Sizes in bands of ratio 1.6, with the parts of each; larger ratios than 1/t lie two bands apart."""

    def __init__(self, similarity: float = 0.75):
        if not 0.65 <= similarity <= 1:
            raise ValueError("similarity must lie between 0.65 and 1")
        self.num, self.den = round(similarity * 1000), 1000
        edges = [1, 2, 3]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 2, int(edges[-1] * 1.6)))
        self.edges = np.array(edges, np.int64)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, n, "right") - 1

    def most(self, a, b):
        """How much two linked sets of these sizes differ at most."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def partner(self, n):
        """The largest set that one of n can be linked with."""
        return n * self.den // self.num

    def own(self, n):
        return self.most(n, self.partner(n))

    def lower(self, n, band):
        return self.most(n, self.edges[band] - 1)

    def reaches_down(self, n, band):
        return (band > 0) & (self.partner(self.edges[band] - 1) >= n)

    def parts(self, band):
        last = self.edges[band + 1] - 1
        return (1.11 * self.own(last)).astype(np.int64) + 6


class Names:
    """A name for each set (0 for an empty one), two low bits free, and new names for sets that share a name with another.

    Names come from one sum of hashes and are told apart by a second one, 125 bits together. taken is empty for all but
    the largest tables: of 2 * 10^10 different sets some hundred pairs share a name.
    """

    def __init__(self, bits: int, taken: Iterator[tuple[int, int]] = ()):
        self.mask = U(((1 << bits) - 1) << 3)
        self.new = {(sig, second): self._renamed(second) for sig, second in taken}
        self.old = np.array(sorted({sig for sig, _ in self.new}), np.int64)

    @staticmethod
    def _renamed(second: int) -> int:
        return int(((mix(np.array([second], np.int64).view(U)) << U(3)) | U(4)).view(np.int64)[0])

    @staticmethod
    def _sum(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        total, end = np.concatenate(([U(0)], np.cumsum(hashes, dtype=U))), np.cumsum(sizes)
        return mix((total[end] - total[end - sizes]) + sizes.astype(U))

    def seconds(self, sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self._sum(mix(sets ^ U(0x3C3C3C3C3C3C3C3C)), sizes).view(np.int64)

    def of(self, sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        sig = np.where(sizes > 0, (self._sum(mix(sets), sizes) << U(3)) & self.mask | U(4), U(0))
        if len(self.old):
            twice = np.flatnonzero(np.isin(sig.view(np.int64), self.old))
            second = self.seconds(sets, sizes)
            for i in twice:
                sig[i] = np.int64(self.new.get((int(sig.view(np.int64)[i]), int(second[i])), sig.view(np.int64)[i])).view(U)
        return sig

    def rows(self, rows: DataFrame) -> DataFrame:
        """rows with the new names in place."""
        if not self.new:
            return rows
        new = rows.sparkSession.createDataFrame([(*old, name) for old, name in self.new.items()], "sig long, second long, renamed long")
        return rows.join(F.broadcast(new), ["sig", "second"], "left").withColumn("sig", F.coalesce("renamed", "sig")).drop("renamed")


def _symbols(sets, sizes, band, k, salt) -> tuple[np.ndarray, np.ndarray]:
    """(symbol of each filled part, set it belongs to), sets given one after another and sorted."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    part = ((sets >> U(32)) * k.astype(U)[owner]) >> U(32)
    first = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])))) if len(sets) else np.zeros(0, np.int64)
    folded = np.bitwise_xor.reduceat(mix(sets + U(salt)), first) if len(sets) else sets
    at = owner[first]
    return mix(folded + part[first] * U(0x9E3779B97F4A7C15) + band.astype(U)[at] * U(0xC2B2AE3D27D4EB4F)), at


def _select(sets, sizes, chosen):
    return sets[np.repeat(chosen, sizes)], sizes[chosen]


def keys(sets: np.ndarray, sizes: np.ndarray, sigs: np.ndarray, bands: Bands) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, owner, kind, filled parts of each set) for each kind: 0 own band, 1 the band below, 2 single shingles."""
    band = np.maximum(bands.of(sizes), 0)
    filled = np.zeros((3, len(sizes)), np.int64)
    out = []
    for kind, chosen in ((0, sizes > 0), (1, (sizes > 0) & bands.reaches_down(sizes, band))):
        index = np.flatnonzero(chosen)
        s, n = _select(sets, sizes, chosen)
        b = band[index] - kind
        symbols, at = _symbols(s, n, b, bands.parts(b), 7)
        filled[kind] = np.bincount(index[at], minlength=len(sizes))
        out.append((symbols, index[at], kind))
    # too few parts are filled, in its own band or the one below: all its shingles count
    unsafe = (sizes > 0) & ((filled[0] <= bands.own(sizes)) | (bands.reaches_down(sizes, band) & (filled[1] <= bands.lower(sizes, band))))
    index = np.flatnonzero(unsafe)
    s, n = _select(sets, sizes, unsafe)
    filled[2] = np.where(unsafe, sizes, 0)
    out.append((mix(s ^ U(0xA5A5A5A5A5A5A5A5)), np.repeat(index, n), 2))
    for symbols, owner, kind in out:
        yield symbols, owner, kind, filled


def _texts(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_pylist()


def shingle_classes(docs: DataFrame, bands: Bands, names: Names, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, sig, second, filled0..2): one row a document, in one pass over the texts."""

    def run(batches):
        for batch in batches:
            texts = _texts(batch, "text")
            for first, sets, sizes in shingle_sets(texts):
                filled = next(iter(keys(sets, sizes, None, bands)))[3]
                ids = batch.column("id").slice(first, len(sizes))
                sig = pa.array(names.of(sets, sizes).view(np.int64))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), sig, pa.array(names.seconds(sets, sizes)), *(pa.array(x) for x in filled)], names=["doc_id", "n_shingles", "sig", "second", "filled0", "filled1", "filled2"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, sig long, second long, filled0 long, filled1 long, filled2 long")


def _packed_symbols(docs: DataFrame, bands: Bands, names: Names, groups: int, text_col: str) -> DataFrame:
    """(group, packed symbols with their owners): what the sets of a task hold, by range of the symbol."""

    def run(batches):
        held, size = [], 0

        def sent():
            key, sig = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            order = np.argsort(key)
            key, sig = key[order], sig[order]
            group = ((key >> U(32)) * U(groups)) >> U(32)
            edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
            pairs = np.stack([key, sig], 1)
            return pa.RecordBatch.from_arrays([pa.array(group[edge[:-1]].astype(np.int64)), pa.array([pairs[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:])], pa.binary())], names=["group", "packed"])

        for batch in batches:
            for _, sets, sizes in shingle_sets(_texts(batch, "text")):
                sigs = names.of(sets, sizes)
                new = np.zeros(len(sizes), bool)
                new[np.unique(sigs, return_index=True)[1]] = True  # copies within a run count once
                sets, sizes = _select(sets, sizes, new & (sizes > 0))
                sigs = sigs[new & (sigs > 0)]
                for symbols, owner, kind, _ in keys(sets, sizes, sigs, bands):
                    held.append((symbols, sigs[owner] | U(kind)))
                    size += len(symbols)
                if size >= GATHER:
                    yield sent()
                    held, size = [], 0
        if size:
            yield sent()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "group long, packed binary")


def _shared(table: pa.Table) -> pa.Table:
    """The symbols of a group that two or more sets hold, with how many do."""
    rows = np.concatenate([np.frombuffer(x.as_py(), U) for x in table.column("packed")]).reshape(-1, 2)
    order = np.argsort(rows[:, 0])
    key, sig = rows[order, 0], rows[order, 1]
    same = key[1:] == key[:-1]
    more = np.concatenate((same, [False])) | np.concatenate(([False], same))
    key, sig = key[more], sig[more]
    order = np.lexsort((sig, key))
    key, sig = key[order], sig[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (sig[1:] != sig[:-1]))) if len(key) else np.zeros(0, bool)
    key, sig = key[new], sig[new]
    # a set may hold one symbol for two kinds; it counts once
    first = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    own = np.concatenate(([True], (key[1:] != key[:-1]) | ((sig[1:] ^ sig[:-1]) > U(3)))) if len(key) else np.zeros(0, bool)
    start = np.flatnonzero(first)
    count = np.add.reduceat(own.astype(np.int64), start) if len(key) else np.zeros(0, np.int64)
    df = np.repeat(count, np.diff(np.append(start, len(key))))
    keep = df > 1
    key, sig, df = key[keep], sig[keep], df[keep]
    return pa.table({"key": pa.array(key.view(np.int64)), "sig": pa.array((sig & ~U(3)).view(np.int64)), "kind": pa.array((sig & U(3)).astype(np.int32)), "df": pa.array(df)})


def bit_sketch(s: np.ndarray) -> bytes:
    """One bit a shingle, XORed, in the power of two next above four times the set's size; halves fold onto each other."""
    bits = 1 << max(6, int(4 * len(s) - 1).bit_length())
    at = (mix(s ^ U(0x0F0F0F0F0F0F0F0F)) & U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches of one length, as rows of 64-bit words."""
    out = np.zeros((len(sketches), size // 8), U)
    for i, x in enumerate(sketches):
        v = np.frombuffer(x, U)
        while len(v) > size // 8:
            v = v[: len(v) // 2] ^ v[len(v) // 2 :]
        out[i] = v
    return out


def _sets(docs: DataFrame, names: Names, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(sig, n, set, sketch) of the wanted documents, from their texts."""

    def run(batches):
        for batch in batches:
            for _, sets, sizes in shingle_sets(_texts(batch, "text")):
                end = np.cumsum(sizes)
                parts = [sets[e - n : e] for e, n in zip(end, sizes) if n]
                sig = names.of(sets, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(sig[sizes > 0].view(np.int64)), pa.array(sizes[sizes > 0]), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([bit_sketch(p) for p in parts], pa.binary())], names=["sig", "n", "members", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(small(wanted), "id", "left_semi").select("text").mapInArrow(run, "sig long, n long, members binary, sketch binary")


def _passing(pairs: DataFrame, sets: DataFrame, column: str, test) -> DataFrame:
    """The pairs (a, b) whose columns pass test(n of a, n of b, column of a, column of b)."""
    side = lambda x: sets.select(F.col("sig").alias(x), F.col("n").alias(f"n{x}"), F.col(column).alias(f"v{x}"))

    def run(batches):
        for x in batches:
            na, nb = (x.column(c).to_numpy() for c in ("na", "nb"))
            va, vb = x.column("va"), x.column("vb")
            ok = [bool(test(na[i], nb[i], va[i].as_buffer(), vb[i].as_buffer())) for i in range(x.num_rows)]
            yield x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    def near(na, nb, x, y):
        size = min(len(x), len(y))
        x, y = folded([x, y], size)
        return np.bitwise_count(x ^ y).sum() <= bands.most(na, nb)

    def same(na, nb, x, y):
        shared = len(np.intersect1d(np.frombuffer(x, U), np.frombuffer(y, U), assume_unique=True))
        return shared * bands.den >= bands.num * (na + nb - shared)

    return cut(_passing(cut(_passing(pairs, sets, "sketch", near), "near"), sets, "members", same), "links")


def _across(bands: Bands):
    """Links between the components of two blocks of sets that share a symbol, as many as join them: a spanning forest.

    Pairs across components are held against each other by sketches; those that pass are verified here, and no pair of
    components once joined is looked at again.
    """

    def run(table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy()
        sig, block = (table.column(c).to_numpy() for c in ("sig", "block"))
        comp = np.unique(table.column("comp").to_numpy(), return_inverse=True)[1]
        sketches = [x.as_buffer() for x in table.column("sketch")]
        rows = folded(sketches, min(map(len, sketches)))
        members = [np.frombuffer(x.as_buffer(), U) for x in table.column("members")]
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        found = []
        for i in left:
            other = right[(comp[right] != comp[i]) & ((sig[right] > sig[i]) | (lo != hi))]
            other = other[(np.minimum(n[other], n[i]) * bands.den >= bands.num * np.maximum(n[other], n[i]))]
            other = other[np.bitwise_count(rows[other] ^ rows[i]).sum(1) <= bands.most(n[other], n[i])]
            while len(other):
                j, other = other[0], other[1:]
                shared = len(np.intersect1d(members[i], members[j], assume_unique=True))
                if shared * bands.den >= bands.num * (n[i] + n[j] - shared):
                    found.append((min(sig[i], sig[j]), max(sig[i], sig[j])))
                    comp[comp == comp[j]] = comp[i]
                    other = other[comp[other] != comp[i]]
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return run


def _counts(bands: Bands):
    """(sig, links) of each set of two blocks of a component, pairs within one block counted where it meets itself."""

    def run(table: pa.Table) -> pa.Table:
        sig, once = np.unique(table.column("sig").to_numpy(), return_index=True)  # a repeated id may give a set twice
        block, n = (table.column(c).to_numpy()[once] for c in ("block", "n"))
        members = table.column("members")
        shingles = np.concatenate([np.frombuffer(members[int(i)].as_buffer(), U) for i in once])
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        names, term = np.unique(shingles, return_inverse=True)
        end = np.cumsum(n)
        owner = np.repeat(np.arange(len(n)), n)
        order = np.argsort(term, kind="stable")
        posted = owner[order]
        begin = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(names)))))
        links = np.zeros(len(n), np.int64)
        for i in np.flatnonzero(block == lo):
            own = term[end[i] - n[i] : end[i]]
            shared = np.bincount(np.concatenate([posted[begin[t] : begin[t + 1]] for t in own]), minlength=len(n))
            ok = shared * bands.den >= bands.num * (n + n[i] - shared)
            ok &= (block == hi) & ((lo != hi) | (np.arange(len(n)) > i))
            links[i] += ok.sum()
            links += ok
        some = links > 0
        return pa.table({"sig": pa.array(sig[some]), "links": pa.array(links[some])})

    return run


def _blocks(clusters: DataFrame, key: str, blocks: F.Column) -> DataFrame:
    """Each row of clusters (key, sig) once for each pair of blocks (lo, hi) of its key that its block is one of."""
    spread = clusters.groupBy(key).agg(F.greatest(F.lit(1), blocks).cast("int").alias("blocks"))
    return (
        clusters.join(spread, key)
        .withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("lo", F.least("block", "with"))
        .withColumn("hi", F.greatest("block", "with"))
        .drop("with", "blocks")
    )


def _degrees(links: DataFrame, comps: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """(sig, links): how many sets each one is linked with, of all pairs of its component."""
    verified = cut(links.select(F.explode(F.array("a", "b")).alias("sig")).groupBy("sig").agg(F.count("*").alias("links")).join(comps.withColumnRenamed("node", "sig"), "sig"), "verified")
    sizes = verified.groupBy("component").agg((F.sum("links") == F.count("*") * (F.count("*") - 1)).alias("whole"))
    verified = verified.join(sizes, "component")
    open_ = verified.where("not whole").select("component", "sig").join(sets.select("sig", "n").distinct(), "sig")
    blocks = _blocks(cut(open_, "open"), "component", F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / MEMBERS)))
    counted = blocks.drop("n").join(sets.select("sig", "n", "members"), "sig").groupBy("component", "lo", "hi").applyInArrow(_counts(bands), "sig long, links long")
    return verified.where("whole").select("sig", "links").unionByName(counted.groupBy("sig").agg(F.sum("links").alias("links")))


def _classes(rows: DataFrame) -> DataFrame:
    """(sig, first_id, n, filled0..2, second, last_second) of every set; the last two differ if two sets share a name."""
    first = (F.first(c).alias(name) for c, name in (("n_shingles", "n"), *((f"filled{i}", f"filled{i}") for i in range(3))))
    known = rows.where("doc_id is not null and n_shingles > 0").groupBy("sig")
    return cut(known.agg(F.min("doc_id").alias("first_id"), *first, F.min("second").alias("second"), F.max("second").alias("last_second")), "classes")


def ngram_jaccard_join(docs: DataFrame, similarity: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, links) for every row of docs: exact connected components.

    Two documents link when 1000 * shared >= round(1000 * similarity) * united, over distinct five-word
    shingles (the whole sequence with fewer words). A null or wordless text has an empty set and links
    with nothing; a null id has null as its component and takes no part. Repeated rows give repeated
    rows. Bytes that aren't UTF-8 are replacement characters of their words. links counts the different sets that a document's set links with, exactly; equal sets count
    as one. A text is one row and its set one value, so a task needs some 60 bytes for each word of the longest
    text. An empty table gives an empty one; other columns of docs are left out, whatever their names.
    """
    bands, docs = Bands(similarity), docs.withColumn(text_col, readable(text_col))
    names = Names(NAME_BITS)
    rows = cut(shingle_classes(docs, bands, names, id_col, text_col), "rows")
    classes = _classes(rows)
    if not (shared_names := classes.where("second <> last_second")).isEmpty():
        kept = shared_names.select("sig", F.col("second").alias("kept"))
        taken = rows.join(F.broadcast(kept), "sig").where("doc_id is not null and second <> kept").select("sig", "second").distinct()
        names = Names(NAME_BITS, map(tuple, taken.collect()))  # see Names for how many there can be
        rows = cut(names.rows(rows), "rows")
        classes = _classes(rows)
    symbols = classes.agg(F.sum(F.col("filled0") + F.col("filled1") + F.col("filled2"))).first()[0] or 0
    groups = max(8, symbols // GROUP)

    shared = _packed_symbols(docs.where(F.col(id_col).isNotNull()), bands, names, groups, text_col).groupBy("group").applyInArrow(_shared, "key long, sig long, kind int, df long")
    below = F.lit(0)
    for j in range(1, len(bands.edges) - 1):
        below = F.when(F.col("n") >= int(bands.edges[j]), F.lit(int(bands.edges[j]) - 1)).otherwise(below)
    differ = lambda a, b: F.floor((a + b) * (bands.den - bands.num) / F.lit(bands.den + bands.num))
    own = differ(F.col("n"), F.floor(F.col("n") * bands.den / F.lit(bands.num)))
    most = F.when(F.col("kind") == 1, differ(F.col("n"), below)).otherwise(own)
    filled = F.when(F.col("kind") == 0, F.col("filled0")).when(F.col("kind") == 1, F.col("filled1")).otherwise(F.col("filled2"))
    per = W.partitionBy("sig", "kind")
    kept = (
        shared.join(classes.drop("first_id", "second", "last_second"), "sig")
        .withColumn("alone", filled - F.count("*").over(per))  # symbols that no other set holds are its rarest
        .withColumn("at", F.row_number().over(per.orderBy("df", "key")))
        .where(F.col("at") <= most + 1 - F.col("alone"))
        .select("key", "sig", "n")
        .distinct()
    )
    kept = cut(kept, "kept")
    meeting = kept.groupBy("key").agg(F.count("*").alias("held"), F.min(F.struct("sig", "n")).alias("pivot")).where("held > 1")
    met = cut(kept.join(meeting, "key"), "met")
    fits = F.least("n", "pivot.n") * bands.den >= bands.num * F.greatest("n", "pivot.n")
    stars = met.where((F.col("sig") != F.col("pivot.sig")) & fits).select(F.col("pivot.sig").alias("a"), F.col("sig").alias("b")).distinct()
    wanted = met.select("sig").distinct().join(classes.select("sig", F.col("first_id").alias("id")), "sig").select("id")
    sets = cut(_sets(docs, names, cut(wanted, "wanted"), id_col, text_col), "sets")
    links = _linked(stars, sets, bands)
    comps = cut(components(links), "comps")

    left = met.where("held > 2").select("key", "sig", "n", "held").join(comps.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("component", "sig"))
    left = cut(left.drop("component"), "left")
    # symbols whose sets lie in several components, by the smallest of these: a family shares many symbols
    # but is compared once
    open_keys = left.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key", "c0")
    clusters = cut(left.join(open_keys, "key").select("c0", "sig", "n", "comp").distinct(), "clusters")
    blocks = _blocks(clusters, "c0", F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / MEMBERS)))
    more = blocks.join(sets.select("sig", "sketch", "members"), "sig").groupBy("c0", "lo", "hi").applyInArrow(_across(bands), "a long, b long")
    links = cut(links.unionByName(more).distinct(), "all_links")
    comps = cut(components(links), "all_comps")
    degree = _degrees(links, comps, sets, bands)
    of = classes.select("sig", "first_id").join(comps.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    lowest = of.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of = of.join(lowest, "component").join(degree, "sig", "left").select("sig", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    of = cut(of, "of")
    return (
        rows.join(of, "sig", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0))).alias("links"))
    )


#: Pairs by shared shingles, and what they reach: for tables in which all pairs that share a shingle can be listed.
ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') g from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) i from w where len(w) > 0)),
n as (select doc_id, count(*) n, md5(string_agg(g, '|' order by g)) sig from s group by 1),
p as (select a.doc_id x, b.doc_id y, count(*) k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y, a.sig sx, b.sig sy from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 75 * (a.n + b.n - k)),
e as (select x, y, sx, sy from l union all select y, x, sy, sx from l),
r as (select x, y from e union select r.x, e.y from r join e on r.y = e.x),
c as (select x, min(y) y from r group by 1),
d as (select x, count(distinct sy) links from e where sx <> sy group by 1)
select w.doc_id, coalesce(n.n, 0) n_shingles, least(w.doc_id, coalesce(c.y, w.doc_id)) component_id, coalesce(d.links, 0) links
from w left join n on n.doc_id = w.doc_id left join c on c.x = w.doc_id left join d on d.x = w.doc_id
"""
