"""Language ID by error-correcting output codes.

Each language has a codeword. For every bit, a binary classifier over hashed byte n-grams tells the
languages with a one there from those with a zero: smoothed log odds of the n-grams of its two sides, each side
pooled over its learning rows, and a threshold half way between what the sides get on average. Learning is one pass
over all learning rows, whose tasks send two count vectors a bit, however many languages there are. A text's margin
for a bit is the mean weight of its n-grams. The codeword with the least loss over all bits wins, each bit
weighted by how well it tells its sides apart; a close second marks the text as ambiguous.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, readable

#: Features; bytes of text looked up at once; distance of the two best probabilities that is ambiguous.
BINS, SLICE, CLOSE = 1 << 15, 1 << 20, 0.2
#: Stretches of bins added up apart; languages whose counts a task holds at once; languages up to which codewords are drawn for distance.
PARTS, HELD, PAIRS = 32, 64, 256

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD = _FOLD.tobytes()


def ngram_bins(text: str) -> Iterator[np.ndarray]:
    """Bins of a text's byte 2- to 4-grams, SLICE bytes at a time; ASCII letters in lower case, other ASCII as blanks, blanks in one."""
    raw = (" " + text + " ").encode("utf-8", "surrogatepass").translate(_FOLD)
    whole = np.frombuffer(raw, np.uint8)
    if len(whole) > 1:
        whole = whole[np.concatenate(([True], (whole[1:] != 32) | (whole[:-1] != 32)))]
    for at in range(0, len(whole), SLICE):
        b = whole[at : at + SLICE + 3].astype(np.uint32)
        out, g = [], b
        for n in (2, 3, 4):
            if len(b) < n:
                break
            g = g[:-1] * np.uint32(257) + b[n - 1 :]
            out.append(((g[:SLICE] * np.uint32(2654435761) + np.uint32(n)) >> np.uint32(17)) & np.uint32(BINS - 1))
        if out:
            yield np.concatenate(out)


def ngram_vector(text: str) -> tuple[np.ndarray, int]:
    """(times of each bin, n-grams) of a text."""
    total, n = np.zeros(BINS), 0
    for bins in ngram_bins(text):
        total += np.bincount(bins, minlength=BINS)
        n += len(bins)
    return total, n


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def codewords(languages: int, seed: int = 11) -> np.ndarray:
    """A 0/1 row for each language: all splits in two for up to six, else seeded rows kept far apart.

    No column is constant, none repeats another or its complement while there are enough.
    """
    if languages < 2:
        return np.ones((languages, 1), np.int8)
    if languages <= 6:
        n = 2 ** (languages - 1) - 1
        return np.array([[1] * n] + [[j >> i & 1 for j in range(n)] for i in range(languages - 1)], np.int8)
    bits = max(15, 6 * math.ceil(math.log2(languages)))
    rng, best, apart = np.random.default_rng(seed), None, -1
    for _ in range(300 if languages <= PAIRS else 1):
        columns: dict[bytes, np.ndarray] = {}
        while len(columns) < bits:
            c = rng.permutation(np.arange(languages) % 2).astype(np.int8)
            c ^= c[0]  # a column and its complement are one split
            columns.setdefault(c.tobytes(), c)
        m = np.stack(list(columns.values()), 1)
        if languages > PAIRS:
            return m
        d = (m[:, None] != m[None]).sum(2) + bits * np.eye(languages, dtype=int)
        if d.min() > apart:
            best, apart = m, d.min()
    return best


def side_counts(rows: DataFrame, weight: dict[str, float], codes: dict[str, np.ndarray], bits: int) -> DataFrame:
    """(part, packed): for a stretch of bins, counts of the sides with a one of all bits and then of everything.

    Every whole text counts with its n-grams divided by their number's root and by weight of its language. A task
    holds one vector for each of HELD languages and one a bit; n-grams of short texts are counted together.
    """

    def run(batches):
        sums = np.zeros((bits + 1, BINS))
        held: dict[str, np.ndarray] = {}
        short: dict[str, list[tuple[np.ndarray, float]]] = {}

        def count():
            for lang, some in short.items():
                bins, weights = zip(*some)
                add(lang, np.bincount(np.concatenate(bins), np.repeat(weights, [len(x) for x in bins]), BINS))
            short.clear()

        def add(lang, vector):
            if lang not in held and len(held) == HELD:
                send()
            at = held.setdefault(lang, np.zeros(BINS))
            np.add(at, vector, out=at)

        def send():
            if held:
                signs = np.array([[*codes[x], 1] for x in held], np.float64)
                np.add(sums, signs.T @ np.stack(list(held.values())), out=sums)
                held.clear()

        size = 0
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                if len(text) > SLICE // 8:
                    times, n = ngram_vector(text)
                    if n:
                        add(lang, times * (weight[lang] / math.sqrt(n)))
                    continue
                for bins in ngram_bins(text):  # one at most
                    short.setdefault(lang, []).append((bins, weight[lang] / math.sqrt(len(bins))))
                    size += len(bins)
                if size >= SLICE:
                    count()
                    size = 0
        count()
        send()
        parts = [np.ascontiguousarray(x).tobytes() for x in np.split(sums, PARTS, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], names=["part", "packed"])

    def total(table: pa.Table) -> pa.Table:
        at = 0
        for x in table.column("packed"):
            at = at + np.frombuffer(x.as_buffer(), np.float64)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "packed": pa.array([at.tobytes()], pa.binary())})

    schema = "part int, packed binary"
    return rows.mapInArrow(run, schema).groupBy("part").applyInArrow(total, schema)


class Model:
    """Weights (bins x bits), thresholds, codewords and languages; a few MB whatever the corpus."""

    def __init__(self, languages: list[str], codes: np.ndarray, ones: np.ndarray, everything: np.ndarray, smooth: float = 0.5):
        """ones: bits x bins, counts of each bit's side with a one; everything: counts of all rows."""
        self.languages, self.codes = languages, codes
        one, zero = ones + smooth, everything - ones + smooth
        one, zero = (np.maximum(x, smooth) / np.maximum(x, smooth).sum(1, keepdims=True) for x in (one, zero))
        weights = np.log(one / zero)
        high, low = (one * weights).sum(1), (zero * weights).sum(1)
        self.weights, self.middle, self.scale = weights.T.astype(np.float32), (high + low) / 2, np.maximum((high - low) / 2, 1e-9)
        # a bit counts by the margin that its own two sides get on average
        self.trust = self.scale / self.scale.sum() if len(self.scale) else self.scale

    def margins(self, text: str) -> np.ndarray | None:
        """How far above (or below) its threshold a text is for each bit; the sides get 1 and -1 on average."""
        total, n = np.zeros(len(self.scale)), 0
        for bins in ngram_bins(text):
            total += np.bincount(bins, minlength=BINS) @ self.weights if len(bins) > 20_000 else self.weights[bins].sum(0)
            n += len(bins)
        return (total / n - self.middle) / self.scale if n else None

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Logistic loss of each codeword, weighted over bits."""
        signs = np.where(self.codes == 1, 1.0, -1.0)
        return np.log1p(np.exp(np.clip(-4 * signs * margins, -60, 60))) @ self.trust

    def predict(self, text: str | None) -> tuple[str, float, str | None, bool]:
        """(language, score, runner-up, ambiguous); und with score 0 without letters or languages."""
        if not self.languages or not has_letter(text):
            return "und", 0.0, None, True
        margins = self.margins(text)
        if margins is None:
            return "und", 0.0, None, True
        loss = self.losses(margins)
        p = np.exp(-3 * (loss - loss.min()))
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        second = p[order[1]] if len(p) > 1 else 0.0
        return self.languages[order[0]], float(min(1.0, p[order[0]])), self.languages[order[1]] if len(p) > 1 else None, bool(p[order[0]] - second < CLOSE)


def fit(rows: DataFrame) -> Model:
    """Learn from all rows of (text, lang) that have both; each language weighs the same in the sides it is on.

    The driver gets the languages' names with their rows, and two vectors a bit.
    """
    learned = rows.where("text is not null and lang is not null").select("text", "lang")
    held = sorted(tuple(r) for r in learned.groupBy("lang").count().collect())
    names = [x for x, _ in held]
    codes = codewords(len(names))
    bits = codes.shape[1] if names else 0
    most = max((n for _, n in held), default=1)
    counted = cut(side_counts(learned, {x: most / n for x, n in held}, dict(zip(names, codes)), bits), "sides")
    sums = np.zeros((bits + 1, BINS))
    for r in counted.toLocalIterator():
        sums[:, r.part * (BINS // PARTS) : (r.part + 1) * (BINS // PARTS)] = np.frombuffer(r.packed, np.float64).reshape(bits + 1, -1)
    return Model(names, codes, sums[:-1], sums[-1])


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """keep's columns with (lang_pred, score, runner_up, ambiguous): whole texts, language never read from docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bins x bits floats

    def run(batches):
        for batch in batches:
            lang, score, second, close = zip(*map(shared.value.predict, batch.column("langid_text").to_pylist())) if batch.num_rows else ((),) * 4
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(second, pa.string()), pa.array(close, pa.bool_())], names=[*batch.schema.names[:-1], "lang_pred", "score", "runner_up", "ambiguous"])

    at = docs.select(*keep, F.col(text_col).alias("langid_text"))
    fields = ", ".join(f"`{n}` {t}" for n, t in at.dtypes[:-1])
    return at.mapInArrow(run, ", ".join(x for x in (fields, "lang_pred string, score double, runner_up string, ambiguous boolean") if x))


def language_id(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, runner_up, ambiguous) of every row of documents.

    Rows whose crc32 of doc_id as text leaves 2 at a division by 4 are held out; the others with a
    non-null lang are learnt from. A null doc_id is learnt from as the empty string. Null or letterless
    texts get und, 0. Bytes that aren't UTF-8 are read as replacement characters. Repeated rows are learnt from and predicted one by one. A text is one value in its task, some ten
    times its size. An empty table gives an empty one; without labels all is und; other columns of docs are left out.
    """
    docs = docs.withColumn("text", readable("text"))
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    model = fit(docs.where(~out))
    return identify(docs, model, keep=(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out")))
