"""Trigrams of words and the best match of a query within a longer text."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fulltext
from .scalars import once

#: Least similarity of a match (the usual server default).
THRESHOLD = 0.6


def ordered_trigrams(text: Column) -> Column:
    """Trigrams in order of the text: lower case, words of letters and digits padded by two blanks before and one behind."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3)))))


def trigrams(text: Column) -> Column:
    return F.array_distinct(ordered_trigrams(text))


def best_extent(query: set[str], grams: Iterable[str]) -> float:
    """Greatest |common| / |query or extent| over stretches of grams; each end grows and shrinks greedily.

    A stretch is kept as its distinct grams in the order of their last places, of which there are less than
    the square of the query's, so work is in proportion to the text's length, also where it repeats itself. The best begin is
    looked for from the end backwards, at grams of the query, until no longer stretch can reach the score.
    """
    last: dict[str, None] = {}
    best, common, n = 0.0, 0, len(query)
    for g in grams:
        hit = g in query
        if not hit and not last:
            continue
        if g in last:
            del last[g]
        else:
            common += hit
        last[g] = None  # behind all others
        if not hit:
            continue
        score, kept, c, s = -1.0, 0, 0, 0
        for old in reversed(last):
            s += 1
            if old in query:
                c += 1
                if (longer := c / (n + s - c)) >= score:
                    score, kept, left = longer, s, c
            elif common / (n + s - c) < score:
                break
        for old in list(islice(last, len(last) - kept)):
            del last[old]
        common = left
        best = max(best, score)
        if best == 1:
            break
    return best


def word_trigrams(word: str) -> list[str]:
    """Trigrams of one lower-case word, in order."""
    p = f"  {word} "
    return [p[i : i + 3] for i in range(len(p) - 2)]


def trigram_entries(words: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row, number of the trigram), each pair once, by trigram and row, and the trigrams. A word's trigrams are taken once."""
    row, word, different = fulltext.numbered(words)
    pair = distinct(row.astype(np.int64) * max(1, len(different)) + word, len(words) * len(different))
    row, word = np.divmod(pair, max(1, len(different)))
    letters = np.frombuffer("".join(f"  {w} " for w in different).encode("utf-32-le"), np.uint32).astype(np.int64)
    n = np.fromiter(map(len, different), np.int64, len(different)) + 1
    at = np.arange(n.sum()) + 2 * np.repeat(np.arange(len(n)), n)  # a word has two letters more than trigrams
    code, grams = pd.factorize(letters[at] << 42 | letters[at + 1] << 21 | letters[at + 2]) if len(at) else (at, at)
    each = n[word]
    code = code[np.arange(each.sum()) + np.repeat((np.cumsum(n) - n)[word] - (np.cumsum(each) - each), each)]
    gram, row = np.divmod(distinct(code * len(words) + np.repeat(row, each), len(grams) * len(words)), max(1, len(words)))
    named = ["".join(map(chr, (g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF))) for g in grams.tolist()]
    return row, gram, named


@F.arrow_udf(T.ArrayType(T.StringType()))
def _listed(words: pa.Array) -> pa.Array:
    def some(part: pa.Array) -> pa.Array:
        row, gram, named = trigram_entries(part)
        order = np.argsort(row, kind="stable")
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(len(part) + 1)).astype(np.int32)), pa.array(named, pa.string()).take(pa.array(gram[order])))

    parts = [some(words.slice(first, last - first)) for first, last in fulltext.slices(words)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))


def listed(text: Column) -> Column:
    """trigrams() in any order, of whole tables of texts: a word's are taken once a stretch of texts."""
    return _listed(fulltext.tokens(text))


def distinct(keys: np.ndarray, most: int) -> np.ndarray:
    """Different keys in order; they are smaller than most."""
    if most > fulltext.FLAGS:
        keys = np.sort(keys)
        return keys[np.flatnonzero(np.diff(keys, prepend=-1))]
    seen = np.zeros(most, bool)
    seen[keys] = True
    return np.flatnonzero(seen)


def scorer(query: str, threshold: float = 0.0):
    """A function of the words of many texts: their word similarity to the query, 0 where too few of its trigrams are in a text to reach the threshold.

    The query comes first, the measure isn't symmetric. The trigrams of a word are taken once a stretch of texts, and those
    of a text one after another, until they have all of the query's.
    """
    wanted = set(query_trigrams(query))
    least = threshold * len(wanted) - 1e-9

    def score(words: pa.Array) -> pa.Array:
        out = np.zeros(len(words))
        for first, last in fulltext.slices(words):
            row, word, different = fulltext.numbered(words.slice(first, last - first))
            grams = [word_trigrams(w) for w in different]
            hits = [wanted.intersection(g) for g in grams]
            hit = np.flatnonzero(np.array([bool(h) for h in hits], bool)[word]) if len(word) else np.zeros(0, np.int64)
            ends = np.searchsorted(row, np.arange(last - first), "right")
            edge = np.append(np.flatnonzero(np.diff(row[hit], prepend=-1)), len(hit))
            for a, b in zip(edge[:-1], edge[1:]):
                i = row[hit[a]]
                if len(set().union(*(hits[w] for w in set(word[hit[a:b]].tolist())))) >= least:
                    out[first + i] = best_extent(wanted, chain.from_iterable(map(grams.__getitem__, word[hit[a] : ends[i]].tolist())))
        return pa.array(out)

    return score


def similarity(words: Column, query: str, threshold: float = 0.0) -> Column:
    """scorer() over a column of tokens()."""
    score = scorer(query, threshold)

    @F.arrow_udf("double")
    def similar(words: pa.Array) -> pa.Array:
        return score(words)

    return similar(words)


def _words(text: str) -> list[str]:
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", text.lower())


def query_trigrams(query: str) -> list[str]:
    return sorted({g for w in _words(query) for g in word_trigrams(w)})


def trigram_matches(rows: DataFrame, query: str, text: str = "content", threshold: float = THRESHOLD, stored: str | None = None) -> DataFrame:
    """rows with word_similarity, those at or above the threshold.

    The share of the query's trigrams that a text has at all bounds the measure from above, so texts
    below it are dropped, most by built-in functions, and only the rest are searched for the best stretch. stored names a
    column of a text's distinct trigrams, kept since ingest.
    """
    wanted = query_trigrams(query)
    if not wanted:
        return rows.limit(0).withColumn("word_similarity", F.lit(0.0))
    named = F.array(*map(F.lit, wanted))
    least = F.lit(threshold * len(wanted) - 1e-9)
    if stored:
        rows = rows.where(F.size(F.array_intersect(stored, named)) >= least)
    else:  # cheaper than trigrams: a text that has one has its letters; blanks stand for the edge of a word
        low = F.lower(F.coalesce(F.col(text), F.lit("")))
        rows = rows.where(sum((F.when(low.contains(g.strip()), 1).otherwise(0) for g in wanted), F.lit(0)) >= least)
    return once(rows, "word_similarity", similarity(fulltext.tokens(F.col(text)), query, threshold)).where(F.col("word_similarity") >= threshold)
