"""English full text: lexemes with positions, boolean and phrase matches, cover density.

Stemming follows the published Porter2 algorithm. Queries are given as groups of terms, not as text.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the usual English stop words
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is are
    was were be been being have has had having do does did doing a an the and but if or because as until while of
    at by for with about against between into through during before after above below to from up down in out on
    off over under again further then once here there when where why how all any both each few more most other
    some such no nor not only own same so than too very s t can will just don should now""".split()
)
TOKEN = r"[\p{L}\p{N}]+"

_V = "[aeiouy]"
_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_UNCHANGED = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes", "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}


_BEGINS = re.compile(f"{_V}[^aeiouy]").search
_CONSONANT_Y = re.compile(r"(^|[aeiouy])y").sub
_VOWEL = re.compile(_V).search
_ENDS_SHORT, _IS_SHORT = re.compile(r"[^aeiouy][aeiouy][^aeiouywxY]$").search, re.compile(r"[aeiouy][^aeiouy]").fullmatch
_PREFIXES = ("gener", "commun", "arsen")
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _longest_first(*ends: str) -> tuple[str, ...]:
    return tuple(sorted(ends, key=len, reverse=True))


_ENDS2, _ENDS3, _ENDS4 = _longest_first(*_STEP2, "ogi", "li"), _longest_first(*_STEP3, "ative"), _longest_first(*_STEP4, "ion")


def _region(w: str, start: int = 0) -> int:
    m = _BEGINS(w, start)
    return m.end() if m else len(w)


def _short(w: str) -> bool:
    return bool(_ENDS_SHORT(w) or _IS_SHORT(w))


def _end(w: str, ends: tuple[str, ...]) -> str:
    """The longest of ends that w has; most words have none, which one call tells."""
    return next(e for e in ends if w.endswith(e)) if w.endswith(ends) else ""


@functools.lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """Porter2 stem of a lower-case word."""
    if len(word) < 3 or not word.isascii():
        return word
    if word in _IRREGULAR or word in _UNCHANGED:
        return _IRREGULAR.get(word, word)
    w = _CONSONANT_Y(r"\1Y", word) if "y" in word else word
    r1 = next(len(p) for p in _PREFIXES if w.startswith(p)) if w.startswith(_PREFIXES) else _region(w)
    r2 = _region(w, r1)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL(w[:-2]):
        w = w[:-1]
    if w.endswith(("eed", "eedly")):
        at = len(w) - (5 if w.endswith("ly") else 3)
        w = w[:at] + "ee" if at >= r1 else w
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                if _VOWEL(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(_DOUBLE):
                        w = w[:-1]
                    elif r1 >= len(w) and _short(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    if (end := _end(w, _ENDS2)) and (at := len(w) - len(end)) >= r1:
        if end == "ogi":
            w = w[:-1] if w[at - 1 : at] == "l" else w
        elif end == "li":
            w = w[:-2] if w[at - 1 : at] in tuple("cdeghkmnrt") else w
        else:
            w = w[:at] + _STEP2[end]
    if end := _end(w, _ENDS3):
        at = len(w) - len(end)
        if end == "ative":
            w = w[:at] if at >= r2 else w
        elif at >= r1:
            w = w[:at] + _STEP3[end]
    if end := _end(w, _ENDS4):
        at = len(w) - len(end)
        if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")):
            w = w[:at]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1]))) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


LEXEMES = T.ArrayType(T.StructType([T.StructField("lexeme", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))]))


#: Words of a batch that are grouped at once; cells of a table of flags at most.
TOGETHER, FLAGS = 1 << 20, 1 << 25


def tokens(text: Column) -> Column:
    """Words of a text in order: runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def slices(words: pa.Array, most: int = TOGETHER):
    """(first, last) rows of stretches of about most words; a row isn't cut."""
    edge, first = words.offsets.to_numpy(), 0
    while first < len(words):
        last = max(first + 1, int(np.searchsorted(edge, edge[first] + most, "right")) - 1)
        yield first, last
        first = last


def numbered(words: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row, number of the word) of all words of a list array, and the different words."""
    edge = words.offsets.to_numpy()
    flat = words.values.slice(edge[0], edge[-1] - edge[0]).dictionary_encode()
    return np.repeat(np.arange(len(words), dtype=np.int32), np.diff(edge)), flat.indices.to_numpy(zero_copy_only=False), flat.dictionary.to_pylist()


def lexeme_entries(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(row, position, number of the lexeme) of all words but stop words, in order, and the lexemes in theirs."""
    row, word, different = numbered(words)
    found = [None if w in STOP else stem(w) for w in different]
    lexemes = sorted({x for x in found if x is not None})
    number = {x: i for i, x in enumerate(lexemes)}
    code = np.array([number.get(x, -1) for x in found], np.int32)[word] if len(word) else np.zeros(0, np.int32)
    edge = words.offsets.to_numpy()
    at = np.arange(1, len(row) + 1, dtype=np.int32) - np.repeat((edge[:-1] - edge[0]).astype(np.int32), np.diff(edge))
    keep = code >= 0
    return row[keep], at[keep], code[keep], lexemes


@F.arrow_udf(LEXEMES)
def _stemmed(words: pa.Array) -> pa.Array:
    def some(part: pa.Array) -> pa.Array:
        row, at, code, lexemes = lexeme_entries(part)
        key = row.astype(np.int64) * max(1, len(lexemes)) + code
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        own = order[first]
        positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(at[order]))
        pairs = pa.StructArray.from_arrays([pa.array(lexemes, pa.string()).take(pa.array(code[own])), positions], names=["lexeme", "positions"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[own], np.arange(len(part) + 1)).astype(np.int32)), pairs)

    parts = [some(words.slice(first, last - first)) for first, last in slices(words)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.struct([("lexeme", pa.string()), ("positions", pa.list_(pa.int32()))])))


def analyzed(text: Column) -> Column:
    """Lexemes of a text with their word positions; stop words have a position but no lexeme. A task groups a stretch of its texts at a time, in Arrow's form."""
    return _stemmed(tokens(text))


def postings(rows: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """(key, lexeme, positions): what is stored at ingest, to be partitioned by lexeme and joined at search."""
    return rows.select(key, F.explode(analyzed(F.col(text))).alias("x")).select(key, "x.lexeme", "x.positions")


@dataclass(frozen=True)
class Terms:
    """A search: all of these words, one of each group of any, these phrases, and none of those words."""

    all: tuple[str, ...] = ()
    any: tuple[tuple[str, ...], ...] = ()
    phrases: tuple[tuple[str, ...], ...] = ()
    none: tuple[str, ...] = ()
    stems: dict = field(default_factory=dict, compare=False)

    @staticmethod
    def lexemes(words) -> list[str]:
        return [stem(w.lower()) for w in words if w.lower() not in STOP]

    def wanted(self) -> list[str]:
        groups = [*self.any, *self.phrases]
        return sorted(set(self.lexemes(self.all)) | {x for g in groups for x in self.lexemes(g)})


def has(lexemes: Column, lexeme: str) -> Column:
    return F.exists(lexemes, lambda x: x["lexeme"] == lexeme)


def positions(lexemes: Column, lexeme: str) -> Column:
    found = F.filter(lexemes, lambda x: x["lexeme"] == lexeme)
    return F.coalesce(F.get(found, 0)["positions"], F.array().cast("array<int>"))


def matches(lexemes: Column, terms: Terms) -> Column:
    """Whether analyzed() lexemes satisfy the terms; a query of stop words only matches nothing."""
    if not terms.wanted():
        return F.lit(False)
    ok = F.lit(True)
    for w in Terms.lexemes(terms.all):
        ok = ok & has(lexemes, w)
    for group in terms.any:
        if words := Terms.lexemes(group):
            ok = ok & F.exists(lexemes, _one_of(words))
    for phrase in terms.phrases:
        at = [(i, stem(w.lower())) for i, w in enumerate(phrase) if w.lower() not in STOP]
        if at:
            begins = positions(lexemes, at[0][1])
            for i, w in at[1:]:
                begins = F.array_intersect(begins, F.transform(positions(lexemes, w), _back(i - at[0][0])))
            ok = ok & (F.size(begins) > 0)
    for w in Terms.lexemes(terms.none):
        ok = ok & ~has(lexemes, w)
    return ok


def maybe(text: Column, terms: Terms) -> Column:
    """A test of the text itself that every match passes: a word begins like its stem, but for the stem's last two letters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    begins = lambda w: low.contains(w[: max(1, len(w) - 2)])
    ok = F.lit(bool(terms.wanted()))
    for w in {*Terms.lexemes(terms.all), *(x for p in terms.phrases for x in Terms.lexemes(p))}:
        ok = ok & begins(w)
    for group in terms.any:
        if words := Terms.lexemes(group):
            ok = ok & reduce(lambda a, b: a | b, map(begins, words))
    return ok


def _one_of(words: list[str]):
    return lambda x: x["lexeme"].isin(words)


def _back(n: int):
    return lambda p: p - n


def cover_density(entries: list[tuple[int, int]], wanted: int) -> float:
    """Sum over minimal covers of 0.1 / (1 + words between) for (position, term) entries in order; a cover has all wanted terms."""
    total, begin = 0.0, 0
    while True:
        seen, end = set(), None
        for i in range(begin, len(entries)):
            seen.add(entries[i][1])
            if len(seen) == wanted:
                end = i
                break
        if end is None:
            return total
        seen, first = set(), end
        for i in range(end, begin - 1, -1):
            seen.add(entries[i][1])
            if len(seen) == wanted:
                first = i
                break
        gaps = entries[end][0] - entries[first][0] - (end - first)
        total += 0.1 / (1 + max(0, gaps))
        begin = first + 1


def rank(lexemes: Column, terms: Terms) -> Column:
    """Cover density of a match; any-groups count as one term each."""
    groups = [[w] for w in dict.fromkeys([*Terms.lexemes(terms.all), *(x for p in terms.phrases for x in Terms.lexemes(p))])] + [g for g in (Terms.lexemes(a) for a in terms.any) if g]
    ids = {w: i for i, g in enumerate(groups) for w in g}

    @F.pandas_udf("double")
    def score(found: pd.Series) -> pd.Series:
        def one(xs):
            entries = sorted((p, ids[x["lexeme"]]) for x in xs for p in x["positions"])
            return cover_density(entries, len(groups)) if entries else 0.0

        return found.map(one)

    return score(F.filter(lexemes, lambda x: x["lexeme"].isin(list(ids))))
