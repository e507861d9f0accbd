"""License scans: short notices found although some of their letters differ.

A notice may have some edits, by its length. Cut into one piece more than that, one of its pieces is in every match as it is,
so an automaton of all pieces of all notices finds all places where a match may be, in one walk over the text. Only
there the regex library looks for the match with the fewest edits, and says where it starts and ends and how many it has.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free


@dataclass(frozen=True)
class Notice:
    """Words of a notice, its label, and how many letters or blanks may be put in, left out or changed."""

    label: str
    text: str
    edits: int

    def pieces(self) -> list[tuple[int, str]]:
        """(offset, piece): edits + 1 pieces of about the same length."""
        cuts = [len(self.text) * i // (self.edits + 1) for i in range(self.edits + 2)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]


#: Phrases that are found exactly, and their labels (fixed values).
BASE = (
    Notice("mit", "under the mit license", 0),
    Notice("apache-2", "apache license version 2", 0),
    Notice("cc-by-nc", "cc by nc", 0),
)
#: A letter in so many may differ.
LETTERS = 16
#: Short notices by which licenses are usually named, as words.
SHORT = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache-2", "licensed under the apache license version 2"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("gpl", "gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl-2", "mozilla public license version 2"),
    ("epl", "eclipse public license"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("public-domain", "dedicated to the public domain"),
    ("reserved", "all rights reserved"),
)
NOTICES = (*BASE, *(Notice(label, text, len(text) // LETTERS) for label, text in SHORT))

#: Letters and digits in lower case, blanks for the rest of ASCII; what isn't ASCII belongs to words.
_WORD = bytes(32 if i < 128 and not (48 <= i < 58 or 97 <= i < 123) else i for i in bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
#: Places remembered by each worker: notices are copied far and wide.
MEMORY = 10_000


def words_of(text: bytes | None) -> bytes:
    """A text's words, a blank before and behind each."""
    return b" " + b"".join(w + b" " for w in (text or b"").translate(_WORD).split())


class Scanner:
    """All notices: an automaton of their pieces, and a pattern each."""

    def __init__(self, notices: tuple[Notice, ...]):
        import ahocorasick
        import regex

        self.notices = notices
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(notices):
            for offset, piece in notice.pieces():
                by_piece.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in by_piece.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(f"(?b)(?<= )(?:{regex.escape(n.text, literal_spaces=True)}){{e<={n.edits}}}(?= )") for n in notices]
        self.best = functools.lru_cache(MEMORY)(self._best)

    def _best(self, k: int, window: str) -> tuple[tuple[int, int, int], ...]:
        """(start, end, edits) of matches that don't overlap: the one with the fewest edits, and those on both sides of it."""
        out, parts = [], [(0, len(window))]
        while parts:
            a, b = parts.pop()
            found = self.patterns[k].search(window, a, b)
            if found:
                s, e = found.span()
                out.append((s, e, sum(found.fuzzy_counts)))
                parts += [(a, s), (e, b)]
        return tuple(sorted(out))

    def windows(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(notice, start, end) of stretches of text in which matches may be; those of a notice that touch are one."""
        at: list[list[tuple[int, int]]] = [[] for _ in self.notices]
        for last, (size, where) in self.automaton.iter(text):
            for k, offset in where:
                n = self.notices[k]
                a = last + 1 - size - offset - n.edits - 1  # a blank on each side
                b = a + len(n.text) + 2 * n.edits + 2
                if at[k] and a <= at[k][-1][1]:
                    at[k][-1] = (min(a, at[k][-1][0]), max(b, at[k][-1][1]))
                else:
                    at[k].append((a, b))
        for k, some in enumerate(at):
            for a, b in some:
                yield k, max(a, 0), min(b, len(text))

    def scan(self, words: bytes) -> list[tuple[int, int, int, int]]:
        """(notice, first word, words, edits) of every match in what words_of gives, by notice and place."""
        text, out = words.decode("latin-1"), []
        for k, a, b in self.windows(text):
            for s, e, edits in self.best(k, text[a:b]):
                out.append((k, a + s, a + e, edits))
        return [(k, words.count(b" ", 0, s) - 1, words.count(b" ", s, e) + 1, edits) for k, s, e, edits in out]


@functools.lru_cache(maxsize=4)
def scanner(notices: tuple[Notice, ...]) -> Scanner:
    return Scanner(notices)


def license_scan(docs: DataFrame, text: Column | str = "text", keep: tuple[str, ...] = ("doc_id",), notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """keep's columns, then n_words and matches, for each row of docs.

    Words are runs of ASCII letters and digits, in lower case, and of whatever isn't ASCII. matches is an array of (label,
    notice, exact, first_word, n_words, edits), words numbered from 0; exact notices (no edits allowed) are those at which their words
    stand one after another, the others begin and end where words do and have the fewest edits there. Edits are
    counted in bytes. A null or empty text has no words and no matches; bytes that aren't UTF-8 belong to words. Repeated rows are
    scanned one by one; an empty table gives an empty one. New columns get underscores where keep has their names. A text is
    scanned whole in one task, which needs some twelve times its size.
    """
    n_words, matches, held = free(docs.select(*keep), "n_words", "matches", "license_text")
    at = docs.select(*keep, (F.col(text) if isinstance(text, str) else text).cast("binary").alias(held))
    kind = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("exact", pa.bool_()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int64())]))

    def run(batches):
        scan = scanner(notices).scan
        for batch in batches:
            counts, found = [], []
            for x in batch.column(batch.num_columns - 1):
                words = words_of(x.as_py())
                counts.append(words.count(b" ") - 1)
                found.append([{"label": notices[k].label, "notice": notices[k].text, "exact": not notices[k].edits, "first_word": a, "n_words": n, "edits": e} for k, a, n, e in scan(words)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(batch.num_columns - 1)), pa.array(counts, pa.int64()), pa.array(found, kind)], names=[*batch.schema.names[:-1], n_words, matches])

    fields = ", ".join(f"`{n}` {t}" for n, t in at.dtypes[:-1])
    new = f"`{n_words}` bigint, `{matches}` array<struct<label: string, notice: string, exact: boolean, first_word: bigint, n_words: bigint, edits: bigint>>"
    return at.mapInArrow(run, ", ".join(x for x in (fields, new) if x))


def documents_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of documents.

    n_base, first_word and last_word are of the exact phrases' places; score is the largest share of a match's letters
    that weren't edited, 0 without one. Nulls, empty and long texts, repeated rows and empty tables as in license_scan; other
    columns of docs are left out.
    """
    found = license_scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    base = F.filter("matches", lambda m: m.exact)
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda m: m.label))), ",")
    starts = F.transform(base, lambda m: m.first_word)
    share = F.array_max(F.transform("matches", lambda m: F.lit(1.0) - m.edits / F.length(m.notice)))
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"), F.coalesce(share, F.lit(0.0)).alias("score"))


_VALUES = ", ".join(f"('{n.label}', '{n.text}', {n.edits}, {len(n.text.split())})" for n in NOTICES)
_PIECES = "|".join(sorted({piece for n in NOTICES for _, piece in n.pieces()}))
#: Every stretch of words that is as long as a notice, give or take its edits, is compared with it, in texts with a piece of one.
ORACLE = rf"""
with n as (select * from (values {_VALUES}) v(label, notice, most, parts)),
d as materialized (select row_number() over () k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
i as (select k, w, unnest(range(len(w))) i from d where regexp_matches(array_to_string(w, ' '), '{_PIECES}')),
m as (select unnest(range((select min(parts - most) from n), (select max(parts + most) + 1 from n))) m),
s as (select k, i, m, array_to_string(w[i + 1 : i + m], ' ') s from i, m where i + m <= len(w) and m > 0),
x as (select k, i, label, notice, most, levenshtein(s, notice) e from s join n on m between parts - most and parts + most and strlen(s) between strlen(notice) - most and strlen(notice) + most where most > 0 or s = notice),
f as (select k, count_if(most = 0) n_base, min(i) filter (most = 0) first_word, max(i) filter (most = 0) last_word,
 string_agg(distinct label, ',' order by label) filter (most = 0) base_labels, string_agg(distinct label, ',' order by label) labels, max(1.0::double - e / strlen(notice)) score from x where e <= most group by k)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_base, 0) as bigint) n_base, first_word, last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0) score from d left join f using (k)
"""
