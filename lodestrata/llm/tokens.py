"""Token ids of many texts inside tasks, each distinct piece of a slice encoded once.

The vocabulary's normalizer and pre-tokenizer never look across ASCII white space, so a text's ids are
those of its words one after another. Arrow cuts a slice of texts into words and numbers the different ones;
those of common letters are cut into pieces by the vocabulary's own pattern, and the different pieces go through the
byte-pair merges, many in one call. Other words (special tokens, other scripts) are encoded one by one by the
library. Pieces are remembered in Arrow's form, which takes little memory.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
_LETTERS, _DIGITS = "a-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾"
#: The vocabulary's own pattern for pieces (fixed value), for lower-case text of plain letters: runs of letters,
#: single digits, English endings, runs of marks. No two of these can begin alike but endings and marks, in that order.
PIECES = re.compile(rf"[{_LETTERS}]+|[{_DIGITS}]|'(?:s|t|re|ve|m|ll|d)|[^\s{_LETTERS}{_DIGITS}]+")
_PIECES_OR_END = re.compile(rf"{PIECES.pattern}|\n")
#: Texts and words whose lower case and pieces are the same for Python as for the vocabulary's own rules.
_PLAIN_WORD = r"^[\x21-\x7E\x{A1}-\x{17F}]*$"
_BLANK = re.compile(r"[\x20\x09-\x0D]")
#: Bytes of text cut into words at once; pieces remembered (about 25 bytes each); pieces in one string for the library, and such strings in one call.
SLICE, MEMORY, TOGETHER, CALLS = 6 << 20, 1_000_000, 400, 50


def vocabulary_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class WordTokenizer:
    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(vocabulary_path(path))
        self.merges = Tokenizer(self.library.model)  # for pieces, which are lower-case and cut as the vocabulary cuts them
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.library.get_vocab_size()
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.ends = np.zeros(size, bool)
        for token, i in self.library.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.known, self.coded = pa.array([], pa.string()), pa.array([], pa.binary())

    def _alone(self, word: str) -> np.ndarray:
        return np.array(self.library.encode(word, add_special_tokens=False).ids, self.dtype)

    def _learned(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, ids of each): many in one call, cut where a word ends."""
        ids, counts = [], []
        groups = [pieces[at : at + TOGETHER] for at in range(0, len(pieces), TOGETHER)]
        for at in range(0, len(groups), CALLS):
            some = groups[at : at + CALLS]
            for group, coded in zip(some, self.merges.encode_batch_fast([" ".join(x) for x in some], add_special_tokens=False)):
                x = np.array(coded.ids, self.dtype)
                n = np.diff(np.flatnonzero(self.ends[x]) + 1, prepend=0)
                if len(n) != len(group):
                    each = [self._alone(p) for p in group]
                    x, n = np.concatenate(each), np.array([len(p) for p in each])
                ids.append(x)
                counts.append(n)
        return _joined(ids, self.dtype), _joined(counts, np.int64)

    def _pieces(self, pieces: pa.Array) -> pa.Array:
        """The ids of different pieces, as bytes. Those of the last slices aren't encoded again, up to MEMORY of them."""
        at = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(pc.is_null(at))
        ids, counts = self._learned(new.to_numpy(zero_copy_only=False).tolist())
        known, coded = pa.concat_arrays([self.known, new]), pa.concat_arrays([self.coded, binary(ids, counts)])
        at = at.to_numpy(zero_copy_only=False)
        place = np.where(np.isnan(at), 0, at).astype(np.int64) if at.dtype.kind == "f" else at.astype(np.int64)
        place[np.isnan(at)] = len(self.known) + np.arange(len(new))
        each = coded.take(pa.array(place))
        self.known, self.coded = (known, coded) if len(known) <= MEMORY else (pieces, each)
        return each

    def _words(self, words: pa.Array) -> pa.Array:
        """Each word's ids, as bytes."""
        plain = pc.and_not(pc.match_substring_regex(words, _PLAIN_WORD), pc.match_substring(words, "<|"))
        some = words.filter(plain)
        lines = "\n".join([*some.to_numpy(zero_copy_only=False), ""]).lower()
        found = pa.array(_PIECES_OR_END.findall(lines), pa.string()).dictionary_encode()
        of, end = found.indices.to_numpy(zero_copy_only=False), pc.index(found.dictionary, "\n").as_py()
        each = self._pieces(found.dictionary.filter(pc.not_equal(found.dictionary, "\n")))
        last = of == end
        of = np.where(of > end, of - 1, of)
        n = np.where(last, 0, _counts(each, self.dtype)[np.where(last, 0, of)] if len(each) else 0)
        edge = np.cumsum(n)[last]
        coded = binary(_ids(each.take(pa.array(of[~last])), self.dtype), np.diff(edge, prepend=0))
        odd = [self._alone(w) for w in words.filter(pc.invert(plain)).to_pylist()]
        if not odd:
            return coded
        there = plain.to_numpy(zero_copy_only=False)
        place = np.empty(len(words), np.int64)
        place[there], place[~there] = np.arange(len(some)), len(some) + np.arange(len(odd))
        return pa.concat_arrays([coded, pa.array([x.tobytes() for x in odd], pa.binary())]).take(pa.array(place))

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        edge = words.offsets.to_numpy()
        flat = words.values.slice(edge[0], edge[-1] - edge[0]).dictionary_encode()
        if not len(flat):
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        coded = self._words(flat.dictionary)
        n = np.concatenate(([0], np.cumsum(_counts(coded, self.dtype)[flat.indices.to_numpy()])))
        return _ids(coded.take(flat.indices), self.dtype), np.diff(n[edge - edge[0]])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids of each). A null text has none."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
        ids, counts, first = [], [], 0
        while first < len(texts):
            before = size[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(size, before + SLICE, "right")))
            some = texts.slice(first, last - first)
            if size[last - 1] - before > SLICE:  # one long text, in parts
                parts = [self._slice(pa.array([x], pa.string()))[0] for x in _parts(some[0].as_py())]
                i, c = np.concatenate(parts), np.array([sum(map(len, parts))])
            else:
                i, c = self._slice(some)
            ids.append(i)
            counts.append(c)
            first = last
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, self.dtype), np.zeros(0, np.int64))


def _joined(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """values cut into counts of them, as bytes. Fewer than 2 GB."""
    edge = np.concatenate(([0], np.cumsum(counts))) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _counts(column: pa.Array, dtype) -> np.ndarray:
    return pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // np.dtype(dtype).itemsize


def _ids(column: pa.Array, dtype) -> np.ndarray:
    """The values of all rows of a binary column one after another; no row is null."""
    edge = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[edge[0] : edge[-1]].view(dtype) if len(column) else np.zeros(0, dtype)


def _parts(text: str) -> Iterator[str]:
    """text cut at white space into parts of SLICE characters or, where a word goes on, up to its end."""
    at = 0
    while at < len(text):
        end = _BLANK.search(text, at + SLICE)
        end = end.start() if end else len(text)
        yield text[at:end]
        at = end


@functools.lru_cache(maxsize=2)
def tokenizer(path: str | None = None) -> WordTokenizer:
    """One for each Python worker and path."""
    return WordTokenizer(path)
