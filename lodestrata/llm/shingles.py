"""Word and shingle hashes of many texts at once, in NumPy, inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_ODD = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # A-Z as a-z
_FOLD[9:14] = 32
_FOLD = _FOLD.tobytes()
_TAIL = np.array([0xFFFFFFFFFFFFFFFF >> 8 * (8 - n) for n in range(1, 9)], U)
#: Bytes of text hashed at once, and about what is held of longer texts: eight bytes a word, and as much for its set.
CHUNK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h *= _ODD[0]
    h ^= h >> U(29)
    h *= _ODD[1]
    return h ^ (h >> U(32))


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts as bytes) in runs of about CHUNK bytes."""
    first, size, run = 0, 0, []
    for i, x in enumerate(texts):
        run.append((x or "").encode("utf-8", "surrogatepass"))
        size += len(run[-1]) + 1
        if size >= CHUNK:
            yield first, run
            first, size, run = i + 1, 0, []
    if run:
        yield first, run


def word_hashes(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, words before each text and in total)."""
    text = b" ".join(run).translate(_FOLD) + b" "
    hashes, starts, at = [], [], 0
    while at < len(text):
        end = text.find(b" ", min(at + CHUNK, len(text) - 1)) + 1
        h, s = _hashed(text[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    edge = np.cumsum([0, *(len(x) + 1 for x in run)])
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), edge)


def _hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of a text in which only blanks divide words.

    A word is read in steps of eight bytes; each step is mixed with its number before all are added up and
    mixed with the word's length, so neither order nor repetition of letters makes two words alike.
    """
    b = np.frombuffer(b" " + text + b" " * 8, np.uint8)
    blank = b == 32
    start = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    size = np.flatnonzero(~blank[:-1] & blank[1:]) + 1 - start
    steps = (size + 7) >> 3
    first = np.cumsum(steps) - steps
    step = np.arange(steps.sum()) - np.repeat(first, steps)
    lanes = np.ndarray(len(b) - 7, "<u8", b, strides=(1,))[np.repeat(start, steps) + 8 * step]
    lanes &= _TAIL[np.minimum(np.repeat(size, steps) - 8 * step, 8) - 1]
    lanes = mix(lanes + (step + 1).astype(U) * _ODD[2])
    total = np.add.reduceat(lanes, first) if len(first) else lanes
    return mix(total + size.astype(U) * _ODD[3]), start - 1


def shingle_sets(texts: list[str | None], width: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: (index of the first, their shingle sets one after another, each sorted; size of each set)."""
    for first, run in chunks(texts):
        w, edge = word_hashes(run)
        count = np.diff(edge)
        n = len(w) - width + 1
        h = np.zeros(0, U)
        if n > 0:
            h = w[:n] * _ODD[0]
            for i in range(1, width):
                h += w[i : n + i] * _ODD[i % 5] + U(i)
            h = mix(h)
        parts, sizes = [], np.zeros(len(run), np.int64)
        for i, k in enumerate(count):
            if k >= width:
                s = np.sort(h[edge[i] : edge[i] + k - width + 1])
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif k:
                v = w[edge[i] : edge[i + 1]]
                s = mix(np.array([(v * np.array(_ODD[:k] if k <= 5 else [_ODD[j % 5] * U(j + 1) for j in range(k)])).sum(dtype=U) + U(0xABCD00 + k)]))
            else:
                continue
            sizes[i] = len(s)
            parts.append(s)
        yield first, np.concatenate(parts) if parts else np.zeros(0, U), sizes
