"""Lists of numbers as bytes, many at once: seven bits a byte, least first, the eighth says that more follow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def packed(values: np.ndarray, edge: np.ndarray) -> pa.Array:
    """values (none below zero) cut into lists at edge, which begins with 0 and ends with their number. Fewer than 2 GB."""
    v = values.astype(np.uint64)
    n, rest = np.ones(len(v), np.int64), v >> np.uint64(7)
    while rest.any():
        n += rest > 0
        rest = rest >> np.uint64(7)
    at = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(at[-1], np.uint8)
    for k in range(n.max(initial=0)):
        some = np.flatnonzero(n > k)
        out[at[some] + k] = (v[some] >> np.uint64(7 * k)).astype(np.uint8) & 127 | (n[some] > k + 1).astype(np.uint8) << 7
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(at[edge].astype(np.int32)), pa.py_buffer(out)])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all lists one after another, edge). A null is an empty list."""
    edge = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    b = np.frombuffer(column.buffers()[2] or b"", np.uint8)[edge[0] : edge[-1]]
    last = np.flatnonzero(b < 128)
    first = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    shift = np.arange(len(b)) - np.repeat(first, last - first + 1)
    v = np.add.reduceat((b & 127).astype(np.uint64) << (7 * shift).astype(np.uint64), first) if len(b) else np.zeros(0, np.uint64)
    return v, np.searchsorted(last, edge - edge[0])


def steps(values: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Each number of lists as its distance to the one before, a list's first as that to 0; those below zero are odd."""
    v = values.astype(np.int64)
    d = np.diff(v, prepend=np.int64(0))
    first = edge[:-1][edge[:-1] < edge[1:]]
    d[first] = v[first]
    return ((d << 1) ^ (d >> 63)).view(np.uint64)


def walked(distances: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The numbers that steps() was given."""
    d = (distances >> np.uint64(1)).view(np.int64) ^ -(distances & np.uint64(1)).astype(np.int64)
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(d)))
    return total[1:] - np.repeat(total[edge[:-1]], np.diff(edge))


def joined(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, edge) of several columns of lists as one: a row's lists stand one behind the other."""
    each = [np.diff(edge) for _, edge in lists]
    edge = np.concatenate(([0], np.cumsum(sum(each))))
    out, at = np.empty(edge[-1], np.uint64), edge[:-1].copy()
    for (values, own), n in zip(lists, each):
        out[np.arange(len(values)) + np.repeat(at - own[:-1], n)] = values
        at += n
    return out, edge


def taken(values: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, edge) of the next list of each row, of which n says the length; at is moved behind it."""
    edge = np.concatenate(([0], np.cumsum(n)))
    out = values[np.arange(edge[-1]) + np.repeat(at - edge[:-1], n)]
    at += n
    return out, edge
