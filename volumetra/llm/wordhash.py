"""Words and word shingles of whole Arrow batches as 64-bit hashes, in NumPy, without a Python loop over words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of text that are hashed at a time; a longer text is a piece of its own.
PIECE = 1 << 19
WIDTH = 5


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on all."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(str(base))
    if got is None or len(got) < n:
        got = np.full(n, U(base))
        got[0] = U(1)
        np.multiply.accumulate(got, out=got)
        if n <= 2 * PIECE:
            _powers[str(base)] = got
    return got[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def pieces(column: pa.Array, most: int = PIECE, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of at most ``rows`` rows with about ``most`` bytes."""
    data, at = buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = min(i + rows, max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1))
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, at: np.ndarray, kinds: np.ndarray = _IS_WORD, alone: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start byte, end byte) of each word: a run of bytes of one kind but 0; bytes of the kind ``alone`` are words of their own."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none, none
    kind = kinds[data]
    edge = np.ones(n + 1, dtype=bool)
    edge[1:n] = kind[1:] != kind[:-1]
    if alone is not None:
        edge[:n] |= kind == alone
    edge[at] = True
    begins = np.flatnonzero(edge[:n] & (kind != 0))
    ends = np.flatnonzero(edge[1:] & (kind != 0)) + 1
    upto = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _power(_BASE, n), out=upto[1:])
    hashes = mix((upto[ends] - upto[begins]) * _power(_INVERSE, n)[begins])
    rows = np.searchsorted(at, begins, side="right") - 1
    return hashes, rows, begins, ends


def shingles(hashes: np.ndarray, rows: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word) of each run of ``width`` words; a row with fewer words has one shingle of all its words."""
    n = len(hashes)
    if not n:
        return np.zeros(0, U), rows, np.zeros(0, np.int64)
    padded = np.concatenate([hashes, np.zeros(width - 1, U)])
    owner = np.concatenate([rows, np.full(width - 1, -1)])
    total = np.zeros(n, U)
    for k in range(width):
        same = owner[k : k + n] == rows
        total = total + np.where(same, padded[k : k + n], U(0)) * U((_BASE * (2 * k + 1)) % (1 << 64))
    whole = owner[width - 1 : width - 1 + n] == rows
    first = np.ones(n, dtype=bool)
    first[1:] = rows[1:] != rows[:-1]
    at = np.flatnonzero(whole | first)
    return mix(total[at]), rows[at], at


def counted(elements: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, row, how often) of the distinct elements of each row, rows ascending."""
    order = np.lexsort((elements, rows))
    elements, rows = elements[order], rows[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (elements[1:] != elements[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    return elements[first], rows[first], np.diff(np.append(first, len(rows)))


def cells(elements: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A hash for each unit of weight: the first, second, ... occurrence of each element, one element after the other."""
    level = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    return mix(np.repeat(elements, times) + level.astype(U) * U(0x9E3779B97F4A7C15))


split_words = re.compile(r"[^\x20\x09-\x0D]+").findall


def shingle_bag(text: str | None, width: int = WIDTH) -> set:
    """The exact shingles of one text, for verification; the second, third, ... occurrence of one is an element of its own."""
    w = split_words(text or "")
    if 0 < len(w) < width:
        return {tuple(w)}
    every = list(zip(*[w[i:] for i in range(width)]))
    out = set(every)
    if len(out) < len(every):
        times: dict[tuple, int] = {}
        for x in every:
            times[x] = n = times.get(x, 0) + 1
            if n > 1:
                out.add((x, n))
    return out
