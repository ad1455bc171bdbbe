"""Vectorised UTF-8 text primitives shared by the text operators.

Everything works on the raw Arrow buffers of a whole slice of documents:
word boundaries, word hashes, shingles and rolling windows come from a few
NumPy passes, with no Python loop over words.

Hashes are 64 bit: a polynomial over random byte codes modulo 2**64 with an odd
base (any substring's hash follows from two prefix sums), finished by a
splitmix mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)

#: ASCII white space: space and 0x09 to 0x0D
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_pow: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, kept between calls."""
    if len(_pow.get("p", ())) <= n:
        size = max(n + 1, 1 << 16)
        for key, base in (("p", _BASE), ("q", _BASE_INV)):
            a = np.full(size, base, U)
            a[0] = 1
            _pow[key] = np.multiply.accumulate(a)
    return _pow["p"][: n + 1], _pow["q"][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.zeros(0, np.uint8)
    if column.buffers()[2] is not None and offs[-1] > offs[0]:
        data = np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut record batches into row ranges of about SLICE_BYTES of text."""
    for batch in batches:
        data, offs = utf8(batch.column(text))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(offs, offs[row] + SLICE_BYTES, "right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield batch.slice(row, end - row), data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
            row = end


def spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends and the word offsets of each document."""
    word = ~IS_SPACE[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    before &= ~edge[:-1]
    starts = np.flatnonzero(word & ~before)
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    after &= ~edge[1:]
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash, one longer than ``data``."""
    p, _ = powers(len(data))
    out = np.zeros(len(data) + 1, U)
    np.cumsum(_CODES[data] * p[: len(data)], out=out[1:])
    return out


def between(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each pair."""
    _, q = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(U))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return between(prefix(data), starts, ends)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i:i+k] for each i; document ends are the caller's matter."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    p, q = powers(len(words))
    sums = np.zeros(len(words) + 1, U)
    np.cumsum(words * p[: len(words)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * q[:n] + U(k))


def doc_of(offs: np.ndarray) -> np.ndarray:
    """Row number of each item, from item offsets."""
    return np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))


def shingles(words: np.ndarray, woffs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each document's k-word shingles, repeats included; a
    shorter document has its whole sequence as one."""
    doc = doc_of(woffs)
    n = len(words)
    if n == 0:
        return np.zeros(0, U), np.zeros(0, np.int32)
    h = window_hashes(words, k)
    ok = doc[: len(h)] == doc[n - len(h) :] if len(h) else np.zeros(0, bool)
    hs, ds = h[ok], doc[: len(h)][ok]
    count = np.diff(woffs)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        p, q = powers(n)
        sums = np.zeros(n + 1, U)
        np.cumsum(words * p[:n], out=sums[1:])
        a, b = woffs[short], woffs[short + 1]
        hs = np.concatenate([hs, mix((sums[b] - sums[a]) * q[a] + (b - a).astype(U))])
        ds = np.concatenate([ds, short.astype(np.int32)])
    return hs, ds


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal keys."""
    if len(sorted_keys) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
    starts = np.concatenate([[0], cut])
    return starts, np.diff(np.concatenate([starts, [len(sorted_keys)]]))
