"""Packed shuffles: many small records of a task travel as one binary row per
hash range, so that rows, not records, are what Spark sorts and serialises."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .store import plan_bytes

U = np.uint64
SCHEMA = "key int, ids binary, body binary"


def range_bits(df, least: int = 8) -> int:
    """Bits of hash for the range number: about 1 MB of input a range."""
    return max(least, min(20, (plan_bytes(df) >> 20).bit_length()))


def short(h: np.ndarray, bits: int) -> np.ndarray:
    """Range number and 32 more bits of a hash, as one number."""
    return (h >> U(32 - bits)).astype(np.int64)


def emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), 512):
        part = rows[a : a + 512]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in part], pa.int32()), pa.array([x[1] for x in part], pa.binary()), pa.array([x[2] for x in part], pa.binary())],
            names=["key", "ids", "body"],
        )


def by_range(h: np.ndarray, row: np.ndarray, ids: np.ndarray, bits: int, *more: np.ndarray) -> list[tuple]:
    """One blob a range from records sorted by hash: ids used, then the low
    hash words, local row numbers and further arrays."""
    cell = short(h, bits)
    slot = cell >> 32
    low = cell.astype(np.uint32)  # keeps the low 32 bits
    at = np.searchsorted(slot, np.arange((1 << bits) + 1))
    out = []
    for r in np.flatnonzero(np.diff(at)):
        a, b = at[r], at[r + 1]
        used, local = np.unique(row[a:b], return_inverse=True)
        kind = np.uint16 if len(used) <= 1 << 16 else np.uint32
        out.append((int(r), ids[used].tobytes(), b"".join([low[a:b].tobytes(), local.astype(kind).tobytes(), *(x[a:b].tobytes() for x in more)])))
    return out


def read(table: pa.Table, kinds: tuple = (), name: np.dtype = np.dtype(np.int64)) -> list[np.ndarray]:
    """[low hash words, ids, *further arrays] of a range, blobs joined; ids are
    of type ``name``."""
    parts: list[list[np.ndarray]] = [[] for _ in range(2 + len(kinds))]
    rest = sum(np.dtype(k).itemsize for k in kinds)
    for i, b in zip(table.column("ids").to_pylist(), table.column("body").to_pylist()):
        ids = np.frombuffer(i, name)
        kind = np.dtype(np.uint16 if len(ids) <= 1 << 16 else np.uint32)
        m = len(b) // (4 + kind.itemsize + rest)
        parts[0].append(np.frombuffer(b, np.uint32, m))
        parts[1].append(ids[np.frombuffer(b, kind, m, 4 * m)])
        at = (4 + kind.itemsize) * m
        for k, dt in enumerate(kinds):
            parts[2 + k].append(np.frombuffer(b, dt, m, at))
            at += np.dtype(dt).itemsize * m
    return [np.concatenate(p) for p in parts]


def fold(ids: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For each row the first row, by id, with the same keys."""
    n = len(ids)
    by = np.lexsort((ids, *keys))
    first = np.ones(n, bool)
    first[1:] = False
    for k in keys:
        first[1:] |= k[by][1:] != k[by][:-1]
    lead = np.empty(n, np.int64)
    lead[by] = by[np.maximum.accumulate(np.where(first, np.arange(n), 0))]
    return lead
