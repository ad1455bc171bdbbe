"""Removal of repeated byte strings by a logarithmic family of suffix arrays.

A text is known by its content (the first half of its SHA-256): equal texts are
one text that occurs several times, whatever their ids.

1. Anchors: in each stretch of ``length`` bytes the position whose gram (a
   quarter of ``length``) has the least hash, so equal stretches have equal
   anchors.  Gram hashes alone travel first and only say where to look: at
   grams that occur twice or more, and at all anchors of texts that do.
2. Suffix arrays: the suffixes at those anchors, with the bytes of every stretch
   they answer for, are sorted in batches, first each task's own, then those
   that meet at a hash range.  There a batch is merge-scanned against itself and
   every level that exists; where it shares a gram with a level, stretches that
   both hold (by 128-bit digests) are repeats of either side.  The batch becomes
   a level, and levels of a size merge geometrically.  All removals come from
   these scans.
3. Only texts with removals are read again, to digest the remaining bytes.

``SuffixFamily`` keeps gram hashes and levels in the shared folder, so that a
later batch of documents meets the levels of earlier ones.

Hot groups: equal texts, and equal neighbourhoods within a task, travel once.  A
gram with over HOT different neighbourhoods would bring them all to one task, so
its stretches are dealt one by one, by their digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import blobs as B
from . import words as W
from .store import Scratch

U = np.uint64
#: a content key as two numbers
KEY = np.dtype([("a", U), ("b", U)])
#: bytes of text, or of neighbourhoods, that a task holds before it sends
FLUSH = 1 << 23
#: mark of a position whose anchor is to be looked at in any case
TWICE = 1 << 31
#: suffixes that a batch has at least, if there are so many
LEVEL = 1 << 12
#: neighbourhoods of a gram beyond which its stretches are dealt one by one
HOT = 1 << 12

_NIL = hashlib.sha256(b"").hexdigest()
_LOOKS = "k binary, looks binary, hot binary"
_SPANS = "k binary, spans binary, level_key int, level_ids binary, level_body binary"
# second digest of a stretch: other codes, so another polynomial
_CODES2 = np.random.default_rng(20250711).integers(1, 1 << 63, 256, dtype=np.uint64)


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over each window of w values (van Herk)."""
    n = len(x)
    m = -(-n // w) * w
    pad = np.full(m, x[-1], x.dtype)
    pad[:n] = x
    left = op.accumulate(pad.reshape(-1, w), axis=1).ravel()
    right = op.accumulate(pad.reshape(-1, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[: n - w + 1], left[w - 1 : n])


class Anchors:
    """Anchors of a slice of texts: positions ``pos`` with gram hash ``hash``
    that answer for the stretches starting at ``lo`` to ``hi``; ``twice`` where
    these hold the gram at another place too, so that two of them may be equal.

    The starts whose stretches have the same least gram form runs; an anchor is
    that gram's last place in the stretch it begins with, and answers for what
    contains it.  So a periodic text has no more anchors than any other.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, length: int):
        gram = length // 4
        w = length - gram + 1
        none = np.zeros(0, np.int64)
        self.pos, self.hash, self.lo, self.hi, self.twice = none, np.zeros(0, U), none, none, np.zeros(0, bool)
        if len(data) < length:
            return
        at = np.arange(len(data) - gram + 1)
        h = W.between(W.prefix(data), at, at + gram) | U(1)
        least = _slide(h, w, np.minimum)  # of the stretch from each position
        start = np.arange(len(least))
        stop = offs[np.searchsorted(offs, start, "right").clip(max=len(offs) - 1)]
        least[start + length > stop] = 0  # beyond its text
        b = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        e = np.append(b[1:], len(least))[least[b] > 0]
        b = b[least[b] > 0]
        kinds = np.unique(least[b])
        n = np.int64(len(h) + 1)
        place = np.searchsorted(kinds, h).clip(max=max(len(kinds) - 1, 0))
        at = np.flatnonzero(kinds[place] == h) if len(kinds) else none
        places = np.sort(place[at] * n + at)
        parts = []
        while len(b):
            own = np.searchsorted(kinds, least[b]) * n
            p = places[np.searchsorted(places, own + b + w - 1, "right") - 1] - own
            last = np.minimum(p, e - 1)
            inside = np.searchsorted(places, own + last + w - 1, "right") - np.searchsorted(places, own + b)
            parts.append((p, least[b], b, last, inside > 1))
            more = last + 1 < e
            b, e = last[more] + 1, e[more]
        if parts:
            cols = [np.concatenate(x) for x in zip(*parts)]
            order = np.argsort(cols[0], kind="stable")
            self.pos, self.hash, self.lo, self.hi, self.twice = (x[order] for x in cols)
            self.hash = W.mix(self.hash ^ U(0xA0761D6478BD642F))  # least hashes are small ones: spread them over the ranges


def _keys(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), KEY)


def _texts(batches, text: int = 1):
    for part, data, offs in W.slices(batches, text):
        yield part, _keys(part.column(0)), data, offs


def _mark(length: int, bits: int):
    """Gram hashes of anchors, packed by range; equal texts of a task once."""

    def flush(ids, hs, ds, ps):
        h, d, p = np.concatenate(hs), np.concatenate(ds), np.concatenate(ps)
        order = np.argsort(h, kind="stable")
        yield from B.emit(B.by_range(h[order], d[order], np.concatenate(ids), bits, p[order]))

    def run(batches):
        held, rows, size, seen = ([], [], [], []), 0, 0, set()
        for part, ids, data, offs in _texts(batches):
            new = []
            for k in part.column(0).to_pylist():
                new.append(k not in seen)
                seen.add(k)
            found = Anchors(data, offs, length)
            doc = np.searchsorted(offs, found.pos, "right") - 1
            ok = np.array(new)[doc]
            for x, v in zip(held, (ids, found.hash[ok], (doc[ok] + rows).astype(np.int32), (found.pos - offs[doc] + found.twice * TWICE)[ok].astype(np.uint32))):
                x.append(v)
            rows, size = rows + part.num_rows, size + len(data)
            if size >= FLUSH:
                yield from flush(*held)
                held, rows, size, seen = ([], [], [], []), 0, 0, set()
        if rows:
            yield from flush(*held)

    return run


def _per_key(ids: np.ndarray, *values: np.ndarray) -> tuple[list[bytes], list[list[bytes]]]:
    """Distinct keys and the bytes of their values."""
    order = np.lexsort((ids["b"], ids["a"]))
    ids = ids[order]
    start = np.flatnonzero(np.append(True, (ids["a"][1:] != ids["a"][:-1]) | (ids["b"][1:] != ids["b"][:-1]))[: len(ids)])
    end = np.append(start[1:], len(ids))
    return [ids[a].tobytes() for a in start], [[v[order[a:b]].tobytes() for a, b in zip(start, end)] for v in values]


def _meet(hot: int):
    """Where to look: anchors whose gram hash others have too.  Of texts known
    before (``old``) only what now has to be looked at for the first time."""

    def run(table):
        parts = []
        for old in (False, True):
            mine = table.filter(pc.equal(table.column("old"), old))
            if mine.num_rows:
                low, ids, p = B.read(mine, (np.uint32,), KEY)
                parts.append((low, ids, p, np.full(len(low), old)))
        low, ids, p, old = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((~old, p, ids["b"], ids["a"], low))
        low, ids, p, old = (x[order] for x in (low, ids, p, old))
        new = np.append(True, (low[1:] != low[:-1]) | (ids[1:] != ids[:-1]) | (p[1:] != p[:-1]))
        low, ids, p, old = (x[new] for x in (low, ids, p, old))  # the same text from several tasks
        start, length = W.runs(low)
        before = np.add.reduceat(old.astype(np.int64), start)
        n, before = np.repeat(length, length), np.repeat(before, length)
        dealt = n > hot  # its old entries are in no levels as single stretches yet, unless it was so before
        twice, p = p >= TWICE, p & np.uint32(TWICE - 1)
        look = np.where(n > 1, ~old | ((before == 1) & ~twice) | (dealt & (before <= hot)), twice & ~old)
        out = []
        for which, name in ((look & ~dealt, "looks"), (look & dealt, "hot")):
            if which.any():
                ks, (ps,) = _per_key(ids[which], p[which].astype(np.int64))
                none = pa.nulls(len(ks), pa.binary())
                out.append(pa.table({"k": pa.array(ks, pa.binary()), "looks": pa.array(ps, pa.binary()) if name == "looks" else none, "hot": pa.array(ps, pa.binary()) if name == "hot" else none}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.binary()) for c in ("k", "looks", "hot")})

    return run


def _digests(data: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of the stretch from each of ``begin``."""
    p, q = W.powers(len(data) + 1)
    out = []
    for codes in (W._CODES, _CODES2):
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(codes[data] * p[: len(data)], out=sums[1:])
        out.append(W.mix((sums[begin + length] - sums[begin]) * q[begin] + U(length)))
    return out[0], out[1]


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, 0, 1, ...) of ``count`` items each."""
    who = np.repeat(np.arange(len(count)), count)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of its run of equal pairs, for each of sorted (a, b)."""
    return np.cumsum(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]) - 1


class Batch:
    """Suffixes sorted by their bytes: for each its text, its anchor's place
    there, the bytes it answers for, how many of them are before the anchor and
    whether the same bytes occur more than once."""

    def __init__(self, ids: np.ndarray, pos: np.ndarray, left: np.ndarray, many: np.ndarray, texts: list[bytes], ordered: bool = False):
        if not ordered:
            order = sorted(range(len(texts)), key=lambda i: (texts[i][left[i] :], texts[i][: left[i]]))
            ids, pos, left, many, texts = ids[order], pos[order], left[order], many[order], [texts[i] for i in order]
        self.ids, self.pos, self.left, self.many, self.texts = ids, pos, left, many, texts

    def __len__(self) -> int:
        return len(self.texts)

    def take(self, keep: np.ndarray) -> Batch:
        at = np.flatnonzero(keep) if keep.dtype == bool else keep
        return Batch(self.ids[at], self.pos[at], self.left[at], self.many[at], [self.texts[i] for i in at.tolist()], True)

    def grams(self, size: int) -> np.ndarray:
        return np.array([t[a : a + size] for t, a in zip(self.texts, self.left.tolist())], f"S{size}")

    def doubled(self, size: int) -> np.ndarray:
        """Whether a suffix's bytes hold its gram at another place too."""
        return np.array([t.find(g := t[a : a + size]) != a or t.find(g, a + 1) >= 0 for t, a in zip(self.texts, self.left.tolist())], bool)

    def fold(self) -> tuple[Batch, Batch]:
        """(one of each equal neighbourhood, the others)."""
        first = np.ones(len(self), bool)
        for i in range(1, len(self)):
            first[i] = self.texts[i] != self.texts[i - 1] or self.left[i] != self.left[i - 1]
        run = np.cumsum(first) - 1
        many = self.many.copy()
        many[first] |= np.bincount(run)[run[first]] > 1
        many[first] |= np.bincount(run, self.many)[run[first]] > 0
        self.many = many
        return self.take(first), self.take(~first)

    def pack(self) -> tuple[bytes, bytes]:
        head = np.stack([self.pos, self.left, self.many.astype(np.int64), np.array([len(t) for t in self.texts], np.int64)])
        return self.ids.tobytes(), head.tobytes() + b"".join(self.texts)

    @staticmethod
    def unpack(ids: bytes, body: bytes) -> Batch:
        k = len(ids) // 16
        pos, left, many, size = np.frombuffer(body, np.int64, 4 * k).reshape(4, k)
        ends = 32 * k + np.cumsum(size)
        return Batch(np.frombuffer(ids, KEY), pos, left, many > 0, [body[e - n : e] for e, n in zip(ends.tolist(), size.tolist())], True)

    @staticmethod
    def merged(parts: list[Batch]) -> Batch:
        """Sorted batches as one."""
        if len(parts) == 1:
            return parts[0]
        return Batch(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("ids", "pos", "left", "many")), [t for p in parts for t in p.texts])

    def whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end) of everything that the suffixes answer for."""
        size = np.array([len(t) for t in self.texts], np.int64)
        return self.ids, self.pos - self.left, self.pos - self.left + size


def repeats(batch: Batch, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of stretches that two suffixes of a group hold, or one
    that occurs more than once."""
    size = np.array([len(t) for t in batch.texts], np.int64)
    data = np.frombuffer(b"".join(batch.texts), np.uint8)
    at = np.cumsum(size) - size
    who, s = _spread(size - length + 1)
    a, b = _digests(data, at[who] + s, length)
    b = b ^ W.mix(group[who].astype(U))
    order = np.lexsort((b, a))
    run = _equal(a[order], b[order])
    same = (np.bincount(run)[run] > 1) | (np.bincount(run, batch.many[who[order]])[run] > 0)
    hit = np.sort(order[same])
    w, t = who[hit], s[hit]
    f = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (t[1:] != t[:-1] + 1))[: len(w)])
    last = np.append(f[1:], len(w))[: len(f)] - 1
    base = batch.pos[w[f]] - batch.left[w[f]]
    return batch.ids[w[f]], base + t[f], base + t[last] + length


class SuffixLevels:
    """Levels of sorted suffixes, of geometrically growing size."""

    def __init__(self, length: int):
        self.length, self.gram = length, length // 4
        self.levels: list[tuple[Batch, np.ndarray]] = []

    def put(self, batch: Batch) -> None:
        """A level as it is; levels at most half as large as the next merge."""
        self.levels.append((batch, batch.grams(self.gram)))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            (a, _), (b, _) = self.levels[-2:]
            both = Batch.merged([a, b])
            self.levels[-2:] = [(both, both.grams(self.gram))]

    def add(self, batch: Batch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Merge-scan a batch against itself and all levels, then keep it.  Gives
        (text, start, end) of what is found to occur elsewhere, in the batch and
        in texts of the levels."""
        grams = batch.grams(self.gram)
        kinds, group = np.unique(grams, return_inverse=True)
        met, of = [batch], [group]
        shared = (np.bincount(group) > 1) | (np.bincount(group, batch.many | batch.doubled(self.gram)) > 0)
        for level, theirs in self.levels:
            lo, hi = np.searchsorted(theirs, kinds), np.searchsorted(theirs, kinds, "right")
            shared |= hi > lo
            who, k = _spread(hi - lo)
            met.append(level.take(lo[who] + k))
            of.append(who)
        group = np.concatenate(of)
        some = np.flatnonzero(shared[group])
        by = some[np.argsort(group[some], kind="stable")]
        every = Batch(*(np.concatenate([getattr(m, f) for m in met]) for f in ("ids", "pos", "left", "many")), [t for m in met for t in m.texts], True)
        a = 0
        while a < len(by):  # whole groups, some thousand suffixes at a time
            b = min(a + 4096, len(by))
            while b < len(by) and group[by[b]] == group[by[b - 1]]:
                b += 1
            yield repeats(every.take(by[a:b]), group[by[a:b]], self.length)
            a = b
        self.put(batch)


def _found(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    ks, (pairs,) = _per_key(ids, np.stack([lo, hi], 1)) if len(ids) else ([], ([],))
    none = pa.nulls(len(ks), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(ks, pa.binary()), pa.array(pairs, pa.binary()), pa.nulls(len(ks), pa.int32()), none, none], names=["k", "spans", "level_key", "level_ids", "level_body"])


def _slot(k: bytes) -> int:
    """One of 1024 groups for spans that are settled already."""
    return int.from_bytes(k[:2], "little") % 1024


def _around(length: int, bits: int):
    """A task's suffixes to look at, as batches by range; hot ones as digests of
    their stretches, numbered after the ranges.  What the task's own arrays tell
    is sent as spans (negative keys)."""
    span = 1 << bits

    def spans(ids, lo, hi):
        ks, (pairs,) = _per_key(ids, np.stack([lo, hi], 1)) if len(ids) else ([], ([],))
        return [(-1 - _slot(k), k, p) for k, p in zip(ks, pairs)]

    def flush(held, hots):
        rows = []
        if held:
            slot = np.array([x[0] for x in held])
            order = np.argsort(slot, kind="stable").tolist()
            start, count = W.runs(slot[order])
            for a, n in zip(start.tolist(), count.tolist()):
                part = [held[i] for i in order[a : a + n]]
                kept, rest = Batch(np.frombuffer(b"".join(x[1] for x in part), KEY), *(np.array([x[j] for x in part], np.int64) for j in (2, 3)), np.array([x[4] for x in part], bool), [x[5] for x in part]).fold()
                rows.append((int(slot[order[a]]), *kept.pack()))
                rows += spans(*rest.whole()) if len(rest) else []
        if hots:
            a, b, ids, at, many = (np.concatenate(x) for x in zip(*hots))
            order = np.lexsort((b, a))
            a, b, ids, at, many = (x[order] for x in (a, b, ids, at, many))
            run = _equal(a, b)
            first = np.append(True, run[1:] != run[:-1])
            twice = np.bincount(run)[run] > 1
            many = (many > 0) | twice | (np.bincount(run, many)[run] > 0)
            rows += spans(ids[~first], at[~first], at[~first] + length) if (~first).any() else []
            a, b, ids, at, many = (x[first] for x in (a, b, ids, at, many))
            slot = (a >> U(64 - bits)).astype(np.int64)
            cut = np.searchsorted(slot, np.arange(span + 1))
            for r in np.flatnonzero(np.diff(cut)):
                z = slice(cut[r], cut[r + 1])
                rows.append((span + int(r), ids[z].tobytes(), a[z].tobytes() + b[z].tobytes() + at[z].astype(np.int64).tobytes() + many[z].astype(np.uint8).tobytes()))
        yield from B.emit(rows)

    def run(batches):
        held, hots, size = [], [], 0
        for part, ids, data, offs in _texts(batches):
            raw, keys = data.tobytes(), part.column(0).to_pylist()
            found = Anchors(data, offs, length)
            cuts = np.searchsorted(found.pos, offs)
            for k, (n, looks, hot) in enumerate(zip(*(part.column(j).to_pylist() for j in (2, 3, 4)))):
                dealt = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in hot or ()] or [np.zeros(0, np.int64)])) + offs[k]
                pos = np.concatenate([np.frombuffer(x, np.int64) for x in looks or ()] or [np.zeros(0, np.int64)]) + offs[k]
                pos = np.setdiff1d(found.pos[cuts[k] : cuts[k + 1]] if n > 1 else pos, dealt)
                if len(pos):
                    j = np.searchsorted(found.pos, pos)
                    lo, hi = found.lo[j], found.hi[j]
                    slot = (found.hash[j] >> U(64 - bits)).astype(np.int64)
                    for s, p, a, b in zip(slot.tolist(), pos.tolist(), lo.tolist(), (hi + length).tolist()):
                        held.append((s, keys[k], p - int(offs[k]), p - a, n > 1, raw[a:b]))
                        size += b - a
                if len(dealt):
                    j = np.searchsorted(found.pos, dealt)
                    lo, hi = found.lo[j], found.hi[j]
                    who, s = _spread(hi - lo + 1)
                    at = np.unique(lo[who] + s)
                    a, b = _digests(data[offs[k] : offs[k + 1]], at - offs[k], length)
                    hots.append((a, b, np.repeat(ids[k : k + 1], len(at)), at - offs[k], np.full(len(at), n > 1, np.int64)))
                    size += 32 * len(at)
            if size >= FLUSH:
                yield from flush(held, hots)
                held, hots, size = [], [], 0
        yield from flush(held, hots)

    return run


def _scan(length: int, bits: int, keep: bool):
    """Suffixes of a range: stored levels, if any, then new batches."""
    span = 1 << bits

    def singles(batches):
        parts = []
        for batch in batches:
            for i, body, old in zip(*(batch.column(c).to_pylist() for c in ("ids", "body", "old"))):
                k = len(i) // 16
                a, b, at = np.frombuffer(body, U, 2 * k).reshape(2, k)[0], np.frombuffer(body, U, k, 8 * k), np.frombuffer(body, np.int64, k, 16 * k)
                parts.append((a, b, np.frombuffer(i, KEY), at, np.frombuffer(body, np.uint8, k, 24 * k), np.full(k, old)))
        a, b, ids, at, many, old = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((b, a))
        run = _equal(a[order], b[order])
        hit = order[(np.bincount(run)[run] > 1) | (np.bincount(run, many[order])[run] > 0)]
        yield _found(ids[hit], at[hit], at[hit] + length)
        return ids[~old].tobytes(), a[~old].tobytes() + b[~old].tobytes() + at[~old].tobytes() + many[~old].tobytes()

    def level(key, ids, body):
        return pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([key], pa.int32()), pa.array([ids], pa.binary()), pa.array([body], pa.binary())], names=["k", "spans", "level_key", "level_ids", "level_body"])

    def run(key, batches):
        r = key[0].as_py()
        if r < 0:  # settled by a task's own arrays
            for batch in batches:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column("ids"), batch.column("body"), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=["k", "spans", "level_key", "level_ids", "level_body"])
            return
        if r >= span:
            stored = yield from singles(batches)
            if keep:
                yield level(r, *stored)
            return
        levels, late, fresh, size = SuffixLevels(length), [], [], 0
        for batch in batches:
            for i, body, old in zip(*(batch.column(c).to_pylist() for c in ("ids", "body", "old"))):
                (late if old else fresh).append(Batch.unpack(i, body))
        for b in sorted(late, key=len, reverse=True):
            levels.put(b)
        kept, a = [], 0
        while a < len(fresh):
            b, size = a, 0
            while b < len(fresh) and size < LEVEL:
                size += len(fresh[b])
                b += 1
            batch = Batch.merged(fresh[a:b])
            kept.append(batch)
            for x in levels.add(batch):
                yield _found(*x)
            a = b
        if keep and kept:  # one level of this call; stored levels merge when they are read
            yield level(r, *Batch.merged(kept).pack())

    return run


def _union(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    f = np.flatnonzero(new)
    return lo[f], hi[np.append(f[1:], len(lo)) - 1]


def _cut(batches):
    for part, data, offs in W.slices(batches):
        raw, removed, spans, shas, kept = data.tobytes(), [], [], [], []
        for k, mine in enumerate(part.column(2).to_pylist()):
            pairs = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in mine])
            lo, hi = _union(pairs[:, 0], pairs[:, 1])
            text = raw[offs[k] : offs[k + 1]]
            edges = [0, *np.stack([lo, hi], 1).ravel().tolist(), len(text)]
            rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            removed.append(len(text) - len(rest))
            spans.append(len(lo))
            shas.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.binary())], names=["k", "n_removed", "n_spans", "kept_sha256", "kept"])


def _typed(f):
    """Type hints tell Spark to hand over a group's batches one by one."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(key, batches)

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


class SuffixFamily:
    """A growing index: each ``add`` meets the levels of all earlier ones.

    Tables lie under ``scratch``; texts are read again from the DataFrames that
    were added.  ``bits`` fixes the number of hash ranges (2**bits) for good:
    give it for a family that is to grow.  With a scratch of a root of its own
    the tables stay, and ``reopen`` goes on with them.
    """

    @classmethod
    def reopen(cls, spark: SparkSession, root: str, seen: list[DataFrame], length: int, bits: int, **options) -> SuffixFamily:
        """The family whose tables lie under ``root``; ``seen`` are the
        DataFrames it was given so far, in order."""
        family = cls(spark, length, bits, scratch=Scratch(spark, "suffixes", root), **options)
        for call, docs in enumerate(seen):
            family.docs.append(docs)
            for kind in ("keys", "grams", "cuts"):
                family.tables[kind].append(spark.read.parquet(f"{root}/{kind}-{call}"))
            family._scanned(spark.read.parquet(f"{root}/scan-{call}"))
        return family

    def _scanned(self, found: DataFrame) -> None:
        if self.keep:
            self.tables["levels"].append(found.where("level_key is not null").select(F.col("level_key").alias("key"), F.col("level_ids").alias("ids"), F.col("level_body").alias("body")))
        self.tables["spans"].append(found.where("spans is not null").select("k", "spans"))

    def __init__(self, spark: SparkSession, length: int = 400, bits: int | None = None, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, keep: bool = True, bytes_kept: bool = False):
        self.spark, self.length, self.bits, self.id_col, self.text_col, self.keep, self.bytes_kept = spark, length, bits, id_col, text_col, keep, bytes_kept
        self.scratch = scratch or Scratch(spark, "suffixes")
        self.docs: list[DataFrame] = []
        self.tables: dict[str, list[DataFrame]] = {"keys": [], "grams": [], "levels": [], "spans": [], "cuts": []}

    def _store(self, kind: str, df: DataFrame) -> DataFrame:
        out = self.scratch.put(df, f"{kind}-{len(self.tables[kind])}")
        self.tables[kind].append(out)
        return out

    def _all(self, kind: str) -> DataFrame:
        return reduce(DataFrame.unionByName, self.tables[kind])

    def _slim(self, docs: DataFrame) -> DataFrame:
        text = F.coalesce(F.col(self.text_col).cast("string"), F.lit(""))
        return docs.select(F.col(self.id_col).cast("bigint").alias("doc_id"), text.alias("text")).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)).withColumn("k", F.unhex(F.substring("sha", 1, 32)))

    def add(self, docs: DataFrame) -> None:
        length, call = self.length, len(self.docs)
        slim = self._slim(docs)
        self.docs.append(docs)
        if self.bits is None:
            self.bits = B.range_bits(docs)
        bits = self.bits
        self._store("keys", slim.select("doc_id", "k", F.unhex("sha").alias("sha"), F.octet_length("text").cast("bigint").alias("n_bytes"), F.lit(call).alias("call")))
        long = slim.where(F.octet_length("text") >= length)
        grams = long.select("k", "text").mapInArrow(_mark(length, bits), B.SCHEMA)
        if self.keep:
            grams = self._store("grams", grams)
        marks = grams.withColumn("old", F.lit(False))
        for t in self.tables["grams"][:-1]:
            marks = marks.unionByName(t.withColumn("old", F.lit(True)))
        looks = self.scratch.put(marks.groupBy("key").applyInArrow(_meet(HOT), _LOOKS), f"looks-{call}")
        looks = looks.groupBy("k").agg(F.collect_list("looks").alias("looks"), F.collect_list("hot").alias("hot"))
        # a text is read where its least id is; it counts as one that occurs n times
        firsts = self._all("keys").where(F.col("n_bytes") >= length).groupBy("k").agg(F.min("doc_id").alias("d0"), F.count("*").alias("n"), F.count_if(F.col("call") < call).alias("n_old"))
        firsts = firsts.withColumn("again", (F.col("n") > 1) & (F.col("n_old") < 2))  # no level knows yet that it occurs twice
        want = firsts.join(looks, "k", "left").where("again or looks is not null").select("k", "d0", F.when(F.col("again"), F.col("n")).otherwise(F.lit(1)).alias("n"), "looks", "hot")
        texts = reduce(DataFrame.unionByName, [self._slim(d).select("doc_id", "k", "text") for d in self.docs])
        texts = texts.where(F.octet_length("text") >= length).withColumnRenamed("k", "tk")
        cand = texts.join(want, (F.col("tk") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d0")))
        cand = self.scratch.put(cand.select("k", "text", "n", "looks", "hot"), f"candidates-{call}")
        new = cand.mapInArrow(_around(length, bits), B.SCHEMA).withColumn("old", F.lit(False))
        for t in self.tables["levels"]:
            new = new.unionByName(t.withColumn("old", F.lit(True)))
        found = self.scratch.put(new.groupBy("key").applyInArrow(_typed(_scan(length, bits, self.keep)), _SPANS), f"scan-{call}")
        self._scanned(found)
        touched = self.tables["spans"][-1].select("k").distinct()
        mine = self._all("spans").join(touched, "k", "left_semi") if call else self._all("spans")
        mine = mine.groupBy("k").agg(F.collect_list("spans").alias("spans"))
        if call:  # spans may be of texts that are no candidates of this call
            where = firsts.select("k", "d0").join(touched, "k", "left_semi")
            source = texts.join(where, (F.col("tk") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d0"))).select("k", "text")
        else:
            source = cand.select("k", "text")
        cut = source.join(mine, "k").select("k", "text", "spans").mapInArrow(_cut, "k binary, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
        # rows that share id and text are read several times, with one result
        cut = cut.groupBy("k").agg(*[F.first(c).alias(c) for c in ("n_removed", "n_spans", "kept_sha256", *(["kept"] if self.bytes_kept else []))])
        self._store("cuts", cut.withColumn("call", F.lit(call)))
        self.scratch.drop(f"looks-{call}", f"candidates-{call}", *([] if self.keep else [f"scan-{call}"]))

    def result(self) -> DataFrame:
        """One row per row added so far, as ``suffix_dedup`` gives them."""
        cuts, extra = self._all("cuts"), ["kept"] if self.bytes_kept else []
        said = ["n_removed", "n_spans", "kept_sha256", *extra]
        if len(self.tables["cuts"]) > 1:
            cuts = cuts.groupBy("k").agg(F.max_by(F.struct(*said), "call").alias("c")).select("k", "c.*")
        cuts = cuts.select("k", *said)
        out = self._all("keys").select("doc_id", "k", "sha", "n_bytes").join(cuts, "k", "left")
        return out.select(
            "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"),
            F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"), *extra,
        )


def suffix_dedup(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", bytes_kept: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]), one row per
    input row.

    Removes each byte covered by a string of ``length`` bytes that also starts
    anywhere else, in the same document or another; matches never cross
    documents and are judged on the input.  Null texts count as empty; texts
    shorter than ``length`` lose nothing.  ``bytes_kept`` adds the remaining
    bytes of documents that lost some (null otherwise).  Rows, not ids, are
    documents: rows with a null id are compared like any other, and so are rows
    that share an id, whether their texts differ or not.  Other columns are
    ignored; an empty table gives an empty result.
    """
    family = SuffixFamily(docs.sparkSession, length, None, id_col, text_col, scratch, keep=False, bytes_kept=bytes_kept)
    family.add(docs)
    return family.result()
