"""N-gram Jaccard join by prefix trees.

1. Every text becomes its set of word n-gram hashes.  Sets travel once, packed
   by hash range; a range's reducer sees all occurrences of its n-grams, so it
   knows their exact document frequency and sends back only n-grams that two
   different sets share.  Documents with equal sets are one set throughout.
2. Globally ordered sets: n-grams by (document frequency, hash), 64 bits of it
   or, where ranges are few, at least 56.  N-grams that
   one document alone has come first and can match nothing, so a document with
   enough of them has no partner and is done.
3. The rest are grouped into families by shared prefix n-grams (distributed
   connected components over ids).  A pair at or above the threshold shares a
   prefix n-gram, hence lies in one family.
4. Inside a family the ordered sets form a trie.  Queries walk it level by
   level, sharing the partial overlap of a common path; a subtree is cut when
   overlap plus the shorter remaining length cannot reach the threshold.
   Pairs that are already connected are not walked again: the result is
   components, and each link between different components is found.
5. Families beyond BLOCK members are dealt at random into blocks, ROUNDS times,
   which connects most of what is alike.  What is left open: sets outside their
   family's largest component, in blocks, against blocks of all of the family,
   or, where they are many, of all that share a prefix n-gram.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .components import connected_components
from .store import Scratch, plan_bytes

U = np.uint64
#: n-grams a task holds before it sends them on
FLUSH = 1 << 21
#: documents in one side of a trie task
BLOCK = 1024
#: times that a large family is dealt into random blocks
ROUNDS = 2
#: blocks outside the largest component that meet all of their family
FEW = 8
#: queries walked together
QUERIES = 128

_MAP = "key int, ids binary, sizes binary, body binary"
_FLAT = "doc_id bigint, n bigint, name bigint, name2 bigint, key int, body binary"
_LIVE = "doc_id bigint, n bigint, prefix array<bigint>, grams binary"


def _ranges(docs: DataFrame) -> int:
    """Hash ranges: a power of two, 256 at least, about 1 MB of input each."""
    need = plan_bytes(docs) >> 20
    return 1 << max(8, min(20, int(need).bit_length()))


def _set_sums(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums per document of distinct hashes."""
    order = np.argsort(doc, kind="stable")
    at = np.searchsorted(doc[order], np.arange(n_docs + 1))
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        c = np.zeros(len(h) + 1, U)
        np.cumsum(W.mix(h[order] ^ U(salt)), out=c[1:])
        out.append(c[at[1:]] - c[at[:-1]])
    return out[0], out[1]


def _kept(bits: int) -> int:
    """Bits of a hash that travel beside its range number."""
    return min(48, 64 - bits)


def _mapper(n: int, lower: bool, bits: int, salt: int = 0):
    span, kept = 1 << bits, _kept(bits)

    def flush(ids, hs, ds):
        ids = np.concatenate(ids)
        h, d = np.concatenate(hs), np.concatenate(ds)
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        if len(h):
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            h, d = h[new], d[new]
        size = np.bincount(d, minlength=len(ids)).astype(np.int64)
        s1, s2 = _set_sums(h, d, len(ids))
        # documents with equal sets are one set from here on, named by its sums;
        # a second name tells whether two different sets share the first
        name = np.where(size > 0, W.mix(s1 ^ W.mix(s2 + size.astype(U) + U(salt))), U(0)).view(np.int64)
        name2 = np.where(size > 0, W.mix(s2 ^ W.mix(s1 + U(salt + 1))), U(0)).view(np.int64)
        lead = np.zeros(len(ids), bool)
        lead[np.unique(name, return_index=True)[1]] = True
        lead &= size > 0
        keys, idss, sizes, bodies = [], [], [], []
        step = 4096
        for a in range(0, len(ids), step):
            keys.append(span + int(ids[a] % 1024))
            idss.append(ids[a : a + step].tobytes())
            sizes.append(size[a : a + step].tobytes())
            bodies.append(name[a : a + step].tobytes() + name2[a : a + step].tobytes())
        ok = lead[d]
        h, d = h[ok], d[ok]
        slot = (h >> U(64 - bits)).astype(np.int64)
        at = np.searchsorted(slot, np.arange(span + 1))
        low = (h >> U(64 - bits - kept)) & U((1 << kept) - 1)
        told = size.astype(np.uint32)  # a set's size goes with its first n-gram only
        for r in np.flatnonzero(np.diff(at)):
            a, b = at[r], at[r + 1]
            used, local = np.unique(d[a:b], return_inverse=True)
            keys.append(int(r))
            idss.append(name[used].tobytes())
            sizes.append(told[used].tobytes())
            told[used] = 0
            bodies.append(low[a:b].astype(np.uint32).tobytes() + (low[a:b] >> U(32)).astype(np.uint16).tobytes() + local.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32).tobytes())
        for a in range(0, len(keys), 512):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[a : a + 512], pa.int32())] + [pa.array(x[a : a + 512], pa.binary()) for x in (idss, sizes, bodies)],
                names=["key", "ids", "sizes", "body"],
            )

    def run(batches):
        ids, hs, ds, rows, held = [], [], [], 0, 0
        for part, data, offs in W.slices(batches):
            if lower:
                data = W.LOWER[data]
            s, e, woffs = W.spans(data, offs)
            h, d = W.shingles(W.word_hashes(data, s, e), woffs, n)
            ids.append(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            hs.append(h)
            ds.append(d + np.int32(rows))
            rows += part.num_rows
            held += len(h)
            if held >= FLUSH:
                yield from flush(ids, hs, ds)
                ids, hs, ds, rows, held = [], [], [], 0, 0
        if rows:
            yield from flush(ids, hs, ds)

    return run


def _reducer(bits: int, buckets: int):
    span, kept = 1 << bits, _kept(bits)

    def empty():
        return pa.table({"doc_id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "name": pa.array([], pa.int64()), "name2": pa.array([], pa.int64()), "key": pa.array([], pa.int32()), "body": pa.array([], pa.binary())})

    def run(key, table):
        r = key[0].as_py()
        cols = {c: table.column(c).to_pylist() for c in ("ids", "sizes", "body")}
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in cols["ids"]])
        sizes = np.concatenate([np.frombuffer(x, np.int64 if r >= span else np.uint32).astype(np.int64) for x in cols["sizes"]])
        if r >= span:
            names = np.concatenate([np.frombuffer(x, np.int64).reshape(2, -1) for x in cols["body"]], 1)
            k = len(ids)
            return pa.table({"doc_id": ids, "n": sizes, "name": names[0], "name2": names[1], "key": pa.nulls(k, pa.int32()), "body": pa.nulls(k, pa.binary())})
        toks, docs, base = [], [], 0
        for i, b in zip(cols["ids"], cols["body"]):
            short = len(i) <= 8 << 16
            m = len(b) // (8 if short else 10)
            toks.append(np.frombuffer(b, np.uint32, m).astype(U) | np.frombuffer(b, np.uint16, m, 4 * m).astype(U) << U(32))
            docs.append(np.frombuffer(b, np.uint16 if short else np.uint32, m, 6 * m).astype(np.int64) + base)
            base += len(i) // 8
        tok, doc = np.concatenate(toks), np.concatenate(docs)
        order = np.lexsort((-sizes[doc], ids[doc], tok))
        tok, doc = tok[order], doc[order]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (ids[doc[1:]] != ids[doc[:-1]])
        tok, doc = tok[new], doc[new]  # the same set from several tasks
        start, length = W.runs(tok)
        df = np.repeat(length, length)
        n = sizes[doc]
        go = (df > 1) | (n > 0)  # shared n-grams, and sizes whatever they come with
        if not go.any():
            return empty()
        tok, doc, df, n = tok[go], doc[go], df[go], n[go]
        value = (U(r) << U(kept)) | tok
        d = ids[doc]
        bucket = (W.mix(d.astype(U)) % U(buckets)).astype(np.int64)
        order = np.lexsort((d, bucket))
        d, value, df, bucket, n = d[order], value[order], np.minimum(df, 0xFFFF)[order], bucket[order], n[order]
        start, length = W.runs(bucket)
        body = [_pack(d[a : a + m], n[a : a + m], value[a : a + m], df[a : a + m]) for a, m in zip(start, length)]
        k = len(start)
        null = pa.nulls(k, pa.int64())
        return pa.table({"doc_id": null, "n": null, "name": null, "name2": null, "key": pa.array(bucket[start], pa.int32()), "body": pa.array(body, pa.binary())})

    return run


def _pack(d: np.ndarray, n: np.ndarray, value: np.ndarray, df: np.ndarray) -> bytes:
    return d.tobytes() + value.tobytes() + n.astype(np.uint32).tobytes() + df.astype(np.uint16).tobytes()


def _unpack(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    k = len(b) // 22
    return np.frombuffer(b, np.int64, k), np.frombuffer(b, np.uint32, k, 16 * k).astype(np.int64), np.frombuffer(b, U, k, 8 * k), np.frombuffer(b, np.uint16, k, 20 * k)


def _ordered(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, frequencies) of a set, in the global order."""
    k = len(b) // 10
    return np.frombuffer(b, U, k), np.frombuffer(b, np.uint16, k, 8 * k)


def _gather(num: int, den: int):
    """Shared n-grams of a bucket's documents; keeps documents that can have a
    partner, with the prefix n-grams to find it by."""

    def run(table):
        d, n, v, df = (np.concatenate(x) for x in zip(*map(_unpack, table.column("body").to_pylist())))
        order = np.lexsort((v, df, d))
        d, n, v, df = d[order], n[order], v[order], df[order]
        start, _ = W.runs(d)
        size = np.repeat(np.maximum.reduceat(n, start), np.diff(np.append(start, len(d))))
        d, size, v, df = (x[df > 1] for x in (d, size, v, df))
        start, length = W.runs(d)
        size = size[start]
        need = -(-size * num // den)  # least overlap with any partner
        own = size - length  # n-grams no one else has: they come first
        take = size - need + 1 - own
        keep = take > 0
        rows = np.flatnonzero(keep)
        offs = np.zeros(len(rows) + 1, np.int32)
        offs[1:] = np.cumsum(np.minimum(take[rows], length[rows]))
        pick = [v[start[r] : start[r] + min(take[r], length[r])] for r in rows]
        values = np.concatenate(pick).view(np.int64) if pick else np.zeros(0, np.int64)
        return pa.table({
            "doc_id": d[start[rows]],
            "n": size[rows],
            "prefix": pa.ListArray.from_arrays(pa.array(offs), pa.array(values)),
            "grams": pa.array([v[start[r] : start[r] + length[r]].tobytes() + df[start[r] : start[r] + length[r]].tobytes() for r in rows], pa.binary()),
        })

    return run


class _Union:
    def __init__(self, n: int):
        self.p = np.arange(n)

    def find(self, x: int) -> int:
        p = self.p
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.p[max(a, b)] = min(a, b)
        return True


def trie_links(sets: list[np.ndarray], sizes: np.ndarray, num: int, den: int, side: np.ndarray | None = None, comp: np.ndarray | None = None, freqs: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Spanning links of the graph of pairs with |A & B| * den >= num * |A | B|.

    sets: n-grams that others share, in the order of (freqs, n-gram), or of the
    n-gram alone; sizes: full set sizes.  side: where given, only pairs across the two sides are of interest
    (the rest are another task's).  comp: components known beforehand.
    """
    k = len(sets)
    link = _Union(k)
    if comp is not None:
        first: dict[int, int] = {}
        for i, c in enumerate(comp.tolist()):
            link.join(first.setdefault(c, i), i)
    out: list[tuple[int, int]] = []
    length = np.array([len(s) for s in sets], np.int64)
    vocab, one, flat = np.unique(np.concatenate(sets), return_index=True, return_inverse=True)
    if freqs is not None:  # numbers in the global order
        rank = np.empty(len(vocab), np.int64)
        rank[np.lexsort((vocab, np.concatenate(freqs)[one]))] = np.arange(len(vocab))
        flat = rank[flat]
    at = np.zeros(k + 1, np.int64)
    np.cumsum(length, out=at[1:])
    # rows in trie order: big-endian bytes sort like the sequences
    spelt = [flat[at[i] : at[i + 1]].astype(">u4").tobytes() for i in range(k)]
    order = np.array(sorted(range(k), key=spelt.__getitem__), np.int64)
    del spelt
    # cheap first links: neighbours in trie order, then by size
    member = np.zeros((k, len(vocab)), bool) if k * len(vocab) <= 1 << 26 else None
    if member is not None:
        member[np.repeat(np.arange(k), length), flat] = True

    def has(q: np.ndarray, t: np.ndarray) -> np.ndarray:
        if member is not None:
            return member[q, t]
        hit = np.searchsorted(key, q * np.int64(len(vocab)) + t)
        hit[hit == len(key)] = 0
        return key[hit] == q * np.int64(len(vocab)) + t

    key = None
    if member is None:
        key = np.repeat(np.arange(k, dtype=np.int64), length) * len(vocab) + flat
    good = lambda inter, a, b: inter * den >= num * (sizes[a] + sizes[b] - inter)

    def overlap(a: int, b: int) -> int:
        return len(np.intersect1d(flat[at[a] : at[a + 1]], flat[at[b] : at[b + 1]], assume_unique=True))

    def attempt(a: int, b: int) -> None:
        if (side is None or side[a] != side[b]) and link.find(a) != link.find(b) and good(overlap(a, b), a, b):
            link.join(a, b)
            out.append((a, b))

    for row in (order, np.lexsort((np.arange(k), sizes))):
        for a, b in zip(row[:-1].tolist(), row[1:].tolist()):
            attempt(a, b)

    roots = np.array([link.find(i) for i in range(k)])
    by = np.argsort(roots, kind="stable")  # queries of one component together
    rank = np.empty(k, np.int64)
    rank[by] = np.arange(k)
    begins, counts = W.runs(roots[by])
    end_of = np.repeat(begins + counts, counts)  # in by-order: end of own component
    pos = 0
    while pos < k:
        queries = by[pos : pos + QUERIES]
        after = int(end_of[pos])
        pos += len(queries)
        if after >= k:
            break
        # rows of components from the first query's successor on, in trie order
        rows = order[rank[order] >= after]
        _walk(rows, queries, length, sizes, num, den, has, flat, at, side, link, out)
    return out


def _walk(rows, queries, length, sizes, num, den, has, flat, at, side, link, out) -> None:
    """Walk the trie of ``rows`` (in trie order) with all queries at once."""
    start = at[rows]
    tall = np.append(length[rows], 0)  # with one more, for ranges up to the end
    least = np.append(sizes[rows], np.iinfo(np.int64).max)
    lo, hi = np.zeros(1, np.int64), np.array([len(rows)])  # nodes of this level: ranges of rows
    node, q = np.zeros(len(queries), np.int64), queries.astype(np.int64)
    over = np.zeros(len(queries), np.int64)
    depth = 0
    while len(node):
        # documents that end at a node come first in its range
        ends = length[rows[lo]] == depth
        if ends.any():
            for j in np.flatnonzero(ends[node]):
                x, o = int(node[j]), int(over[j])
                a, r = int(q[j]), int(lo[x])
                while r < hi[x] and length[rows[r]] == depth:
                    b = int(rows[r])
                    r += 1
                    if a != b and (side is None or side[a] != side[b]) and o * den >= num * (sizes[a] + sizes[b] - o) and link.join(a, b):
                        out.append((a, b))
            skip = np.zeros(len(lo), np.int64)
            for x in np.flatnonzero(ends):
                r = int(lo[x])
                while r < hi[x] and length[rows[r]] == depth:
                    r += 1
                skip[x] = r - lo[x]
            lo = lo + skip
        live = lo < hi
        if not live.any():
            return
        # children: runs of equal n-grams at this depth
        span = np.where(live, hi - lo, 0)
        idx = np.repeat(lo, span) + np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
        parent = np.repeat(np.arange(len(lo)), span)
        tok = flat[start[idx] + depth]
        cut = np.ones(len(idx), bool)
        cut[1:] = (tok[1:] != tok[:-1]) | (parent[1:] != parent[:-1])
        c0 = np.flatnonzero(cut)
        clo = idx[c0]
        chi = clo + np.diff(np.concatenate([c0, [len(idx)]]))
        cpar, ctok = parent[c0], tok[c0]
        first = np.searchsorted(cpar, np.arange(len(lo)))
        last = np.searchsorted(cpar, np.arange(len(lo)), "right")
        fan = (last - first)[node]
        pick = np.repeat(first[node], fan) + np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
        src = np.repeat(np.arange(len(node)), fan)
        nq = q[src]
        t = ctok[pick].astype(np.int64)
        hit = has(nq, t)
        no = over[src] + hit
        # bounds from what is left of the longest document below and of the query
        left_x = np.maximum.reduceat(tall, _pairs(clo, chi))[::2] - depth - 1 if len(clo) else clo
        small = np.minimum.reduceat(least, _pairs(clo, chi))[::2] if len(clo) else clo
        # n-grams of the query that the path has passed without a match
        later = length[nq] - _rank(flat, at, nq, t)
        best = no + np.minimum(left_x[pick], later)
        keep = best * den >= num * (small[pick] + sizes[nq] - best)
        node, q, over = pick[keep], nq[keep], no[keep]
        used, node = np.unique(node, return_inverse=True)
        lo, hi = clo[used], chi[used]
        depth += 1


def _pairs(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index pairs for reduceat over [lo, hi)."""
    out = np.empty(2 * len(lo), np.int64)
    out[::2] = lo
    out[1::2] = hi
    return out


def _rank(flat: np.ndarray, at: np.ndarray, q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """How many n-grams of set q are at most t (sets hold ascending ids)."""
    lo, hi = at[q], at[q + 1]
    base = lo.copy()
    while True:
        go = lo < hi
        if not go.any():
            return lo - base
        mid = (lo + hi) // 2
        less = go & (flat[np.minimum(mid, len(flat) - 1)] <= t)
        lo = np.where(less, mid + 1, lo)
        hi = np.where(go & ~less, mid, hi)


def _blocks(num: int, den: int, sides: bool = False):
    """Links within a block, or between its two sides."""

    def run(table):
        ids = table.column("doc_id").to_numpy()
        sizes = table.column("n").to_numpy()
        known = table.column("known").to_numpy()
        sets, freqs = zip(*map(_ordered, table.column("grams").to_pylist()))
        links = trie_links(list(sets), sizes, num, den, table.column("side").to_numpy() if sides else None, known, list(freqs))
        a = np.array([ids[x] for x, _ in links], np.int64)
        b = np.array([ids[y] for _, y in links], np.int64)
        return pa.table({"a": a, "b": b})

    return run


_PAIR = "a bigint, b bigint"


def _dealt(member: DataFrame, r: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Links within blocks of families, dealt anew each round; a family of one
    block is done with the first."""
    nb = F.ceil(F.col("k") / BLOCK)
    block = F.pmod(F.xxhash64("doc_id", F.lit(r)), nb).cast("int")
    rows = member.withColumn("block", block).select("family", "block", "doc_id", "n", "grams", "known")
    return scratch.put(rows.groupBy("family", "block").applyInArrow(_blocks(num, den), _PAIR), f"links-{r}")


def _known(member: DataFrame, local: DataFrame) -> DataFrame:
    """Members with the component they are known to be in."""
    of = local.select(F.col("id").alias("doc_id"), F.col("component").alias("known"))
    return member.join(of, "doc_id", "left").withColumn("known", F.coalesce("known", "doc_id"))


def _open(big: DataFrame) -> DataFrame:
    """(family, top, every, rest) of families of several components: the largest
    component, and blocks that all sets, and those outside it, make."""
    each = big.groupBy("family", "known").agg(F.count("*").alias("size"))
    per = each.groupBy("family").agg(F.count("*").alias("parts"), F.max(F.struct("size", "known")).alias("top"), F.sum("size").alias("size")).where("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    return per.select("family", F.col("top.known").alias("top"), blocks(F.col("size")).alias("every"), blocks(F.col("size") - F.col("top.size")).alias("rest"))


def _across(big: DataFrame, left: DataFrame, num: int, den: int) -> DataFrame:
    """Links between sets outside their family's largest component and all sets,
    blocks of the ones against blocks of the others.  Where the former make more
    than FEW blocks, only sets that share a prefix n-gram meet."""
    who = big.join(left, "family").withColumn("out", F.col("known") != F.col("top"))
    near = who.where(F.col("rest") <= FEW).select("doc_id", "out", F.struct(F.col("family").alias("a"), F.lit(0).cast("bigint").alias("b")).alias("at"), "every", "rest")
    post = who.where(F.col("rest") > FEW).select("doc_id", "out", "family", F.explode("prefix").alias("gram"))
    sizes = post.groupBy("family", "gram").agg(F.count("*").alias("every"), F.count_if("out").alias("rest")).where("rest > 0 and every > 1")
    sizes = sizes.select("family", "gram", *[F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("every", "rest")])
    far = post.join(sizes, ["family", "gram"]).select("doc_id", "out", F.struct(F.col("family").alias("a"), F.col("gram").alias("b")).alias("at"), "every", "rest")
    seats = near.unionByName(far)
    own = lambda c: F.pmod(F.xxhash64("doc_id", "at"), F.col(c)).cast("int")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    a = seats.where("out").select("doc_id", "at", F.lit(0).alias("side"), own("rest").alias("i"), all_of("every").alias("j"))
    b = seats.select("doc_id", "at", F.lit(1).alias("side"), all_of("rest").alias("i"), own("every").alias("j"))
    rows = a.unionByName(b).join(big.select("doc_id", "n", "grams", "known"), "doc_id")
    return rows.groupBy("at", "i", "j").applyInArrow(_blocks(num, den, True), _PAIR)


def ngram_jaccard_join(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100), lower: bool = True, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Components of the graph of documents whose n-gram sets have a Jaccard
    similarity of at least threshold[0] / threshold[1].

    Returns (doc_id, n_shingles, component_id), one row per input row;
    component_id is the smallest id reachable through links, the row's own id
    without links.  Null, empty and wordless texts have n_shingles 0 and no
    links; a text of fewer than n words has its whole word sequence as its one
    shingle.  Rows with a null id keep their size and have a null component.
    Repeated ids name one document: their rows share its component.  Other
    columns of ``docs`` are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    num, den = threshold
    scratch = scratch or Scratch(spark, "jaccard")
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    nameless = slim.where("doc_id is null").select("doc_id", "text")
    bits = _ranges(slim).bit_length() - 1
    buckets = 1 << max(8, bits - 2)
    for salt in range(8):  # another salt only where two different sets have one name
        packed = slim.where("doc_id is not null").mapInArrow(_mapper(n, lower, bits, salt), _MAP)
        flat = scratch.put(packed.groupBy("key").applyInArrow(_reducer(bits, buckets), _FLAT), f"shared-{salt}")
        base = flat.where("key is null").select("doc_id", "n", "name", "name2")
        if base.groupBy("name").agg((F.min("name2") != F.max("name2")).alias("clash")).where("clash").isEmpty():
            break
        scratch.drop(f"shared-{salt}")
    live = scratch.put(flat.where("key is not null").groupBy("key").applyInArrow(_gather(num, den), _LIVE), "live")
    post = live.select("doc_id", F.explode("prefix").alias("gram"))
    heads = post.groupBy("gram").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("tail")).where("head != tail").select("gram", "head")
    edges = post.join(heads, "gram").where("doc_id != head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    family = connected_components(edges, scratch, "family")
    sized = family.join(family.groupBy("component").agg(F.count("*").alias("k")), "component").select(F.col("id").alias("doc_id"), F.col("component").alias("family"), "k")
    member = live.join(sized, "doc_id")
    links = _dealt(member.withColumn("known", F.col("doc_id")), 0, num, den, scratch)
    local = connected_components(links, scratch, "local-0")
    for r in range(1, ROUNDS + 1):  # large families of which not all is one component
        big = scratch.put(_known(member.where(F.col("k") > BLOCK), local), f"big-{r}")
        left = _open(big)
        if left.isEmpty():
            break
        if r == ROUNDS:
            within = scratch.put(_across(big, left, num, den), f"links-{r}")
        else:
            within = _dealt(big.join(left.select("family"), "family", "left_semi"), r, num, den, scratch)
        local = connected_components(within.union(local.select(F.col("id").alias("a"), F.col("component").alias("b"))), scratch, f"local-{r}")
    whole = base.join(local.select(F.col("id").alias("name"), F.col("component").alias("c")), "name", "left").withColumn("c", F.coalesce("c", "name"))
    whole = scratch.put(whole.select("doc_id", "n", "c"), "classes")
    least = scratch.put(whole.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("least")).withColumnRenamed("c", "lc"), "least")
    found = whole.join(least, (whole.c == least.lc) & (whole.n > 0), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
    lone = nameless.mapInArrow(_sizes(n, lower), "n_shingles bigint").select(F.lit(None).cast("bigint").alias("doc_id"), "n_shingles", F.lit(None).cast("bigint").alias("component_id"))
    return found.unionByName(lone)


def _sizes(n: int, lower: bool):
    def run(batches):
        for _, data, offs in W.slices(batches):
            s, e, woffs = W.spans(data := W.LOWER[data] if lower else data, offs)
            h, d = W.shingles(W.word_hashes(data, s, e), woffs, n)
            size = [len(np.unique(h[d == k])) for k in range(len(offs) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(size, pa.int64())], names=["n_shingles"])

    return run
