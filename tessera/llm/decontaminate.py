"""Benchmark decontamination by latent semantic retrieval.

1. Texts become sequences of benchmark terms (other words count as none): the
   only words that can make a passage like an item.  Written once, 2 bytes a
   word; the rest works on that table.
2. TF-IDF passages (windows of ``PASSAGE`` words, half overlapping) of the whole
   corpus, with the items weighted in, are factorised by a distributed
   randomised SVD: each task adds its part of A'(A Omega), twice, and the small
   results are orthonormalised on the driver (terms x rank, both bounded).
3. A passage whose cosine with an item, in the latent space, reaches
   ``cosine`` is a candidate.
   Benchmarks beyond ``MAX_ITEMS`` or ``MAX_TERMS`` are cut into blocks, each
   searched for in the whole corpus; their finds are united.
   The items are a query set that all passages meet, in blocks of bounded size.
4. Candidates are checked by the heaviest common subsequence of terms with the
   item around the passage, terms weighing their inverse document frequency:
   ``coverage`` of the item's weight, and part of its answer's.  So words that
   every text has do not make a leak, and a paraphrase that keeps the telling
   words in order, among others, is one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .store import Scratch

PASSAGE, STRIDE = 64, 32
#: an item's answer is its last quarter, of so many terms at least, and is there
#: if this share of its weight is
ANSWER, ANSWERED = 4, 1 / 4
#: most benchmark items and terms of one block: what the driver and tasks hold
MAX_ITEMS, MAX_TERMS = 20_000, 65_535
_FOUND = "doc_id bigint, item_id bigint, coverage double, cosine double"
_STRIP = np.zeros(256, bool)
_STRIP[list(b".,;:!?\"'()[]*#%&$|<>")] = True


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words without the punctuation at their ends."""
    data = W.LOWER[data]
    s, e, woffs = W.spans(data, offs)
    s, e = s.copy(), e.copy()
    for _ in range(3):
        more = (e > s) & _STRIP[data[np.maximum(e - 1, 0)]]
        e -= more
        more = (e > s) & _STRIP[data[np.minimum(s, len(data) - 1)]]
        s += more
    return W.between(W.prefix(data), s, e), woffs


class Items:
    """The benchmark as term sequences; small enough to ship to every task."""

    def __init__(self, ids: list[int], texts: list[str]):
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        h, woffs = _words(data, offs)
        self.vocab = np.unique(h)
        if len(self.vocab) > MAX_TERMS or len(ids) > MAX_ITEMS:
            raise ValueError(f"{len(ids)} items with {len(self.vocab)} terms are beyond {MAX_ITEMS} and {MAX_TERMS}")
        term = np.searchsorted(self.vocab, h) + 1
        self.ids = np.array(ids, np.int64)
        self.terms = [term[a:b] for a, b in zip(woffs[:-1], woffs[1:])]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.vocab >> np.uint64(44)).astype(np.int64)] = True

    def encode(self, h: np.ndarray) -> np.ndarray:
        """Term numbers of word hashes, 0 for words of no item."""
        out = np.zeros(len(h), np.uint16)
        some = np.flatnonzero(self.sieve[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocab, h[some]), len(self.vocab) - 1)
        hit = self.vocab[at] == h[some]
        out[some[hit]] = at[hit] + 1
        return out


def _encode(items: Items):
    def run(batches):
        for part, data, offs in W.slices(batches):
            h, woffs = _words(data, offs)
            t = items.encode(h)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t[a:b].tobytes() for a, b in zip(woffs[:-1], woffs[1:])], pa.binary())], names=["doc_id", "terms"])

    return run


def _passages(blobs: list[bytes], weigh: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, passage of each, document of each passage, start of each) with
    words of no item, and of no weight, left out."""
    seqs = [np.frombuffer(b, np.uint16) for b in blobs]
    n = np.array([len(x) for x in seqs])
    k = np.where(n > 0, np.maximum(1, -(-(n - PASSAGE) // STRIDE) + 1), 0)
    base = np.concatenate([[0], np.cumsum(k)])
    flat = np.concatenate(seqs) if seqs else np.zeros(0, np.uint16)
    doc = np.repeat(np.arange(len(seqs)), n)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    some = flat > 0 if weigh is None else np.append(False, weigh > 0)[flat]
    flat, doc, at = flat[some].astype(np.int64), doc[some], at[some]
    # passage j covers words j * STRIDE up to + PASSAGE: two a word, at the ends one
    j = at // STRIDE
    terms, rows = [], []
    for back in range(PASSAGE // STRIDE):
        ok = (j - back >= 0) & (j - back < k[doc])
        terms.append(flat[ok]), rows.append(base[doc[ok]] + j[ok] - back)
    owner = np.repeat(np.arange(len(seqs)), k)
    return np.concatenate(terms), np.concatenate(rows), owner, (np.arange(base[-1]) - base[owner]) * STRIDE


def _parts(batch: pa.RecordBatch, words: int = 1 << 19):
    """(ids, blobs) of a batch in parts of about so many words."""
    ids, blobs = batch.column(0).to_pylist(), [x or b"" for x in batch.column(1).to_pylist()]
    a = 0
    while a < len(ids):
        b, size = a, 0
        while b < len(ids) and (b == a or size + len(blobs[b]) // 2 <= words):
            size += len(blobs[b]) // 2
            b += 1
        yield ids[a:b], blobs[a:b]
        a = b


def _tf(terms: np.ndarray, rows: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, 1 + log count) with each pair once, by row."""
    pair = np.sort(rows * np.int64(n_terms) + terms - 1)
    start, count = W.runs(pair)
    pair = pair[start]
    return pair // n_terms, pair % n_terms, (1 + np.log(count)).astype(np.float32)


def _rows_times(row: np.ndarray, term: np.ndarray, val: np.ndarray, n_rows: int, m: np.ndarray) -> np.ndarray:
    """Sparse rows, each of few entries, times a dense matrix: the first
    entries of all rows, then the second ones, and so on."""
    out = np.zeros((n_rows, m.shape[1]), np.float32)
    start, length = W.runs(row)
    order = np.argsort(-length, kind="stable")
    start, length, rows = start[order], length[order], row[start[order]]
    for j in range(int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -j))  # rows with an entry j
        at = start[:n] + j
        out[rows[:n]] += m[term[at]] * val[at, None]
    return out


def _columns_times(row: np.ndarray, term: np.ndarray, val: np.ndarray, n_terms: int, y: np.ndarray) -> np.ndarray:
    """The transpose of sparse rows times a dense matrix, in bounded parts."""
    out = np.zeros((n_terms, y.shape[1]), np.float32)
    order = np.argsort(term, kind="stable")
    row, term, val = row[order], term[order], val[order]
    step = (1 << 22) // y.shape[1]
    for a in range(0, len(row), step):
        z = slice(a, a + step)
        start, _ = W.runs(term[z])
        out[term[z][start]] += np.add.reduceat(y[row[z]] * val[z, None], start, axis=0)
    return out


def _frequencies(n_terms: int):
    def run(batches):
        df, n = np.zeros(n_terms, np.int64), 0
        for _, blobs in (x for b in batches for x in _parts(b)):
            terms, rows, owner, _ = _passages(blobs)
            df += np.bincount(_tf(terms, rows, n_terms)[1], minlength=n_terms)
            n += len(owner)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_terms + 1)), pa.array(np.append(df, n))], names=["term", "n"])

    return run


def _weigh(row, term, val, idf, n_rows):
    """TF-IDF values and the norms of rows."""
    v = val * idf[term]
    return v, np.sqrt(np.bincount(row, v.astype(np.float64) ** 2, minlength=n_rows)).astype(np.float32)


def _gram(n_terms: int, idf: np.ndarray, omega: np.ndarray):
    """Each task's part of A'(A omega), rows of unit length, as term blocks."""

    def run(batches):
        out = np.zeros((n_terms, omega.shape[1]), np.float32)
        for _, blobs in (x for b in batches for x in _parts(b)):
            terms, rows, owner, _ = _passages(blobs, idf)
            row, term, val = _tf(terms, rows, n_terms)
            v, norm = _weigh(row, term, val, idf, len(owner))
            v = v / np.maximum(norm[row], 1e-6)
            y = _rows_times(row, term, v, len(owner), omega)
            out += _columns_times(row, term, v, n_terms, y)
        blocks = range(0, n_terms, 64)
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([out[a : a + 64].tobytes() for a in blocks], pa.binary())], names=["block", "part"])

    return run


#: tasks' parts are added in so many lanes first, then the lanes
LANES = 64


def _add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of a group's parts, one batch of them in memory at a time."""
    total = 0
    for batch in batches:
        for x in batch.column("part").to_pylist():
            total = total + np.frombuffer(x, np.float32).astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["block", "part"])


# kept as types: Spark reads them to hand over a group's batches one by one
_add.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}


def lcs(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> float:
    """Greatest weight of a common subsequence; ``weight`` is that of each of
    ``a``.  One row of the table after the other."""
    row = np.zeros(len(b) + 1)
    for x, w in zip(a.tolist(), weight.tolist()):
        best = np.where(b == x, row[:-1] + w, row[1:])
        np.maximum.accumulate(np.maximum(best, row[1:]), out=row[1:])
    return float(row[-1])


def _judge(item: np.ndarray, weight: np.ndarray, near: np.ndarray, coverage: float) -> float:
    """Share of the item, by weight, in the terms near a passage; 0 if the item
    or its answer is not there."""
    got = lcs(item, near, weight)
    if got < coverage * weight.sum():
        return 0.0
    tail = slice(-max(ANSWER, len(item) // 4), None)
    if lcs(item[tail], near, weight[tail]) < ANSWERED * weight[tail].sum():
        return 0.0
    return got / float(weight.sum())


def _search(items: Items, idf: np.ndarray, full: np.ndarray, basis: np.ndarray, cosine: float, coverage: float):
    n_terms = len(items.vocab)
    q = np.zeros((len(items.ids), basis.shape[1]), np.float32)
    for i, t in enumerate(items.terms):
        if len(t):
            r, c, v = _tf(t, np.zeros(len(t), np.int64), n_terms)
            w, norm = _weigh(r, c, v, idf, 1)
            q[i] = (w / max(norm[0], 1e-6)) @ basis[c]
    weights = [full[t - 1].astype(np.float64) for t in items.terms]
    distinct = [np.unique(t, return_inverse=True) for t in items.terms]
    shares = [(u, np.bincount(k, w, len(u)) / max(w.sum(), 1e-9)) for (u, k), w in zip(distinct, weights)]
    present = np.zeros(n_terms + 1, bool)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-6)

    def run(batches):
        for ids, blobs in (x for b in batches for x in _parts(b)):
            best: dict[tuple[int, int], tuple[float, float]] = {}
            terms, rows, owner, begin = _passages(blobs, idf)
            row, term, val = _tf(terms, rows, n_terms)
            v, norm = _weigh(row, term, val, idf, len(owner))
            z = _rows_times(row, term, v, len(owner), basis)
            some = np.flatnonzero(norm > 0)
            z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-6)
            step = min(4096, 1 + (1 << 24) // len(q))
            last, near = (-1, -1), np.zeros(0, np.int64)
            for a in range(0, len(some), step):
                p, i = np.nonzero(z[some[a : a + step]] @ q.T >= cosine)
                for p1, i1 in zip(some[p + a].tolist(), i.tolist()):
                    d = int(owner[p1])
                    if (d, i1) in best and best[d, i1][0] >= 1:
                        continue
                    size = len(items.terms[i1])
                    if (p1, size) != last:
                        last, at = (p1, size), int(begin[p1])
                        present[near] = False
                        near = np.frombuffer(blobs[d], np.uint16)[max(0, at - size) : at + PASSAGE + size].astype(np.int64)
                        near = near[near > 0]
                        present[near] = True
                    # no subsequence weighs more than the shared terms
                    if shares[i1][1] @ present[shares[i1][0]] < coverage:
                        continue
                    share = _judge(items.terms[i1], weights[i1], near, coverage)
                    if share:
                        best[d, i1] = max(best.get((d, i1), (0.0, 0.0)), (share, float(z[p1] @ q[i1])))
            present[near] = False
            found = sorted(best)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[d] for d, _ in found], pa.int64()), pa.array([int(items.ids[i]) for _, i in found], pa.int64()), pa.array([best[k][0] for k in found], pa.float64()), pa.array([best[k][1] for k in found], pa.float64())],
                names=["doc_id", "item_id", "coverage", "cosine"],
            )

    return run


def _telling(items: Items, df: np.ndarray, passages: int) -> np.ndarray:
    """Which terms have weight in the search: those in at most one passage in
    fifty, and each item's rarer half in any case, so that an item that leaked
    everywhere is still found.  The check of candidates weighs all terms."""
    keep = df * 50 <= passages
    for t in items.terms:
        own = np.unique(t) - 1
        keep[own[np.argsort(df[own], kind="stable")[: -(-len(own) // 2)]]] = True
    return keep


def _blocks(rows: Iterator[tuple[int, str]]) -> Iterator[Items]:
    """Items in blocks of at most MAX_ITEMS items and MAX_TERMS terms."""
    held, terms = [], set()
    for i, t in rows:
        raw = t.encode()
        own = set(_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist())
        if held and (len(held) >= MAX_ITEMS or len(terms | own) > MAX_TERMS):
            yield Items(*map(list, zip(*held)))
            held, terms = [], set()
        held.append((i, t))
        terms |= own
    if held:
        yield Items(*map(list, zip(*held)))


def load_items(benchmark: DataFrame, scratch: Scratch, item_col: str = "item_id", text_col: str = "text") -> Iterator[Items]:
    """All distinct items with words, a part of about MAX_ITEMS rows at a time."""
    rows = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("bigint").alias("i"), F.col(text_col).alias("t"))
    rows = scratch.put(rows.distinct(), "items")
    parts = -(-rows.count() // MAX_ITEMS)

    def read():
        for k in range(parts):
            part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).collect()
            yield from sorted((r.i, r.t) for r in part if r.t.split())

    return _blocks(read())


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = 64, cosine: float = 0.5, coverage: float = 0.45, seed: int = 3, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, item_id, coverage, cosine) of each item found in a document."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "leaks")
    slim = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    found = []
    for b, items in enumerate(load_items(benchmark, scratch)):
        seqs = scratch.put(slim.mapInArrow(_encode(items), "doc_id bigint, terms binary"), f"terms-{b}")
        found.append(scratch.put(_leaks(seqs, items, rank, cosine, coverage, seed), f"leaks-{b}"))
        scratch.drop(f"terms-{b}")
    if not found:
        return spark.createDataFrame([], _FOUND)
    return reduce(DataFrame.unionByName, found)


def _leaks(seqs: DataFrame, items: Items, rank: int, cosine: float, coverage: float, seed: int) -> DataFrame:
    """Finds of one block of items."""
    n = len(items.vocab)
    counts = {r.term: r.n for r in seqs.mapInArrow(_frequencies(n), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    idf = np.array([np.log((1 + counts.get(n, 0)) / (1 + counts.get(t, 0))) + 0.05 for t in range(n)], np.float32)
    full = idf.copy()
    idf[~_telling(items, np.array([counts.get(t, 0) for t in range(n)]), counts.get(n, 0))] = 0
    # the items as rows of their own, so that the space holds what they say
    m = len(items.ids)
    row, term, val = _tf(np.concatenate(items.terms), np.repeat(np.arange(m), [len(t) for t in items.terms]), n)
    val, norm = _weigh(row, term, val, idf, m)
    val = val / np.maximum(norm[row], 1e-6)
    k = min(n, rank)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, k)))[0].astype(np.float32)
    passages = max(1, counts.get(n, 0))
    for step in range(2):
        parts = seqs.mapInArrow(_gram(n, idf, basis), "block int, part binary").withColumn("lane", F.spark_partition_id() % LANES)
        for keys in (("block", "lane"), ("block",)):
            parts = parts.groupBy(*keys).applyInArrow(_add, "block int, part binary")
        parts = parts.collect()
        z = np.zeros((n, k), np.float64)
        for r in parts:
            z[r.block : r.block + 64] = np.frombuffer(r.part, np.float32).reshape(-1, k)
        z += passages * _columns_times(row, term, val, n, _rows_times(row, term, val, m, basis)).astype(np.float64)  # items weigh as much as the corpus
        basis = np.linalg.qr(z)[0].astype(np.float32)
    return seqs.mapInArrow(_search(items, idf, full, basis, cosine, coverage), _FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, **options) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, coverage), one row per input row.

    Null, empty and wordless texts are clean, as is any text when the benchmark
    is empty; items that are null or wordless are left out.  Rows are told by id
    and text, so those with a null id, or one that others have, are judged for
    themselves.  Texts are searched whole; other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "leaks")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    found = leaks(rows, benchmark, id_col="row", scratch=scratch, **options).withColumnRenamed("doc_id", "row")
    found = scratch.put(found.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage")), "found")
    return rows.select("doc_id", "row").join(found, "row", "left").select(
        "doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce(F.size("item_ids"), F.lit(0)).alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
    )
