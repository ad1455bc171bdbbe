"""Removal of repeated word windows by fixed-block anchors.

1. Every text is cut into non-overlapping blocks of half a window: the index.
   Every rolling window of that length is a probe.  Both travel packed by hash
   range; where a block meets a probe of another document, all holders of that
   hash get a hit.  A window that two documents share contains a whole block of
   the one, hence a hit in both.
2. Hits extend to the windows around them.  The short hashes of step 1 only
   propose; each candidate window is digested anew from its words (BLAKE2b).
   The digest goes to its range with the smallest document id that has it,
   combined per task first; starts in other documents come back as removals.
   Their union is the set of maximal exact repeats.
3. Only documents with removals are read once more, to digest what is left.

Copies inside a task are folded before the shuffle, and a hash that over HOT
documents of a task share is sent once: hot passages cost a record per task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import blobs as B
from . import words as W
from .store import Scratch

U = np.uint64
FLUSH = 1 << 21
HOT = 64
#: a row: its id and a hash of its text, as rows may share an id
ROW = np.dtype([("id", np.int64), ("h", np.int64)])
_NIL = hashlib.sha256(b"").hexdigest()


def _rows(part: pa.RecordBatch) -> np.ndarray:
    """Row keys of a batch whose last column is the hash."""
    out = np.empty(part.num_rows, ROW)
    out["id"], out["h"] = part.column(0).to_numpy(zero_copy_only=False), part.column(part.num_columns - 1).to_numpy(zero_copy_only=False)
    return out


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _starts(h: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Where a window of k words stays in its document."""
    return np.flatnonzero(doc[: len(h)] == doc[k - 1 :]) if len(h) else np.zeros(0, np.int64)


def _probe(block: int, bits: int):
    span = 1 << bits

    def flush(ids, words, counts, shas):
        ids, words, counts = np.concatenate(ids), np.concatenate(words), np.concatenate(counts)
        woffs = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(counts, out=woffs[1:])
        whole = np.frombuffer(b"".join(shas), U).reshape(-1, 4)
        lead = B.fold(ids["id"], *whole.T)
        rows = []
        for a in range(0, len(ids), 4096):
            z = slice(a, a + 4096)
            rows.append((span + int(ids["id"][a] % 1024), ids[z].tobytes(), counts[z].tobytes() + ids["id"][lead[z]].tobytes() + b"".join(shas[z])))
        h = W.window_hashes(words, block)
        doc = W.doc_of(woffs)
        at = _starts(h, doc, block)
        at = at[lead[doc[at]] == doc[at]]
        isblock = (at - woffs[doc[at]]) % block == 0
        h, doc = h[at], doc[at]
        order = np.argsort(h, kind="stable")
        h, doc, isblock = h[order], doc[order], isblock[order]
        if len(h):
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            isblock = np.logical_or.reduceat(isblock, np.flatnonzero(new))
            h, doc = h[new], doc[new]
            start, length = W.runs(h)
            hot = np.repeat(length > HOT, length)
            if hot.any():
                mine, (hits,) = _per_doc(ids[doc[hot]], B.short(h[hot], bits))
                rows += [(-1 - int(i["id"] % 1024), i.tobytes(), x) for i, x in zip(mine, hits)]
                any_block = np.repeat(np.logical_or.reduceat(isblock, start), length)
                stay = ~hot
                stay[start] = True
                isblock = np.where(hot, any_block, isblock)[stay]
                h, doc = h[stay], doc[stay]
            rows += B.by_range(h, doc, ids, bits, isblock.astype(np.uint8))
        yield from B.emit(rows)

    def run(batches):
        held, size = ([], [], [], []), 0
        for part, data, offs in W.slices(batches):
            s, e, woffs = W.spans(data, offs)
            raw = data.tobytes()
            held[0].append(_rows(part))
            held[1].append(W.word_hashes(data, s, e))
            held[2].append(np.diff(woffs))
            held[3].extend(hashlib.sha256(b" ".join(raw[a:b].split())).digest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()))
            size += len(s)
            if size >= FLUSH:
                yield from flush(*held)
                held, size = ([], [], [], []), 0
        if held[0]:
            yield from flush(*held)

    return run


_HITS = "doc_id bigint, h bigint, n_words bigint, rep bigint, sha binary, hits binary"


def _hits_table(doc=np.zeros(0, ROW), n=None, rep=None, sha=None, hits=None) -> pa.Table:
    k = len(doc)
    null = lambda x, t: pa.nulls(k, t) if x is None else pa.array(x, t)
    return pa.table({"doc_id": pa.array(doc["id"], pa.int64()), "h": pa.array(doc["h"], pa.int64()), "n_words": null(n, pa.int64()), "rep": null(rep, pa.int64()), "sha": null(sha, pa.binary()), "hits": null(hits, pa.binary())})


def _per_doc(ids: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    order = np.lexsort((ids["h"], ids["id"]))
    ids = ids[order]
    start, length = _runs2(ids["id"], ids["h"])
    return ids[start], [[v[a : a + m].tobytes() for a, m in zip(start, length)] for v in (x[order] for x in values)]


def _meet(bits: int):
    span = 1 << bits

    def run(key, table):
        r = key[0].as_py()
        if r < 0:
            ids = np.concatenate([np.frombuffer(x, ROW) for x in table.column("ids").to_pylist()])
            return _hits_table(ids, hits=table.column("body").to_pylist())
        if r >= span:
            out = ([], [], [], [])
            for i, b in zip(table.column("ids").to_pylist(), table.column("body").to_pylist()):
                k = len(i) // 16
                out[0].append(np.frombuffer(i, ROW))
                out[1].append(np.frombuffer(b, np.int64, k))
                out[2].append(np.frombuffer(b, np.int64, k, 8 * k))
                out[3].extend(b[16 * k + 32 * j : 16 * k + 32 * j + 32] for j in range(k))
            return _hits_table(*(np.concatenate(x) for x in out[:3]), out[3])
        low, ids, isblock = B.read(table, (np.uint8,), ROW)
        order = np.argsort(low, kind="stable")
        low, ids, isblock = low[order], ids[order], isblock[order]
        start, length = W.runs(low)
        good = np.repeat((length > 1) & (np.maximum.reduceat(isblock, start) > 0), length)
        if not good.any():
            return _hits_table()
        doc, (hits,) = _per_doc(ids[good], (np.int64(r) << 32) | low[good].astype(np.int64))
        return _hits_table(doc, hits=hits)

    return run


def _digests(raw: bytes, offs: np.ndarray, s: np.ndarray, e: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """128-bit digests, as two columns, of the k words from each of ``at``."""
    text = b" ".join(w for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()) for w in raw[a:b].split())
    end = np.cumsum(e - s + 1) - 1  # in ``text``: one space after each word
    lo, hi = end[at] - (e[at] - s[at]), end[at + k - 1]
    out = b"".join(hashlib.blake2b(text[a:b], digest_size=16).digest() for a, b in zip(lo.tolist(), hi.tolist()))
    return np.frombuffer(out, U).reshape(-1, 2)


def _runs2(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal pairs."""
    start = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)])
    return start, np.diff(np.append(start, len(a)))


def _extend(window: int, block: int, bits: int, bits2: int):
    """Candidate windows around hits."""

    def flush(ids, hs, ds, ps):
        ids = np.concatenate(ids)
        h, d, p = np.concatenate(hs), np.concatenate(ds), np.concatenate(ps)
        order = np.lexsort((h[:, 1], h[:, 0]))
        h, more, d, p = h[order, 0], h[order, 1], d[order], p[order]
        rows = []
        if len(h):
            start, length = _runs2(h, more)
            low = np.repeat(np.minimum.reduceat(ids["id"][d], start), length)
            gone = ids["id"][d] > low
            if gone.any():
                doc, (at,) = _per_doc(ids[d[gone]], p[gone])
                rows += [(-1 - int(i["id"] % 1024), i.tobytes(), b) for i, b in zip(doc, at)]
            rows += B.by_range(h[~gone], d[~gone], ids, bits2, more[~gone], p[~gone])
        yield from B.emit(rows)

    def run(batches):
        held, rows, size = ([], [], [], []), 0, 0
        for part, data, offs in W.slices(batches):
            s, e, woffs = W.spans(data, offs)
            words = W.word_hashes(data, s, e)
            doc = W.doc_of(woffs)
            h = W.window_hashes(words, block)
            ok = _starts(h, doc, block)
            cell = B.short(h, bits)
            mark = np.zeros(len(words) + 1, np.int32)
            hits = part.column(2).to_pylist()
            cuts = np.searchsorted(doc[ok], np.arange(part.num_rows + 1))
            for k, mine in enumerate(hits):
                at = ok[cuts[k] : cuts[k + 1]]
                at = at[np.isin(cell[at], np.concatenate([np.frombuffer(x, np.int64) for x in mine]))]
                lo, hi = np.maximum(at - (window - block), woffs[k]), np.minimum(at, woffs[k + 1] - window) + 1
                good = lo < hi
                np.add.at(mark, lo[good], 1)
                np.add.at(mark, hi[good], -1)
            at = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            held[0].append(_rows(part))
            held[1].append(_digests(data.tobytes(), offs, s, e, at, window))
            held[2].append(doc[at] + np.int32(rows))
            held[3].append((at - woffs[doc[at]]).astype(np.uint32))
            rows, size = rows + part.num_rows, size + len(at)
            if size >= FLUSH:
                yield from flush(*held)
                held, rows, size = ([], [], [], []), 0, 0
        if rows:
            yield from flush(*held)

    return run


def _first(table_key, table):
    """Starts whose window a smaller id also has."""
    if table_key[0].as_py() < 0:
        ids = np.concatenate([np.frombuffer(x, ROW) for x in table.column("ids").to_pylist()])
        return pa.table({"doc_id": ids["id"], "h": ids["h"], "starts": pa.array(table.column("body").to_pylist(), pa.binary())})
    low, ids, more, p = B.read(table, (U, np.uint32), ROW)
    order = np.lexsort((more, low))
    low, ids, more, p = low[order], ids[order], more[order], p[order]
    start, length = _runs2(low, more)
    gone = ids["id"] > np.repeat(np.minimum.reduceat(ids["id"], start), length)
    doc, (at,) = _per_doc(ids[gone], p[gone]) if gone.any() else (np.zeros(0, ROW), [[]])
    return pa.table({"doc_id": doc["id"], "h": doc["h"], "starts": pa.array(at, pa.binary())})


def _cut(window: int):
    def run(batches):
        for part, data, offs in W.slices(batches):
            raw, removed, shas, kept_texts = data.tobytes(), [], [], []
            for k, mine in enumerate(part.column(2).to_pylist()):
                words = raw[offs[k] : offs[k + 1]].split()
                at = np.concatenate([np.frombuffer(x, np.uint32) for x in mine]).astype(np.int64)
                mark = np.zeros(len(words) + 1, np.int32)
                np.add.at(mark, at, 1)
                np.add.at(mark, at + window, -1)
                keep = np.cumsum(mark[:-1]) == 0
                kept_texts.append(b" ".join(w for w, k2 in zip(words, keep.tolist()) if k2))
                shas.append(hashlib.sha256(kept_texts[-1]).hexdigest())
                removed.append(int((~keep).sum()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(kept_texts, pa.binary()).cast(pa.string())], names=["doc_id", "h", "n_removed", "kept_sha256", "kept"])

    return run


def word_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]), one row per input row.

    Removes each word covered by a window of ``window`` words that also starts
    in a document with a smaller id; windows are those of the input.  Null,
    empty and short texts lose nothing.  ``texts`` adds the kept words, joined
    by one space, of documents that lost some (null: the text is whole).  Rows
    with a null id have no place in the order and stay whole.  Rows that share
    an id are documents of their own, none smaller than the other.  Other
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "words")
    block = window // 2
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    named = slim.where("doc_id is not null").withColumn("h", F.xxhash64("text"))
    row = ["doc_id", "h"]
    bits = B.range_bits(named)
    bits2 = max(6, bits - 3)
    hits = scratch.put(named.mapInArrow(_probe(block, bits), B.SCHEMA).groupBy("key").applyInArrow(_meet(bits), _HITS), "hits")
    base = hits.where("n_words is not null").select("doc_id", "h", "n_words", "rep", "sha")
    mine = hits.where("hits is not null").groupBy(*row).agg(F.collect_list("hits").alias("hits"))
    cand = scratch.put(named.join(mine, row).select("doc_id", "text", "hits", "h"), "candidates")
    starts = cand.mapInArrow(_extend(window, block, bits, bits2), B.SCHEMA).groupBy("key").applyInArrow(_first, "doc_id bigint, h bigint, starts binary")
    starts = scratch.put(starts, "starts")
    cut = cand.select("doc_id", "text", "h").join(starts.groupBy(*row).agg(F.collect_list("starts").alias("starts")), row).select("doc_id", "text", "starts", "h")
    cut = cut.mapInArrow(_cut(window), "doc_id bigint, h bigint, n_removed bigint, kept_sha256 string, kept string")
    extra = ["kept"] if texts else []
    cut = cut.groupBy(*row).agg(*[F.first(c).alias(c) for c in ("n_removed", "kept_sha256", *extra)])
    copy = (F.col("rep") < F.col("doc_id")) & (F.col("n_words") >= window)
    out = base.join(cut.withColumnsRenamed({"n_removed": "r", "kept_sha256": "s"}), row, "left").select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("r", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copy, F.lit(_NIL)).otherwise(F.coalesce("s", F.lower(F.hex("sha")))).alias("kept_sha256"),
        *([F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept")] if texts else []),
    )
    lone = slim.where("doc_id is null").mapInArrow(_whole, "n_words bigint, kept_sha256 string").select(
        F.lit(None).cast("bigint").alias("doc_id"), "n_words", F.lit(0).cast("bigint").alias("n_removed"), "kept_sha256",
        *([F.lit(None).cast("string").alias("kept")] if texts else []),
    )
    return out.unionByName(lone)


def _whole(batches):
    for _, data, offs in W.slices(batches):
        raw = data.tobytes()
        lists = [raw[a:b].split() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in lists], pa.int64()), pa.array([_digest(x) for x in lists])], names=["n_words", "kept_sha256"])
