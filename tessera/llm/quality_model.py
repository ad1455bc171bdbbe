"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage is encoded
from its character classes, its words and how much of it repeats within the
document; a gated attention weighs the encodings, and the weighted sum is
scored.  Attention and encoder are learned together from document labels, as in
Ilse et al., "Attention-based Deep Multiple Instance Learning" (2018).

Fitting takes at most ``max_train`` labelled documents, those of least id hash,
and of each at most ``max_passages`` passages, evenly spaced, encoded on the
executors: a bounded sample.  Scoring takes every passage, in one pass over all
texts without a shuffle.  Labels, language, source and id are no inputs.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import words as W
from ..session import ship

PASSAGE = 64
WORD_BUCKETS = 32

_CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "line": [10], "stop": b".", "comma": b",",
    "shout": b"!?", "symbol": b"#*$%&<>", "bar": b"|", "quote": b"\"'()[]{}", "other": b"-_/\\:;=+@~^`", "high": range(128, 256),
}
_LUT = np.full(256, len(_CLASSES), np.uint8)
for _k, _v in enumerate(_CLASSES.values()):
    _LUT[list(_v)] = _k
N_FEATURES = len(_CLASSES) + 6 + WORD_BUCKETS


def passages(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, offsets): one row per passage, at least one per document."""
    s, e, woffs = W.spans(data, offs)
    n_docs, count = len(offs) - 1, np.diff(woffs)
    n_pass = np.maximum(1, -(-count // PASSAGE))
    poffs = np.zeros(n_docs + 1, np.int64)
    np.cumsum(n_pass, out=poffs[1:])
    owner = W.doc_of(poffs)
    first = woffs[owner] + (np.arange(poffs[-1]) - poffs[owner]) * PASSAGE
    last = np.minimum(first + PASSAGE, woffs[owner + 1])
    n_words = (last - first).astype(np.float64)
    has = n_words > 0
    sums = W.prefix(data)
    words = W.between(sums, s, e)
    out = np.zeros((len(owner), N_FEATURES), np.float32)
    a, b = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
    a[has], b[has] = s[first[has]], e[last[has] - 1]
    size = np.maximum(b - a, 1)
    kind = _LUT[data]
    c = np.zeros(len(data) + 1, np.int32)
    for k in range(len(_CLASSES)):
        np.cumsum(kind == k, out=c[1:])
        out[:, k] = (c[b] - c[a]) / size
    k = len(_CLASSES)

    def share(flags: np.ndarray) -> np.ndarray:
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return (c[last] - c[first]) / np.maximum(n_words, 1)

    doc = W.doc_of(woffs)
    order = np.argsort(words, kind="stable")
    seen = np.zeros(len(words), bool)
    seen[order[1:]] = (words[order][1:] == words[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    again = np.zeros(len(words) + 1, np.int32)
    h = W.window_hashes(words, 5)
    ok = np.flatnonzero(doc[: len(h)] == doc[4:]) if len(h) else np.zeros(0, np.int64)
    o = ok[np.argsort(h[ok], kind="stable")]
    twice = o[1:][(h[o][1:] == h[o][:-1]) & (doc[o][1:] == doc[o][:-1])]
    np.add.at(again, twice, 1)
    np.add.at(again, twice + 5, -1)
    out[:, k] = share(seen)
    out[:, k + 1] = share(np.cumsum(again[:-1]) > 0)
    out[:, k + 2] = share(e - s) / 10
    out[:, k + 3] = share(_LUT[data[s]] == 1) if len(s) else 0
    out[:, k + 4] = np.log1p(n_words) / 5
    out[:, k + 5] = np.log1p(count[owner]) / 10
    which = np.repeat(np.arange(len(owner)), (last - first)) * WORD_BUCKETS + (words >> np.uint64(59)).astype(np.int64)
    hist = np.bincount(which, minlength=len(owner) * WORD_BUCKETS).reshape(len(owner), WORD_BUCKETS)
    out[:, k + 6 :] = hist / np.maximum(n_words, 1)[:, None]
    return out, poffs


class GatedAttention:
    """h = tanh(xE + e); a = softmax(v . (tanh(hV) * sigmoid(hU))); score =
    sigmoid(c . sum(a h) + b).  Trained by Adam on whole bags."""

    def __init__(self, n_in: int, hidden: int = 24, attend: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        init = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float64)
        self.p = {"E": init(n_in, hidden), "e": np.zeros(hidden), "V": init(hidden, attend), "U": init(hidden, attend), "v": init(attend, 1)[:, 0], "c": init(hidden, 1)[:, 0], "b": np.zeros(1)}
        self.mean, self.std = np.zeros(n_in), np.ones(n_in)

    @staticmethod
    def _sig(x):
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    def _forward(self, x: np.ndarray, offs: np.ndarray):
        p, start = self.p, offs[:-1]
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), self._sig(h @ p["U"])
        s = (t * g) @ p["v"]
        who = np.repeat(np.arange(len(start)), np.diff(offs))
        s = np.exp(s - np.maximum.reduceat(s, start)[who])
        a = s / np.add.reduceat(s, start)[who]
        z = np.add.reduceat(a[:, None] * h, start, axis=0)
        return h, t, g, who, a, z, self._sig(z @ p["c"] + p["b"][0])

    def score(self, x: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return self._forward((x - self.mean) / self.std, offs)[-1]

    def fit(self, x: np.ndarray, offs: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> "GatedAttention":
        if len(y) == 0:
            return self
        self.mean, self.std = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.std
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        q = {k: np.zeros_like(v) for k, v in self.p.items()}
        rng, step = np.random.default_rng(seed), 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
                size = np.diff(offs)[part]
                o = np.concatenate([[0], np.cumsum(size)])
                rows = np.repeat(offs[part] - o[:-1], size) + np.arange(o[-1])
                grad = self._grad(x[rows], o, y[part])
                step += 1
                for k, g in grad.items():
                    g = g + decay * self.p[k]
                    m[k] += 0.1 * (g - m[k])
                    q[k] += 0.01 * (g * g - q[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def _grad(self, x, offs, y) -> dict[str, np.ndarray]:
        p = self.p
        h, t, g, who, a, z, out = self._forward(x, offs)
        d = (out - y) / len(y)
        dz = d[:, None] * p["c"]
        dh = a[:, None] * dz[who]
        da = (h * dz[who]).sum(1)
        ds = a * (da - np.add.reduceat(a * da, offs[:-1])[who])
        dt, dg = ds[:, None] * p["v"] * g * (1 - t * t), ds[:, None] * p["v"] * t * g * (1 - g)
        dh = (dh + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "v": (t * g).T @ ds, "c": z.T @ d, "b": np.array([d.sum()])}


def _encode(most: int):
    def run(batches):
        for part, data, offs in W.slices(batches):
            x, poffs = passages(data, offs)
            bags = [x[a:b][np.unique(np.linspace(0, b - a - 1, min(most, b - a)).astype(int))].tobytes() for a, b in zip(poffs[:-1], poffs[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(bags, pa.binary())], names=["doc_id", "label", "bag"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_train: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_passages: int = 64) -> GatedAttention:
    """Fit on at most ``max_train`` labelled documents outside the held-out fold,
    and ``max_passages`` passages of each; of rows that share an id one counts."""
    ship(docs.sparkSession)
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    marks = marks.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = marks.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(max_train)
    rows = (
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "text", "label").mapInArrow(_encode(max_passages), "doc_id bigint, label int, bag binary")
        .groupBy("doc_id").agg(F.max("label").alias("label"), F.min("bag").alias("bag")).collect()
    )
    rows.sort(key=lambda r: (r.label, zlib.crc32(bytes(r.bag)), bytes(r.bag)))  # the order of tasks does not matter
    if not rows:
        return GatedAttention(N_FEATURES)
    bags = [np.frombuffer(r.bag, np.float32).reshape(-1, N_FEATURES) for r in rows]
    offs = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return GatedAttention(N_FEATURES).fit(np.concatenate(bags).astype(np.float64), offs, np.array([r.label for r in rows], np.float64))


def _score(model: GatedAttention):
    def run(batches):
        for part, data, offs in W.slices(batches):
            x, poffs = passages(data, offs)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(x, poffs), pa.float64())], names=["doc_id", "score"])

    return run


def quality_model(docs: DataFrame, labels: DataFrame, cut: float = 0.7, max_train: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", model: GatedAttention | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row.

    Null, empty and wordless texts are a bag of one empty passage and get that
    bag's score.  Rows with a null id are scored, with held_out false.  Labels
    with a null id or label are left out; of repeated labels the highest
    counts; without labels the untrained model scores.  Very long texts are
    scored whole.  Other columns are ignored.
    """
    model = model or train(docs, labels, max_train, id_col, text_col, label_col)
    ship(docs.sparkSession)
    scored = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_score(model), "doc_id bigint, score double")
    return scored.select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )


def _keep(model: GatedAttention):
    def run(batches):
        for part, data, offs in W.slices(batches):
            x, poffs = passages(data, offs)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(model.score(x, poffs), pa.float64())], names=["row", "text", "score"])

    return run


def quality_filter(docs: DataFrame, labels: DataFrame, cut: float = 0.7, max_train: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", model: GatedAttention | None = None) -> DataFrame:
    """Rows of ``docs`` whose text scores ``cut`` or more, all columns kept.

    Scores as ``quality_model`` does, without a shuffle: the row travels beside
    its score, so null and repeated ids need no care.
    """
    model = model or train(docs, labels, max_train, id_col, text_col, label_col)
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c != text_col]
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(text_col).alias("text"))
    schema = T.StructType([source.schema["row"], T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType())])
    kept = source.mapInArrow(_keep(model), schema).where(F.col("score") >= cut)
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
