"""Quality rules with adaptive thresholds.

Every text is measured once (vectorised over slices).  Measures go into
mergeable quantile sketches: counts in geometric bins, so merging is a sum and
results do not depend on how the data are dealt.  Sketches are kept per
(language, source), language, and all, which are merges of the same counts.  A
group's quartiles are drawn toward those of its language, and these toward those
of all, with the weight of ``prior`` documents, so that groups of any size are
treated alike.  A measure's threshold is its upper quartile plus a multiple of the interquartile range, at
least a margin above the quartile; the thresholds are joined back and a text
beyond any of them is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import words as W
from .store import Scratch

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

#: measure -> (least margin above the upper quartile)
MARGINS = {"symbols_per_word": 0.15, "dup_lines": 0.35, "repeat_words": 0.15, "chars_per_word": 1.0, "upper_share": 0.10}
#: relative width of a sketch's bins and the smallest value told from 0
GAMMA, LEAST = 1.02, 1e-4

_SCHEMA = "doc_id bigint, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_lines bigint, n_upper bigint, n_repeat_words bigint"


def _per_doc(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def measure(data: np.ndarray, offs: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """Word, symbol, line and repetition counts of each text of a slice."""
    s, e, woffs = W.spans(data, offs)
    n_docs = len(offs) - 1
    n_words = np.diff(woffs)
    sums = W.prefix(data)
    word = ~W.IS_SPACE[data]
    out = {
        "n_words": n_words,
        "word_chars": _per_doc(word & ((data & 0xC0) != 0x80), offs),
        "n_symbols": _per_doc(SYMBOL[data], offs),
        "n_upper": _per_doc((data >= 65) & (data <= 90), offs),
    }
    # lines: cut at \n and at text ends; only those with a word count
    cuts = np.flatnonzero(data == 10)
    ls = np.unique(np.concatenate([offs[:-1], cuts + 1]))
    ls = ls[ls < offs[-1]]
    le = np.minimum(np.append(ls[1:], offs[-1]), offs[np.searchsorted(offs, ls, "right")])
    le = np.where((le > ls) & (data[np.maximum(le - 1, 0)] == 10), le - 1, le)
    wc = np.zeros(len(data) + 1, np.int64)
    np.cumsum(word, out=wc[1:])
    full = wc[le] > wc[ls]
    ls, le = ls[full], le[full]
    ldoc = np.searchsorted(offs, ls, "right") - 1
    out["n_lines"] = np.bincount(ldoc, minlength=n_docs)
    again = _repeats(W.between(sums, ls, le), ldoc)[1]
    out["n_dup_lines"] = np.bincount(ldoc[again], minlength=n_docs)
    # words in windows that occur twice or more, the first time included
    words = W.between(sums, s, e)
    h = W.window_hashes(words, window)
    doc = W.doc_of(woffs)
    ok = np.flatnonzero(doc[: len(h)] == doc[window - 1 :]) if len(h) else np.zeros(0, np.int64)
    twice = ok[_repeats(h[ok], doc[ok])[0]]
    mark = np.zeros(len(words) + 1, np.int32)
    np.add.at(mark, twice, 1)
    np.add.at(mark, twice + window, -1)
    out["n_repeat_words"] = _per_doc(np.cumsum(mark[:-1]) > 0, woffs)
    return out


def _repeats(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs again or before, occurred before) within the same document."""
    both, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    order = np.argsort(h, kind="stable")
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    later[order[1:][same]] = True
    both |= later
    both[order[:-1][same]] = True
    return both, later


def _measures(window: int):
    def run(batches):
        for part, data, offs in W.slices(batches, 3):
            m = measure(data, offs, window)
            cols = [part.column(0), part.column(1), part.column(2)]
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper", "n_repeat_words"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(m[k].astype(np.int64)) for k in names], names=["doc_id", "lang", "source", *names])

    return run


def _bin(value: Column) -> Column:
    return F.when(value < LEAST, F.lit(-1)).otherwise(F.ceil(F.log(value / LEAST) / F.log(F.lit(GAMMA)))).cast("int")


def _value(b: Column) -> Column:
    """Upper edge of a bin."""
    return F.when(b < 0, F.lit(0.0)).otherwise(F.lit(LEAST) * F.pow(F.lit(GAMMA), b))


def _quartiles(bins: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, q1, q3, n) from bin counts: a pass over sketches only."""
    keys = [*keys, "measure"]
    up = Window.partitionBy(*keys).orderBy("bin")
    c = bins.groupBy(*keys, "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(up)).withColumn("n_docs", F.sum("n").over(Window.partitionBy(*keys)))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("n_docs") * q, F.col("bin")))
    return c.groupBy(*keys).agg(_value(at(1)).alias("q1"), _value(at(3)).alias("q3"), F.max("n_docs").alias("n_docs"))


def quality_rules(
    docs: DataFrame,
    spread: float = 4.0,
    prior: float = 100.0,
    window: int = 5,
    min_words: int = 10,
    max_repeat: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    scratch: Scratch | None = None,
) -> DataFrame:
    """Measures and verdicts, one row per input row.

    base_failed: fewer than ``min_words`` words, or over ``max_repeat`` per
    cent of words in repeated windows.  kept: not base_failed and no measure
    beyond its group's threshold.  Null and wordless texts have zero counts and
    fail the base rule.  Null languages and sources are groups of their own;
    null and repeated ids pass through.  Other columns are ignored; an empty
    table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "rules")
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    m = scratch.put(slim.mapInArrow(_measures(window), _SCHEMA), "measures")
    words = F.greatest(F.col("n_words"), F.lit(1))
    m = m.withColumns({
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_words": F.col("n_repeat_words") / words,
        "chars_per_word": F.col("word_chars") / words,
        "upper_share": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "base_failed": (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")),
    })
    names = list(MARGINS)
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), _bin(F.col(k)).alias("bin")) for k in names]))
    bins = m.select("lang", "source", pairs.alias("p")).select("lang", "source", "p.*").groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n"))
    bins = scratch.put(bins, "sketches")
    own = _quartiles(bins, ["lang", "source"])
    toward = lambda q, to: (F.col("n_docs") * F.col(q) + prior * F.col(to)) / (F.col("n_docs") + prior)
    every = _quartiles(bins, []).select(F.col("measure").alias("am"), F.col("q1").alias("a1"), F.col("q3").alias("a3"))
    lang = _quartiles(bins, ["lang"]).join(every, F.col("measure") == F.col("am"))
    lang = lang.select(F.col("lang").alias("l"), F.col("measure").alias("lm"), toward("q1", "a1").alias("l1"), toward("q3", "a3").alias("l3"))
    best = own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("lm"))).select(
        "lang", "source", "measure", F.struct(toward("q1", "l1").alias("q1"), toward("q3", "l3").alias("q3")).alias("s")
    )
    margin = F.element_at(F.create_map(*[x for k, v in MARGINS.items() for x in (F.lit(k), F.lit(v))]), F.col("measure"))
    limit = F.col("s.q3") + F.greatest(F.lit(spread) * (F.col("s.q3") - F.col("s.q1")), margin)
    limits = scratch.put(best.groupBy("lang", "source").pivot("measure", names).agg(F.first(limit)).select(F.col("lang").alias("tl"), F.col("source").alias("ts"), *[F.col(k).alias(f"max_{k}") for k in names]), "limits")
    beyond = F.lit(False)
    for k in names:
        beyond = beyond | (F.col(k) > F.col(f"max_{k}"))
    return (
        m.join(limits, F.col("lang").eqNullSafe(F.col("tl")) & F.col("source").eqNullSafe(F.col("ts")), "left")
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            (~F.col("base_failed") & ~F.coalesce(beyond, F.lit(False))).alias("kept"), "lang", "source",
            *[F.col(f"max_{k}") for k in names],
        )
    )
