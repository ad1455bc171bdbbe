"""Mixing sources to target weights by Sainte-Lague apportionment.

DataFrame functions only.  Word counts are written once; all else works on
that narrow table and on small aggregates of it.

1. Targets: each source's share of all words by weight, at most ``cap`` times
   its size; what is above is shared again by weight.  The fixed point is
   min(cap * size, level * weight) with one level for all, found by a running
   sum over sources in the order of cap * size / weight.
2. Blocks of ``block`` words go to sources by the highest quotients
   target / (2 * seats + 1).  Seats lie near target / block, so only quotients
   around that are listed and ranked: a few rows per source.
3. In the same way each source's blocks go to its shards by their sizes.
4. A shard's words, with documents in a seeded order, form a row of blocks.  It
   gives whole passes, then the first blocks of that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .store import Scratch

WORD = r"[^\x20\x09-\x0D]+"


def _seats(shares: DataFrame, within: list[str], seats: Column, share: str, order: list[Column]) -> DataFrame:
    """Highest-quotient seats per row of ``shares``; ``seats`` to give in each
    group of ``within``.  Equal quotients go by ``order``."""
    group = W.partitionBy(*within)
    base = (
        shares.withColumn("_all", F.sum(share).over(group)).withColumn("_n", F.count("*").over(group)).withColumn("_seats", seats)
        .withColumn("_q", F.when(F.col("_all") > 0, F.col(share) / F.col("_all") * F.col("_seats")).otherwise(F.lit(0.0)))
        # seats differ from the fair share by at most this much
        .withColumn("_m", F.ceil(F.when(F.col("_seats") > 0, F.col("_q") * F.col("_n") / (2 * F.col("_seats"))).otherwise(F.lit(0.0))) + 2)
        .withColumn("_lo", F.greatest(F.lit(0).cast("bigint"), F.floor(F.col("_q")) - F.col("_m")))
    )
    tried = base.withColumn("_k", F.explode(F.sequence(F.col("_lo"), F.floor(F.col("_q")) + F.col("_m"))))
    tried = tried.withColumn("_quot", F.col(share) / (2 * F.col("_k") + 1))
    left = F.col("_seats") - F.sum(F.when(F.col("_k") == F.col("_lo"), F.col("_lo")).otherwise(0)).over(group)
    ranked = tried.withColumn("_left", left).withColumn("_r", F.row_number().over(group.orderBy(F.col("_quot").desc(), *order, F.col("_k"))))
    keys = shares.columns
    return ranked.groupBy(*keys).agg(
        (F.min("_lo") + F.sum(F.when((F.col("_r") <= F.col("_left")) & (F.col(share) > 0), 1).otherwise(0))).cast("bigint").alias("seats")
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    cap: int = 3,
    block: int = 256,
    shard_docs: int = 2000,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    scratch: Scratch | None = None,
) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) for each input row.

    Sources are taken by code point, null last, and weigh ``weights`` in turn.
    size is the number of words; null and wordless texts have 0, and take 0.
    Null sources form one source.  Repeated rows are rows of their own; null
    ids are ordered like any other.  An empty table, or one without words,
    gives targets of 0.  Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mixing")
    sized = scratch.put(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary")).alias("dice"),
        ),
        "sized",
    )
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    # one row per source; every window below runs over such aggregates
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (rank % len(weights) + 1).cast("int"))
    w = sources.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    by = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(W.unboundedPreceding, -1)
    after = by.rowsBetween(W.currentRow, W.unboundedFollowing)
    w = (
        w.withColumn("total", F.sum("source_size").over(W.partitionBy()))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("heft", F.sum("weight").over(after))
        # the first source whose share under this level is not above its most
        .withColumn("fits", wide("rest") * wide("weight") <= wide("most") * wide("heft"))
    )
    first = F.min(F.when(F.col("fits"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), "source", "rest", "heft"))).over(W.partitionBy())
    w = w.withColumn("level", first).withColumn(
        "target",
        F.when(F.col("total") == 0, F.lit(0.0)).otherwise(
            F.least(F.col("most").cast("double"), (F.col("level.rest").cast("decimal(19,0)") * wide("weight")).cast("double") / F.col("level.heft").cast("double"))
        ),
    )
    quota = _seats(
        w.select("source", "source_size", "n_docs", "target", (F.floor(F.col("total") / block + F.lit(0.5))).alias("blocks")),
        [], F.col("blocks"), "target", [F.col("source").asc_nulls_last()],
    ).withColumn("n_shards", F.ceil(F.col("n_docs") / shard_docs).cast("bigint")).withColumnRenamed("seats", "source_seats")
    quota = scratch.put(quota, "quota")
    shard = F.pmod(F.conv(F.substring("dice", 1, 8), 16, 10).cast("bigint"), F.col("n_shards"))
    placed = (
        sized.alias("d").join(quota.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")))
        .select("doc_id", F.col("d.source").alias("source"), "size", "dice", "source_size", "target", "n_shards", "source_seats")
        .withColumn("shard", shard)
    )
    shards = placed.groupBy("source", "shard", "source_seats").agg(F.sum("size").alias("shard_size"))
    shards = _seats(shards, ["source"], F.col("source_seats"), "shard_size", [F.col("shard")])
    shards = scratch.put(shards.select("source", "shard", "shard_size", F.least(F.col("seats") * block, cap * F.col("shard_size")).alias("words")), "shards")
    row = W.partitionBy("source", "shard").orderBy("dice", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    end = (
        placed.alias("d").join(shards.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.shard") == F.col("s.shard")))
        .select("doc_id", "size", F.col("d.source").alias("source"), F.col("d.shard").alias("shard"), "dice", "source_size", "target", "shard_size", "words")
        .withColumn("start", F.coalesce(F.sum("size").over(row), F.lit(0)))
    )
    per = F.when(F.col("shard_size") > 0, F.col("shard_size")).otherwise(F.lit(1))
    whole = F.floor(F.col("words") / per)
    rest = F.col("words") - whole * per
    taken = whole * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("start")))
    return end.select("doc_id", "size", "source", "source_size", "target", taken.cast("bigint").alias("taken"))
