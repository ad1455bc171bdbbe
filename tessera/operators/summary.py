"""Summaries of a batch of encoded files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import size_reduction


def reductions(files: DataFrame) -> DataFrame:
    return files.select("file_id", "in_size", "out_size", size_reduction(F.col("in_size"), F.col("out_size")).alias("reduction"))


def batch_summary(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, sums, and ratios of sums of results: file_id, secs, in_size,
    out_size, video_secs, passed.  The message depends on how many there are."""
    n = F.count("*")
    message = F.when(n == 0, F.lit("No files were successfully encoded")).when(n == 1, F.concat(F.lit("Successfully encoded "), F.min("filename"))).otherwise(F.lit(None))
    return results.groupBy(*(by or [])).agg(
        n.alias("n_files"), F.sum("in_size").alias("total_in"), F.sum("out_size").alias("total_out"), F.sum("secs").alias("total_secs"),
        size_reduction(F.coalesce(F.sum("in_size"), F.lit(0)), F.coalesce(F.sum("out_size"), F.lit(0))).alias("reduction"),
        F.when(F.sum("secs") > 0, F.sum("video_secs") / F.sum("secs")).otherwise(F.lit(0.0)).alias("avg_speed"),
        F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed"), message.alias("message"),
    )


def outcome_events(results: DataFrame, batches: DataFrame) -> DataFrame:
    """Events of each batch (column batch, also of those without results), in
    order (turn): for each result its validation and its end, by file_id, then
    what is told of the batch: a warning without results, the one file's name,
    or sums.

    Results: batch, file_id, filename, passed, in_size, out_size.
    """
    c, null = F.col, lambda t: F.lit(None).cast(t)
    saved = size_reduction(c("in_size"), c("out_size"))

    def event(kind, turn, passed=null("boolean"), size=null("bigint"), reduction=null("double"), message=null("string"), n=null("bigint")):
        return F.struct(
            F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), turn.cast("bigint").alias("turn"), passed.alias("passed"),
            size.alias("size"), reduction.alias("reduction"), message.alias("message"), n.alias("n_files"),
        )

    per_file = results.select("batch", "file_id", F.inline(F.array(
        event("validation_complete", F.lit(1), passed=c("passed")),
        event("encoding_complete", F.lit(2), size=c("out_size"), reduction=saved, message=c("filename")),
    )))
    sums = results.groupBy("batch").agg(F.count("*").alias("n"), F.sum("in_size").alias("i"), F.sum("out_size").alias("o"), F.min("filename").alias("one"))
    n = F.coalesce("n", F.lit(0))
    kind = F.when(n == 0, F.lit("warning")).when(n == 1, F.lit("operation_complete")).otherwise(F.lit("batch_complete"))
    message = F.when(n == 0, F.lit("No files were successfully encoded")).when(n == 1, F.concat(F.lit("Successfully encoded "), c("one")))
    end = event(kind, F.lit(3), size=F.when(n > 1, c("o")), reduction=F.when(n > 1, size_reduction(c("i"), c("o"))), message=message, n=n.cast("bigint"))
    per_batch = batches.select("batch").distinct().join(sums, "batch", "left").select("batch", F.lit(None).cast("bigint").alias("file_id"), F.inline(F.array(end)))
    return per_file.unionByName(per_batch)
