"""Progress: running counters, monotone and bucketed emission, speed, ETA."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import ratio_percent

#: fixed values: log every so many per cent, the highest bucket, and the types
#: of event that the library's handler gets
BUCKET_PERCENT, LAST_BUCKET = 5, 20
PUBLIC_TYPES = ("encoding_progress", "validation_complete", "encoding_complete", "warning", "error", "batch_complete")


def running(events: DataFrame) -> DataFrame:
    """Frames so far and per cent of the total, per file in order of ord."""
    so_far = Window.partitionBy("file_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("frames").over(Window.partitionBy("file_id"))
    out = events.withColumn("frames_complete", F.sum("frames").over(so_far)).withColumn("frames_total", total)
    return out.withColumn("percent", ratio_percent(F.col("frames_complete"), F.col("frames_total")))


def monotone(shown: DataFrame) -> DataFrame:
    """Rows whose per cent, held to 0..100, is not below any before."""
    before = Window.partitionBy("file_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    held = shown.withColumn("percent", F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("percent"))))
    return held.withColumn("_top", F.max("percent").over(before)).where("_top is null or percent >= _top").drop("_top")


def bucketed(shown: DataFrame) -> DataFrame:
    """First row of each new five-per-cent bucket; bucket 0 is never shown."""
    before = Window.partitionBy("file_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    b = shown.withColumn("bucket", F.least(F.floor(F.col("percent") / BUCKET_PERCENT), F.lit(LAST_BUCKET)).cast("bigint"))
    return b.withColumn("_top", F.coalesce(F.max("bucket").over(before), F.lit(0))).where("bucket > _top").drop("_top")


def speed_and_eta(frames: Column, total: Column, fps: Column, elapsed: Column) -> Column:
    """struct(speed, eta_secs): times real time, and whole seconds left; both 0
    until a frame is done in measurable time."""
    ok = (elapsed > 0) & (frames > 0) & (fps > 0)
    speed = F.when(ok, frames / F.when(fps > 0, fps) / F.when(elapsed > 0, elapsed))
    eta = F.when(speed > 0, F.floor((total - frames) / F.when(fps > 0, fps) / speed))
    return F.struct(F.coalesce(speed, F.lit(0.0)).alias("speed"), F.coalesce(eta, F.lit(0)).cast("bigint").alias("eta_secs"))


def project_public(events: DataFrame) -> DataFrame:
    """Events of the types that a handler receives, payload by type."""
    t = F.col("type")
    return events.where(t.isin(*PUBLIC_TYPES)).select(
        "ord", "file_id", t,
        F.when(t == "encoding_progress", F.col("percent")).alias("percent"),
        F.when(t.isin("warning", "error"), F.col("message")).alias("message"),
        F.when(t == "validation_complete", F.col("passed")).alias("passed"),
        F.when(t.isin("encoding_complete", "batch_complete"), F.col("size")).alias("size"),
    )
