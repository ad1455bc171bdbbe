"""Crop detection: sampled candidates, two majority votes, and dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# fixed values: sampling from 15 % to 85 % in half per cents; share needed
FIRST_SAMPLE, LAST_SAMPLE, SAMPLES_PER_UNIT = 30, 170, 200
NEEDED_SHARE = 0.8
_UINT32 = 2**32 - 1


def sample_points(videos: DataFrame) -> DataFrame:
    """(file_id, sample_id, position): 141 positions in seconds."""
    k = F.explode(F.sequence(F.lit(FIRST_SAMPLE), F.lit(LAST_SAMPLE))).alias("k")
    return videos.select("file_id", "duration_secs", k).select("file_id", (F.col("k") - FIRST_SAMPLE).cast("bigint").alias("sample_id"), (F.col("duration_secs") * F.col("k") / SAMPLES_PER_UNIT).alias("position"))


def candidates(lines: DataFrame) -> DataFrame:
    """First crop=w:h:x:y of each output line (file_id, sample_id, line)."""
    found = F.regexp_extract("line", r"crop=(\d+:\d+:\d+:\d+)", 1)
    return lines.select("file_id", "sample_id", found.alias("crop")).where("crop <> ''")


def part(crop: Column, i: int) -> Column:
    return F.try_element_at(F.split(crop, ":"), F.lit(i)).try_cast("bigint")


def is_valid(crop: Column) -> Column:
    """Exactly four unsigned 32-bit numbers."""
    shape = F.coalesce(crop.rlike(r"^\d+:\d+:\d+:\d+$"), F.lit(False))
    fits = [F.coalesce(part(crop, i) <= _UINT32, F.lit(False)) for i in range(1, 5)]
    return shape & fits[0] & fits[1] & fits[2] & fits[3]


def is_effective(crop: Column, width: Column, height: Column) -> Column:
    """Whether width or height changes; what cannot be read counts as a change."""
    w, h = part(crop, 1), part(crop, 2)
    return F.when(w.isNull() | h.isNull(), F.lit(True)).otherwise((w != width) | (h != height))


def sample_mode(found: DataFrame) -> DataFrame:
    """The commonest crop of each sample; ties to the least text."""
    counts = found.groupBy("file_id", "sample_id", "crop").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("crop")))
    return counts.groupBy("file_id", "sample_id").agg(best["crop"].alias("crop"), (-best["less"]).alias("n"))


def vote(samples: DataFrame) -> DataFrame:
    """Per file the leading crop, its share of samples with a crop, and whether
    it wins: alone, or with a share above 0.8."""
    counts = samples.where(F.coalesce("crop", F.lit("")) != "").groupBy("file_id", "crop").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("crop")))
    per = counts.groupBy("file_id").agg(F.count("*").alias("n_values"), F.sum("n").alias("n_samples"), best.alias("best"))
    top = -F.col("best.less")
    wins = (F.col("n_values") == 1) | (top.cast("double") / F.col("n_samples") > NEEDED_SHARE)
    return per.select("file_id", "n_values", "n_samples", F.col("best.crop").alias("crop"), top.alias("n_top"), (top.cast("double") / F.col("n_samples")).alias("share"), wins.alias("wins"))


def dimensions(votes: DataFrame) -> DataFrame:
    """What a crop makes of width x height: the output size that is expected
    (w, h of the crop) and the one encoded (borders x, y on both sides)."""
    c, w, h = F.col("crop"), F.col("width"), F.col("height")
    x, y = F.coalesce(part(c, 3), F.lit(0)), F.coalesce(part(c, 4), F.lit(0))
    known = part(c, 3).isNotNull() & part(c, 4).isNotNull()
    x, y = F.when(known, x).otherwise(F.lit(0)), F.when(known, y).otherwise(F.lit(0))
    sized = part(c, 1).isNotNull() & part(c, 2).isNotNull()
    return votes.select(
        "file_id", c, is_valid(c).alias("valid"), is_effective(c, w, h).alias("effective"), x.alias("crop_h"), y.alias("crop_v"),
        F.when(sized, part(c, 1)).otherwise(w).alias("expected_w"), F.when(sized, part(c, 2)).otherwise(h).alias("expected_h"),
        (w - 2 * x).alias("encoded_w"), (h - 2 * y).alias("encoded_h"),
    )
