"""Argument lists of the steps around encoding: audio extraction, joining of
chunks, and the final container.  Arrays of strings; nothing is run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.classify import opus_kbps

# fixed values: names within a work folder, and options of each step
AUDIO_NAME, VIDEO_NAME, LIST_NAME = "audio.mka", "video.mkv", "concat.txt"
QUIET = ("-hide_banner",)
AUDIO_LAYOUTS = "aformat=channel_layouts=7.1|5.1|stereo|mono"
JOIN_BEFORE = ("-f", "concat", "-safe", "0", "-i")
JOIN_AFTER = ("-fflags", "+genpts+igndts+discardcorrupt+bitexact", "-avoid_negative_ts", "make_zero", "-reset_timestamps", "1", "-start_at_zero", "-y")
NO_RATE, NO_FILES = "invalid video info: FPS denominator is 0", "no IVF files found in "


def _list(*items) -> Column:
    return F.array(*[x if isinstance(x, Column) else F.lit(x) for x in items])


def _in(folder: Column, name: str) -> Column:
    return F.concat(folder, F.lit("/" + name))


def audio_arguments(source: Column, folder: Column, streams: Column) -> Column:
    """Arguments that extract all audio to Opus; null without streams (structs
    with idx and channels, in order)."""

    def one(s: Column, i: Column) -> Column:
        n = i.cast("string")
        return _list(
            "-map", F.concat(F.lit("0:a:"), s["idx"].cast("string")), F.concat(F.lit("-c:a:"), n), "libopus",
            F.concat(F.lit("-b:a:"), n), F.concat(opus_kbps(s["channels"]).cast("string"), F.lit("k")), F.concat(F.lit("-filter:a:"), n), AUDIO_LAYOUTS,
        )

    head = _list(*QUIET, "-i", source, "-vn", "-map_metadata", "0")
    return F.when(F.size(streams) > 0, F.concat(head, F.flatten(F.transform(streams, one)), _list("-y", _in(folder, AUDIO_NAME))))


def mux_arguments(source: Column, folder: Column, output: Column, has_audio: Column) -> Column:
    """Arguments of the final container: encoded video, audio if there is any,
    subtitles and chapters of the source, which is the last input."""
    last = F.when(has_audio, F.lit("2")).otherwise(F.lit("1"))
    none = F.array().cast("array<string>")
    return F.concat(
        _list(*QUIET, "-i", _in(folder, VIDEO_NAME)), F.when(has_audio, _list("-i", _in(folder, AUDIO_NAME))).otherwise(none),
        _list("-i", source, "-map", "0:v:0"), F.when(has_audio, _list("-map", "1:a?")).otherwise(none),
        _list("-map", F.concat(last, F.lit(":s?")), "-c", "copy", "-map_metadata", "0", "-map_chapters", last, "-movflags", "+faststart", "-y", output),
    )


def join_arguments(folder: Column, fps_num: Column, fps_den: Column) -> Column:
    """Arguments that join a work folder's chunks by its list file."""
    rate = F.format_string("%.6f", fps_num.cast("double") / F.when(fps_den != 0, fps_den).cast("double"))
    return _list(*QUIET, *JOIN_BEFORE, _in(folder, LIST_NAME), "-c", "copy", "-r", rate, *JOIN_AFTER, _in(folder, VIDEO_NAME))


def plan_joins(videos: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, n_files, args, error) of each video (file_id, folder, fps_num,
    fps_den) and its chunk files (file_id, idx); args are null where there is an
    error: a zero frame rate denominator first, then no files."""
    n = files.groupBy("file_id").agg(F.count("*").alias("n"))
    v = videos.join(n, "file_id", "left").withColumn("n_files", F.coalesce("n", F.lit(0)).cast("bigint"))
    error = F.when(F.col("fps_den") == 0, F.lit(NO_RATE)).when(F.col("n_files") == 0, F.concat(F.lit(NO_FILES), F.col("folder"), F.lit("/encode")))
    return v.select("file_id", "n_files", F.when(error.isNull(), join_arguments(F.col("folder"), F.col("fps_num"), F.col("fps_den"))).alias("args"), error.alias("error"))
