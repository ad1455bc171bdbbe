"""Validation of outputs: eight verdicts, seven named steps, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: tolerances and what counts as each codec
DURATION_SECS, SYNC_MS = 1.0, 100.0
VIDEO_CODECS, AUDIO_CODEC = ("av1", "av01"), "opus"
# fixed values: the names of the steps
STEPS = ("Video codec", "Bit depth", "Crop detection", "Video duration", "HDR/SDR status", "Audio tracks", "Audio/video sync")


def codec_ok(codec: Column) -> Column:
    low = F.lower(F.coalesce(codec, F.lit("")))
    return low.contains(VIDEO_CODECS[0]) | low.contains(VIDEO_CODECS[1])


def depth_of(by_mediainfo: Column, by_probe: Column) -> Column:
    """Known depth, MediaInfo first; 10 where neither tells."""
    return F.coalesce(by_mediainfo, by_probe, F.lit(10))


def _label(hdr: Column) -> Column:
    return F.when(hdr, F.lit("HDR")).otherwise(F.lit("SDR"))


def hdr_verdict(expected: Column, actual: Column, available: Column | None = None) -> Column:
    """struct(valid, actual, message, used) of expected against actual; nulls
    are unknown.  Where MediaInfo is missing the check passes, unused."""
    both = expected.isNotNull() & actual.isNotNull()
    message = (
        F.when(both & (expected == actual), F.concat(_label(actual), F.lit(" preserved")))
        .when(both, F.concat(F.lit("Expected "), _label(expected), F.lit(", found "), _label(actual)))
        .when(actual.isNotNull(), F.concat(F.lit("Output is "), _label(actual)))
        .when(expected.isNotNull(), F.concat(F.lit("Expected "), _label(expected), F.lit(", but could not detect HDR status")))
        .otherwise(F.lit("Could not detect HDR status"))
    )
    valid = F.coalesce(expected == actual, actual.isNotNull())
    found = F.struct(valid.alias("valid"), actual.alias("actual"), message.alias("message"), F.lit(True).alias("used"))
    if available is None:
        return found
    none = F.struct(F.lit(True).alias("valid"), F.lit(None).cast("boolean").alias("actual"), F.lit("MediaInfo not available, HDR check skipped").alias("message"), F.lit(False).alias("used"))
    return F.when(available, found).otherwise(none)


def codec_text(codec: Column, passed: Column) -> Column:
    c = F.coalesce(codec, F.lit(""))
    return F.when(passed, F.concat(F.lit("AV1 ("), c, F.lit(")"))).when(c != "", F.concat(F.lit("Expected AV1, got "), c)).otherwise(F.lit("Unknown codec"))


def depth_text(depth: Column, pixel_format: Column) -> Column:
    p = F.coalesce(pixel_format, F.lit(""))
    name = F.when(depth.isin(8, 10, 12), F.concat(depth.cast("string"), F.lit("-bit"))).otherwise(F.lit(""))
    return (
        F.when(depth.isNotNull() & (p != ""), F.concat(name, F.lit(" ("), p, F.lit(")"))).when(depth.isNotNull(), name)
        .when(p != "", F.concat(F.lit("Pixel format: "), p)).otherwise(F.lit("Unknown bit depth"))
    )


def _tenths(value: Column) -> Column:
    """One decimal, halves to even."""
    t = F.rint(value * 10).cast("bigint")
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def _size(w: Column, h: Column) -> Column:
    return F.concat_ws("x", w.cast("string"), h.cast("string"))


def crop_text(expected_w: Column, expected_h: Column, actual_w: Column, actual_h: Column) -> Column:
    got, want = _size(actual_w, actual_h), _size(expected_w, expected_h)
    same = (expected_w == actual_w) & (expected_h == actual_h)
    told = F.when(same, F.concat(F.lit("Dimensions match: "), got)).when(~same, F.concat(F.lit("Dimension mismatch: got "), got, F.lit(", expected "), want))
    return F.coalesce(told, F.lit("No crop validation required"))


def duration_text(expected: Column, actual: Column) -> Column:
    gap = F.abs(actual - expected)
    told = F.when(gap <= DURATION_SECS, F.concat(F.lit("Duration matches input ("), _tenths(actual), F.lit("s)"))).when(
        gap > DURATION_SECS, F.concat(F.lit("Duration mismatch: got "), _tenths(actual), F.lit("s, expected "), _tenths(expected), F.lit("s (diff: "), _tenths(gap), F.lit("s)"))
    )
    return F.coalesce(told, F.lit("Duration validation skipped"))


def audio_text(codecs: Column) -> Column:
    low, n = F.transform(codecs, lambda x: F.lower(x)), F.size(codecs)
    opus = F.forall(low, lambda x: x == AUDIO_CODEC)
    count = F.concat(n.cast("string"), F.lit(" audio tracks"))
    return (
        F.when(codecs.isNull(), F.lit("Failed to get audio info")).when(n == 0, F.lit("No audio tracks"))
        .when((n == 1) & opus, F.lit("Audio track is Opus")).when(n == 1, F.concat(F.lit("Audio track is "), F.try_element_at(low, F.lit(1)), F.lit(" (expected Opus)")))
        .when(opus, F.concat(count, F.lit(", all Opus"))).otherwise(F.concat(count, F.lit(": "), F.array_join(low, ", ")))
    )


def sync_text(expected: Column, actual: Column) -> Column:
    drift = F.abs(actual - expected) * 1000
    told = F.when(drift <= SYNC_MS, F.concat(F.lit("Audio/video sync preserved (drift: "), _tenths(drift), F.lit("ms)"))).when(
        drift > SYNC_MS, F.concat(F.lit("Audio/video sync drift too large: "), _tenths(drift), F.lit(f"ms (max: {SYNC_MS:.1f}ms)"))
    )
    return F.coalesce(told, F.lit("Sync validation skipped"))


def join_facts(sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row of facts per output: what its source makes one expect beside what
    the output is.  Both are keyed by file_id."""
    return outputs.join(sources, "file_id")


def validate(facts: DataFrame) -> DataFrame:
    """Verdicts from facts of output and source.

    Facts: file_id, codec, depth_mediainfo, depth_probe, expected_w/h,
    actual_w/h, expected_secs, actual_secs, expected_hdr, actual_hdr, codecs
    (array of audio codecs, null if the audio probe failed), expected_tracks.
    What was not checked passes.
    """
    c = F.col
    depth = depth_of(c("depth_mediainfo"), c("depth_probe"))
    gap = F.abs(c("actual_secs") - c("expected_secs"))
    hdr = hdr_verdict(c("expected_hdr"), c("actual_hdr"))
    return facts.select(
        "file_id", "codec",
        codec_ok(c("codec")).alias("is_av1"), (depth >= 10).alias("is_10bit"), depth.cast("bigint").alias("depth"),
        F.coalesce((c("expected_w") == c("actual_w")) & (c("expected_h") == c("actual_h")), F.lit(True)).alias("is_crop_correct"),
        F.coalesce(gap <= DURATION_SECS, F.lit(True)).alias("is_duration_correct"),
        hdr["valid"].alias("is_hdr_correct"),
        F.coalesce(F.forall("codecs", lambda x: F.lower(x) == AUDIO_CODEC), F.lit(True)).alias("is_audio_opus"),
        F.coalesce(F.size("codecs") == c("expected_tracks"), F.lit(True)).alias("is_track_count_correct"),
        F.coalesce(gap * 1000 <= SYNC_MS, F.lit(True)).alias("is_sync_preserved"),
        hdr["message"].alias("hdr_message"),
        F.array(
            codec_text(c("codec"), codec_ok(c("codec"))), depth_text(depth, c("pixel_format") if "pixel_format" in facts.columns else F.lit("")),
            crop_text(c("expected_w"), c("expected_h"), c("actual_w"), c("actual_h")), duration_text(c("expected_secs"), c("actual_secs")), hdr["message"],
            audio_text(c("codecs")), sync_text(c("expected_secs"), c("actual_secs")),
        ).alias("details"),
    )


_VERDICTS = ("is_av1", "is_10bit", "is_crop_correct", "is_duration_correct", "is_hdr_correct", "is_audio_opus", "is_track_count_correct", "is_sync_preserved")


def is_valid(results: DataFrame) -> DataFrame:
    out = F.lit(True)
    for v in _VERDICTS:
        out = out & F.col(v)
    return results.withColumn("is_valid", out)


def _steps(results: DataFrame) -> Column:
    """Array of the seven steps; the audio step joins two verdicts."""
    passed = [F.col("is_av1"), F.col("is_10bit"), F.col("is_crop_correct"), F.col("is_duration_correct"), F.col("is_hdr_correct"), F.col("is_audio_opus") & F.col("is_track_count_correct"), F.col("is_sync_preserved")]
    return F.array(*[F.struct(F.lit(i + 1).cast("bigint").alias("step"), F.lit(n).alias("name"), p.alias("passed"), F.col("details")[i].alias("details")) for i, (n, p) in enumerate(zip(STEPS, passed))])


def steps(results: DataFrame) -> DataFrame:
    """Seven rows per file: number, name, verdict and details."""
    return results.select("file_id", F.inline(_steps(results)))


def failures(results: DataFrame) -> DataFrame:
    """Files with failed steps, and these as ``name: details`` in order; a row's
    own steps tell, so there is no shuffle."""
    failed = F.filter(_steps(results), lambda s: ~s["passed"])
    texts = F.transform(failed, lambda s: F.concat(s["name"], F.lit(": "), s["details"]))
    return results.select("file_id", F.size(failed).cast("bigint").alias("n_failed"), F.array_join(texts, "; ").alias("failed")).where("n_failed > 0")
