"""Formatting and parsing of sizes, durations, settings and audio lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .classify import opus_kbps

KIB, MIB, GIB = 1024, 1024**2, 1024**3
#: fixed values: what a negative or undefined duration shows
UNKNOWN_TIME = "??:??:??"


def ratio_percent(part: Column, whole: Column) -> Column:
    """part / whole * 100, 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / F.when(whole == 0, F.lit(1)).otherwise(whole).cast("double") * 100)


def size_reduction(before: Column, after: Column) -> Column:
    """Percentage saved; negative if the output grew."""
    return ratio_percent(before - after, before)


def clock(seconds: Column) -> Column:
    """HH:MM:SS, truncated; hours may pass 24."""
    whole = F.floor(F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0), F.lit(0.0)).otherwise(seconds)).cast("bigint")
    text = F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60)
    return F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0), F.lit(UNKNOWN_TIME)).otherwise(text)


def parse_clock(text: Column) -> Column:
    """Seconds of HH:MM:SS[.f]; null unless it has three numbers."""
    parts = F.split(text, ":")
    number = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    return F.when(F.size(parts) == 3, number(1) * 3600 + number(2) * 60 + number(3))


def _fixed2(value: Column) -> Column:
    """Two decimals, halves of the exact binary value to even."""
    cents = F.rint(value * 100).cast("bigint")
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def byte_text(size: Column) -> Column:
    """B, KiB, MiB or GiB with two decimals."""
    out = F.when(size >= GIB, F.concat(_fixed2(size / F.lit(float(GIB))), F.lit(" GiB")))
    out = out.when(size >= MIB, F.concat(_fixed2(size / F.lit(float(MIB))), F.lit(" MiB")))
    out = out.when(size >= KIB, F.concat(_fixed2(size / F.lit(float(KIB))), F.lit(" KiB")))
    return out.otherwise(F.concat(size.cast("string"), F.lit(" B")))


def byte_pair(size: Column) -> Column:
    """Megabytes with gigabytes in brackets, both of base 1024."""
    return F.concat(_fixed2(size / F.lit(float(MIB))), F.lit(" MB ("), _fixed2(size / F.lit(float(GIB))), F.lit(" GB)"))


def parse_crf(text: Column) -> Column:
    """struct(sd, hd, uhd): one value for all tiers or three by comma; null if
    any is no number of 0 to 255, or there are two or more than three."""
    parts = F.transform(F.split(text, ","), lambda p: F.when(F.trim(p).rlike(r"^\d+$"), F.trim(p).try_cast("int")))
    ok = F.forall(parts, lambda v: v.isNotNull() & (v >= 0) & (v <= 255)) & F.size(parts).isin(1, 3)
    at = lambda i: F.try_element_at(parts, F.when(F.size(parts) == 1, F.lit(1)).otherwise(F.lit(i)))
    return F.when(ok, F.struct(at(1).alias("sd"), at(2).alias("hd"), at(3).alias("uhd")))


def audio_basic(channels: Column) -> Column:
    """Description of a list of channel counts."""
    each = F.transform(channels, lambda c, i: F.concat(F.lit("Stream "), i.cast("string"), F.lit(" ("), c.cast("string"), F.lit("ch)")))
    return (
        F.when(channels.isNull() | (F.size(channels) == 0), F.lit("No audio"))
        .when(F.size(channels) == 1, F.concat(F.try_element_at(channels, F.lit(1)).cast("string"), F.lit(" channels")))
        .otherwise(F.concat(F.size(channels).cast("string"), F.lit(" streams: "), F.array_join(each, ", ")))
    )


def audio_config(streams: Column) -> Column:
    """Description of streams, structs with idx and channels, before encoding."""
    one = F.try_element_at(streams, F.lit(1))
    each = F.transform(streams, lambda s: F.concat(F.lit("Stream "), s["idx"].cast("string"), F.lit(": "), s["channels"].cast("string"), F.lit("ch ["), opus_kbps(s["channels"]).cast("string"), F.lit("kbps Opus]")))
    return (
        F.when(streams.isNull() | (F.size(streams) == 0), F.lit("No audio"))
        .when(F.size(streams) == 1, F.concat(one["channels"].cast("string"), F.lit(" channels @ "), opus_kbps(one["channels"]).cast("string"), F.lit("kbps Opus")))
        .otherwise(F.array_join(each, ", "))
    )


def audio_results(channels: Column) -> Column:
    """Description of channel counts after encoding."""
    one = F.try_element_at(channels, F.lit(1))
    each = F.transform(channels, lambda c: F.concat(c.cast("string"), F.lit("ch@"), opus_kbps(c).cast("string"), F.lit("k")))
    return (
        F.when(channels.isNull() | (F.size(channels) == 0), F.lit("No audio"))
        .when(F.size(channels) == 1, F.concat(F.lit("Opus "), one.cast("string"), F.lit("ch @ "), opus_kbps(one).cast("string"), F.lit("kbps")))
        .otherwise(F.concat(F.lit("Opus ("), F.array_join(each, ", "), F.lit(")")))
    )


def mastering_display(px: Column, py: Column, wx: Column, wy: Column, most: Column, least: Column) -> Column:
    """Display metadata from arrays in red, green, blue order."""
    pair = lambda a, b: F.concat(F.lit("("), F.format_string("%.4f", a), F.lit(","), F.format_string("%.4f", b), F.lit(")"))
    green, blue, red = ((F.element_at(px, i), F.element_at(py, i)) for i in (2, 3, 1))
    return F.concat(F.lit("G"), pair(*green), F.lit("B"), pair(*blue), F.lit("R"), pair(*red), F.lit("WP"), pair(wx, wy), F.lit("L"), pair(most, least))


def content_light(most: Column, average: Column) -> Column:
    return F.concat_ws(",", most.cast("string"), average.cast("string"))
