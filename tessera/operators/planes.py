"""Arithmetic on planes of samples, held as flat arrays in row order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_ten_bit(samples: Column) -> Column:
    """8-bit samples shifted to 10 bits."""
    return F.transform(samples, lambda x: F.shiftleft(x, 2))


def to_ten_bit_bytes(samples: Column) -> Column:
    """As little-endian byte pairs."""
    return F.flatten(F.transform(samples, lambda x: F.array(F.shiftleft(x, 2) % 256, F.shiftright(F.shiftleft(x, 2), 8))))


def copy_plane(samples: Column, stride: Column, rows: Column, length: Column) -> Column:
    """First ``length`` samples of each row of ``stride``, packed."""
    n = F.least(stride, length).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), rows.cast("int") - 1), lambda r: F.slice(samples, r * stride.cast("int") + 1, n)))


def crop_plane(samples: Column, stride: Column, left: Column, top: Column, width: Column, height: Column) -> Column:
    """The part of ``width`` x ``height`` that begins at left, top."""
    rows = F.sequence(top.cast("int"), (top + height).cast("int") - 1)
    return F.flatten(F.transform(rows, lambda r: F.slice(samples, r * stride.cast("int") + left.cast("int") + 1, width.cast("int"))))


def packed_size(width: Column, height: Column) -> Column:
    """Bytes of a 10-bit 4:2:0 frame."""
    return width * height * 3


def eight_bit_size(width: Column, height: Column) -> Column:
    return F.floor(width * height * 3 / 2).cast("bigint")


def decode_strategy(ten_bit: Column, crop_h: Column, crop_v: Column) -> Column:
    """Name of the fast path: depth and whether anything is cropped."""
    return F.concat(F.when(ten_bit, F.lit("B10")).otherwise(F.lit("B8")), F.when((crop_h > 0) | (crop_v > 0), F.lit("CropFast")).otherwise(F.lit("Fast")))


def crop_offsets(width: Column, height: Column, ten_bit: Column, crop_h: Column, crop_v: Column) -> Column:
    """struct of cropped dimensions, strides, starts and lengths in bytes; null
    without a crop."""
    bytes_ = F.when(ten_bit, F.lit(2)).otherwise(F.lit(1))
    half = lambda x: F.floor(x / 2).cast("bigint")
    w, h = width - 2 * crop_h, height - 2 * crop_v
    return F.when((crop_h > 0) | (crop_v > 0), F.struct(
        w.alias("new_w"), h.alias("new_h"), (width * bytes_).alias("y_stride"), half(width * bytes_).alias("uv_stride"),
        (crop_v * width * bytes_ + crop_h * bytes_).alias("y_start"), (w * bytes_).alias("y_len"),
        (half(half(crop_v) * width * bytes_) + half(crop_h * bytes_)).alias("uv_off"), half(w * bytes_).alias("uv_len"),
    ))


def frame_size(width: Column, height: Column, crop_h: Column, crop_v: Column) -> Column:
    return packed_size(width - 2 * crop_h, height - 2 * crop_v)
