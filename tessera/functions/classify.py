"""Classification of streams and files: resolution tiers, dynamic range, audio."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

# fixed values: width thresholds and the defaults of each tier
UHD_WIDTH, HD_WIDTH = 3840, 1920
CRF = {"UHD": 29, "HD": 27, "SD": 25}
CHUNK_SECONDS = {"UHD": 45.0, "HD": 30.0, "SD": 20.0}
MAX_THREADS = {"UHD": 16, "HD": 10, "SD": 6}
# fixed values: Opus kilobits per second by channels; others get 48 a channel
OPUS_KBPS = {1: 64, 2: 128, 6: 256, 8: 384}
OPUS_KBPS_PER_CHANNEL = 48
# fixed values: spellings that tell HDR, in probe output and in MediaInfo
PROBE_HDR = {"primaries": ("bt2020", "bt.2020", "bt2100"), "transfer": ("pq", "smpte2084", "hlg", "arib-std-b67"), "matrix": ("bt2020", "bt.2020")}
MEDIAINFO_HDR = {"primaries": ("BT.2020", "BT.2100"), "transfer": ("PQ", "HLG", "SMPTE 2084"), "matrix": ("BT.2020",)}
# fixed values: pixel-format codes of ten bits
TEN_BIT_FORMATS = (62, 67)


def by_tier(width: Column, values: dict) -> Column:
    """The value of the width's tier."""
    return F.when(width >= UHD_WIDTH, F.lit(values["UHD"])).when(width >= HD_WIDTH, F.lit(values["HD"])).otherwise(F.lit(values["SD"]))


def tier(width: Column) -> Column:
    return by_tier(width, {k: k for k in CRF})


def crf(width: Column, values: dict = CRF) -> Column:
    return by_tier(width, values)


def chunk_seconds(width: Column, values: dict = CHUNK_SECONDS) -> Column:
    return by_tier(width, values)


def quality_label(width: Column, values: dict = CRF) -> Column:
    return F.concat(F.lit("CRF "), crf(width, values).cast("string"), F.lit(" ("), tier(width), F.lit(")"))


def range_label(is_hdr: Column) -> Column:
    return F.when(is_hdr, F.lit("HDR")).otherwise(F.lit("SDR"))


def opus_kbps(channels: Column) -> Column:
    out = None
    for n, rate in OPUS_KBPS.items():
        out = F.when(channels == n, F.lit(rate)) if out is None else out.when(channels == n, F.lit(rate))
    return out.otherwise(channels * OPUS_KBPS_PER_CHANNEL).cast("bigint")


def contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    """Case-insensitive; false for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(or_, (low.contains(n.lower()) for n in needles))


def _hdr(words: dict, primaries: Column, transfer: Column, matrix: Column) -> Column:
    return contains_any(primaries, words["primaries"]) | contains_any(transfer, words["transfer"]) | contains_any(matrix, words["matrix"])


def hdr_by_probe(primaries: Column, transfer: Column, matrix: Column) -> Column:
    return _hdr(PROBE_HDR, primaries, transfer, matrix)


def hdr_by_mediainfo(primaries: Column, transfer: Column, matrix: Column) -> Column:
    return _hdr(MEDIAINFO_HDR, primaries, transfer, matrix)


def is_ten_bit(pixel_format: Column) -> Column:
    return pixel_format.between(*TEN_BIT_FORMATS)


def matrix_for(is_hdr: Column, matrix: Column) -> Column:
    """Matrix coefficients to encode with: an HDR source's own, or a default."""
    own = F.coalesce(matrix, F.lit(""))
    return F.when(~is_hdr, F.lit("bt709")).when(own == "", F.lit("bt2020nc")).otherwise(own)


def bit_depth(text: Column) -> Column:
    """Depth as number; null where the text is none."""
    return text.try_cast("smallint")
