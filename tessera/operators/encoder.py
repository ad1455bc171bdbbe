"""Arguments for the encoder of one chunk; planning only, nothing is run."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: options that do not depend on the chunk
BEFORE = ("-i", "stdin", "--input-depth", "10", "--color-format", "1", "--profile", "0", "--passes", "1", "--tile-rows", "0", "--tile-columns", "0")
BETWEEN = ("--rc", "0", "--scd", "1", "--scm", "0", "--progress", "2")
KEYFRAME_SECONDS = 10


def keyint(fps_num: Column, fps_den: Column) -> Column:
    return F.floor(fps_num.cast("double") / F.when(fps_den != 0, fps_den).cast("double") * KEYFRAME_SECONDS).cast("bigint")


def _option(name: str, value: Column) -> Column:
    """[name, value], or nothing for a null value."""
    return F.when(value.isNotNull(), F.array(F.lit(name), value.cast("string"))).otherwise(F.array().cast("array<string>"))


def arguments(
    width: Column, height: Column, fps_num: Column, fps_den: Column, frames: Column, crf: Column, preset: Column, tune: Column, output: Column,
    threads: Column | None = None, primaries: Column | None = None, transfer: Column | None = None, matrix: Column | None = None,
    mastering: Column | None = None, light: Column | None = None, grain: Column | None = None, ac_bias: Column | None = None, boost: tuple[Column, Column] | None = None,
) -> Column:
    """Array of arguments; optional ones are left out where null or 0."""
    none = F.lit(None).cast("string")
    some = lambda c: none if c is None else F.when(c != 0, c.cast("string"))
    told = lambda c: none if c is None else c
    fixed = lambda xs: F.array(*[F.lit(x) for x in xs])
    return F.concat(
        fixed(BEFORE), _option("--width", width), _option("--height", height), _option("--fps-num", fps_num), _option("--fps-denom", fps_den),
        _option("--keyint", keyint(fps_num, fps_den)), fixed(BETWEEN), _option("--frames", frames), _option("--crf", F.rint(crf).cast("bigint")),
        _option("--preset", preset), _option("--tune", tune), _option("--lp", some(threads)),
        _option("--color-primaries", told(primaries)), _option("--transfer-characteristics", told(transfer)), _option("--matrix-coefficients", told(matrix)),
        _option("--mastering-display", told(mastering)), _option("--content-light", told(light)), _option("--fgs-table", told(grain)),
        _option("--ac-bias", none if ac_bias is None else F.when(ac_bias != 0, F.format_string("%.2f", ac_bias))),
        *([] if boost is None else [fixed(("--enable-variance-boost", "1")), _option("--variance-boost-strength", boost[0]), _option("--variance-octile", boost[1])]),
        F.array(F.lit("-b"), output),
    )


def display(ac_bias: str, boost: Column, tune: Column) -> Column:
    """Short form of the settings for people."""
    return F.concat(F.lit(f"ac-bias={ac_bias}:enable-variance-boost="), F.when(boost, F.lit("1")).otherwise(F.lit("0")), F.lit(":tune="), tune.cast("string"), F.lit(f":keyint={KEYFRAME_SECONDS}s:scd=1:scm=0"))
