"""Path functions and the naming of outputs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: container extensions that count as video
VIDEO_EXTENSIONS = ("mkv", "wmv", "ts", "avi", "mp4", "m4v", "mpg", "mpeg", "mov", "webm", "flv", "m2ts", "ogv", "vob")
# fixed values: extensions by which an output argument names a file
OUTPUT_EXTENSIONS = (".mkv", ".mp4", ".webm", ".avi", ".mov", ".m4v")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """With its dot, as spelt; empty without one."""
    return F.regexp_extract(name, r"(\.[^./]*)$", 1)


def stem(name: Column) -> Column:
    """Name without its last extension."""
    return F.regexp_replace(name, r"\.[^./]*$", "")


def is_video(name: Column) -> Column:
    return F.lower(F.substring(extension(name), 2, 64)).isin(*VIDEO_EXTENSIONS)


def is_visible(name: Column) -> Column:
    return ~name.startswith(".")


def output_path(folder: Column, name: Column, override: Column | None = None) -> Column:
    """<folder>/<stem>.mkv, or the override's name."""
    own = F.concat(stem(name), F.lit(".mkv"))
    return F.concat(folder, F.lit("/"), own if override is None else F.coalesce(F.nullif(override, F.lit("")), own))


def _clean(path: Column) -> Column:
    return F.when(path == "", F.lit(".")).otherwise(path)


def resolve_output(path: Column, input_is_folder: Column) -> Column:
    """struct(folder, name): a path with one of six extensions, spelt in lower
    case, names a file unless the input is a folder."""
    is_file = ~input_is_folder & extension(base_name(path)).isin(*OUTPUT_EXTENSIONS)
    parent = F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))
    return F.when(is_file, F.struct(_clean(parent).alias("folder"), base_name(path).alias("name"))).otherwise(F.struct(path.alias("folder"), F.lit("").alias("name")))


def resolve_output_strict(path: Column, input_is_folder: Column) -> Column:
    """As above, but any extension names a file and only mkv is valid; null if
    invalid."""
    ext = F.lower(extension(base_name(path)))
    parent = F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))
    return (
        F.when(input_is_folder | (ext == ""), F.struct(path.alias("folder"), F.lit("").alias("name")))
        .when(ext == ".mkv", F.struct(_clean(parent).alias("folder"), base_name(path).alias("name")))
    )


def chunk_file(idx: Column) -> Column:
    return F.format_string("encode/%04d.ivf", idx)


def random_suffix(length: int) -> Column:
    """Random hex digits; differs between runs."""
    digits = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    return F.substring(F.concat(*[digits] * -(-length // 32)), 1, length)


def temp_path(folder: Column, prefix: str, ending: str = "", length: int = 12) -> Column:
    """A path for a temporary file, whose prefix ``stale`` files are found by."""
    return F.concat(folder, F.lit(f"/{prefix}"), random_suffix(length), F.lit(ending))


def work_folder(name: Column, root: Column, prefix: str = ".encode-") -> Column:
    """Working folder beside the outputs, named after the input's stem."""
    return F.concat(root, F.lit("/" + prefix), stem(name))
