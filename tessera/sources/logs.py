"""Run logs: a time-stamped name, lines by level, and the sink that writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: levels, the time stamps of names and lines
INFO, DEBUG = "INFO", "DEBUG"
NAME_TIME, LINE_TIME = "yyyyMMdd_HHmmss", "yyyy-MM-dd HH:mm:ss"


def log_path(folder: Column, started: Column, prefix: str = "encode_run_") -> Column:
    return F.concat(folder, F.lit(f"/{prefix}"), F.date_format(started, NAME_TIME), F.lit(".log"))


def log_lines(records: DataFrame, verbose: bool = False) -> DataFrame:
    """Records (ts, level, message) with their line; debug records only if
    ``verbose``."""
    kept = records if verbose else records.where(F.col("level") != DEBUG)
    return kept.withColumn("line", F.concat(F.date_format("ts", LINE_TIME), F.lit(" ["), F.col("level"), F.lit("] "), F.col("message")))


def write_log(records: DataFrame, path: str, verbose: bool = False) -> None:
    """Append the lines, in time order within a call."""
    log_lines(records, verbose).orderBy("ts").select("line").write.mode("append").text(path)
