"""Worker, thread and memory planning; host facts are parameters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.classify import HD_WIDTH, MAX_THREADS, UHD_WIDTH, by_tier

# fixed values: memory of a worker by frame size, and the usable share
UHD_HEIGHT, HD_HEIGHT = 2160, 1080
UHD_BYTES, HD_BYTES, SD_BYTES = 5 * 1024**3, 2 * 1024**3, 512 * 1024**2
USABLE = 0.7
# fixed values: defaults of parallel encoding
WORKERS, BUFFER = 24, 4
# fixed value: megabytes that temporary files need
LEAST_TEMP_MB = 100


def memory_per_worker(width: Column, height: Column) -> Column:
    return (
        F.when((width >= UHD_WIDTH) | (height >= UHD_HEIGHT), F.lit(UHD_BYTES))
        .when((width >= HD_WIDTH) | (height >= HD_HEIGHT), F.lit(HD_BYTES)).otherwise(F.lit(SD_BYTES)).cast("bigint")
    )


def worker_cap(requested: Column, available: Column, width: Column, height: Column) -> Column:
    """struct(workers, capped): as many as fit 70 % of memory, 1 at least; no
    cap where memory is unknown (0)."""
    usable = F.floor(available.cast("double") * USABLE)
    most = F.greatest(F.lit(1), F.floor(usable / memory_per_worker(width, height))).cast("bigint")
    return F.when((available > 0) & (requested > most), F.struct(most.alias("workers"), F.lit(True).alias("capped"))).otherwise(F.struct(requested.cast("bigint").alias("workers"), F.lit(False).alias("capped")))


def permits(workers: Column, buffer: Column) -> Column:
    return F.greatest(workers + buffer, F.lit(1))


def threads_per_worker(workers: Column, width: Column, physical: Column, logical: Column) -> Column:
    """Physical cores a worker, one more with SMT below the tier's cap."""
    cap = by_tier(width, MAX_THREADS)
    base = F.floor(physical / F.when(workers > 0, workers).otherwise(F.lit(1)))
    base = base + F.when((logical > physical) & (base < cap), F.lit(1)).otherwise(F.lit(0))
    return F.when(workers <= 0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.least(base, cap))).cast("bigint")


def permits_for_memory(available: Column, need: Column, share: Column) -> Column:
    """In-flight chunks that fit a share of memory, 1 at least."""
    usable = F.floor(available.cast("double") * share)
    return F.when((available == 0) | (usable < need), F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(usable / need))).cast("bigint")


def enough_space(available: Column) -> Column:
    """Whether temporary files fit; unknown space (0) counts as enough."""
    return (available == 0) | (F.floor(available / (1024 * 1024)) >= LEAST_TEMP_MB)


def physical_cores(cpus):
    """Distinct (package, core) pairs per host; half the logical ones where the
    topology is unknown."""
    known = F.count_distinct("package_id", "core_id")
    return cpus.groupBy("host").agg(F.count("*").alias("logical"), F.when(known > 0, known).otherwise(F.greatest(F.lit(1), F.floor(F.count("*") / 2))).cast("bigint").alias("physical"))
