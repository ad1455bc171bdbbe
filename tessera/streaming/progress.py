"""Progress as a stream: keyed running counters, windows by event time, and
several sinks from one query."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT_SCHEMA = "file_id bigint, ord bigint, ts timestamp, frames bigint, size bigint"
STATE_SCHEMA = "chunks bigint, frames bigint, bytes bigint"
OUT_SCHEMA = "file_id bigint, chunks_complete bigint, frames_complete bigint, bytes_complete bigint"
_STORE = "spark.sql.streaming.stateStore."
#: state on local disk; all of an executor's stores share 256 MB of memory
DISK_STATE = {
    f"{_STORE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}rocksdb.maxMemoryUsageMB": "256",
}
_lock = threading.Lock()


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def collect_results(events: DataFrame) -> DataFrame:
    """Counters per file after each micro-batch, kept as keyed state."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        chunks, frames, size = state.get if state.exists else (0, 0, 0)
        for b in batches:
            chunks, frames, size = chunks + len(b), frames + int(b.frames.sum()), size + int(b["size"].sum())
        state.update((chunks, frames, size))
        yield pd.DataFrame({"file_id": [key[0]], "chunks_complete": [chunks], "frames_complete": [frames], "bytes_complete": [size]})

    return events.groupBy("file_id").applyInPandasWithState(step, OUT_SCHEMA, STATE_SCHEMA, "update", GroupStateTimeout.NoTimeout)


def totals(events: DataFrame) -> DataFrame:
    """The same counters as a plain streaming aggregation (JVM only)."""
    return events.groupBy("file_id").agg(F.count("*").alias("chunks_complete"), F.sum("frames").alias("frames_complete"), F.sum("size").alias("bytes_complete"))


def throughput(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Frames and bytes per window of event time; late rows beyond the
    watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "file_id").agg(F.sum("frames").alias("frames"), F.sum("size").alias("bytes"))


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state on disk, so it may outgrow the
    executors' memory; afterwards the session has its own settings again."""
    with _lock:
        before = {k: spark.conf.get(k, None) for k in DISK_STATE}
        try:
            for k, v in DISK_STATE.items():
                spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keep_complete(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that keeps the whole result so far as Parquet under
    ``path``, anew with each micro-batch.  State is on disk and executors write
    the result, so neither they nor the driver hold it in memory."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    with disk_state(stream.sparkSession):  # a query takes its settings when it starts
        return stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fan_out(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str, mode: str = "update", strict: bool = False, **trigger):
    """Start one query that hands each micro-batch to every sink.

    What a sink raises never stops the others.  By default it does not stop the
    query either, and is kept in ``sink_errors``: that sink has lost the batch.
    With ``strict`` the query fails after all sinks had the batch, and hands it
    out again when it is restarted, so sinks must bear a batch twice."""
    errors: list[tuple[int, Exception]] = []

    def each(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            for sink in sinks:
                try:
                    sink(batch, epoch)
                except Exception as e:  # noqa: BLE001
                    errors.append((epoch, e))
        finally:
            batch.unpersist()
        if strict and errors:
            raise errors[-1][1]

    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    query.sink_errors = errors
    return query
