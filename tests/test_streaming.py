"""Streams against the batch operators on the same rows."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tessera.plans import bindings
from tessera.plans.queries import QUERIES
from tessera.streaming import progress as st, reporters as rp


def _feed(spark, sf_dir, folder, parts=3):
    p = bindings.progress(spark, sf_dir).select("file_id", "ord", F.col("ts").cast("timestamp").alias("ts"), "frames", "size")
    for k in range(parts):
        p.where(F.col("ord") % parts == k).coalesce(1).write.mode("append").parquet(folder)
    return p


def test_state_and_fan_out(spark, sf_dir, tmp_path):
    src = str(tmp_path / "in")
    p = _feed(spark, sf_dir, src)
    seen, other = {}, []

    def keep(batch, epoch):
        for r in batch.collect():
            seen[r.file_id] = (r.chunks_complete, r.frames_complete, r.bytes_complete)

    def broken(batch, epoch):
        raise RuntimeError("ignored")

    q = st.fan_out(st.collect_results(st.read_events(spark, src)), [broken, keep, lambda b, e: other.append(e)], str(tmp_path / "cp"))
    q.awaitTermination(120)
    want = {r.file_id: tuple(r)[1:] for r in p.groupBy("file_id").agg(F.count("*"), F.sum("frames"), F.sum("size")).collect()}
    assert seen == want and len(other) == len(q.sink_errors) >= 3


def test_strict_fan_out_fails_after_all_sinks(spark, sf_dir, tmp_path):
    src, other = str(tmp_path / "in"), []
    _feed(spark, sf_dir, src, 1)

    def broken(batch, epoch):
        raise RuntimeError("told")

    q = st.fan_out(st.totals(st.read_events(spark, src)), [broken, lambda b, e: other.append(e)], str(tmp_path / "cp"), "complete", strict=True)
    with pytest.raises(StreamingQueryException):
        q.awaitTermination(120)
    assert other == [0]


def test_reporters(spark):
    seen, public = [], []

    class Keep(rp.Reporter):
        def verbose(self, event):
            seen.append(event.ord)

    def handler(event):
        public.append(event.ord)
        raise ValueError("dropped")

    types = [*rp.EVENT_TYPES, "unheard_of"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(types)], "ord long, type string").repartition(3)
    rp.sink(rp.Fan(rp.Reporter(), Keep(), rp.Handler(handler)))(df, 0)
    assert [types[i] for i in seen] == ["verbose"]
    assert {types[i] for i in public} == {"encoding_progress", "validation_complete", "encoding_complete", "warning", "error", "batch_complete"} and public == sorted(public)
    assert all(callable(getattr(rp.Reporter, t)) for t in rp.EVENT_TYPES) and len(rp.EVENT_TYPES) == 16


def test_windows_match_batch(spark, sf_dir, tmp_path):
    src = str(tmp_path / "in")
    p = _feed(spark, sf_dir, src, 1)
    q = st.throughput(st.read_events(spark, src)).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    want = p.groupBy(F.window("ts", "5 minutes"), "file_id").agg(F.sum("frames").alias("frames"), F.sum("size").alias("bytes"))
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, want.collect()))


def test_complete_windows_are_kept_on_disk(spark, sf_dir, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    p = _feed(spark, sf_dir, src)
    before = {k: spark.conf.get(k, None) for k in st.DISK_STATE}
    windows = st.throughput(st.read_events(spark, src))
    q = st.keep_complete(windows, out, str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert len(q.recentProgress) >= 3 and any(k.startswith("rocksdb") for k in q.lastProgress["stateOperators"][0]["customMetrics"])
    assert {k: spark.conf.get(k, None) for k in st.DISK_STATE} == before
    want = p.groupBy(F.window("ts", "5 minutes"), "file_id").agg(F.sum("frames").alias("frames"), F.sum("size").alias("bytes"))
    assert sorted(map(tuple, spark.read.schema(windows.schema).parquet(out).collect())) == sorted(map(tuple, want.collect()))


def test_window_query_holds_no_rows_on_the_driver(spark, sf_dir, tmp_path):
    before = {t.name for t in spark.catalog.listTables()}
    assert QUERIES["stream_windows"](spark, sf_dir).count() > 0
    assert {t.name for t in spark.catalog.listTables()} == before  # a memory sink leaves a table there
    none = str(tmp_path / "none")
    spark.read.parquet(f"{sf_dir}/events.parquet").where("false").write.parquet(f"{none}/events.parquet")
    assert QUERIES["stream_windows"](spark, none).count() == 0
