"""Literal cases of operators as small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import classify as cl, paths as pt, text as tx
from tessera.operators import chunks as ch, config as cf, crop as cr, encoder as en, mux as mx, planes as pl, qc, resources as rs, summary as sm
from tessera.sources import logs, media

c = F.col


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    "total, num, den, secs, want",
    [
        (2400, 24, 1, 10.0, list(range(0, 2400, 240))), (3000, 30, 1, 10.0, list(range(0, 3000, 300))), (6000, 60, 1, 20.0, list(range(0, 6000, 1200))),
        (2398, 24000, 1001, 10.0, list(range(0, 2398, 239))), (720, 24, 1, 10.0, [0, 240, 480]), (100, 24, 1, 10.0, [0]),
        (1000, 24, 0, 10.0, [0]), (0, 24, 1, 10.0, [0]), (-100, 24, 1, 10.0, [0]), (100, 24, 1, 0.5, list(range(0, 100, 12))),
    ],
)
def test_boundaries(spark, total, num, den, secs, want):
    assert one(spark, ch.boundaries(F.lit(total), F.lit(num), F.lit(den), F.lit(secs)).alias("b")).b == want


def test_chunks_cover_their_video(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.randint(-2, 5000), rnd.choice([24, 25, 30000]), rnd.choice([1, 1001])) for i in range(60)]
    v = spark.createDataFrame(rows, "file_id long, total_frames long, fps_num long, fps_den long")
    got = {r.file_id: r for r in ch.coverage(ch.plan_chunks(v, F.lit(7.0))).collect()}
    for i, total, num, den in rows:
        if total <= 0:
            assert i not in got
        else:
            n = max(1, int(num / den * 7))
            assert (got[i].n_chunks, got[i].frames, got[i].last_end, got[i].contiguous) == (math.ceil(total / n), total, total, True)


@pytest.mark.parametrize("values, want", [([1, 2, 3], [1, 2, 3]), ([1, 1, 2, 3, 3, 3], [1, 2, 3]), ([5, 5, 5], [5]), ([], []), ([42], [42])])
def test_dedupe(spark, values, want):
    arr = F.array(*map(F.lit, values)).cast("array<int>")
    assert one(spark, ch.dedupe_sorted(arr).alias("d")).d == want


def test_scenes_add_zero_and_drop_what_lies_beyond(spark):
    p = spark.createDataFrame([(1, 50), (1, 20), (1, 50), (1, 120)], "file_id long, frame long")
    t = spark.createDataFrame([(1, 100)], "file_id long, total_frames long")
    got = [(r.idx, r.start_frame, r.end_frame) for r in ch.scenes_from_boundaries(p, t).orderBy("idx").collect()]
    assert got == [(0, 0, 20), (1, 20, 50), (2, 50, 120)]


@pytest.mark.parametrize("ready, done, want", [([2, 0, 1], [], 0), ([0, 1, 2, 3, 4, 6, 7, 8, 9], [5], 4), ([0, 1, 3, 4], [2], 1), ([0, 3, 6, 9], [1, 5], 0)])
def test_next_chunk(spark, ready, done, want):
    r = spark.createDataFrame([(1, x) for x in ready], "file_id long, idx long")
    d = spark.createDataFrame([(1, x) for x in done], "file_id long, idx long")
    assert ch.next_chunk(r, d).first().next_idx == want


def test_dispatch_order_takes_each_once(spark):
    r = spark.createDataFrame([(1, x) for x in (2, 0, 1)], "file_id long, idx long")
    got = [x.idx for x in ch.dispatch_order(r, r.where("false")).orderBy("turn").collect()]
    assert got == [0, 1, 2]


@pytest.mark.parametrize("seed", range(30))
def test_greedy_order_is_that_of_plain_picks(seed):
    rnd = random.Random(seed)
    every = rnd.sample(range(200), rnd.randint(0, 60))
    cut = rnd.choice([0, len(every) // 4, len(every)])
    done, ready = every[:cut], every[cut:]
    order, left, ended = [], sorted(ready), list(done)
    while left:
        pick = min(left, key=lambda x: (min((abs(x - f) for f in ended), default=0), x))
        order.append(pick), left.remove(pick), ended.append(pick)
    assert ch.greedy_order(ready, done) == order


def test_greedy_order_of_many_chunks():
    assert len(ch.greedy_order(list(range(1, 200_000, 2)), [0, 99_999])) == 99_999


@pytest.mark.parametrize("n, want", [(500, 1), (501, 2)])
def test_merge_batches(spark, n, want):
    k = spark.range(n).select(F.lit(1).alias("file_id"), c("id").alias("idx"))
    assert ch.merge_batches(k).count() == want


@pytest.mark.parametrize("width, crf, secs", [(720, 25, 20), (1280, 25, 20), (1919, 25, 20), (1920, 27, 30), (2560, 27, 30), (3839, 27, 30), (3840, 29, 45), (7680, 29, 45)])
def test_tiers(spark, width, crf, secs):
    w = F.lit(width)
    assert tuple(one(spark, cl.crf(w).alias("a"), cl.chunk_seconds(w).alias("b"))) == (crf, secs)


@pytest.mark.parametrize("name, value, ok", [("preset", 14, False), ("preset", 13, True), ("crf_sd", 64, False), ("crf_uhd", 64, False), ("chunk_duration_sd", 0, False), ("chunk_duration_hd", 121, False), ("workers", 0, False)])
def test_config(spark, name, value, ok):
    assert one(spark, cf.setting_valid(F.lit(name), F.lit(float(value))).alias("v")).v is ok
    assert cf.in_range(name, value) is ok
    assert cf.Config().check() == [] and cf.Config().with_crf(20, 22, 24).crf_by_tier() == {"UHD": 24, "HD": 22, "SD": 20}


@pytest.mark.parametrize("workers, width, low, high", [(0, 1920, 1, 1), (-1, 1920, 1, 1), (8, 3840, 1, 16), (1, 3840, 1, 16), (16, 1920, 1, 10), (24, 720, 1, 6), (12, 1280, 1, 6)])
def test_threads(spark, workers, width, low, high):
    got = one(spark, rs.threads_per_worker(F.lit(workers), F.lit(width), F.lit(16), F.lit(32)).alias("t")).t
    assert low <= got <= high


@pytest.mark.parametrize(
    "expected, actual, valid, message",
    [
        (True, True, True, "HDR preserved"), (False, False, True, "SDR preserved"), (True, False, False, "Expected HDR, found SDR"), (False, True, False, "Expected SDR, found HDR"), (None, True, True, "Output is HDR"),
        (None, False, True, "Output is SDR"), (True, None, False, "Expected HDR, but could not detect HDR status"), (False, None, False, "Expected SDR, but could not detect HDR status"), (None, None, False, "Could not detect HDR status"),
    ],
)
def test_hdr(spark, expected, actual, valid, message):
    b = lambda x: F.lit(x).cast("boolean")
    r = one(spark, qc.hdr_verdict(b(expected), b(actual)).alias("h"), qc.hdr_verdict(b(expected), b(actual), F.lit(False)).alias("n"))
    assert (r.h.valid, r.h.message) == (valid, message)
    assert r.n.valid and r.n.actual is None and not r.n.used and "skipped" in r.n.message


def test_formats(spark):
    sizes = {0: "0 B", 1: "1 B", 1023: "1023 B", 1024: "1.00 KiB", 1536: "1.50 KiB", 2**20: "1.00 MiB", 2**30: "1.00 GiB", 2**31: "2.00 GiB"}
    df = spark.createDataFrame([(k,) for k in sizes], "s long").select("s", tx.byte_text(c("s")).alias("t"))
    assert {r.s: r.t for r in df.collect()} == sizes
    times = {0.0: "00:00:00", 59.0: "00:00:59", 60.0: "00:01:00", 3599.9: "00:59:59", 3661.0: "01:01:01", 86400.0: "24:00:00", -1.0: "??:??:??"}
    df = spark.createDataFrame([(k,) for k in times], "s double").select("s", tx.clock(c("s")).alias("t"))
    assert {r.s: r.t for r in df.collect()} == times
    assert one(spark, tx.clock(F.lit(float("nan"))).alias("t")).t == "??:??:??"
    texts = {"00:00:00": 0, "01:02:03": 3723, "00:00:00.5": 0.5, "01:30:45.75": 5445.75, "": None, "00:00": None, "invalid": None}
    df = spark.createDataFrame([(k,) for k in texts], "s string").select("s", tx.parse_clock(c("s")).alias("t"))
    assert {r.s: r.t for r in df.collect()} == texts
    for a, b, want in [(100, 50, 50), (1000, 250, 75), (0, 100, 0), (100, 100, 0), (100, 150, -50)]:
        assert one(spark, tx.size_reduction(F.lit(a), F.lit(b)).alias("r")).r == want


@pytest.mark.parametrize("n_top, n_other, wins", [(4, 1, False), (5, 1, True), (3, 0, True), (1, 1, False)])
def test_crop_vote(spark, n_top, n_other, wins):
    rows = [(1, i, "a") for i in range(n_top)] + [(1, 50 + i, "b") for i in range(n_other)] + [(1, 99, "")]
    assert cr.vote(spark.createDataFrame(rows, "file_id long, sample_id long, crop string")).first().wins is wins


def test_crop_text(spark):
    got = one(spark, *[cr.is_valid(F.lit(x)).alias(f"v{i}") for i, x in enumerate(["1:2:3:4", "1:2:3", "a:2:3:4", "4294967296:1:1:1", None])], cr.is_effective(F.lit("x"), F.lit(1), F.lit(1)).alias("e"))
    assert tuple(got) == (True, False, False, False, False, True)


def test_resume_log(spark):
    lines = spark.createDataFrame([("0 10 5",), ("",), ("1 2",), ("a 1 2",), (" 3\t4  5 ",), ("0 10 5",)], "line string")
    done = media.parse_resume(lines).withColumn("file_id", F.lit(1))
    assert sorted(map(tuple, done.select("idx", "frames", "size").collect())) == [(0, 10, 5), (0, 10, 5), (3, 4, 5)]
    assert tuple(ch.resume_totals(done).first()) == (1, 15, 24, 3, 2)


def test_folder_listing(spark, tmp_path):
    for name in ("b.MKV", "A.mp4", ".c.mkv", "d.txt", "_e.mov", "f"):
        (tmp_path / name).write_text("")
    (tmp_path / "g.mkv").mkdir()
    assert [r.name for r in media.find_videos_in(spark, str(tmp_path)).collect()] == ["_e.mov", "A.mp4", "b.MKV"]
    with pytest.raises(ValueError):
        media.find_videos_in(spark, str(tmp_path / "g.mkv"))


def test_sinks(spark, tmp_path):
    p = str(tmp_path / "scenes")
    points = spark.createDataFrame([(5,), (0,)], "frame long")
    media.write_boundaries(points, p)
    media.write_boundaries(points.select((c("frame") + 1).alias("frame")), p)  # the old table wins
    assert sorted(r.frame for r in media.parse_boundaries(media.read_lines(spark, p)).collect()) == [0, 5]
    log = str(tmp_path / "log")
    for i in range(2):
        media.append_resume(spark.createDataFrame([(i, 10, 99)], "idx long, frames long, size long"), log)
    assert media.parse_resume(media.read_lines(spark, log)).count() == 2


def test_log(spark, tmp_path):
    r = spark.sql("select timestamp'2024-05-06 07:08:09' + make_interval(0, 0, 0, 0, 0, 0, id) as ts, if(id % 2 = 0, 'INFO', 'DEBUG') as level, concat('m', id) as message from range(4)")
    path = str(tmp_path / "log")
    logs.write_log(r.repartition(3), path)
    logs.write_log(r, path, verbose=True)
    assert sorted(x.line for x in media.read_lines(spark, path).collect()) == sorted([f"2024-05-06 07:08:{9 + i:02d} [{'INFO' if i % 2 == 0 else 'DEBUG'}] m{i}" for i in (0, 2, 0, 1, 2, 3)])


def test_probe_json(spark):
    docs = media.parse_probe(spark.createDataFrame([(1, '{"streams":[{"codec_type":"audio","channels":0},{"codec_type":"audio","channels":6,"codec_name":"aac"},{"codec_type":"video","width":10,"height":20}]}'), (2, "{}")], "file_id long, json string"))
    v = {r.file_id: r for r in media.video_properties(docs).collect()}
    assert (v[1].width, v[1].duration_secs, v[1].error, v[2].error) == (10, 0.0, None, "no video stream")
    assert [tuple(r) for r in media.audio_streams(docs).collect()] == [(1, 0, 6, "aac", "")]


def test_paths_and_planes(spark):
    got = one(spark, pt.output_path(F.lit("/o"), F.lit("a.b.mkv")).alias("a"), pt.resolve_output(F.lit("x.MKV"), F.lit(False)).alias("b"), pt.resolve_output(F.lit("d/x.mkv"), F.lit(False)).alias("c"), pt.resolve_output_strict(F.lit("x.mp4"), F.lit(False)).alias("d"))
    assert got.a == "/o/a.b.mkv" and tuple(got.b) == ("x.MKV", "") and tuple(got.c) == ("d", "x.mkv") and got.d is None
    arr = F.array(*map(F.lit, range(12)))
    got = one(spark, pl.copy_plane(arr, F.lit(4), F.lit(3), F.lit(2)).alias("a"), pl.crop_plane(arr, F.lit(4), F.lit(1), F.lit(1), F.lit(2), F.lit(2)).alias("b"), pl.to_ten_bit(F.array(F.lit(255))).alias("c"))
    assert (got.a, got.b, got.c) == ([0, 1, 4, 5, 8, 9], [5, 6, 9, 10], [1020])


def test_summary_of_one_and_none(spark):
    t = spark.createDataFrame([(1, "a.mkv", 10, 100, 40, 60, True)], "file_id long, filename string, secs long, in_size long, out_size long, video_secs long, passed boolean")
    assert sm.batch_summary(t).first().message == "Successfully encoded a.mkv"
    none = sm.batch_summary(t.where("false")).first()
    assert none.message == "No files were successfully encoded" and none.reduction == 0 and none.avg_speed == 0


def test_encoder_options_vanish(spark):
    n = F.lit(None).cast("int")
    args = en.arguments(*map(F.lit, (10, 20, 24, 1, 5, 27, 6, 0)), F.lit("o"), threads=F.lit(0), primaries=n, ac_bias=F.lit(0.0))
    got = one(spark, args.alias("a")).a
    assert "--lp" not in got and "--color-primaries" not in got and "--ac-bias" not in got and got[-2:] == ["-b", "o"] and got[got.index("--keyint") + 1] == "240"


def test_audio_and_mux_arguments(spark):
    streams = F.array(F.struct(F.lit(0).alias("idx"), F.lit(6).alias("channels")), F.struct(F.lit(2).alias("idx"), F.lit(3).alias("channels")))
    none = F.filter(streams, lambda s: F.lit(False))
    got = one(spark, mx.audio_arguments(F.lit("in"), F.lit("w"), streams).alias("a"), mx.audio_arguments(F.lit("in"), F.lit("w"), none).alias("n"), *[mx.mux_arguments(F.lit("in"), F.lit("w"), F.lit("o"), F.lit(x)).alias(f"m{x}") for x in (True, False)])
    assert got.n is None and got.a[got.a.index("-map") :][:8] == ["-map", "0:a:0", "-c:a:0", "libopus", "-b:a:0", "256k", "-filter:a:0", "aformat=channel_layouts=7.1|5.1|stereo|mono"] and "0:a:2" in got.a and got.a[got.a.index("-b:a:1") + 1] == "144k"
    for args, has in ((got.mTrue, True), (got.mFalse, False)):
        assert ("w/audio.mka" in args) is has and ("1:a?" in args) is has and args[args.index("-map_chapters") + 1] == ("2" if has else "1") and args[-1] == "o"


def test_join_errors(spark):
    v = spark.createDataFrame([(1, "w", 24, 0), (2, "w", 24, 1), (3, "w", 24, 1)], "file_id long, folder string, fps_num long, fps_den long")
    got = {r.file_id: r for r in mx.plan_joins(v, spark.createDataFrame([(1, 0), (3, 0), (3, 1)], "file_id long, idx long")).collect()}
    assert "denominator" in got[1].error and "no IVF files" in got[2].error and got[3].error is None and got[3].n_files == 2 and "24.000000" in got[3].args and got[1].args is None


def test_outcomes_of_no_one_and_two_results(spark):
    r = spark.createDataFrame([(1, 1, "a", True, 100, 50), (2, 2, "b", False, 10, 5), (2, 3, "c", True, 30, 15)], "batch long, file_id long, filename string, passed boolean, in_size long, out_size long")
    got = sm.outcome_events(r, spark.createDataFrame([(0,), (1,), (2,), (2,)], "batch long")).where("turn = 3").orderBy("batch").collect()
    assert [(x.type, x.message, x.n_files, x.reduction) for x in got] == [("warning", "No files were successfully encoded", 0, None), ("operation_complete", "Successfully encoded a", 1, None), ("batch_complete", None, 2, 50.0)]


def test_work_folders_and_temporary_names(spark, tmp_path):
    w = f"file://{tmp_path}/w"
    assert not media.work_folder_exists(spark, w)
    media.make_work_folder(spark, w)
    assert media.work_folder_exists(spark, w + "/encode") and media.free_space(spark, w) > 0
    media.remove_work_folder(spark, w)
    assert not media.work_folder_exists(spark, w)
    names = {r.p for r in spark.range(50).select(pt.temp_path(F.lit("/t"), "x-", ".tmp", 40).alias("p")).collect()}
    assert len(names) == 50 and all(n.startswith("/t/x-") and len(n) == 49 for n in names)
    assert tuple(one(spark, *[rs.enough_space(F.lit(n)).alias(f"s{i}") for i, n in enumerate((0, 1, 100 * 2**20, 100 * 2**20 - 1))])) == (True, False, True, False)
