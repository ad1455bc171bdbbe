"""Every operator of the engine as a query over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import classify as cl, paths as pt, text as tx
from ..operators import chunks as ch, config as cf, crop as cr, encoder as en, mux as mx, planes as pl, progress as pr, qc, resources as rs, summary as sm
from ..session import shared_dir
from ..sources import logs, media
from ..streaming import progress as st
from . import bindings as b

c, lit = F.col, F.lit
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, with its oracle where SQL can tell the result."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _chunks(spark, d) -> DataFrame:
    return ch.plan_chunks(b.video(spark, d), cl.chunk_seconds(c("width")))


def _done(spark, d) -> DataFrame:
    done = _chunks(spark, d).where((c("file_id") + c("idx")) % 3 == 0)
    size = (c("end_frame") - c("start_frame")) * 100 + c("idx")
    done = done.select("file_id", "idx", (c("end_frame") - c("start_frame")).alias("frames"), size.alias("size"))
    return done.unionByName(done.where("idx = 0"))  # the log has these twice


_V, _CH = f"WITH {b.VIDEO}", f"WITH {b.VIDEO}, {b.chunks_sql()}"
_DONE = f"""{_CH}, once AS (SELECT file_id, idx, end_frame - start_frame AS frames, (end_frame - start_frame) * 100 + idx AS size FROM chunks WHERE (file_id + idx) % 3 = 0),
 done AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE idx = 0)"""


@query(f"{_CH} SELECT file_id, idx, start_frame, end_frame FROM chunks")
def chunk_plan(spark, d):
    return _chunks(spark, d)


@query(f"{_CH} SELECT file_id, count(*) AS n_chunks, CAST(sum(end_frame - start_frame) AS BIGINT) AS frames, max(end_frame) AS last_end, true AS contiguous FROM chunks GROUP BY 1")
def chunk_coverage(spark, d):
    return ch.coverage(_chunks(spark, d))


@query(f"""{_CH} SELECT file_id, n AS n_chunks, f::DOUBLE / n AS avg_frames, f::DOUBLE / n / (fps_num::DOUBLE / fps_den::DOUBLE) AS avg_secs
 FROM (SELECT file_id, count(*) AS n, CAST(sum(end_frame - start_frame) AS BIGINT) AS f FROM chunks GROUP BY 1) JOIN video USING (file_id)""")
def chunk_averages(spark, d):
    return ch.average_chunk(_chunks(spark, d), b.video(spark, d))


@query(f"{_CH} SELECT file_id, count(*) AS n_rows, CAST(sum(frame) AS BIGINT) AS frame_sum FROM (SELECT file_id, unnest(range(start_frame, end_frame)) AS frame FROM chunks) GROUP BY 1")
def frame_scan(spark, d):
    return ch.frame_rows(_chunks(spark, d)).groupBy("file_id").agg(F.count("*").alias("n_rows"), F.sum("frame").alias("frame_sum"))


_TIER = "CASE WHEN width >= 3840 THEN {} WHEN width >= 1920 THEN {} ELSE {} END"


@query(f"""{_V} SELECT file_id, width, {_TIER.format("'UHD'", "'HD'", "'SD'")} AS tier, {_TIER.format(29, 27, 25)} AS crf, {_TIER.format("45.0::DOUBLE", "30.0::DOUBLE", "20.0::DOUBLE")} AS chunk_secs,
 {_TIER.format("'CRF 29 (UHD)'", "'CRF 27 (HD)'", "'CRF 25 (SD)'")} AS quality FROM video""")
def tier_params(spark, d):
    w = c("width")
    return b.video(spark, d).select("file_id", "width", cl.tier(w).alias("tier"), cl.crf(w).alias("crf"), cl.chunk_seconds(w).alias("chunk_secs"), cl.quality_label(w).alias("quality"))


_POINTS = """points AS (SELECT user_id AS file_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS frame FROM events), totals AS (SELECT user_id AS file_id, CAST(80 AS BIGINT) AS total_frames FROM events GROUP BY 1),
 marks AS (SELECT DISTINCT file_id, frame FROM points UNION SELECT file_id, 0 FROM totals),
 ends AS (SELECT file_id, frame, coalesce(lead(frame) OVER (PARTITION BY file_id ORDER BY frame), total_frames) AS end_frame FROM marks JOIN totals USING (file_id)),
 scenes AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY frame) - 1 AS idx, frame AS start_frame, end_frame FROM ends WHERE frame < end_frame)"""


def _scenes(spark, d) -> DataFrame:
    p = b.progress(spark, d)
    return ch.scenes_from_boundaries(p.select("file_id", c("size").alias("frame")), p.select("file_id", lit(80).cast("bigint").alias("total_frames")).distinct())


@query(f"WITH {_POINTS} SELECT file_id, idx, start_frame, end_frame FROM scenes")
def scene_intervals(spark, d):
    return _scenes(spark, d)


@query(f"""WITH {_POINTS} SELECT file_id, count(*) AS n_scenes, max(end_frame - start_frame) AS longest, coalesce(bool_and(end_frame - start_frame BETWEEN 1 AND least(floor((file_id % 3)::DOUBLE / nullif(file_id % 2, 0)::DOUBLE * 30), 1000)), false) AND file_id % 2 <> 0 AS valid FROM scenes GROUP BY file_id""")
def scene_validity(spark, d):
    return ch.scene_validity(_scenes(spark, d).withColumn("fps_num", c("file_id") % 3).withColumn("fps_den", c("file_id") % 2))


@query("SELECT event_id, k FROM (SELECT event_id, [k % 5, k % 5, k % 7] AS v FROM (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)), LATERAL (SELECT list_filter(list_sort(v), lambda x, i: i = 1 OR x <> list_sort(v)[i - 1]) AS k)")
def sorted_dedupe(spark, d):
    k = c("size")
    return b.progress(spark, d).select(c("ord").alias("event_id"), ch.dedupe_sorted(F.array_sort(F.array(k % 5, k % 5, k % 7))).alias("k"))


_VISIBLE = "WITH " + b.PATHS + ", found AS (SELECT * FROM split WHERE name NOT LIKE '.%' AND lower(substr(ext, 2)) IN (" + ", ".join(f"'{x}'" for x in pt.VIDEO_EXTENSIONS) + "))"


@query(f"{_VISIBLE} SELECT path, name, stem, lower(ext) AS ext, length FROM found")
def file_discovery(spark, d):
    return media.find_videos(b.paths(spark, d).select("path", "length"))


_PLANNED = f"{_VISIBLE}, planned AS (SELECT path, concat('/out/', CASE WHEN length % 5 = 0 THEN 'movie.mkv' ELSE concat(stem, '.mkv') END) AS output FROM found)"


def _planned(spark, d) -> DataFrame:
    found = media.find_videos(b.paths(spark, d).select("path", "length"))
    return found.select("path", pt.output_path(lit("/out"), c("name"), F.when(c("length") % 5 == 0, lit("movie.mkv"))).alias("output"))


@query(f"{_PLANNED} SELECT output, path FROM planned WHERE output NOT IN (SELECT concat('/out/clip', CAST(page_id AS VARCHAR), '.mkv') FROM pages WHERE page_id % 3 = 0)")
def skip_existing(spark, d):
    there = b.read(spark, d, "pages").where("page_id % 3 = 0").select(F.concat(lit("/out/clip"), c("page_id").cast("string"), lit(".mkv")).alias("path"))
    return media.skip_existing(_planned(spark, d), there)


@query(f"""WITH {b.PATHS} SELECT file_id, CASE WHEN f AND ext IN ('.mkv', '.mp4', '.webm', '.avi', '.mov', '.m4v') THEN regexp_replace(path, '/[^/]*$', '') ELSE path END AS folder,
 CASE WHEN f AND ext IN ('.mkv', '.mp4', '.webm', '.avi', '.mov', '.m4v') THEN name ELSE '' END AS name,
 CASE WHEN NOT f OR ext = '' THEN path WHEN lower(ext) = '.mkv' THEN regexp_replace(path, '/[^/]*$', '') END AS strict_folder FROM (SELECT *, file_id % 4 <> 0 AS f FROM split)""")
def output_arguments(spark, d):
    folder = c("file_id") % 4 == 0
    p = b.paths(spark, d).select("file_id", pt.resolve_output(c("path"), folder).alias("o"), pt.resolve_output_strict(c("path"), folder).alias("s"))
    return p.select("file_id", c("o.folder").alias("folder"), c("o.name").alias("name"), c("s.folder").alias("strict_folder"))


@query(f"{_VISIBLE} SELECT path, concat('/work/.encode-', stem) AS folder, printf('encode/%04d.ivf', length % 2000) AS chunk FROM found")
def work_paths(spark, d):
    found = media.find_videos(b.paths(spark, d).select("path", "length"))
    return found.select("path", pt.work_folder(c("name"), lit("/work")).alias("folder"), pt.chunk_file(c("length") % 2000).alias("chunk"))


def _probe_docs(spark, d) -> DataFrame:
    """Probe documents built from line items, then parsed."""
    s = F.struct(
        F.when(c("l_linenumber") == 1, "video").otherwise("audio").alias("codec_type"), F.when(c("l_returnflag") == "R", "aac").otherwise("opus").alias("codec_name"),
        (c("l_partkey") % 4000).alias("width"), (c("l_suppkey") * 10).alias("height"), (c("l_quantity").cast("bigint") % 9).alias("channels"), c("l_partkey").cast("string").alias("nb_frames"),
    )
    per = b.read(spark, d, "lineitem").groupBy(c("l_orderkey").alias("file_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", s.alias("s")))), lambda x: x["s"]).alias("streams"))
    secs = F.when(c("file_id") % 10 == 0, lit("N/A")).when(c("file_id") % 10 == 1, lit(None)).otherwise(F.concat((c("file_id") % 5000).cast("string"), lit(".5")))
    doc = F.to_json(F.struct(F.struct(secs.alias("duration")).alias("format"), c("streams").alias("streams")))
    return media.parse_probe(per.select("file_id", doc.alias("json")))


_LINES = """li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) AS rn FROM lineitem)"""


@query(f"""WITH {_LINES} SELECT l_orderkey AS file_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY rn) - 1 AS idx, CAST(floor(l_quantity) AS BIGINT) % 9 AS channels,
 CASE WHEN l_returnflag = 'R' THEN 'aac' ELSE 'opus' END AS codec_name, '' AS profile FROM li WHERE l_linenumber <> 1 AND CAST(floor(l_quantity) AS BIGINT) % 9 > 0""")
def probe_streams(spark, d):
    return media.audio_streams(_probe_docs(spark, d))


@query(f"""WITH {_LINES}, firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY rn) AS r FROM li WHERE l_linenumber = 1) WHERE r = 1), ids AS (SELECT DISTINCT l_orderkey AS file_id FROM lineitem)
 SELECT file_id, coalesce(l_partkey % 4000, 0) AS width, coalesce(l_suppkey * 10, 0) AS height, CASE file_id % 10 WHEN 0 THEN NULL WHEN 1 THEN 0.0::DOUBLE ELSE (file_id % 5000)::DOUBLE + 0.5::DOUBLE END AS duration_secs, coalesce(l_partkey, 0) AS total_frames,
 CASE WHEN l_orderkey IS NULL THEN '' WHEN l_returnflag = 'R' THEN 'aac' ELSE 'opus' END AS codec_name,
 CASE WHEN l_orderkey IS NULL THEN 'no video stream' WHEN l_partkey % 4000 <= 0 OR l_suppkey <= 0 THEN 'invalid dimensions' WHEN file_id % 10 = 0 THEN 'invalid duration' END AS error FROM ids LEFT JOIN firsts ON file_id = l_orderkey""")
def probe_video(spark, d):
    return media.video_properties(_probe_docs(spark, d)).select("file_id", "width", "height", "duration_secs", "total_frames", "codec_name", "error")


@query(f"""WITH {b.COLOUR} SELECT file_id, primaries, CASE WHEN file_id % 2 = 0 THEN file_id % 13 END AS depth, 2 AS n_tracks FROM colour""")
def mediainfo_tracks(spark, d):
    col = b.colour(spark, d)
    tracks = F.array(
        F.struct(lit("General").alias("@type"), lit(None).cast("string").alias("colour_primaries"), lit(None).cast("string").alias("BitDepth")),
        F.struct(lit("Video").alias("@type"), c("primaries").alias("colour_primaries"), F.when(c("file_id") % 2 == 0, (c("file_id") % 13).cast("string")).otherwise(lit("n/a")).alias("BitDepth")),
        F.struct(lit("Audio").alias("@type"), lit(None).cast("string").alias("colour_primaries"), lit(None).cast("string").alias("BitDepth")),
    )
    docs = media.parse_mediainfo(col.select("file_id", F.to_json(F.struct(F.struct(tracks.alias("track")).alias("media"))).alias("json")))
    v = F.try_element_at("video", lit(1))
    return docs.select("file_id", v["colour_primaries"].alias("primaries"), cl.bit_depth(v["BitDepth"]).cast("bigint").alias("depth"), (F.size("video") + F.size("audio")).alias("n_tracks"))


_KBPS = "CASE {0} WHEN 1 THEN 64 WHEN 2 THEN 128 WHEN 6 THEN 256 WHEN 8 THEN 384 ELSE {0} * 48 END"


@query(f"WITH {b.AUDIO} SELECT channels, CAST({_KBPS.format('channels')} AS BIGINT) AS kbps, count(*) AS n FROM audio GROUP BY 1, 2")
def audio_bitrate(spark, d):
    return b.audio(spark, d).groupBy("channels", cl.opus_kbps(c("channels")).alias("kbps")).agg(F.count("*").alias("n"))


def _streams(spark, d) -> DataFrame:
    s = b.audio(spark, d).where("channels > 0").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("ord", "channels", "codec"))).alias("s"))
    return s.select("file_id", F.transform("s", lambda x, i: F.struct(i.cast("bigint").alias("idx"), x["channels"].alias("channels"), x["codec"].alias("codec"))).alias("s"))


_STREAMS = f"""WITH {b.AUDIO}, kept AS (SELECT file_id, channels, codec, row_number() OVER (PARTITION BY file_id ORDER BY l_linenumber, l_partkey, l_suppkey, channels, codec) - 1 AS i, CAST({_KBPS.format('channels')} AS BIGINT) AS kbps FROM audio WHERE channels > 0)"""


@query(f"""{_STREAMS} SELECT file_id, count(*) AS n_streams,
 CASE WHEN count(*) = 1 THEN concat(CAST(min(channels) AS VARCHAR), ' channels') ELSE concat(CAST(count(*) AS VARCHAR), ' streams: ', string_agg(concat('Stream ', CAST(i AS VARCHAR), ' (', CAST(channels AS VARCHAR), 'ch)'), ', ' ORDER BY i)) END AS basic,
 CASE WHEN count(*) = 1 THEN concat(CAST(min(channels) AS VARCHAR), ' channels @ ', CAST(min(kbps) AS VARCHAR), 'kbps Opus') ELSE string_agg(concat('Stream ', CAST(i AS VARCHAR), ': ', CAST(channels AS VARCHAR), 'ch [', CAST(kbps AS VARCHAR), 'kbps Opus]'), ', ' ORDER BY i) END AS config,
 CASE WHEN count(*) = 1 THEN concat('Opus ', CAST(min(channels) AS VARCHAR), 'ch @ ', CAST(min(kbps) AS VARCHAR), 'kbps') ELSE concat('Opus (', string_agg(concat(CAST(channels AS VARCHAR), 'ch@', CAST(kbps AS VARCHAR), 'k'), ', ' ORDER BY i), ')') END AS results FROM kept GROUP BY 1""")
def audio_summary(spark, d):
    s = _streams(spark, d)
    chans = F.transform("s", lambda x: x["channels"])
    return s.select("file_id", F.size("s").cast("bigint").alias("n_streams"), tx.audio_basic(chans).alias("basic"), tx.audio_config(c("s")).alias("config"), tx.audio_results(chans).alias("results"))


@query(f"{_STREAMS} SELECT file_id, string_agg(codec, ',' ORDER BY i) AS codecs, bool_and(codec = 'opus') AS all_opus FROM kept GROUP BY 1")
def audio_codecs(spark, d):
    return _streams(spark, d).select("file_id", F.array_join(F.transform("s", lambda x: x["codec"]), ",").alias("codecs"), F.forall("s", lambda x: x["codec"] == "opus").alias("all_opus"))


def _any(column: str, words) -> str:
    return " OR ".join(f"contains(lower({column}), '{w.lower()}')" for w in words)


def _hdr_sql(words: dict) -> str:
    return " OR ".join(_any(k, v) for k, v in words.items())


@query(f"WITH {b.COLOUR} SELECT file_id, {_hdr_sql(cl.PROBE_HDR)} AS is_hdr FROM colour")
def hdr_ffprobe(spark, d):
    return b.colour(spark, d).select("file_id", cl.hdr_by_probe(c("primaries"), c("transfer"), c("matrix")).alias("is_hdr"))


@query(f"WITH {b.COLOUR}, h AS (SELECT *, {_hdr_sql(cl.MEDIAINFO_HDR)} AS is_hdr FROM colour) SELECT file_id, is_hdr, CASE WHEN is_hdr THEN 'HDR' ELSE 'SDR' END AS label, CASE WHEN NOT is_hdr THEN 'bt709' WHEN matrix = '' THEN 'bt2020nc' ELSE matrix END AS matrix_out FROM h")
def hdr_mediainfo(spark, d):
    h = b.colour(spark, d).withColumn("is_hdr", cl.hdr_by_mediainfo(c("primaries"), c("transfer"), c("matrix")))
    return h.select("file_id", "is_hdr", cl.range_label(c("is_hdr")).alias("label"), cl.matrix_for(c("is_hdr"), c("matrix")).alias("matrix_out"))


@query(f"WITH {b.COLOUR}, h AS (SELECT *, {_hdr_sql(cl.PROBE_HDR)} AS a, {_hdr_sql(cl.MEDIAINFO_HDR)} AS b FROM colour) SELECT primaries, transfer, matrix, a AS by_probe, b AS by_mediainfo, count(*) AS n FROM h WHERE a <> b GROUP BY 1, 2, 3, 4, 5")
def hdr_disagree(spark, d):
    p, t, m = c("primaries"), c("transfer"), c("matrix")
    h = b.colour(spark, d).withColumn("by_probe", cl.hdr_by_probe(p, t, m)).withColumn("by_mediainfo", cl.hdr_by_mediainfo(p, t, m))
    return h.where("by_probe <> by_mediainfo").groupBy("primaries", "transfer", "matrix", "by_probe", "by_mediainfo").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS file_id, p_size % 70 AS pixel_format, p_size % 70 BETWEEN 40 AND 45 AS ten_bit FROM part")
def ten_bit(spark, d):
    p = c("p_size") % 70
    return b.read(spark, d, "part").select(c("p_partkey").alias("file_id"), p.alias("pixel_format"), cl.is_ten_bit(p + 22).alias("ten_bit"))


_MODE = """counts AS (SELECT file_id, sample_id, crop, count(*) AS n FROM crops WHERE crop <> '' GROUP BY 1, 2, 3),
 modes AS (SELECT file_id, sample_id, crop, n FROM (SELECT *, row_number() OVER (PARTITION BY file_id, sample_id ORDER BY n DESC, crop) AS r FROM counts) WHERE r = 1)"""


def _modes(spark, d) -> DataFrame:
    return cr.sample_mode(cr.candidates(b.crop_lines(spark, d)))


@query(f"WITH {b.CROP}, {_MODE} SELECT file_id, sample_id, crop, n FROM modes")
def crop_sample_mode(spark, d):
    return _modes(spark, d)


_VOTE = """tallies AS (SELECT file_id, crop, count(*) AS n FROM modes GROUP BY 1, 2),
 votes AS (SELECT file_id, n_values, n_samples, crop, n AS n_top, n::DOUBLE / n_samples AS share, n_values = 1 OR n::DOUBLE / n_samples > 0.8 AS wins FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, crop) AS r,
 count(*) OVER (PARTITION BY file_id) AS n_values, CAST(sum(n) OVER (PARTITION BY file_id) AS BIGINT) AS n_samples FROM tallies) WHERE r = 1)"""


@query(f"WITH {b.CROP}, {_MODE}, {_VOTE} SELECT * FROM votes")
def crop_vote(spark, d):
    return cr.vote(_modes(spark, d))


@query(f"""WITH {b.CROP}, {_MODE}, {_VOTE}, parts AS (SELECT file_id, crop, string_split(crop, ':') AS p FROM votes)
 SELECT file_id, crop, true AS valid, CAST(p[1] AS BIGINT) <> 1920 OR CAST(p[2] AS BIGINT) <> 1080 AS effective, CAST(p[3] AS BIGINT) AS crop_h, CAST(p[4] AS BIGINT) AS crop_v, CAST(p[1] AS BIGINT) AS expected_w, CAST(p[2] AS BIGINT) AS expected_h,
 1920 - 2 * CAST(p[3] AS BIGINT) AS encoded_w, 1080 - 2 * CAST(p[4] AS BIGINT) AS encoded_h FROM parts""")
def crop_dims(spark, d):
    return cr.dimensions(cr.vote(_modes(spark, d)).withColumn("width", lit(1920)).withColumn("height", lit(1080)))


@query(f"{_V}, timed AS (SELECT file_id, total_frames::DOUBLE / 32 AS s FROM video) SELECT file_id, k - 30 AS sample_id, s * k / 200 AS position FROM timed, (SELECT unnest(range(30, 171)) AS k)")
def sample_points(spark, d):
    return cr.sample_points(b.video(spark, d).withColumn("duration_secs", c("total_frames").cast("double") / 32))


@query(f"{_DONE} SELECT file_id, idx, start_frame, end_frame FROM chunks WHERE (file_id, idx) NOT IN (SELECT file_id, idx FROM done)")
def resume_remaining(spark, d):
    return ch.remaining(_chunks(spark, d), _done(spark, d))


@query(f"{_DONE} SELECT file_id, CAST(sum(size) AS BIGINT) AS bytes_done, CAST(sum(frames) AS BIGINT) AS frames_done, count(*) AS n_lines, count(DISTINCT idx) AS n_chunks FROM done GROUP BY 1")
def resume_totals(spark, d):
    return ch.resume_totals(_done(spark, d))


@query("SELECT event_id, k AS idx, user_id AS frames, event_id AS size FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) WHERE k % 5 IN (0, 1)")
def resume_parse(spark, d):
    p, k = b.progress(spark, d), c("size")
    a, u, e = k.cast("string"), c("file_id").cast("string"), c("ord").cast("string")
    line = F.when(k % 5 == 0, F.concat_ws(" ", a, u, e)).when(k % 5 == 1, F.concat(lit(" "), F.concat_ws("\t ", a, u, e), lit(" "))).when(k % 5 == 2, F.concat_ws(" ", a, u)).when(k % 5 == 3, F.concat_ws(" ", a, lit("x"), e)).otherwise(lit(""))
    return media.parse_resume(p.select(c("ord").alias("event_id"), line.alias("line")))


@query("SELECT event_id, k AS frame FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) WHERE k % 4 <> 0")
def boundary_parse(spark, d):
    p, k = b.progress(spark, d), c("size")
    return media.parse_boundaries(p.select(c("ord").alias("event_id"), F.when(k % 4 == 0, lit("  ")).otherwise(F.concat(lit(" "), k.cast("string"))).alias("line")))


@query(f"WITH {b.PROGRESS} SELECT file_id, ord, frames_complete, frames_total, percent FROM shown")
def progress_running(spark, d):
    return pr.running(b.progress(spark, d)).select("file_id", "ord", "frames_complete", "frames_total", "percent")


@query(f"""WITH {b.PROGRESS}, bk AS (SELECT *, CAST(least(floor(percent / 5), 20) AS BIGINT) AS bucket FROM shown),
 bt AS (SELECT *, coalesce(max(bucket) OVER (PARTITION BY file_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM bk) SELECT file_id, ord, bucket FROM bt WHERE bucket > top""")
def progress_buckets(spark, d):
    return pr.bucketed(pr.running(b.progress(spark, d))).select("file_id", "ord", "bucket")


_SHAKY = "CASE WHEN size % 4 = 0 THEN percent - 20 ELSE percent + size % 3 END"


@query(f"""WITH {b.PROGRESS}, h AS (SELECT file_id, ord, least(100.0::DOUBLE, greatest(0.0::DOUBLE, {_SHAKY})) AS percent FROM shown),
 t AS (SELECT *, max(percent) OVER (PARTITION BY file_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM h) SELECT file_id, ord, percent FROM t WHERE top IS NULL OR percent >= top""")
def progress_monotone(spark, d):
    shaky = pr.running(b.progress(spark, d)).withColumn("percent", F.when(c("size") % 4 == 0, c("percent") - 20).otherwise(c("percent") + c("size") % 3))
    return pr.monotone(shaky).select("file_id", "ord", "percent")


@query(f"""WITH {b.PROGRESS}, s AS (SELECT file_id, ord, frames_complete, frames_total, CASE WHEN frames_complete > 0 AND size > 0 THEN frames_complete / 25.0::DOUBLE / size END AS speed FROM shown)
 SELECT file_id, ord, CAST(floor(coalesce(speed, 0) * 1000 + 0.5) AS BIGINT) AS speed_milli, CAST(coalesce(floor((frames_total - frames_complete) / 25.0::DOUBLE / speed), 0) AS BIGINT) AS eta_secs FROM s""")
def progress_eta(spark, d):
    r = pr.running(b.progress(spark, d)).withColumn("e", pr.speed_and_eta(c("frames_complete"), c("frames_total"), lit(25.0), c("size").cast("double")))
    return r.select("file_id", "ord", F.floor(c("e.speed") * 1000 + 0.5).cast("bigint").alias("speed_milli"), c("e.eta_secs").alias("eta_secs"))


@query(f"""WITH {b.PROGRESS} SELECT file_id, ord, count(*) OVER w AS chunks_complete, CAST(sum(frames) OVER w AS BIGINT) AS frames_complete, CAST(sum(size) OVER w AS BIGINT) AS bytes_complete FROM progress WINDOW w AS (PARTITION BY file_id ORDER BY ord ROWS UNBOUNDED PRECEDING)""")
def result_collector(spark, d):
    return ch.running_totals(b.progress(spark, d)).select("file_id", "ord", "chunks_complete", "frames_complete", "bytes_complete")


_MEM = "CASE WHEN width >= 3840 OR height >= 2160 THEN 5368709120 WHEN width >= 1920 OR height >= 1080 THEN 2147483648 ELSE 536870912 END"
_GIB32 = 32 * 1024**3


@query(f"{_V}, m AS (SELECT *, greatest(1, CAST(floor(floor({_GIB32}::DOUBLE * 0.7::DOUBLE) / ({_MEM})) AS BIGINT)) AS most FROM video) SELECT file_id, CAST({_MEM} AS BIGINT) AS memory, least(24, most) AS workers, 24 > most AS capped FROM m")
def worker_cap(spark, d):
    cap = rs.worker_cap(lit(24), lit(_GIB32), c("width"), c("height"))
    return b.video(spark, d).select("file_id", rs.memory_per_worker(c("width"), c("height")).alias("memory"), cap["workers"].alias("workers"), cap["capped"].alias("capped"))


@query(f"""{_V}, w AS (SELECT file_id, width, file_id % 26 - 1 AS workers, {_TIER.format(16, 10, 6)} AS cap FROM video), t AS (SELECT *, CASE WHEN workers > 0 THEN 16 // workers END AS base FROM w)
 SELECT file_id, workers, CAST(CASE WHEN workers <= 0 THEN 1 ELSE greatest(1, least(base + CASE WHEN base < cap THEN 1 ELSE 0 END, cap)) END AS BIGINT) AS threads FROM t""")
def threads_per_worker(spark, d):
    w = c("file_id") % 26 - 1
    return b.video(spark, d).select("file_id", w.alias("workers"), rs.threads_per_worker(w, c("width"), lit(16), lit(32)).alias("threads"))


@query("SELECT o_orderkey AS file_id, greatest(o_orderkey % 30 + o_custkey % 6 - 5, 1) AS permits, CASE WHEN o_custkey % 4 = 0 THEN 1 ELSE greatest(1, CAST(floor(floor(((o_custkey % 4) * 1073741824)::DOUBLE * 0.5::DOUBLE) / 100000000) AS BIGINT)) END AS by_memory FROM orders")
def permits(spark, d):
    o = b.read(spark, d, "orders")
    return o.select(c("o_orderkey").alias("file_id"), rs.permits(c("o_orderkey") % 30, c("o_custkey") % 6 - 5).alias("permits"), rs.permits_for_memory((c("o_custkey") % 4) * 1073741824, lit(100_000_000), lit(0.5)).alias("by_memory"))


@query("""WITH cpus AS (SELECT n.n_regionkey AS host, s.s_nationkey % 2 AS package_id, CASE WHEN n.n_regionkey > 0 THEN s.s_suppkey % 8 END AS core_id FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey)
 SELECT host, count(*) AS logical, CASE WHEN count(DISTINCT CASE WHEN core_id IS NOT NULL THEN package_id * 100 + core_id END) > 0 THEN count(DISTINCT CASE WHEN core_id IS NOT NULL THEN package_id * 100 + core_id END) ELSE greatest(1, count(*) // 2) END AS physical FROM cpus GROUP BY 1""")
def physical_cores(spark, d):
    s, n = b.read(spark, d, "supplier"), b.read(spark, d, "nation")
    cpus = s.join(n, s.s_nationkey == n.n_nationkey).select(c("n_regionkey").alias("host"), (c("s_nationkey") % 2).alias("package_id"), F.when(c("n_regionkey") > 0, c("s_suppkey") % 8).alias("core_id"))
    return rs.physical_cores(cpus)


@query("SELECT p_partkey AS file_id, n AS name, CAST(p_size AS DOUBLE) * 3 AS value, CASE n WHEN 'preset' THEN p_size * 3 <= 13 WHEN 'crf_sd' THEN p_size * 3 <= 63 WHEN 'workers' THEN p_size * 3 >= 1 WHEN 'chunk_buffer' THEN p_size * 3 >= 0 WHEN 'chunk_duration_hd' THEN p_size * 3 BETWEEN 1 AND 120 ELSE true END AS valid FROM (SELECT *, (['preset', 'crf_sd', 'workers', 'chunk_buffer', 'chunk_duration_hd', 'tune'])[CAST(p_partkey % 6 + 1 AS INT)] AS n FROM part)")
def config_checks(spark, d):
    name = b._dealt(("preset", "crf_sd", "workers", "chunk_buffer", "chunk_duration_hd", "tune"), c("p_partkey"))
    value = c("p_size").cast("double") * 3
    return b.read(spark, d, "part").select(c("p_partkey").alias("file_id"), name.alias("name"), value.alias("value"), cf.setting_valid(name, value).alias("valid"))


@query("SELECT p_partkey AS file_id, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE CAST(p_size AS INT) END AS sd, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS INT) WHEN 1 THEN CAST(p_size + 1 AS INT) WHEN 2 THEN CAST(p_size AS INT) END AS hd FROM part")
def crf_text(spark, d):
    s = c("p_size").cast("string")
    k = c("p_partkey") % 4
    text = F.when(k == 0, F.concat(lit(" "), s)).when(k == 1, F.concat(s, lit(", "), (c("p_size") + 1).cast("string"), lit(",3"))).when(k == 2, F.concat_ws(",", s, s, s)).otherwise(F.concat(s, lit(",2")))
    v = tx.parse_crf(text)
    return b.read(spark, d, "part").select(c("p_partkey").alias("file_id"), v["sd"].alias("sd"), v["hd"].alias("hd"))


@query(f"WITH {b.FACTS} SELECT *, is_av1 AND is_10bit AND is_crop_correct AND is_duration_correct AND is_hdr_correct AND is_audio_opus AND is_track_count_correct AND is_sync_preserved AS is_valid FROM results")
def qc_result(spark, d):
    return qc.is_valid(qc.validate(b.facts(spark, d)))


_STEPS = f"""WITH {b.FACTS}, steps AS (SELECT file_id, CAST(i AS BIGINT) AS step, ({b._list(qc.STEPS)})[CAST(i AS INT)] AS name,
 ([is_av1, is_10bit, is_crop_correct, is_duration_correct, is_hdr_correct, is_audio_opus AND is_track_count_correct, is_sync_preserved])[CAST(i AS INT)] AS passed, details[CAST(i AS INT)] AS details FROM results, (SELECT unnest(range(1, 8)) AS i))"""


@query(f"{_STEPS} SELECT * FROM steps")
def qc_steps(spark, d):
    return qc.steps(qc.validate(b.facts(spark, d)))


@query(f"{_STEPS} SELECT file_id, count(*) AS n_failed, string_agg(name || ': ' || details, '; ' ORDER BY step) AS failed FROM steps WHERE NOT passed GROUP BY 1")
def qc_failures(spark, d):
    return qc.failures(qc.validate(b.facts(spark, d)))


@query(f"WITH {b.FACTS} SELECT expected_hdr, actual_hdr, hdr_message, is_hdr_correct, count(*) AS n FROM facts JOIN results USING (file_id) GROUP BY 1, 2, 3, 4")
def qc_hdr(spark, d):
    v = qc.hdr_verdict(c("expected_hdr"), c("actual_hdr"))
    return b.facts(spark, d).select("expected_hdr", "actual_hdr", v["message"].alias("hdr_message"), v["valid"].alias("is_hdr_correct")).groupBy("expected_hdr", "actual_hdr", "hdr_message", "is_hdr_correct").agg(F.count("*").alias("n"))


@query(f"""WITH {b.FACTS} SELECT file_id, CASE WHEN is_av1 THEN concat('AV1 (', codec, ')') WHEN codec <> '' THEN concat('Expected AV1, got ', codec) ELSE 'Unknown codec' END AS codec_text,
 CASE WHEN depth_mediainfo IS NOT NULL THEN concat(CAST(depth_mediainfo AS VARCHAR), '-bit (yuv420p10le)') ELSE 'Pixel format: yuv420p10le' END AS depth_text FROM facts JOIN results USING (file_id, codec)""")
def qc_texts(spark, d):
    f = b.facts(spark, d)
    return f.select("file_id", qc.codec_text(c("codec"), qc.codec_ok(c("codec"))).alias("codec_text"), qc.depth_text(c("depth_mediainfo"), lit("yuv420p10le")).alias("depth_text"))


@query(f"WITH {b.SIZES} SELECT file_id, in_size, out_size, CASE WHEN in_size = 0 THEN 0.0 ELSE (in_size - out_size)::DOUBLE / in_size::DOUBLE * 100 END AS reduction FROM sizes")
def size_reduction(spark, d):
    return sm.reductions(b.sizes(spark, d))


_SUMMARY = """count(*) AS n_files, CAST(sum(in_size) AS BIGINT) AS total_in, CAST(sum(out_size) AS BIGINT) AS total_out, CAST(sum(secs) AS BIGINT) AS total_secs, (sum(in_size) - sum(out_size))::DOUBLE / sum(in_size)::DOUBLE * 100 AS reduction,
 sum(video_secs)::DOUBLE / sum(secs)::DOUBLE AS avg_speed, count(*) FILTER (passed) AS n_passed, count(*) FILTER (NOT passed) AS n_failed"""


@query(f"WITH {b.SIZES} SELECT {_SUMMARY}, CAST(NULL AS VARCHAR) AS message FROM sizes")
def batch_summary(spark, d):
    return sm.batch_summary(b.sizes(spark, d).withColumn("filename", F.concat(c("file_id").cast("string"), lit(".mkv"))))


@query(f"WITH {b.SIZES} SELECT file_id % 7 AS batch, {_SUMMARY} FROM sizes GROUP BY 1")
def batch_summaries(spark, d):
    s = b.sizes(spark, d).withColumn("filename", c("file_id").cast("string")).withColumn("batch", c("file_id") % 7)
    return sm.batch_summary(s, ["batch"]).drop("message")


@query(f"{_V} SELECT file_id, CASE WHEN s < 0 THEN '??:??:??' ELSE printf('%02d:%02d:%02d', CAST(floor(s) AS BIGINT) // 3600, CAST(floor(s) AS BIGINT) // 60 % 60, CAST(floor(s) AS BIGINT) % 60) END AS clock FROM (SELECT file_id, total_frames::DOUBLE * 7 / 2 - 1000 AS s FROM video)")
def format_duration(spark, d):
    return b.video(spark, d).select("file_id", tx.clock(c("total_frames").cast("double") * 7 / 2 - 1000).alias("clock"))


_FIX = "concat(CAST(CAST(round_even({0} * 100, 0) AS BIGINT) // 100 AS VARCHAR), '.', lpad(CAST(CAST(round_even({0} * 100, 0) AS BIGINT) % 100 AS VARCHAR), 2, '0'))"


@query(f"""WITH {b.SIZES}, z AS (SELECT file_id, CASE file_id % 4 WHEN 0 THEN in_size % 1024 WHEN 1 THEN in_size WHEN 2 THEN in_size * 1024 ELSE in_size * 100000 END AS s FROM sizes)
 SELECT file_id, CASE WHEN s >= 1073741824 THEN concat({_FIX.format('(s / 1073741824.0::DOUBLE)')}, ' GiB') WHEN s >= 1048576 THEN concat({_FIX.format('(s / 1048576.0::DOUBLE)')}, ' MiB') WHEN s >= 1024 THEN concat({_FIX.format('(s / 1024.0::DOUBLE)')}, ' KiB') ELSE concat(CAST(s AS VARCHAR), ' B') END AS text,
 concat({_FIX.format('(s / 1048576.0::DOUBLE)')}, ' MB (', {_FIX.format('(s / 1073741824.0::DOUBLE)')}, ' GB)') AS pair FROM z""")
def format_bytes(spark, d):
    k, n = c("file_id") % 4, c("in_size")
    z = b.sizes(spark, d).select("file_id", F.when(k == 0, n % 1024).when(k == 1, n).when(k == 2, n * 1024).otherwise(n * 100000).alias("s"))
    return z.select("file_id", tx.byte_text(c("s")).alias("text"), tx.byte_pair(c("s")).alias("pair"))


@query("SELECT event_id, CASE k % 3 WHEN 0 THEN (k % 24 * 3600 + k % 60 * 60)::DOUBLE + (event_id % 60)::DOUBLE + 0.5::DOUBLE END AS secs FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)")
def parse_time(spark, d):
    p, k = b.progress(spark, d), c("size")
    text = F.when(k % 3 == 0, F.format_string("%02d:%02d:%02d.5", k % 24, k % 60, c("ord") % 60)).when(k % 3 == 1, lit("10:20")).otherwise(lit("a:b:c"))
    return p.select(c("ord").alias("event_id"), tx.parse_clock(text).alias("secs"))


_SMALL = f"WITH {b.VIDEO}, {b.chunks_sql('0.25::DOUBLE')}"


_MERGES = f"""{_SMALL}, n AS (SELECT *, count(*) OVER (PARTITION BY file_id) AS n FROM chunks), bt AS (SELECT *, CASE WHEN n > 500 THEN idx // 500 ELSE 0 END AS batch FROM n)
 SELECT file_id, batch, count(*) AS n_chunks, min(idx) AS first_idx, max(idx) AS last_idx, string_agg(printf('file ''encode/%04d.ivf''', idx), chr(10) ORDER BY idx) AS list_text FROM bt GROUP BY 1, 2"""


@query(_MERGES)
def merge_batches(spark, d):
    return ch.merge_batches(ch.plan_chunks(b.video(spark, d), lit(0.25)))


@query(_MERGES)
def merge_plan(spark, d):
    return ch.plan_merges(b.video(spark, d), lit(0.25))


@query(f"{_CH} SELECT file_id, idx, start_frame, end_frame, CAST(idx % 2 AS INT) AS part FROM chunks")
def ordered_concat(spark, d):
    k = _chunks(spark, d).withColumn("ord", F.struct("file_id", "idx"))
    return media.ordered_union([k.where("idx % 2 = 0"), k.where("idx % 2 = 1")]).drop("ord")


@query(f"""{_DONE}, ready AS (SELECT file_id, idx FROM chunks WHERE (file_id, idx) NOT IN (SELECT file_id, idx FROM done)), dist AS (SELECT r.file_id, r.idx, min(abs(r.idx - d.idx)) AS dist FROM ready r LEFT JOIN (SELECT DISTINCT file_id, idx FROM done) d ON r.file_id = d.file_id GROUP BY 1, 2)
 SELECT file_id, n_ready, idx AS next_idx, dist FROM (SELECT *, count(*) OVER (PARTITION BY file_id) AS n_ready, row_number() OVER (PARTITION BY file_id ORDER BY coalesce(dist, 0), idx) AS r FROM dist) WHERE r = 1""")
def next_chunk(spark, d):
    done = _done(spark, d)
    return ch.next_chunk(ch.remaining(_chunks(spark, d), done), done)


@query(f"""{_DONE.replace("WITH ", "WITH RECURSIVE ", 1)}, ready AS (SELECT file_id, idx FROM chunks WHERE (file_id, idx) NOT IN (SELECT file_id, idx FROM done)),
 began AS (SELECT r.file_id, r.l AS rest, coalesce(d.l, []) AS fin FROM (SELECT file_id, list(idx) AS l FROM ready GROUP BY 1) r LEFT JOIN (SELECT file_id, list(DISTINCT idx) AS l FROM done GROUP BY 1) d ON r.file_id = d.file_id),
 picks AS (SELECT file_id, CAST(-1 AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS idx, rest, fin FROM began
 UNION ALL SELECT file_id, turn + 1, pick, list_filter(rest, lambda x: x <> pick), list_append(fin, pick) FROM (SELECT *, (list_sort(list_transform(rest, lambda x: {{'d': coalesce(list_min(list_transform(fin, lambda f: abs(x - f))), 0), 'i': x}}))[1]).i AS pick FROM picks WHERE len(rest) > 0))
 SELECT file_id, turn, idx FROM picks WHERE turn >= 0""")
def dispatch_order(spark, d):
    done = _done(spark, d)
    return ch.dispatch_order(ch.remaining(_chunks(spark, d), done), done)


@query(f"WITH {b.PLANES} SELECT file_id, list_transform(samples, lambda x: x * 4) AS ten_bit, flatten(list_transform(samples, lambda x: [x * 4 % 256, x * 4 // 256])) AS bytes FROM planes")
def plane_8to10(spark, d):
    return b.planes(spark, d).select("file_id", pl.to_ten_bit(c("samples")).alias("ten_bit"), pl.to_ten_bit_bytes(c("samples")).alias("bytes"))


@query(f"WITH {b.PLANES} SELECT file_id, flatten(list_transform(range(0, 8), lambda r: samples[r * 8 + 1 : r * 8 + 6])) AS packed FROM planes")
def plane_stride(spark, d):
    return b.planes(spark, d).select("file_id", pl.copy_plane(c("samples"), lit(8), lit(8), lit(6)).alias("packed"))


@query(f"WITH {b.PLANES} SELECT file_id, flatten(list_transform(range(1, 6), lambda r: samples[r * 8 + 3 : r * 8 + 6])) AS cropped FROM planes")
def plane_crop(spark, d):
    return b.planes(spark, d).select("file_id", pl.crop_plane(c("samples"), lit(8), lit(2), lit(1), lit(4), lit(5)).alias("cropped"))


@query(f"""{_V}, x AS (SELECT *, file_id % 3 * 8 AS ch, file_id % 2 * 4 AS cv, CASE WHEN file_id % 5 < 3 THEN 2 ELSE 1 END AS bp FROM video)
 SELECT file_id, width * height * 3 AS packed, width * height * 3 // 2 AS eight_bit, (width - 2 * ch) * (height - 2 * cv) * 3 AS frame, concat(CASE bp WHEN 2 THEN 'B10' ELSE 'B8' END, CASE WHEN ch > 0 OR cv > 0 THEN 'CropFast' ELSE 'Fast' END) AS strategy,
 CASE WHEN ch > 0 OR cv > 0 THEN cv * width * bp + ch * bp END AS y_start, CASE WHEN ch > 0 OR cv > 0 THEN (cv // 2 * width * bp) // 2 + (ch * bp) // 2 END AS uv_off FROM x""")
def frame_size(spark, d):
    h, v, ten = c("file_id") % 3 * 8, c("file_id") % 2 * 4, c("file_id") % 5 < 3
    o = pl.crop_offsets(c("width"), c("height"), ten, h, v)
    return b.video(spark, d).select(
        "file_id", pl.packed_size(c("width"), c("height")).alias("packed"), pl.eight_bit_size(c("width"), c("height")).alias("eight_bit"), pl.frame_size(c("width"), c("height"), h, v).alias("frame"),
        pl.decode_strategy(ten, h, v).alias("strategy"), o["y_start"].alias("y_start"), o["uv_off"].alias("uv_off"),
    )


@query(f"""{_CH} SELECT file_id, idx, concat('-i stdin --input-depth 10 --color-format 1 --profile 0 --passes 1 --tile-rows 0 --tile-columns 0 --width ', width, ' --height ', height, ' --fps-num ', fps_num, ' --fps-denom ', fps_den, ' --keyint ', CAST(floor(fps_num::DOUBLE / fps_den::DOUBLE * 10) AS BIGINT),
 ' --rc 0 --scd 1 --scm 0 --progress 2 --frames ', end_frame - start_frame, ' --crf ', {_TIER.format(29, 27, 25)}, ' --preset 6 --tune 0 --lp 4', CASE WHEN file_id % 2 = 0 THEN concat(' --color-primaries ', file_id % 10) ELSE '' END, CASE WHEN file_id % 3 = 0 THEN ' --content-light 1000,400' ELSE '' END,
 ' --ac-bias 0.10 -b ', printf('encode/%04d.ivf', idx)) AS args, concat('ac-bias=0.1:enable-variance-boost=', CASE WHEN file_id % 2 = 0 THEN '1' ELSE '0' END, ':tune=0:keyint=10s:scd=1:scm=0') AS shown FROM chunks JOIN video USING (file_id)""")
def encoder_args(spark, d):
    j = _chunks(spark, d).join(b.video(spark, d), "file_id")
    args = en.arguments(
        c("width"), c("height"), c("fps_num"), c("fps_den"), c("end_frame") - c("start_frame"), cl.crf(c("width")), lit(6), lit(0), pt.chunk_file(c("idx")), threads=lit(4),
        primaries=F.when(c("file_id") % 2 == 0, c("file_id") % 10), light=F.when(c("file_id") % 3 == 0, tx.content_light(lit(1000), lit(400))), ac_bias=lit(0.1),
    )
    return j.select("file_id", "idx", F.array_join(args, " ").alias("args"), en.display("0.1", c("file_id") % 2 == 0, lit(0)).alias("shown"))


@query("SELECT p_partkey AS file_id, concat('G(0.2650,0.6900)B(0.1500,0.0600)R(0.6800,0.3200)WP(0.3127,0.3290)L(', p_size, '.0000,0.0050)') AS display FROM part")
def mastering_display(spark, d):
    xs, ys = F.array(lit(0.68), lit(0.265), lit(0.15)), F.array(lit(0.32), lit(0.69), lit(0.06))
    return b.read(spark, d, "part").select(c("p_partkey").alias("file_id"), tx.mastering_display(xs, ys, lit(0.3127), lit(0.329), c("p_size").cast("double"), lit(0.005)).alias("display"))


_TYPES = ("encoding_progress", "warning", "stage_progress", "validation_complete", "encoding_complete", "hardware", "error", "batch_complete")


@query(f"""WITH {b.PROGRESS}, e AS (SELECT *, ({b._list(_TYPES)})[CAST(ord % 8 + 1 AS INT)] AS type FROM shown) SELECT ord, file_id, type, CASE WHEN type = 'encoding_progress' THEN percent END AS percent, CASE WHEN type IN ('warning', 'error') THEN event_type END AS message,
 CASE WHEN type = 'validation_complete' THEN size % 2 = 0 END AS passed, CASE WHEN type IN ('encoding_complete', 'batch_complete') THEN size END AS size FROM e WHERE type NOT IN ('stage_progress', 'hardware')""")
def event_projection(spark, d):
    e = pr.running(b.progress(spark, d)).withColumn("type", b._dealt(_TYPES, c("ord"))).withColumn("message", c("event_type")).withColumn("passed", c("size") % 2 == 0)
    return pr.project_public(e)


@query(f"""{_STREAMS} SELECT file_id, concat('-hide_banner -i /in/', file_id, '.mkv -vn -map_metadata 0 ', string_agg(concat('-map 0:a:', i, ' -c:a:', i, ' libopus -b:a:', i, ' ', kbps, 'k -filter:a:', i, ' aformat=channel_layouts=7.1|5.1|stereo|mono'), ' ' ORDER BY i), ' -y /work/', file_id, '/audio.mka') AS args FROM kept GROUP BY 1""")
def audio_extract_args(spark, d):
    name = c("file_id").cast("string")
    return _streams(spark, d).select("file_id", F.array_join(mx.audio_arguments(F.concat(lit("/in/"), name, lit(".mkv")), F.concat(lit("/work/"), name), c("s")), " ").alias("args"))


@query("""SELECT o_orderkey AS file_id, concat('-hide_banner -i /work/', o_orderkey, '/video.mkv ', CASE WHEN o_custkey % 2 = 0 THEN concat('-i /work/', o_orderkey, '/audio.mka ') ELSE '' END, '-i /in/', o_orderkey, '.mkv -map 0:v:0 ',
 CASE WHEN o_custkey % 2 = 0 THEN '-map 1:a? -map 2:s? -c copy -map_metadata 0 -map_chapters 2' ELSE '-map 1:s? -c copy -map_metadata 0 -map_chapters 1' END, ' -movflags +faststart -y /out/', o_orderkey, '.mkv') AS args FROM orders""")
def mux_args(spark, d):
    name = c("o_orderkey").cast("string")
    path = lambda top, end="": F.concat(lit(f"/{top}/"), name, lit(end))
    args = mx.mux_arguments(path("in", ".mkv"), path("work"), path("out", ".mkv"), c("o_custkey") % 2 == 0)
    return b.read(spark, d, "orders").select(c("o_orderkey").alias("file_id"), F.array_join(args, " ").alias("args"))


@query(f"""{_CH}, n AS (SELECT file_id, count(*) AS n FROM chunks WHERE file_id % 5 <> 0 GROUP BY 1), v AS (SELECT file_id, fps_num, CASE WHEN file_id % 7 = 0 THEN 0 ELSE fps_den END AS fps_den, coalesce(n, 0) AS n_files FROM video LEFT JOIN n USING (file_id))
 SELECT file_id, n_files, CASE WHEN fps_den <> 0 AND n_files > 0 THEN concat('-hide_banner -f concat -safe 0 -i /work/', file_id, '/concat.txt -c copy -r ', printf('%.6f', fps_num::DOUBLE / fps_den::DOUBLE),
 ' -fflags +genpts+igndts+discardcorrupt+bitexact -avoid_negative_ts make_zero -reset_timestamps 1 -start_at_zero -y /work/', file_id, '/video.mkv') END AS args,
 CASE WHEN fps_den = 0 THEN 'invalid video info: FPS denominator is 0' WHEN n_files = 0 THEN concat('no IVF files found in /work/', file_id, '/encode') END AS error FROM v""")
def join_plan(spark, d):
    v = b.video(spark, d).select("file_id", F.concat(lit("/work/"), c("file_id").cast("string")).alias("folder"), "fps_num", F.when(c("file_id") % 7 == 0, lit(0)).otherwise(c("fps_den")).alias("fps_den"))
    out = mx.plan_joins(v, _chunks(spark, d).where("file_id % 5 <> 0").select("file_id", "idx"))
    return out.select("file_id", "n_files", F.array_join("args", " ").alias("args"), "error")


@query(f"WITH {b.FACTS} SELECT * FROM results")
def qc_joined(spark, d):
    f = b.facts(spark, d)
    expected = ("expected_w", "expected_h", "expected_secs", "expected_hdr", "expected_tracks")
    return qc.validate(qc.join_facts(f.select("file_id", *expected), f.drop(*expected)))


@query(f"""WITH {b.SIZES}, r AS (SELECT *, file_id // 6 AS batch FROM sizes WHERE file_id % 12 NOT IN (0, 1, 2, 3, 4) AND file_id % 36 > 5), bt AS (SELECT DISTINCT file_id // 6 AS batch FROM sizes),
 s AS (SELECT batch, count(*) AS n, CAST(sum(in_size) AS BIGINT) AS i, CAST(sum(out_size) AS BIGINT) AS o, min(concat('f', file_id, '.mkv')) AS one FROM r GROUP BY 1), t AS (SELECT bt.batch, coalesce(n, 0) AS n, i, o, one FROM bt LEFT JOIN s USING (batch))
 SELECT batch, file_id, 'validation_complete' AS type, CAST(1 AS BIGINT) AS turn, passed, CAST(NULL AS BIGINT) AS size, CAST(NULL AS DOUBLE) AS reduction, CAST(NULL AS VARCHAR) AS message, CAST(NULL AS BIGINT) AS n_files FROM r
 UNION ALL SELECT batch, file_id, 'encoding_complete', 2, NULL, out_size, CASE WHEN in_size = 0 THEN 0.0 ELSE (in_size - out_size)::DOUBLE / in_size::DOUBLE * 100 END, concat('f', file_id, '.mkv'), NULL FROM r
 UNION ALL SELECT batch, NULL, CASE n WHEN 0 THEN 'warning' WHEN 1 THEN 'operation_complete' ELSE 'batch_complete' END, 3, NULL, CASE WHEN n > 1 THEN o END, CASE WHEN n > 1 THEN CASE WHEN i = 0 THEN 0.0 ELSE (i - o)::DOUBLE / i::DOUBLE * 100 END END,
 CASE n WHEN 0 THEN 'No files were successfully encoded' WHEN 1 THEN concat('Successfully encoded ', one) END, n FROM t""")
def outcome_events(spark, d):
    s = b.sizes(spark, d).withColumn("batch", F.floor(c("file_id") / 6).cast("bigint"))
    r = s.where("file_id % 12 not in (0, 1, 2, 3, 4) and file_id % 36 > 5").withColumn("filename", F.concat(lit("f"), c("file_id").cast("string"), lit(".mkv")))
    return sm.outcome_events(r, s)


@query("SELECT l_orderkey AS file_id, list(l_linenumber ORDER BY l_linenumber, l_suppkey, l_partkey) FILTER (l_linenumber % 3 <> 0) AS channels FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_linenumber % 3 <> 0) > 0")
def mediainfo_channels(spark, d):
    text = F.when(c("l_linenumber") % 3 == 0, lit("n/a")).otherwise(c("l_linenumber").cast("string"))
    track = F.struct(lit("Audio").alias("@type"), text.alias("Channels"))
    per = b.read(spark, d, "lineitem").groupBy(c("l_orderkey").alias("file_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", track.alias("t")))), lambda x: x["t"]).alias("track"))
    docs = media.parse_mediainfo(per.select("file_id", F.to_json(F.struct(F.struct("track").alias("media"))).alias("json")))
    return media.mediainfo_channels(docs).where(F.size("channels") > 0)


#: fixed values: crop texts that the query deals out, with what each is worth
_CROPS = ("1920:800:0:140", "1920:1080:0:0", "1920:800:0", "a:800:0:140", "4294967296:800:0:140", "1920:800:0:140:5", "1280:720:x:2", "")


@query(f"""WITH t AS (SELECT event_id AS file_id, ({b._list(_CROPS)})[CAST(event_id % 8 + 1 AS INT)] AS crop FROM events), p AS (SELECT *, list_transform(string_split(crop, ':'), lambda x: TRY_CAST(x AS BIGINT)) AS n FROM t),
 k AS (SELECT *, n[1] IS NOT NULL AND n[2] IS NOT NULL AS sized, n[3] IS NOT NULL AND n[4] IS NOT NULL AS placed FROM p)
 SELECT file_id, crop, len(n) = 4 AND len(list_filter(n, lambda x: x BETWEEN 0 AND 4294967295)) = 4 AS valid, CASE WHEN sized THEN n[1] <> 1920 OR n[2] <> 1080 ELSE true END AS effective,
 CASE WHEN placed THEN n[3] ELSE 0 END AS crop_h, CASE WHEN placed THEN n[4] ELSE 0 END AS crop_v, CASE WHEN sized THEN n[1] ELSE 1920 END AS expected_w, CASE WHEN sized THEN n[2] ELSE 1080 END AS expected_h,
 1920 - 2 * CASE WHEN placed THEN n[3] ELSE 0 END AS encoded_w, 1080 - 2 * CASE WHEN placed THEN n[4] ELSE 0 END AS encoded_h FROM k""")
def crop_check(spark, d):
    return cr.dimensions(b.read(spark, d, "events").select(c("event_id").alias("file_id"), b._dealt(_CROPS, c("event_id")).alias("crop"), lit(1920).alias("width"), lit(1080).alias("height")))


@query("SELECT o_orderkey AS file_id, o_custkey % 300 * 1048576 + o_custkey % 2 = 0 OR (o_custkey % 300 * 1048576 + o_custkey % 2) // 1048576 >= 100 AS enough FROM orders")
def temp_space(spark, d):
    o = b.read(spark, d, "orders")
    return o.select(c("o_orderkey").alias("file_id"), rs.enough_space(c("o_custkey") % 300 * 1048576 + c("o_custkey") % 2).alias("enough"))


def _fresh(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT CAST(n AS BIGINT) AS frame FROM (SELECT DISTINCT o_custkey * 7 AS n FROM orders)")
def boundary_sink(spark, d):
    path = _fresh(spark, "boundaries")
    media.write_boundaries(b.read(spark, d, "orders").select((c("o_custkey") * 7).alias("frame")).distinct(), path)
    media.write_boundaries(spark.range(3).select(c("id").alias("frame")), path)  # what is there stays
    return media.parse_boundaries(media.read_lines(spark, path))


@query(f"{_DONE} SELECT idx, frames, size FROM done")
def resume_sink(spark, d):
    path, done = _fresh(spark, "resume"), _done(spark, d)
    for k in range(2):
        media.append_resume(done.where(c("size") % 2 == k), path)
    return media.parse_resume(media.read_lines(spark, path))


def _event_stream(spark, d) -> DataFrame:
    """The events as a stream of files in the shared folder."""
    path = _fresh(spark, "events")
    b.progress(spark, d).select("file_id", "ord", c("ts").cast("timestamp").alias("ts"), "frames", "size").repartition(3).write.parquet(path)
    return st.read_events(spark, path)


def _ran(stream: DataFrame, mode: str) -> DataFrame:
    name = "t" + _fresh(stream.sparkSession, "")[-32:]
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", _fresh(stream.sparkSession, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


@query(f"WITH {b.PROGRESS} SELECT file_id, count(*) AS chunks_complete, CAST(sum(frames) AS BIGINT) AS frames_complete, CAST(sum(size) AS BIGINT) AS bytes_complete FROM progress GROUP BY 1")
def stream_totals(spark, d):
    return _ran(st.totals(_event_stream(spark, d)), "complete")


@query("SELECT user_id AS file_id, CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 AS start, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS frames, CAST(sum(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) AS BIGINT) AS bytes FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    """Nearly as many windows as events: too many for memory."""
    windows, path = st.throughput(_event_stream(spark, d)), _fresh(spark, "windows")
    st.keep_complete(windows, path, _fresh(spark, "stream")).awaitTermination()
    return spark.read.schema(windows.schema).parquet(path).select("file_id", F.unix_timestamp("window.start").alias("start"), "frames", "bytes")


@query(f"WITH {b.PROGRESS} SELECT file_id, count(*) AS chunks_complete, CAST(sum(frames) AS BIGINT) AS frames_complete, CAST(sum(size) AS BIGINT) AS bytes_complete FROM progress GROUP BY 1")
def stream_state(spark, d):
    """The last state of each file from keyed counters, kept by a sink."""
    path = _fresh(spark, "state")
    q = st.fan_out(st.collect_results(_event_stream(spark, d)), [lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/{epoch}")], _fresh(spark, "stream"), strict=True)
    q.awaitTermination()
    seen = spark.read.option("recursiveFileLookup", "true").schema(st.OUT_SCHEMA).parquet(path)
    return seen.groupBy("file_id").agg(*[F.max(k).alias(k) for k in ("chunks_complete", "frames_complete", "bytes_complete")])


@query("""SELECT event_id, concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), ' [', CASE WHEN event_id % 3 = 0 THEN 'DEBUG' ELSE 'INFO' END, '] ', event_type) AS line, concat('/logs/encode_run_', strftime(ts, '%Y%m%d_%H%M%S'), '.log') AS path
 FROM events WHERE event_id % 2 = 0 OR event_id % 3 <> 0""")
def log_lines(spark, d):
    r = b.progress(spark, d).select(c("ord").alias("event_id"), "ts", F.when(c("ord") % 3 == 0, logs.DEBUG).otherwise(logs.INFO).alias("level"), c("event_type").alias("message"))
    both = logs.log_lines(r.where("event_id % 2 = 0"), verbose=True).unionByName(logs.log_lines(r.where("event_id % 2 = 1")))
    return both.select("event_id", "line", logs.log_path(lit("/logs"), c("ts")).alias("path"))
