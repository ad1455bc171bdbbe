"""Deterministic projections of the driver tables to the domain tables.

Each binding has a DataFrame form and the same in SQL for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

c, lit = F.col, F.lit


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_value(column, values: dict, other):
    out = None
    for k, v in values.items():
        out = F.when(column == k, lit(v)) if out is None else out.when(column == k, lit(v))
    return out.otherwise(lit(other))


# video: one per document
def video(spark, d) -> DataFrame:
    w = (c("doc_id") % 50 + 1) * 160
    return read(spark, d, "documents").select(
        c("doc_id").alias("file_id"), w.alias("width"), F.floor(w * 9 / 16).cast("bigint").alias("height"), c("n_chars").alias("total_frames"),
        by_value(c("lang"), {"en": 24000, "de": 25, "fr": 30000}, 60).cast("bigint").alias("fps_num"), by_value(c("lang"), {"en": 1001, "fr": 1001}, 1).cast("bigint").alias("fps_den"),
    )


VIDEO = """video AS (SELECT doc_id AS file_id, (doc_id % 50 + 1) * 160 AS width, ((doc_id % 50 + 1) * 160 * 9) // 16 AS height, n_chars AS total_frames,
 CAST(CASE lang WHEN 'en' THEN 24000 WHEN 'de' THEN 25 WHEN 'fr' THEN 30000 ELSE 60 END AS BIGINT) AS fps_num, CAST(CASE WHEN lang IN ('en', 'fr') THEN 1001 ELSE 1 END AS BIGINT) AS fps_den FROM documents)"""

_SECS = "CASE WHEN width >= 3840 THEN 45.0::DOUBLE WHEN width >= 1920 THEN 30.0::DOUBLE ELSE 20.0::DOUBLE END"


def chunks_sql(seconds: str = _SECS, name: str = "chunks") -> str:
    """Chunks of video, in SQL."""
    return f"""stepped_{name} AS (SELECT *, greatest(1, CAST(floor(fps_num::DOUBLE / fps_den::DOUBLE * ({seconds})) AS BIGINT)) AS step FROM video WHERE total_frames > 0),
 {name} AS (SELECT file_id, s // step AS idx, s AS start_frame, least(s + step, total_frames) AS end_frame FROM (SELECT file_id, step, total_frames, unnest(range(0, total_frames, step)) AS s FROM stepped_{name}))"""


# audio streams: a line item each
def audio(spark, d) -> DataFrame:
    return read(spark, d, "lineitem").select(
        c("l_orderkey").alias("file_id"), (c("l_quantity").cast("bigint") % 9).alias("channels"), F.when(c("l_returnflag") == "R", "aac").otherwise("opus").alias("codec"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"),
    )


AUDIO = """audio AS (SELECT l_orderkey AS file_id, CAST(floor(l_quantity) AS BIGINT) % 9 AS channels, CASE WHEN l_returnflag = 'R' THEN 'aac' ELSE 'opus' END AS codec,
 l_linenumber, l_partkey, l_suppkey FROM lineitem)"""


# sizes before and after: line items of an order
def sizes(spark, d) -> DataFrame:
    li = read(spark, d, "lineitem").select("l_orderkey", F.floor("l_extendedprice").cast("bigint").alias("a"), F.floor(c("l_extendedprice") * (1 - c("l_discount"))).cast("bigint").alias("b"), F.floor("l_quantity").cast("bigint").alias("q"))
    return li.groupBy(c("l_orderkey").alias("file_id")).agg(F.sum("a").alias("in_size"), F.sum("b").alias("out_size"), F.sum("q").alias("secs"), (F.count("*") * 60).alias("video_secs")).withColumn("passed", c("in_size") % 3 != 0)


SIZES = """sizes AS (SELECT l_orderkey AS file_id, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS in_size, CAST(sum(CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT)) AS BIGINT) AS out_size,
 CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS secs, count(*) * 60 AS video_secs, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) % 3 <> 0 AS passed FROM lineitem GROUP BY 1)"""


# crop candidates: three a sample, from an event's number
def _k():
    return F.regexp_extract("props", r"(\d+)", 1).cast("bigint")


def crop_lines(spark, d) -> DataFrame:
    k = _k()
    crop = F.when((c("user_id") % 2 == 0) & (k < 90), lit("1920:800:0:140")).when(k % 3 == 0, lit("1920:1080:0:0")).when(k % 3 == 1, lit("1440:1080:240:0")).otherwise(lit(""))
    return read(spark, d, "events").select(c("user_id").alias("file_id"), F.floor(c("event_id") / 3).cast("bigint").alias("sample_id"), crop.alias("crop"), F.when(crop == "", lit("no frame")).otherwise(F.concat(lit("[Parsed] w:1 crop="), crop)).alias("line"))


CROP = """crops AS (SELECT user_id AS file_id, event_id // 3 AS sample_id, CASE WHEN user_id % 2 = 0 AND k < 90 THEN '1920:800:0:140' WHEN k % 3 = 0 THEN '1920:1080:0:0' WHEN k % 3 = 1 THEN '1440:1080:240:0' ELSE '' END AS crop
 FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events))"""


# progress: an event each
def progress(spark, d) -> DataFrame:
    return read(spark, d, "events").select(c("user_id").alias("file_id"), c("event_id").alias("ord"), F.floor("value").cast("bigint").alias("frames"), _k().alias("size"), "ts", "event_type")


PROGRESS = """progress AS (SELECT user_id AS file_id, event_id AS ord, CAST(floor(value) AS BIGINT) AS frames, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS size, event_type FROM events),
 running AS (SELECT *, CAST(sum(frames) OVER (PARTITION BY file_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS frames_complete, CAST(sum(frames) OVER (PARTITION BY file_id) AS BIGINT) AS frames_total FROM progress),
 shown AS (SELECT *, CASE WHEN frames_total = 0 THEN 0.0::DOUBLE ELSE frames_complete::DOUBLE / frames_total::DOUBLE * 100 END AS percent FROM running)"""

# fixed values: colour words that the binding deals out by part size
PRIMARIES = ("bt709", "bt2020", "BT.2020", "bt.2020", "bt2100", "BT.2100", "", "smpte170m")
TRANSFERS = ("bt709", "smpte2084", "PQ", "HLG", "arib-std-b67", "SMPTE 2084", "")
MATRICES = ("bt709", "bt2020nc", "BT.2020 non-constant", "bt.2020", "")


def _dealt(values, key):
    return F.element_at(F.array(*[lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def colour(spark, d) -> DataFrame:
    return read(spark, d, "part").select(c("p_partkey").alias("file_id"), _dealt(PRIMARIES, c("p_size")).alias("primaries"), _dealt(TRANSFERS, c("p_size") + c("p_partkey") % 5).alias("transfer"), _dealt(MATRICES, c("p_partkey")).alias("matrix"))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


COLOUR = f"""colour AS (SELECT p_partkey AS file_id, ({_list(PRIMARIES)})[CAST(p_size % {len(PRIMARIES)} + 1 AS INT)] AS primaries,
 ({_list(TRANSFERS)})[CAST((p_size + p_partkey % 5) % {len(TRANSFERS)} + 1 AS INT)] AS transfer, ({_list(MATRICES)})[CAST(p_partkey % {len(MATRICES)} + 1 AS INT)] AS matrix FROM part)"""


# planes: 8 x 8 samples of a vector
def planes(spark, d) -> DataFrame:
    s = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 255).cast("int"))
    return read(spark, d, "embeddings").select(c("vec_id").alias("file_id"), s.alias("samples"))


PLANES = "planes AS (SELECT vec_id AS file_id, list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 255) AS INT)) AS samples FROM embeddings)"

#: fixed values: extensions that the path binding deals out
EXTENSIONS = (".mkv", ".MP4", ".txt", ".mov", "", ".ts", ".avi.bak", ".Webm")


def paths(spark, d) -> DataFrame:
    p = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$|/$", "")
    head = F.when(c("page_id") % 7 == 0, lit("/.hidden")).otherwise(lit("/clip"))
    return read(spark, d, "pages").select(c("page_id").alias("file_id"), F.concat(lit("/media/"), p, head, c("page_id").cast("string"), _dealt(EXTENSIONS, c("page_id"))).alias("path"), F.length("html").cast("bigint").alias("length"))


PATHS = f"""paths AS (SELECT page_id AS file_id, concat('/media/', regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$|/$', '', 'g'), CASE WHEN page_id % 7 = 0 THEN '/.hidden' ELSE '/clip' END, CAST(page_id AS VARCHAR),
 ({_list(EXTENSIONS)})[CAST(page_id % {len(EXTENSIONS)} + 1 AS INT)]) AS path, CAST(length(html) AS BIGINT) AS length FROM pages),
 named AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name FROM paths),
 split AS (SELECT *, regexp_extract(name, '(\\.[^./]*)$', 1) AS ext, regexp_replace(name, '\\.[^./]*$', '') AS stem FROM named)"""

#: fixed values: codecs and colour labels of the QC binding
CODECS = ("av1", "AV01", "hevc", "", "libaom-av1")


# validation facts: an order each, with unknowns
def facts(spark, d) -> DataFrame:
    k = c("o_orderkey")
    secs = F.floor("o_totalprice") / 4
    maybe = lambda on, v: F.when(on, v)
    return read(spark, d, "orders").select(
        k.alias("file_id"), _dealt(CODECS, k).alias("codec"), maybe(k % 4 != 0, by_value(k % 3, {0: 8, 1: 10}, 12)).alias("depth_mediainfo"), maybe(k % 5 != 0, by_value(k % 2, {0: 8}, 10)).alias("depth_probe"),
        lit(1920).alias("expected_w"), lit(800).alias("expected_h"), F.when(k % 11 == 0, 1918).otherwise(1920).alias("actual_w"), lit(800).alias("actual_h"),
        secs.alias("expected_secs"), (secs + by_value(k % 6, {0: 0.0, 1: 0.0625, 2: -0.125, 3: 1.0, 4: 1.25}, 0.0)).alias("actual_secs"),
        maybe(k % 7 != 0, k % 2 == 0).alias("expected_hdr"), maybe(k % 9 != 0, k % 4 < 2).alias("actual_hdr"),
        F.when(k % 10 == 0, F.array().cast("array<string>")).when(k % 10 == 1, F.array(lit("opus"), lit("aac"))).when(k % 10 == 2, lit(None)).otherwise(F.array(lit("Opus"), lit("opus"))).alias("codecs"),
        maybe(k % 13 != 0, lit(2)).alias("expected_tracks"),
    )


FACTS = f"""facts AS (SELECT k AS file_id, ({_list(CODECS)})[CAST(k % {len(CODECS)} + 1 AS INT)] AS codec, CASE WHEN k % 4 <> 0 THEN CASE k % 3 WHEN 0 THEN 8 WHEN 1 THEN 10 ELSE 12 END END AS depth_mediainfo,
 CASE WHEN k % 5 <> 0 THEN CASE k % 2 WHEN 0 THEN 8 ELSE 10 END END AS depth_probe, 1920 AS expected_w, 800 AS expected_h, CASE WHEN k % 11 = 0 THEN 1918 ELSE 1920 END AS actual_w, 800 AS actual_h,
 floor(o_totalprice) / 4 AS expected_secs, floor(o_totalprice) / 4 + CASE k % 6 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.0625::DOUBLE WHEN 2 THEN -0.125::DOUBLE WHEN 3 THEN 1.0::DOUBLE WHEN 4 THEN 1.25::DOUBLE ELSE 0.0::DOUBLE END AS actual_secs,
 CASE WHEN k % 7 <> 0 THEN k % 2 = 0 END AS expected_hdr, CASE WHEN k % 9 <> 0 THEN k % 4 < 2 END AS actual_hdr,
 CASE WHEN k % 10 = 0 THEN CAST([] AS VARCHAR[]) WHEN k % 10 = 1 THEN ['opus', 'aac'] WHEN k % 10 = 2 THEN NULL ELSE ['Opus', 'opus'] END AS codecs, CASE WHEN k % 13 <> 0 THEN 2 END AS expected_tracks
 FROM (SELECT *, o_orderkey AS k FROM orders)),
 gaps AS (SELECT *, abs(actual_secs - expected_secs) AS gap, coalesce(depth_mediainfo, depth_probe, 10) AS depth FROM facts),
 verdicts AS (SELECT file_id, codec, contains(lower(codec), 'av1') OR contains(lower(codec), 'av01') AS is_av1, depth >= 10 AS is_10bit, CAST(depth AS BIGINT) AS depth,
 expected_w = actual_w AND expected_h = actual_h AS is_crop_correct, gap <= 1.0 AS is_duration_correct,
 coalesce(expected_hdr = actual_hdr, actual_hdr IS NOT NULL) AS is_hdr_correct, coalesce(len(list_filter(codecs, lambda x: lower(x) <> 'opus')) = 0, true) AS is_audio_opus,
 coalesce(len(codecs) = expected_tracks, true) AS is_track_count_correct, gap * 1000 <= 100 AS is_sync_preserved,
 CASE WHEN expected_hdr = actual_hdr THEN CASE WHEN actual_hdr THEN 'HDR preserved' ELSE 'SDR preserved' END
 WHEN expected_hdr <> actual_hdr THEN CASE WHEN expected_hdr THEN 'Expected HDR, found SDR' ELSE 'Expected SDR, found HDR' END
 WHEN actual_hdr IS NOT NULL THEN CASE WHEN actual_hdr THEN 'Output is HDR' ELSE 'Output is SDR' END
 WHEN expected_hdr IS NOT NULL THEN CASE WHEN expected_hdr THEN 'Expected HDR, but could not detect HDR status' ELSE 'Expected SDR, but could not detect HDR status' END
 ELSE 'Could not detect HDR status' END AS hdr_message FROM gaps),
 results AS (SELECT verdicts.*, [CASE WHEN is_av1 THEN concat('AV1 (', verdicts.codec, ')') WHEN verdicts.codec <> '' THEN concat('Expected AV1, got ', verdicts.codec) ELSE 'Unknown codec' END, concat(CAST(verdicts.depth AS VARCHAR), '-bit'),
 CASE WHEN is_crop_correct THEN 'Dimensions match: ' || actual_w || 'x' || actual_h ELSE 'Dimension mismatch: got ' || actual_w || 'x' || actual_h || ', expected ' || expected_w || 'x' || expected_h END,
 CASE WHEN is_duration_correct THEN printf('Duration matches input (%.1fs)', actual_secs) ELSE printf('Duration mismatch: got %.1fs, expected %.1fs (diff: %.1fs)', actual_secs, CAST(expected_secs AS DOUBLE), gap) END, hdr_message,
 CASE WHEN codecs IS NULL THEN 'Failed to get audio info' WHEN len(codecs) = 0 THEN 'No audio tracks' WHEN is_audio_opus THEN len(codecs) || ' audio tracks, all Opus' ELSE len(codecs) || ' audio tracks: ' || lower(array_to_string(codecs, ', ')) END,
 CASE WHEN is_sync_preserved THEN printf('Audio/video sync preserved (drift: %.1fms)', gap * 1000) ELSE printf('Audio/video sync drift too large: %.1fms (max: 100.0ms)', gap * 1000) END] AS details FROM verdicts JOIN gaps USING (file_id))"""
