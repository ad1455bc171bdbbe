"""Readers: media folders, probe documents, boundary files, resume logs, crop
detector output; and sinks for the same formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.paths import base_name, extension, is_video, is_visible, stem

_DISPOSITION = "default dub original comment lyrics karaoke forced hearing_impaired visual_impaired clean_effects attached_pic timed_thumbnails".split()

#: probe document: absent keys become null and are coalesced where used
PROBE = (
    "format struct<duration string>, streams array<struct<codec_type string, codec_name string, profile string, width bigint, height bigint, "
    "channels bigint, nb_frames string, pix_fmt string, color_primaries string, color_transfer string, color_space string, bits_per_raw_sample string, "
    f"disposition struct<{', '.join(f'`{d}`: int' for d in _DISPOSITION)}>>>"
)
#: MediaInfo document: a superset of its video and audio tracks
MEDIAINFO = (
    "media struct<track array<struct<`@type`: string, Format: string, Width: string, Height: string, Duration: string, BitDepth: string, ColorSpace: string, "
    "ChromaSubsampling: string, colour_range: string, colour_primaries: string, transfer_characteristics: string, matrix_coefficients: string, Channels: string, SamplingRate: string, BitRate: string>>>"
)


def find_videos(files: DataFrame) -> DataFrame:
    """Visible video files of a listing (path, length), in no order."""
    name = base_name(F.col("path"))
    out = files.withColumn("name", name).where(is_visible(F.col("name")) & is_video(F.col("name")))
    return out.select("path", "name", stem(F.col("name")).alias("stem"), F.lower(extension(F.col("name"))).alias("ext"), "length")


def in_order(videos: DataFrame) -> DataFrame:
    """Videos by lower-cased name, for who shows or runs them in turn."""
    return videos.orderBy(F.lower("name"), "path")


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of a folder's files, one level, from Hadoop's listing, so
    that empty files and names with an underscore are there too."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(conf).listStatus(path)
    rows = [(s.getPath().toUri().getPath(), s.getLen()) for s in found if s.isFile()]
    return spark.createDataFrame(rows, "path string, length bigint")


def find_videos_in(spark: SparkSession, folder: str) -> DataFrame:
    out = in_order(find_videos(list_folder(spark, folder)))
    if out.isEmpty():
        raise ValueError(f"no video files in {folder}")
    return out


def skip_existing(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """Planned outputs (output) that no listed path is."""
    return planned.join(existing.select(F.col("path").alias("output")).distinct(), "output", "left_anti")


def parse_probe(raw: DataFrame) -> DataFrame:
    """(file_id, doc) from (file_id, json)."""
    schema = T.StructType.fromDDL(PROBE)
    return raw.select("file_id", F.from_json("json", schema).alias("doc"))


def parse_mediainfo(raw: DataFrame) -> DataFrame:
    """(file_id, video, audio): track arrays, told apart by @type; other tracks
    are left out."""
    doc = raw.select("file_id", F.from_json("json", T.StructType.fromDDL(MEDIAINFO)).alias("d"))
    return doc.select("file_id", F.filter(F.col("d.media.track"), lambda t: t["@type"] == "Video").alias("video"), F.filter(F.col("d.media.track"), lambda t: t["@type"] == "Audio").alias("audio"))


def mediainfo_channels(docs: DataFrame) -> DataFrame:
    """(file_id, channels): channel counts of the audio tracks that tell one, in
    track order; needs the columns of ``parse_mediainfo``."""
    told = F.transform(F.col("audio"), lambda t: F.when(t["Channels"].rlike(r"^\d+$"), t["Channels"].try_cast("bigint")))
    return docs.select("file_id", F.filter(told, lambda n: n.isNotNull() & (n <= 2**32 - 1)).alias("channels"))


def streams_of(doc: Column, kind: str) -> Column:
    return F.filter(doc["streams"], lambda s: s["codec_type"] == kind)


def video_properties(docs: DataFrame) -> DataFrame:
    """First video stream of each document, with why it cannot be used."""
    v = F.try_element_at(streams_of(F.col("doc"), "video"), F.lit(1))
    text = F.coalesce(F.col("doc.format.duration"), F.lit(""))
    secs = F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double"))
    frames = F.when(F.coalesce(v["nb_frames"], F.lit("")).rlike(r"^\d+$"), v["nb_frames"].try_cast("bigint"))
    width, height = F.coalesce(v["width"], F.lit(0)), F.coalesce(v["height"], F.lit(0))
    error = F.when(v.isNull(), F.lit("no video stream")).when((width <= 0) | (height <= 0), F.lit("invalid dimensions")).when(secs.isNull(), F.lit("invalid duration"))
    return docs.select(
        "file_id", width.alias("width"), height.alias("height"), secs.alias("duration_secs"), F.coalesce(frames, F.lit(0)).alias("total_frames"),
        F.coalesce(v["codec_name"], F.lit("")).alias("codec_name"), F.coalesce(v["pix_fmt"], F.lit("")).alias("pix_fmt"),
        v["color_primaries"].alias("color_primaries"), v["color_transfer"].alias("color_transfer"), v["color_space"].alias("color_space"), error.alias("error"),
    )


def audio_streams(docs: DataFrame) -> DataFrame:
    """One row per audio stream with channels, numbered after that filter."""
    rows = F.posexplode(F.filter(streams_of(F.col("doc"), "audio"), lambda s: F.coalesce(s["channels"], F.lit(0)) > 0)).alias("idx", "s")
    return docs.select("file_id", rows).select("file_id", F.col("idx").cast("bigint").alias("idx"), F.col("s.channels").alias("channels"), F.coalesce("s.codec_name", F.lit("")).alias("codec_name"), F.coalesce("s.profile", F.lit("")).alias("profile"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


def parse_resume(lines: DataFrame) -> DataFrame:
    """(idx, frames, size) of log lines; those without exactly three numbers
    are skipped."""
    parts = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    kept = lines.select("*", parts.alias("p")).where(F.size("p") == 3)
    number = lambda i: F.when(F.col("p")[i].rlike(r"^[+-]?\d+$"), F.col("p")[i].try_cast("bigint"))
    rest = [c for c in lines.columns if c != "line"]
    return kept.select(*rest, number(0).alias("idx"), number(1).alias("frames"), number(2).alias("size")).where("idx is not null and frames is not null and size is not null")


def parse_boundaries(lines: DataFrame) -> DataFrame:
    """Frame numbers of non-blank lines; a bad line fails the query."""
    rest = [c for c in lines.columns if c != "line"]
    return lines.where(F.trim("line") != "").select(*rest, F.trim("line").cast("bigint").alias("frame"))


def write_boundaries(points: DataFrame, path: str) -> None:
    """One number a line; a table that is there stays."""
    points.orderBy("frame").select(F.col("frame").cast("string")).coalesce(1).write.mode("ignore").text(path)


def append_resume(done: DataFrame, path: str) -> None:
    done.select(F.concat_ws(" ", "idx", "frames", "size")).write.mode("append").text(path)


def write_list(batches: DataFrame, path: str) -> None:
    batches.select("list_text").write.mode("overwrite").text(path)


def work_folder_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def make_work_folder(spark: SparkSession, path: str) -> None:
    """A work folder with its place for chunks."""
    fs, p = _fs(spark, f"{path}/encode")
    fs.mkdirs(p)


def remove_work_folder(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def free_space(spark: SparkSession, path: str) -> int:
    """Bytes free where ``path`` is; 0 where that cannot be told."""
    fs, p = _fs(spark, path)
    return max(0, fs.getStatus(p).getRemaining())


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def ordered_union(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts, by part and their own order (column ord)."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("part", F.lit(k))
        out = p if out is None else out.unionByName(p)
    return out.orderBy("part", "ord")


def stale(files: DataFrame, prefix: str, now: Column, hours: int) -> DataFrame:
    """Files (path, modified) of a name prefix older than so many hours."""
    return files.where(base_name(F.col("path")).startswith(prefix) & (F.col("modified") < now - F.make_interval(hours=F.lit(hours))))


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
