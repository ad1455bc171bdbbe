"""Chunk planning: fixed intervals of frames, scenes, resuming and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.paths import chunk_file

#: fixed value: chunks merged at once; more go in batches of this size
MERGE_BATCH = 500


def frames_per_chunk(fps_num: Column, fps_den: Column, seconds: Column) -> Column:
    """Whole frames of an interval, 1 at least; null without a frame rate."""
    fps = fps_num.cast("double") / F.when(fps_den != 0, fps_den).cast("double")
    return F.greatest(F.lit(1), F.floor(fps * seconds)).cast("bigint")


def boundaries(total: Column, fps_num: Column, fps_den: Column, seconds: Column) -> Column:
    """Array of interval starts; [0] without frames or frame rate."""
    usable = (fps_den != 0) & (total > 0)
    step = F.when(usable, frames_per_chunk(fps_num, fps_den, seconds)).otherwise(F.lit(1).cast("bigint"))
    last = F.when(usable, total - 1).otherwise(F.lit(0)).cast("bigint")
    return F.sequence(F.lit(0).cast("bigint"), last, step)


def plan_chunks(videos: DataFrame, seconds: Column) -> DataFrame:
    """(file_id, idx, start_frame, end_frame) half-open chunks of each video.

    A row's own boundaries give its chunks, so there is no shuffle: the end is
    the next start, the last end the total.  Videos without frames have none.
    """
    b = boundaries(F.col("total_frames"), F.col("fps_num"), F.col("fps_den"), seconds)
    cut = videos.where("total_frames > 0").select("file_id", "total_frames", b.alias("b"))
    return cut.select("file_id", "total_frames", "b", F.posexplode("b").alias("idx", "start_frame")).select(
        "file_id", F.col("idx").cast("bigint").alias("idx"), "start_frame",
        F.coalesce(F.try_element_at("b", F.col("idx") + 2), F.col("total_frames")).alias("end_frame"),
    )


def scenes_from_boundaries(points: DataFrame, totals: DataFrame) -> DataFrame:
    """Scenes from boundary rows (file_id, frame) and (file_id, total_frames).

    0 is added where missing, order and repeats do not matter; each scene ends
    where the next starts, and empty ones go.
    """
    all_points = points.select("file_id", "frame").unionByName(totals.select("file_id", F.lit(0).cast("bigint").alias("frame"))).distinct()
    per = Window.partitionBy("file_id").orderBy("frame")
    scenes = (
        all_points.join(totals, "file_id")
        .withColumn("end_frame", F.coalesce(F.lead("frame").over(per), F.col("total_frames")))
        .where("frame < end_frame")
    )
    return scenes.select("file_id", (F.row_number().over(per) - 1).cast("bigint").alias("idx"), F.col("frame").alias("start_frame"), "end_frame")


def scene_validity(scenes: DataFrame, most: int = 1000) -> DataFrame:
    """Whether a file's scenes are all between 1 frame and 30 seconds, 1000
    frames at most; needs fps_num and fps_den."""
    fps = F.col("fps_num").cast("double") / F.when(F.col("fps_den") != 0, F.col("fps_den")).cast("double")
    limit = F.when(fps.isNotNull(), F.least(F.floor(fps * 30), F.lit(most)))
    length = F.col("end_frame") - F.col("start_frame")
    ok = F.coalesce((length >= 1) & (length <= limit), F.lit(False))
    return scenes.groupBy("file_id").agg(F.count("*").alias("n_scenes"), F.max(length).alias("longest"), F.every(ok).alias("valid"))


def dedupe_sorted(values: Column) -> Column:
    """Adjacent repeats of a sorted array removed."""
    return F.filter(values, lambda v, i: (i == 0) | (v != F.try_element_at(values, F.greatest(i, F.lit(1)))))


def coverage(chunks: DataFrame) -> DataFrame:
    """Per file: chunk and frame counts and whether the chunks are contiguous."""
    per = Window.partitionBy("file_id").orderBy("idx")
    joined = chunks.withColumn("gap", F.col("start_frame") - F.lag("end_frame", 1, 0).over(per))
    return joined.groupBy("file_id").agg(
        F.count("*").alias("n_chunks"), F.sum(F.col("end_frame") - F.col("start_frame")).alias("frames"),
        F.max("end_frame").alias("last_end"), F.every(F.col("gap") == 0).alias("contiguous"),
    )


def average_chunk(chunks: DataFrame, videos: DataFrame) -> DataFrame:
    """Mean frames and seconds of each file's chunks."""
    per = chunks.groupBy("file_id").agg(F.count("*").alias("n_chunks"), F.sum(F.col("end_frame") - F.col("start_frame")).alias("frames"))
    fps = F.col("fps_num").cast("double") / F.col("fps_den").cast("double")
    avg = F.col("frames").cast("double") / F.col("n_chunks")
    return per.join(videos.select("file_id", "fps_num", "fps_den"), "file_id").select("file_id", "n_chunks", avg.alias("avg_frames"), (avg / fps).alias("avg_secs"))


def frame_rows(chunks: DataFrame) -> DataFrame:
    """One row per frame of each chunk."""
    return chunks.select("file_id", "idx", F.explode(F.sequence("start_frame", F.col("end_frame") - 1)).alias("frame"))


def remaining(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks that the resume log has not."""
    return chunks.join(done.select("file_id", "idx").distinct(), ["file_id", "idx"], "left_anti")


def resume_totals(done: DataFrame) -> DataFrame:
    """Bytes and frames done; repeated log lines count each time, the set of
    chunks once."""
    return done.groupBy("file_id").agg(F.sum("size").alias("bytes_done"), F.sum("frames").alias("frames_done"), F.count("*").alias("n_lines"), F.count_distinct("idx").alias("n_chunks"))


def plan_merges(videos: DataFrame, seconds: Column, batch: int = MERGE_BATCH) -> DataFrame:
    """What ``merge_batches`` gives for all chunks of planned videos, from each
    video's own row: no shuffle."""
    n = F.size(boundaries(F.col("total_frames"), F.col("fps_num"), F.col("fps_den"), seconds)).cast("bigint")
    few = F.greatest(F.col("n"), F.lit(1)) <= batch
    cut = videos.where("total_frames > 0").select("file_id", n.alias("n"))
    each = cut.select("file_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(few, F.lit(0)).otherwise(F.ceil(F.col("n") / batch) - 1))).alias("batch"))
    first, last = F.col("batch") * batch, F.when(few, F.col("n")).otherwise(F.least(F.col("n"), (F.col("batch") + 1) * batch)) - 1
    lines = F.transform(F.sequence(first, last), lambda i: F.concat(F.lit("file '"), chunk_file(i), F.lit("'")))
    return each.select("file_id", "batch", (last - first + 1).alias("n_chunks"), first.alias("first_idx"), last.alias("last_idx"), F.array_join(lines, "\n").alias("list_text"))


def merge_batches(chunks: DataFrame, batch: int = MERGE_BATCH) -> DataFrame:
    """Per file and merge batch: its chunks and the list file's text, in order."""
    k = Window.partitionBy("file_id")
    b = chunks.withColumn("n", F.count("*").over(k)).withColumn("batch", F.when(F.col("n") > batch, F.floor(F.col("idx") / batch)).otherwise(F.lit(0)).cast("bigint"))
    line = F.concat(F.lit("file '"), chunk_file(F.col("idx")), F.lit("'"))
    return b.groupBy("file_id", "batch").agg(
        F.count("*").alias("n_chunks"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))), lambda s: s["line"]), "\n").alias("list_text"),
    )


def next_chunk(ready: DataFrame, done: DataFrame) -> DataFrame:
    """Per file the ready chunk nearest to a finished one, the lower on ties;
    the lowest where none is finished.

    The nearest finished chunk is the last one before or the first one after in
    index order: one window each way instead of all pairs.
    """
    rows = ready.select("file_id", "idx", F.lit(False).alias("fin")).unionByName(done.select("file_id", "idx").distinct().withColumn("fin", F.lit(True)))
    up = Window.partitionBy("file_id").orderBy("idx")
    mark = F.when(F.col("fin"), F.col("idx"))
    near = (
        rows.withColumn("below", F.last(mark, True).over(up.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("above", F.first(mark, True).over(up.rowsBetween(0, Window.unboundedFollowing)))
        .where("not fin")
        .withColumn("dist", F.least(F.col("idx") - F.col("below"), F.col("above") - F.col("idx")))
    )
    best = F.min(F.struct(F.coalesce("dist", F.lit(0)).alias("dist"), F.col("idx")))
    return near.groupBy("file_id").agg(F.count("*").alias("n_ready"), best["idx"].alias("next_idx"), F.min("dist").alias("dist"))


def greedy_order(ready: list[int], done: list[int]) -> list[int]:
    """``ready`` in the order of picks: nearest to a finished chunk, the lower on
    ties, each pick finished for the next.  The nearest is always beside a
    finished one, so a heap of such neighbours does: n log n."""
    import heapq

    at = sorted({*ready, *done})
    place = {x: k for k, x in enumerate(at)}
    left, right = list(range(-1, len(at) - 1)), list(range(1, len(at) + 1))  # unfinished neighbours; finished ones are linked out
    heap: list[tuple[int, int]] = []

    def finish(x: int) -> None:
        k = place[x]
        a, b = left[k], right[k]
        if a >= 0:
            right[a] = b
            heapq.heappush(heap, (x - at[a], at[a]))
        if b < len(at):
            left[b] = a
            heapq.heappush(heap, (at[b] - x, at[b]))

    ended = set(done)
    order: list[int] = []
    for x in sorted(ended):
        finish(x)
    if not ended and at:
        heap.append((0, at[0]))
    while heap:
        _, x = heapq.heappop(heap)
        if x not in ended:
            ended.add(x)
            order.append(x)
            finish(x)
    return order


def dispatch_order(ready: DataFrame, done: DataFrame) -> DataFrame:
    """The whole greedy order (file_id, turn, idx): each pick counts as done
    for the next.  Picks depend on earlier ones, so a file's chunks, a few
    thousand numbers at most, are ordered together."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = greedy_order(pdf.loc[~pdf.fin, "idx"].tolist(), pdf.loc[pdf.fin, "idx"].tolist())
        return pd.DataFrame({"file_id": pdf.file_id.iloc[0], "turn": range(len(order)), "idx": order})

    rows = ready.select("file_id", "idx", F.lit(False).alias("fin")).unionByName(done.select("file_id", "idx").withColumn("fin", F.lit(True)))
    return rows.groupBy("file_id").applyInPandas(run, "file_id bigint, turn bigint, idx bigint")


def running_totals(results: DataFrame) -> DataFrame:
    """Chunks, frames and bytes so far, in order of arrival (file_id, ord)."""
    so_far = Window.partitionBy("file_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return results.withColumns({"chunks_complete": F.count("*").over(so_far), "frames_complete": F.sum("frames").over(so_far), "bytes_complete": F.sum("size").over(so_far)})
