"""Media folders and raw audio: catalogs of files, PCM to RMS windows, batch summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeweave.functions.text import split_log
from timeweave.sources import pcm

# Endings of video files.
EXTENSIONS = ("mp4", "mov", "avi", "mkv", "webm", "flv", "m4v")


def media_catalog(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, name, stem, length, modified of the media files in a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    own = files.select("path", name.alias("name"), "length", F.col("modificationTime").alias("modified"))
    own = own.where(F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(*extensions))
    return own.withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", ""))


def pcm_windows(spark: SparkSession, path: str, per_window: int = 8000, split_bytes: int = 64 << 20) -> DataFrame:
    """video_id (file stem), win_idx, rms of raw s16le mono files. A tail shorter than a window is left out.

    Tasks read ranges of whole windows, some ``split_bytes`` each, so a recording of any length is cut among them,
    no file is a cell and no row holds a sample.
    """
    pcm.register(spark)
    return spark.read.format("pcm_windows").option("per_window", per_window).option("split_bytes", split_bytes).load(path)


def write_pcm(parts: DataFrame, path: str, order: str) -> None:
    """Write recordings given as parts (video_id, ``order``, content: bytes of whole samples) as a file each.
    One task streams the parts of a recording, as a file has one writer; null parts are empty."""
    pcm.register(parts.sparkSession)
    own = parts.select(F.col("video_id").cast("string"), order, "content").where("video_id is not null")
    own = own.repartition("video_id").sortWithinPartitions("video_id", order).select("video_id", "content")
    own.write.format("pcm_windows").mode("append").save(path)


def files_by_name(catalog: DataFrame) -> DataFrame:
    """``catalog`` with place: files of a folder from 1 in order of their names, then paths."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return catalog.withColumn("place", F.row_number().over(Window.partitionBy(folder).orderBy("name", "path")))


def folder_results(catalog: DataFrame, clips: DataFrame) -> DataFrame:
    """source_video, n_clips, ok of every file of ``catalog`` (stem): ok if the run left clips (source_video)."""
    made = clips.groupBy(F.col("source_video").alias("stem")).agg(F.count("*").alias("n_clips"))
    own = catalog.select("stem").join(made, "stem", "left")
    return own.select(F.col("stem").alias("source_video"), F.coalesce("n_clips", F.lit(0)).alias("n_clips"), F.col("n_clips").isNotNull().alias("ok"))


def batch_summary(results: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """processed, failed and failed_videos of (source_video, ok), for each of ``keys`` if there are any; the
    failed are listed in order."""
    return results.groupBy(*keys).agg(
        F.count_if("ok").alias("processed"), F.count_if(~F.col("ok")).alias("failed"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("source_video")))).alias("failed_videos")
    )


def recent_lines(logs: DataFrame, n: int = 2000) -> DataFrame:
    """The last ``n`` lines of each job's log (job_id, line_no, line), with level and message."""
    w = Window.partitionBy("job_id").orderBy(F.col("line_no").desc())
    level, message = split_log(F.col("line"))
    return logs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r").withColumns({"level": level, "message": message})
