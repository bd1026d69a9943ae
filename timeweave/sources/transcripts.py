"""Transcript documents: JSON files in two shapes, read to rows and written back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from timeweave.operators.transcript import is_non_speech

SEGMENT = "struct<start: double, end: double, text: string, words: array<struct<word: string, start: double, end: double>>, no_speech_prob: double, non_speech_event: boolean>"
WRAPPED = f"struct<segments: array<{SEGMENT}>, language_info: struct<language: string, language_probability: double>>"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """The segments of the transcript files in a folder; video_id is a file's name without ending."""
    files = spark.read.option("wholetext", "true").text(path).select("value", F.col("_metadata.file_name").alias("_f"))
    return parse_transcripts(files.select(F.regexp_replace("_f", r"\.[^.]*$", "").alias("video_id"), "value"))


def parse_transcripts(files: DataFrame) -> DataFrame:
    """video_id, language, language_probability, seg_id and the segment's fields of documents (video_id, value).

    A document is an object with segments and language_info, or the bare list; without language_info the
    language is ``unknown`` with probability 0. Documents that are neither, or empty, give no rows.
    """
    wrapped = F.from_json("value", WRAPPED)
    bare = F.from_json("value", f"array<{SEGMENT}>")
    is_list = F.ltrim("value").startswith("[")
    own = files.select(
        "video_id",
        F.when(is_list, bare).otherwise(wrapped["segments"]).alias("segments"),
        F.coalesce(F.when(~is_list, wrapped["language_info"]["language"]), F.lit("unknown")).alias("language"),
        F.coalesce(F.when(~is_list, wrapped["language_info"]["language_probability"]), F.lit(0.0)).alias("language_probability"),
    )
    rows = own.select("video_id", "language", "language_probability", F.posexplode("segments").alias("seg_id", "s"))
    out = rows.select("video_id", "language", "language_probability", "seg_id", "s.*")
    return out.withColumn("non_speech_event", F.coalesce("non_speech_event", is_non_speech(F.col("text"))))


def write_transcripts(segs: DataFrame, path: str, buckets: int = 64) -> None:
    """One JSON row a segment, in ``buckets`` folders by hash of video_id, a video whole in one of them."""
    own = segs.withColumn("bucket", F.pmod(F.xxhash64("video_id"), F.lit(buckets)))
    own.repartition("bucket").sortWithinPartitions("bucket", "video_id").write.partitionBy("bucket").mode("overwrite").json(path)


def load_transcripts(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Segments as ``write_transcripts`` has written them."""
    return spark.read.schema(schema).json(path).select(*schema.names)


def explode_words(segs: DataFrame) -> DataFrame:
    """video_id, seg_id, word_pos, word, w_start, w_end, seg_start, seg_end of segments with words."""
    rows = segs.select("video_id", "seg_id", F.col("start").alias("seg_start"), F.col("end").alias("seg_end"), F.posexplode("words").alias("word_pos", "w"))
    return rows.select("video_id", "seg_id", "word_pos", "w.word", F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), "seg_start", "seg_end")


def transcript_durations(segs: DataFrame) -> DataFrame:
    """video_id, duration: the end of the last segment."""
    return segs.groupBy("video_id").agg(F.max_by("end", "seg_id").alias("duration"))
