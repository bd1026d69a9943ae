"""Clip tables: public and internal columns apart, files that may be broken, result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_clips(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Clips and rejects (path, text) of JSON files, each a list of clips. Broken files are
    rejects and empty ones give nothing at all; neither is an error."""
    return parse_clips(spark.read.option("wholetext", "true").text(path).select("value", F.col("_metadata.file_path").alias("path")), schema)


def parse_clips(files: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """As ``read_clips`` for documents (path, value)."""
    parsed = files.withColumn("_c", F.from_json("value", T.ArrayType(schema)))
    good = F.col("_c").isNotNull() & F.trim("value").startswith("[") & F.trim("value").endswith("]")
    clips = parsed.where(good).select("path", F.posexplode("_c").alias("clip_ord", "c")).select("path", "clip_ord", "c.*")
    return clips, parsed.where(~good).select("path", F.col("value").alias("text"))


def public_columns(clips: DataFrame) -> DataFrame:
    return clips.select(*[c for c in clips.columns if not c.startswith("_")])


def internal_columns(clips: DataFrame, keys: list[str]) -> DataFrame:
    return clips.select(*keys, *[c for c in clips.columns if c.startswith("_") and c not in keys])


def save_clips(clips: DataFrame, path: str, keys: list[str]) -> None:
    """Two tables: public columns, and internal ones by ``keys``."""
    public_columns(clips).write.mode("overwrite").parquet(f"{path}/clips")
    internal_columns(clips, keys).write.mode("overwrite").parquet(f"{path}/internal")


def load_clips(spark: SparkSession, path: str, keys: list[str], with_internal: bool = True) -> DataFrame:
    """Clips with their internal columns attached by ``keys``; null where the internal side has no row."""
    clips = spark.read.parquet(f"{path}/clips")
    return clips.join(spark.read.parquet(f"{path}/internal"), keys, "left") if with_internal else clips


def best_and_all(clips: DataFrame, path: str) -> None:
    """JSON of every video's best clip (rank 1) and of all."""
    clips.where("rank = 1").write.mode("overwrite").json(f"{path}/best_clip")
    clips.write.mode("overwrite").json(f"{path}/all_clips")


def file_rank(name: F.Column) -> F.Column:
    """Rank in a name that starts with rankNN_; null in others."""
    return F.regexp_extract(name, r"^rank(\d{2,})_", 1).try_cast("int")


def attach_files(files: DataFrame, clips: DataFrame) -> DataFrame:
    """Output files (video_id, name, length) with their clip by rank; other files stay without one."""
    own = files.withColumns({"rank": file_rank(F.col("name")), "size_mb": F.round(F.col("length") / 1048576, 1)})
    return own.join(clips, ["video_id", "rank"], "left")


def cut_list(clips: DataFrame, pad: float = 0.35) -> DataFrame:
    """video_id, clip_ord, cut_start, cut_end: what to cut out of the media."""
    return clips.select("video_id", "clip_ord", F.greatest(F.lit(0.0), F.col("start") - pad).alias("cut_start"), (F.col("end") + pad).alias("cut_end"))


def full_video_clips(videos: DataFrame, segs: DataFrame) -> DataFrame:
    """One clip a video over all of it, from its first segment, with full scores. ``videos`` has duration."""
    first = segs.groupBy("video_id").agg(F.min_by("start", "seg_id").alias("_s"))
    own = videos.join(first, "video_id", "left")
    start = F.least(F.greatest(F.coalesce("_s", F.lit(0.0)), F.lit(0.0)), "duration")
    scores = {f"score_{p}": F.lit(100) for p in ("emotion", "hook", "retention", "personality")}
    return own.select("video_id", F.lit(0).alias("clip_ord"), start.alias("start"), F.col("duration").alias("end")).withColumns(
        scores | {"clip_score": F.lit(100.0), "rank": F.lit(1)}
    )
