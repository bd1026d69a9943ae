"""Merging a model's rewrites back into clips, and which language to ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEXT_FIELDS = ("title", "topic", "caption", "hook", "closing_line", "comment_bait", "social_description")
# Ways to ask for the language of the transcript.
KEEP_LANGUAGE = ("none", "auto", "source", "keep", "keep-original", "keep_original", "original")
# Names of two target languages.
ENGLISH = ("en", "english")
INDONESIAN = ("id", "indonesian", "bahasa", "bahasa indonesia")


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def target_language(option: Column) -> Column:
    """auto, or a lower-case language; en if nothing is given."""
    low = F.lower(F.trim(option))
    keep = (low == "") | low.isin(*KEEP_LANGUAGE)
    return F.when(option.isNull() | (option == ""), "en").when(keep, "auto").otherwise(low)


def target_label(option: Column) -> Column:
    """The language's name for a prompt; unknown ones as they are."""
    low = F.lower(F.trim(option))
    return F.when(low.isin(*ENGLISH), "English").when(low.isin(*INDONESIAN), "Indonesian").otherwise(F.trim(option))


def should_translate(language: Column, probability: Column) -> Column:
    """False only for English that was recognised with more than 0.6."""
    return ~((F.coalesce(F.lower(language), F.lit("")) == "en") & (F.coalesce(probability, F.lit(0.0)) > 0.6))


def refine_prompt_key(option: Column, language: Column, probability: Column) -> Column:
    """Prompt section: keep the language; improve what is English already; or translate."""
    target = target_language(option)
    english = F.when(should_translate(language, probability), "refine_to_english").otherwise("improve")
    return F.when(target == "auto", "refine_keep").when(target.startswith("en"), english).otherwise("refine_to_target")


def merge_refined(clips: DataFrame, refined: DataFrame, fields: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """Full join on (video_id, clip_id): a field is overwritten by what is not blank; rows of either side
    alone stay. Ranked anew by clip_score falling, then the old rank, then clip_id."""
    new = refined.select("video_id", "clip_id", *(F.col(f).alias(f"_{f}") for f in fields))
    out = clips.join(new, ["video_id", "clip_id"], "full_outer")
    out = out.withColumns({f: F.coalesce(blank_to_null(F.col(f"_{f}")), F.col(f)) for f in fields}).drop(*(f"_{f}" for f in fields))
    w = Window.partitionBy("video_id").orderBy(F.col("clip_score").desc_nulls_last(), F.col("rank").asc_nulls_last(), "clip_id")
    return out.withColumn("rank", F.row_number().over(w))


def refine_clips(clips: DataFrame, parsed: DataFrame, fields: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """Rewrites of a model merged into ``clips``: only a reply that was read as a list of objects (``parsed``:
    video_id, status, items) counts, and only its objects with a whole clip_id; videos whose reply failed
    keep their clips as they are, ranked anew like all."""
    schema = "clip_id string, " + ", ".join(f"{f} string" for f in fields)
    rows = parsed.where("status != 'failed'").select("video_id", F.explode("items").alias("_item"))
    rows = rows.select("video_id", F.from_json("_item", schema).alias("_f")).select("video_id", "_f.*")
    rows = rows.withColumn("clip_id", F.col("clip_id").try_cast("long")).where("clip_id is not null")
    return merge_refined(clips, rows.dropDuplicates(["video_id", "clip_id"]), fields)


def update_fields(clips: DataFrame, changes: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Left join on (video_id, clip_id): a field is overwritten where the change has it, blank or not.
    ``changes`` holds field and value rows, so that a blank value differs from a missing one."""
    given = changes.groupBy("video_id", "clip_id").pivot("field", list(fields)).agg(F.first(F.struct("value")))
    out = clips.join(given.select("video_id", "clip_id", *(F.col(f).alias(f"_{f}") for f in fields)), ["video_id", "clip_id"], "left")
    return out.withColumns({f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.value")).otherwise(F.col(f)) for f in fields}).drop(*(f"_{f}" for f in fields))


def keep_answered(clips: DataFrame, answer: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Right join: clips that the answer (with answer_ord) left out are gone; ranks follow the answer."""
    new = answer.select("video_id", "clip_id", "answer_ord", *(F.col(f).alias(f"_{f}") for f in fields))
    out = clips.join(new, ["video_id", "clip_id"], "right")
    out = out.withColumns({f: F.coalesce(blank_to_null(F.col(f"_{f}")), F.col(f)) for f in fields}).drop(*(f"_{f}" for f in fields))
    w = Window.partitionBy("video_id").orderBy("answer_ord", "clip_id")
    return out.withColumn("rank", F.row_number().over(w)).drop("answer_ord")


def single_metadata(videos: DataFrame, generated: DataFrame, required: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """Metadata of one clip a video: the user's title and caption (user_title, user_caption) win over the
    generated; ``missing`` lists required fields that nobody filled."""
    out = videos.join(generated, "video_id", "left")
    out = out.withColumns({f: F.coalesce(blank_to_null(F.col(f"user_{f}")), F.col(f)) for f in ("title", "caption")})
    gaps = F.array_compact(F.array(*(F.when(blank_to_null(F.col(f)).isNull(), F.lit(f)) for f in required)))
    return out.withColumn("missing", gaps).drop("user_title", "user_caption")
