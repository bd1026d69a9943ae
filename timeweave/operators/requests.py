"""Request batches for a language model: overlapping chunks, transcript lines, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.functions.intervals import overlap_join
from timeweave.functions.stored import stored


def assign_chunks(segs: DataFrame, chunk: float = 480.0, overlap: float = 60.0) -> DataFrame:
    """``segs`` with chunk_id (from 0), a row for each chunk a segment belongs to.

    A video no longer than 1.3 chunks is one chunk. Otherwise chunk k covers the time from start + k *
    chunk on, with ``overlap`` seconds more at its end; a segment belongs to each chunk it reaches into.
    """
    span = segs.groupBy("video_id").agg(F.min_by("start", "seg_id").alias("_t0"), F.max_by("end", "seg_id").alias("_t1"))
    own = segs.join(span, "video_id")
    total = F.col("_t1") - F.col("_t0")
    last = F.greatest(F.lit(0), F.ceil(total / chunk) - 1)
    low = F.greatest(F.lit(0), F.floor((F.col("start") - F.col("_t0") - overlap) / chunk) - 1)
    high = F.least(last, F.floor((F.col("end") - F.col("_t0")) / chunk) + 1)
    several = F.filter(
        F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>")),
        lambda k: (F.col("end") > F.col("_t0") + k * chunk) & (F.col("start") < F.col("_t0") + k * chunk + chunk + overlap),
    )
    chunks = F.when(total <= chunk * 1.3, F.array(F.lit(0).cast("long"))).otherwise(several)
    return own.withColumn("chunk_id", F.explode(chunks)).drop("_t0", "_t1")


def match_moments(segs: DataFrame, moments: DataFrame, width: float = 30.0) -> DataFrame:
    """``segs`` (video_id, seg_id, start, end, ...) with moment_id and moment_kind of the first moment, by
    its start, that overlaps; null where none does."""
    m = moments.select("video_id", "moment_id", F.col("start").alias("_ms"), F.col("end").alias("_me"), F.col("kind").alias("moment_kind"))
    s = segs.select("video_id", "seg_id", F.col("start").alias("_ss"), F.col("end").alias("_se"))
    hits = overlap_join(s, m, ["video_id"], ("_ss", "_se"), ("_ms", "_me"), (F.col("_me") > F.col("_ss")) & (F.col("_ms") < F.col("_se")), width)
    first = hits.groupBy("video_id", "seg_id").agg(F.min(F.struct("_ms", "moment_id", "moment_kind")).alias("_f"))
    first = stored(first.select("video_id", "seg_id", "_f.moment_id", "_f.moment_kind"), "marks")  # lines, spans and unmatched moments ask for it
    return segs.join(first, ["video_id", "seg_id"], "left")


def unmatched_moments(moments: DataFrame, matched: DataFrame) -> DataFrame:
    """Moments out of speech that mark no line of ``matched``."""
    used = matched.where("moment_id is not null").select("video_id", "moment_id").distinct()
    return moments.where("not in_speech").join(used, ["video_id", "moment_id"], "left_anti")


def time_label(seconds: Column) -> Column:
    """Whole seconds without, others with one decimal."""
    return F.when(seconds == F.floor(seconds), F.floor(seconds).cast("string")).otherwise(F.format_string("%.1f", seconds))


def gap_seconds(keys: list[str]) -> Column:
    """Seconds to the next line of the same chunk; null behind the last."""
    return F.lead("start").over(Window.partitionBy(*keys).orderBy("seg_id")) - F.col("end")


def gap_kind(gap: Column) -> Column:
    """pause from one second on, gap from a half on, else null."""
    return F.when(gap >= 1.0, "pause").when(gap >= 0.5, "gap")


def transcript_lines(assigned: DataFrame) -> DataFrame:
    """Lines ``[start-end] text [marker] [gap]`` of rows with chunk_id and moment_kind."""
    marked = assigned.withColumn("gap", gap_seconds(["video_id", "chunk_id"]))
    energy = F.when(F.col("moment_kind") == "spike", " [ENERGY SPIKE]").when(F.col("moment_kind") == "high", " [HIGH ENERGY]").otherwise("")
    pause = F.when(F.col("gap") >= 1.0, F.format_string(" [PAUSE %.1fs]", "gap")).when(F.col("gap") >= 0.5, F.format_string(" [gap %.2fs]", "gap"))
    line = F.concat(
        F.lit("["), time_label(F.col("start")), F.lit("-"), time_label(F.col("end")), F.lit("] "), F.coalesce("text", F.lit("")), energy, F.coalesce(pause, F.lit(""))
    )
    return marked.withColumn("line", line)


def halved(assigned: DataFrame, empty: DataFrame) -> DataFrame:
    """Lines of the chunks (video_id, chunk_id) in ``empty``, which gave no clip, cut in two for another try:
    part 1 holds the first half of the lines (the smaller one of an odd number), part 2 the rest. A chunk of
    one line cannot be halved and is left out."""
    w = Window.partitionBy("video_id", "chunk_id")
    own = assigned.join(empty.select("video_id", "chunk_id").distinct(), ["video_id", "chunk_id"], "left_semi")
    own = own.withColumns({"_i": F.row_number().over(w.orderBy("seg_id")), "_n": F.count("*").over(w)}).where("_n > 1")
    return own.withColumn("part", F.when(F.col("_i") <= F.floor(F.col("_n") / 2), 1).otherwise(2)).drop("_i", "_n")


def compact_transcript(segs: DataFrame) -> DataFrame:
    """video_id, transcript, n_lines: the texts of a video in order, joined by line feeds; blank ones are left out."""
    own = segs.where(F.trim("text") != "").groupBy("video_id")
    line = F.transform(F.array_sort(F.collect_list(F.struct("seg_id", "text"))), lambda x: x["text"])
    return own.agg(F.array_join(line, "\n").alias("transcript"), F.count("*").alias("n_lines"))


def chunk_texts(lines: DataFrame, trailing: DataFrame | None = None) -> DataFrame:
    """video_id, chunk_id, n_lines, transcript: a chunk's lines in order, joined by line feeds.

    ``trailing`` (unmatched moments) is listed behind the chunks in whose time range each moment lies.
    """
    texts = lines.groupBy("video_id", "chunk_id").agg(
        F.count("*").alias("n_lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_id", "line"))), lambda x: x["line"]), "\n").alias("transcript"),
        F.min("start").alias("_t0"),
        F.max("end").alias("_t1"),
    )
    if trailing is None:
        return texts.drop("_t0", "_t1")
    m = trailing.select("video_id", F.col("start").alias("_ms"), F.col("end").alias("_me"), "kind")
    hits = overlap_join(
        texts.select("video_id", "chunk_id", "_t0", "_t1"), m, ["video_id"], ("_t0", "_t1"), ("_ms", "_me"),
        (F.col("_me") > F.col("_t0")) & (F.col("_ms") < F.col("_t1")), 480.0,
    )
    label = F.when(F.col("kind") == "spike", "ENERGY SPIKE").otherwise("HIGH ENERGY")
    tail = F.concat(F.lit("["), F.format_string("%.1f", "_ms"), F.lit("-"), F.format_string("%.1f", "_me"), F.lit("] "), label)
    tails = hits.groupBy("video_id", "chunk_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_ms", tail.alias("l")))), lambda x: x["l"]), "\n").alias("_tail")
    )
    joined = texts.join(tails, ["video_id", "chunk_id"], "left")
    whole = F.concat("transcript", F.lit("\n\n[MOMENTS WITHOUT WORDS]\n"), "_tail")
    return joined.withColumn("transcript", F.coalesce(whole, "transcript")).drop("_t0", "_t1", "_tail")


def marked_chunks(segs: DataFrame, moments: DataFrame) -> DataFrame:
    """``chunk_texts`` of segments whose lines are marked by ``moments``, with the moments that mark none listed
    behind. Both tables are written once, as each is read several times."""
    segs = stored(segs.select("video_id", "seg_id", "start", "end", "text"), "segs")
    moments = stored(moments, "moments")
    matched = match_moments(segs, moments)
    return chunk_texts(transcript_lines(assign_chunks(matched)), unmatched_moments(moments, matched))


def chunk_budget(n_chunks: Column, max_clips: int) -> Column:
    """Clips to ask for in each chunk: half as many again as an even share, ten at least."""
    return F.least(F.greatest(F.lit(10), F.ceil(F.lit(max_clips) / n_chunks * 1.5)), F.lit(max_clips)).cast("int")


def llm_requests(texts: DataFrame, prompts: DataFrame, section: str, language: str, max_clips: int = 30) -> DataFrame:
    """video_id, chunk_id, max_clips, prompt: the section's template (``prompts``: section, template) with
    {TARGET_LANGUAGE}, {MAX_CLIPS} and {TRANSCRIPT} filled in."""
    n = texts.groupBy("video_id").agg(F.count("*").alias("_n"))
    own = texts.join(n, "video_id").withColumn("max_clips", chunk_budget(F.col("_n"), max_clips))
    # One template is wanted, so it is looked up on the driver and is no join.
    template = prompts.where(F.col("section") == section).agg(F.min("template")).first()[0]
    prompt = F.replace(F.lit(template), F.lit("{TARGET_LANGUAGE}"), F.lit(language))
    prompt = F.replace(prompt, F.lit("{MAX_CLIPS}"), F.col("max_clips").cast("string"))
    return own.select("video_id", "chunk_id", "max_clips", F.replace(prompt, F.lit("{TRANSCRIPT}"), "transcript").alias("prompt"))
