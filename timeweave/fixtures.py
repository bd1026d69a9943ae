"""Timeline tables derived from the given tables, for the registered queries.

Times are whole milliseconds until the last projection, so any engine gets the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeweave.functions.text import tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed(lines: DataFrame) -> DataFrame:
    """Segments of lines (video_id, seg_id, text): start, end, no_speech_prob and ms a word by fixed rules."""
    pick = F.pmod(F.col("video_id") * 11 + F.col("seg_id") * 29, F.lit(23))
    pace = F.when(pick == 0, 50).when(pick == 1, 12000).otherwise(350)
    gaps = F.array(*(F.lit(g) for g in (100, 400, 700, 1300, 2600)))
    gap = F.get(gaps, F.pmod(F.col("video_id") * 7 + F.col("seg_id") * 13, F.lit(5)).cast("int"))
    sized = lines.withColumns({"ms": pace, "_len": F.size(tokens(F.col("text"))) * pace, "_gap": gap})
    w = Window.partitionBy("video_id").orderBy("seg_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("_len") + F.col("_gap")).over(w), F.lit(0))
    placed = sized.withColumn("_s", start)
    return placed.select(
        "video_id",
        "seg_id",
        (F.col("_s") / 1000.0).alias("start"),
        ((F.col("_s") + F.col("_len")) / 1000.0).alias("end"),
        "text",
        (F.pmod(F.col("video_id") * 31 + F.col("seg_id") * 17, F.lit(100)) / 100.0).alias("no_speech_prob"),
        "ms",
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of documents as transcript segments; every 41st is a song, a laugh, a note."""
    docs = _table(spark, sf_dir, "documents")
    lines = docs.select(F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", "\n")).alias("seg_id", "line"))
    lines = lines.withColumn("line", F.trim("line")).where("line != ''")
    kind = F.pmod(F.col("video_id") + F.col("seg_id"), F.lit(41))
    text = F.when(kind == 0, "la la la").when(kind == 1, F.concat(F.lit("[laughter] "), "line"))
    text = text.when(kind == 2, F.concat(F.lit("♪ "), "line")).otherwise(F.col("line"))
    return timed(lines.select("video_id", "seg_id", text.alias("text")))


def word_arrays(segs: DataFrame) -> DataFrame:
    """``segs`` with ``ws``: an array of word_pos, word, w_start, w_end."""

    def timed_word(word: F.Column, i: F.Column) -> F.Column:
        base = F.col("_base") + i * F.col("ms")
        cut = F.when(F.col("ms") == 350, F.pmod(i * 7 + F.col("seg_id"), F.lit(4)) * 60).otherwise(0)
        return F.struct(i.alias("word_pos"), word.alias("word"), (base / 1000.0).alias("w_start"), ((base + F.col("ms") - cut) / 1000.0).alias("w_end"))

    own = segs.withColumn("_base", F.bround(F.col("start") * 1000, 0).cast("long"))  # once a line, not for each mention of a word
    return own.withColumn("ws", F.transform(tokens(F.col("text")), timed_word)).drop("_base")


def words(segs: DataFrame) -> DataFrame:
    """video_id, seg_id, word_pos, word, start, end, with the segment's bounds as seg_start, seg_end."""
    exploded = segs.select("*", F.posexplode(tokens(F.col("text"))).alias("word_pos", "word"))
    base = F.bround(F.col("start") * 1000, 0).cast("long") + F.col("word_pos") * F.col("ms")
    cut = F.when(F.col("ms") == 350, F.pmod(F.col("word_pos") * 7 + F.col("seg_id"), F.lit(4)) * 60).otherwise(0)
    return exploded.select(
        "video_id", "seg_id", "word_pos", "word", (base / 1000.0).alias("w_start"), ((base + F.col("ms") - cut) / 1000.0).alias("w_end"),
        F.col("start").alias("seg_start"), F.col("end").alias("seg_end"),
    )


def energy_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, win_idx, t, rms: a user's events in time order as half-second windows."""
    events = _table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ranked = events.select(F.col("user_id").alias("video_id"), (F.row_number().over(w) - 1).alias("win_idx"), (F.col("value") * 10).alias("rms"))
    return ranked.select("video_id", "win_idx", (F.col("win_idx") * 0.5).alias("t"), "rms")


def clips(segs: DataFrame) -> DataFrame:
    """Clip candidates: from the start of each segment to the end of the second after it."""
    w = Window.partitionBy("video_id").orderBy("seg_id")
    score = lambda a, b: F.pmod(F.col("video_id") * a + F.col("seg_id") * b, F.lit(101)).cast("int")
    out = segs.select(
        "video_id",
        F.col("seg_id").alias("clip_ord"),
        F.col("start"),
        F.lead("end", 2).over(w).alias("end"),
        score(13, 29).alias("score_emotion"),
        score(17, 31).alias("score_hook"),
        score(19, 37).alias("score_retention"),
        score(23, 41).alias("score_personality"),
        F.concat(F.lit("Clip "), F.col("seg_id")).alias("title"),
        F.col("text").alias("hook"),
        F.lead("text", 2).over(w).alias("closing_line"),
    )
    return out.where("end is not null")


# The same tables for DuckDB, as common table expressions.
SEGMENTS_SQL = r"""
lines AS (
    SELECT doc_id AS video_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seg_id,
        trim(unnest(string_split(text, chr(10)))) AS line FROM documents
),
texts AS (
    SELECT video_id, seg_id, CASE (video_id + seg_id) % 41 WHEN 0 THEN 'la la la' WHEN 1 THEN '[laughter] ' || line
        WHEN 2 THEN '♪ ' || line ELSE line END AS text FROM lines WHERE line <> ''
),
sized AS (
    SELECT *, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS n_words,
        CASE (video_id * 11 + seg_id * 29) % 23 WHEN 0 THEN 50 WHEN 1 THEN 12000 ELSE 350 END AS ms,
        [100, 400, 700, 1300, 2600][(video_id * 7 + seg_id * 13) % 5 + 1] AS gap FROM texts
),
placed AS (
    SELECT *, CAST(coalesce(sum(n_words * ms + gap) OVER (PARTITION BY video_id ORDER BY seg_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s_ms FROM sized
),
segments AS (
    SELECT video_id, seg_id, CAST(s_ms AS DOUBLE) / 1000 AS start, CAST(s_ms + n_words * ms AS DOUBLE) / 1000 AS "end", text,
        CAST((video_id * 31 + seg_id * 17) % 100 AS DOUBLE) / 100 AS no_speech_prob, ms, n_words, s_ms FROM placed
)"""
WORDS_SQL = (
    SEGMENTS_SQL
    + r""",
tokens AS (
    SELECT *, generate_subscripts(w, 1) - 1 AS word_pos, unnest(w) AS word
    FROM (SELECT *, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM segments)
),
words AS (
    SELECT video_id, seg_id, word_pos, word, CAST(s_ms + word_pos * ms AS DOUBLE) / 1000 AS w_start,
        CAST(s_ms + word_pos * ms + ms - CASE WHEN ms = 350 THEN (word_pos * 7 + seg_id) % 4 * 60 ELSE 0 END AS DOUBLE) / 1000 AS w_end,
        start AS seg_start, "end" AS seg_end FROM tokens
)"""
)
CLIPS_SQL = r"""
clips AS (
    SELECT * FROM (
        SELECT video_id, seg_id AS clip_ord, start, lead("end", 2) OVER (PARTITION BY video_id ORDER BY seg_id) AS "end",
            CAST((video_id * 13 + seg_id * 29) % 101 AS INTEGER) AS score_emotion, CAST((video_id * 17 + seg_id * 31) % 101 AS INTEGER) AS score_hook,
            CAST((video_id * 19 + seg_id * 37) % 101 AS INTEGER) AS score_retention, CAST((video_id * 23 + seg_id * 41) % 101 AS INTEGER) AS score_personality
        FROM segments)
    WHERE "end" IS NOT NULL
)"""
WINDOWS_SQL = r"""
windows AS (
    SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS win_idx, value * 10 AS rms FROM events
)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, time, boxes: a minute for each document, two people who sway; some seconds are empty."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clip_id"))
    rows = docs.select("clip_id", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("t")).where("t % 17 != 0")

    def box(x: F.Column, conf: F.Column) -> F.Column:
        x1, x2 = (x - 100).cast("int"), (x + 100).cast("int")
        return F.struct(
            x1.alias("x1"), F.lit(340).alias("y1"), x2.alias("x2"), F.lit(740).alias("y2"), conf.alias("conf"), ((x2 - x1) * 400 - x % 7).cast("int").alias("area")
        )

    left, right = 480 + (F.col("t") * 37) % 50, 1440 - (F.col("t") * 23) % 50
    weak = F.when(F.pmod(F.col("clip_id") + F.col("t"), F.lit(5)) == 0, 0.4).otherwise(0.9)
    return rows.select("clip_id", F.col("t").cast("double").alias("time"), F.array(box(left, F.lit(0.9)), box(right, weak)).alias("boxes"))


def crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, time, boxes: a minute for each document, three people whose ways and speeds follow from the
    document's id and length. Two cross, the third leaves at times; the largest box changes."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clip_id"), F.length("text").alias("n"))
    rows = docs.select("clip_id", "n", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("t")).where("(t + n) % 17 != 0")

    def box(cx: F.Column, y1: int, area: F.Column, conf: F.Column) -> F.Column:
        return F.struct(
            (cx - 100).cast("int").alias("x1"), F.lit(y1).alias("y1"), (cx + 100).cast("int").alias("x2"), F.lit(y1 + 400).alias("y2"), conf.alias("conf"), area.cast("int").alias("area")
        )

    t, n, c = F.col("t"), F.col("n"), F.col("clip_id")
    there = F.when(F.pmod(t + c, F.lit(9)) < 3, 0.4).otherwise(0.9)
    boxes = F.array(
        box(200 + t * (20 + n % 7), 340, 80000 - (t + n) % 5, F.lit(0.9)),
        box(1700 - t * (18 + n % 11), 360, 80000 - (t * 3 + c) % 5, F.lit(0.9)),
        box(960 + (t * 37 + n) % 90, 320, 80000 - (t * 7 + n) % 5, there),
    )
    return rows.select("clip_id", t.cast("double").alias("time"), boxes.alias("boxes"))


def clip_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id of each document, dealt by clip while a clip is one row: the seconds and samples made of it stay where
    it is, and joins and groups of a clip's rows shuffle none. The number of parts is named, as small rows would
    else be put into a few."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clip_id")).repartition(n, "clip_id")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, width, height of each document's clip."""
    return clip_ids(spark, sf_dir).select("clip_id", F.lit(1920).alias("width"), F.lit(1080).alias("height"))


def mouths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, track_id, sample_idx, score: two mouths, a sample a second."""
    rows = clip_ids(spark, sf_dir).select("clip_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("track_id")).select("*", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("sample_idx"))
    return rows.withColumn("score", F.pmod(F.col("clip_id") * 7 + F.col("track_id") * 31 + F.col("sample_idx") * 13, F.lit(100)) / 100.0)


def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, win_idx, env: loudness of each half second."""
    rows = clip_ids(spark, sf_dir).select("clip_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(119).cast("long"))).alias("win_idx"))
    return rows.withColumn("env", F.pmod(F.col("clip_id") * 3 + F.col("win_idx") * 17, F.lit(100)) / 100.0)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, raw: the clip candidates of a video as a model might send them, whole, fenced, behind a
    thought, in an object, cut off, or refused."""
    items = clips(segments(spark, sf_dir)).groupBy("video_id").agg(
        F.array_sort(F.collect_list(F.struct("clip_ord", F.to_json(F.struct("start", "end", "title", "score_emotion", "score_hook", "score_retention", "score_personality")).alias("j")))).alias("a")
    )
    body = F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["j"]), ", "), F.lit("]"))
    own = items.select("video_id", body.alias("b"))
    kind = F.pmod("video_id", F.lit(6))
    raw = F.when(kind == 0, F.col("b")).when(kind == 1, F.concat(F.lit("```json\n"), "b", F.lit("\n```")))
    raw = raw.when(kind == 2, F.concat(F.lit("<think>first [one] then</think>\nuser safety: safe\n"), "b"))
    raw = raw.when(kind == 3, F.concat(F.lit('{"note": "ok", "clips": '), "b", F.lit("}")))
    raw = raw.when(kind == 4, F.substring("b", F.lit(1), F.floor(F.length("b") * 7 / 10).cast("int"))).otherwise("I cannot help with that.")
    return own.select("video_id", raw.alias("raw"))


BOXES_SQL = r"""
seconds AS (SELECT doc_id AS clip_id, unnest(range(60)) AS t FROM documents),
boxes AS (
    SELECT clip_id, t::DOUBLE AS time, 0 AS box_ord, 480 + (t * 37) % 50 AS cx, 0.9 AS conf, 80000 - (480 + (t * 37) % 50) % 7 AS area FROM seconds WHERE t % 17 <> 0
    UNION ALL
    SELECT clip_id, t::DOUBLE, 1, 1440 - (t * 23) % 50, CASE WHEN (clip_id + t) % 5 = 0 THEN 0.4 ELSE 0.9 END, 80000 - (1440 - (t * 23) % 50) % 7 FROM seconds WHERE t % 17 <> 0
),
largest AS (
    SELECT clip_id, time, cx::DOUBLE AS cx FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, time ORDER BY area DESC, box_ord) AS r FROM boxes WHERE conf >= 0.5) WHERE r = 1
)"""
