"""Registered queries of the timeline operators, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeweave import fixtures as fx
from timeweave.functions import text as tx
from timeweave.functions.stats import ranked_values
from timeweave.functions.stored import stored
from timeweave.operators import boundaries, crops, energy, refine, requests, responses, selection, silence, subtitles, transcript
from timeweave.sources import cache, media, transcripts
from timeweave.sources import clips as clip_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _sec(name: str) -> F.Column:
    """Seconds for comparison between engines."""
    return F.round(F.col(name), 6).alias(name)


# Cascade of reasons, in SQL.
_SUNG = "|".join(rf"{s}(\s+{s})*" for s in transcript.SUNG)
_INTERESTING = " OR ".join(f"contains(lower(trim(text)), '{m}')" for m in transcript.INTERESTING)
_MUSIC = " OR ".join(f"contains(lower(trim(text)), '{m}')" for m in transcript.MUSIC_MARKERS)
_NON_SPEECH = " OR ".join(f"contains(lower(trim(text)), '{m}')" for m in transcript.NON_SPEECH)
MARKED_SQL = (
    fx.SEGMENTS_SQL
    + rf""",
marked AS (
    SELECT *, CASE WHEN "end" - start < 0.3 THEN 'short_dur' WHEN n_words < 1 THEN 'few_words' WHEN no_speech_prob > 0.9 THEN 'no_speech'
        WHEN lower(trim(text)) <> '' AND NOT ({_INTERESTING}) AND (no_speech_prob > 0.75 OR regexp_full_match(lower(trim(text)), '({_SUNG})') OR {_MUSIC}) THEN 'music'
        WHEN n_words / ("end" - start) < 0.1 THEN 'slow_speech' WHEN n_words / ("end" - start) > 15 THEN 'hallucination' END AS drop_reason
    FROM segments
)"""
)


@register(f'WITH {fx.SEGMENTS_SQL} SELECT video_id, seg_id, start, "end", text, no_speech_prob FROM segments')
def src1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.segments(spark, sf_dir).drop("ms")


@register(f"WITH {fx.WORDS_SQL} SELECT video_id, seg_id, word_pos, word, w_start, w_end FROM words")
def src1_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.words(fx.segments(spark, sf_dir)).drop("seg_start", "seg_end")


@register(f"WITH {MARKED_SQL} SELECT video_id, seg_id, drop_reason FROM marked")
def p2_reason_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.segments(spark, sf_dir).select("video_id", "seg_id", transcript.drop_reason().alias("drop_reason"))


@register(
    rf"""WITH {fx.SEGMENTS_SQL} SELECT video_id, seg_id, round(CASE WHEN "end" > start THEN n_words / ("end" - start) ELSE 0 END, 6) AS wps,
    ({_INTERESTING}) AS interesting, ({_NON_SPEECH}) AS non_speech,
    lower(trim(text)) <> '' AND NOT ({_INTERESTING}) AND (no_speech_prob > 0.75 OR regexp_full_match(lower(trim(text)), '({_SUNG})') OR {_MUSIC}) AS music
    FROM segments"""
)
def p1_p3_p4_p5_segment_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return fx.segments(spark, sf_dir).select(
        "video_id", "seg_id", F.round(transcript.words_per_second(t, F.col("start"), F.col("end")), 6).alias("wps"),
        transcript.is_interesting(t).alias("interesting"), transcript.is_non_speech(t).alias("non_speech"),
        transcript.is_music(t, F.col("no_speech_prob")).alias("music"),
    )


_FILLER = "|".join(transcript.FILLERS)


@register(
    rf"""WITH {fx.WORDS_SQL} SELECT video_id, seg_id, word_pos, regexp_full_match(lower(trim(word)), '({_FILLER})\W*') AS filler,
    trim(lower(word), '.,!?;:') AS norm FROM words"""
)
def p6_s3_word_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = fx.words(fx.segments(spark, sf_dir))
    return words.select("video_id", "seg_id", "word_pos", transcript.is_filler(F.col("word")).alias("filler"), tx.norm_word(F.col("word")).alias("norm"))


@register(f"WITH {MARKED_SQL} SELECT video_id, drop_reason, count(*) AS n FROM marked WHERE drop_reason IS NOT NULL GROUP BY ALL")
def a1_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = fx.segments(spark, sf_dir).withColumn("drop_reason", transcript.drop_reason())
    return transcript.reason_counts(marked)


# The fold as a recursion over each video's passing segments: kept holds the last twelve token sets.
SUPPRESSED_SQL = (
    MARKED_SQL
    + r""",
passing AS (
    SELECT video_id, seg_id, row_number() OVER (PARTITION BY video_id ORDER BY seg_id) AS i,
        list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS own
    FROM marked WHERE drop_reason IS NULL
),
steps AS (
    SELECT video_id, seg_id, i, false AS dup, [own] AS kept FROM passing WHERE i = 1
    UNION ALL
    SELECT p.video_id, p.seg_id, p.i, d.dup, CASE WHEN d.dup THEN s.kept ELSE list_append(s.kept, p.own)[-12:] END AS kept
    FROM steps s JOIN passing p ON p.video_id = s.video_id AND p.i = s.i + 1,
        LATERAL (SELECT coalesce(list_bool_or(list_transform(s.kept, lambda k:
            len(list_intersect(k, p.own)) >= 0.95 * (len(k) + len(p.own) - len(list_intersect(k, p.own))))), false) AS dup) d
),
reasons AS (
    SELECT m.video_id, m.seg_id, CASE WHEN s.dup THEN 'duplicate' ELSE m.drop_reason END AS drop_reason
    FROM marked m LEFT JOIN steps s USING (video_id, seg_id)
)"""
)


@register(f"WITH RECURSIVE {SUPPRESSED_SQL} SELECT * FROM reasons")
def f1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.mark_segments(fx.segments(spark, sf_dir)).select("video_id", "seg_id", "drop_reason")


MERGED_SQL = (
    SUPPRESSED_SQL
    + r""",
stay AS (
    SELECT s.video_id, s.seg_id, s.start, s."end" AS e, s.text, row_number() OVER (PARTITION BY s.video_id ORDER BY s.seg_id) AS i
    FROM segments s JOIN reasons r USING (video_id, seg_id) WHERE r.drop_reason IS NULL
),
joined AS (
    SELECT video_id, i, seg_id AS first, start AS s, e FROM stay WHERE i = 1
    UNION ALL
    SELECT n.video_id, n.i, CASE WHEN m.same THEN j.first ELSE n.seg_id END, CASE WHEN m.same THEN j.s ELSE n.start END, n.e
    FROM joined j JOIN stay n ON n.video_id = j.video_id AND n.i = j.i + 1, LATERAL (SELECT n.start - j.e <= 1.0 AND n.e - j.s <= 60.0 AS same) m
),
merged AS (
    SELECT j.video_id, j.first AS seg_id, max(t.seg_id) AS last_seg_id, min(j.s) AS start, max_by(j.e, j.i) AS "end",
        string_agg(t.text, ' ' ORDER BY j.i) AS text, count(*)::INTEGER AS n_merged
    FROM joined j JOIN stay t USING (video_id, i) GROUP BY j.video_id, j.first
)"""
)


@register(f"WITH RECURSIVE {MERGED_SQL} SELECT * FROM merged")
def c1_clean_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.clean_transcript(fx.segments(spark, sf_dir)).drop("no_speech_prob")


@register(
    f"""WITH RECURSIVE {MERGED_SQL} SELECT r.video_id, count(*) AS original, count(*) FILTER (r.drop_reason IS NULL) AS after_filter,
    coalesce(any_value(m.n), 0) AS kept, count(*) FILTER (r.drop_reason IS NOT NULL) AS dropped,
    count(*) FILTER (r.drop_reason IS NULL) - coalesce(any_value(m.n), 0) AS merged,
    round(count(*) FILTER (r.drop_reason IS NOT NULL) * 100.0::DOUBLE / count(*), 6) AS drop_pct
    FROM reasons r LEFT JOIN (SELECT video_id, count(*) AS n FROM merged GROUP BY 1) m USING (video_id) GROUP BY r.video_id"""
)
def a1_clean_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = transcript.mark_segments(fx.segments(spark, sf_dir))
    merged = transcript.merge_segments(marked.where("drop_reason is null"))
    return transcript.clean_stats(marked, merged).withColumn("drop_pct", F.round("drop_pct", 6))


@register(
    rf"""WITH {fx.SEGMENTS_SQL}, t AS (SELECT video_id, seg_id, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS a,
    list_distinct(list_filter(string_split_regex(lower(coalesce(lead(text) OVER (PARTITION BY video_id ORDER BY seg_id), '')), '\s+'), lambda x: x <> '')) AS b FROM segments)
    SELECT video_id, seg_id, round(coalesce(len(list_intersect(a, b)) / nullif(len(a) + len(b) - len(list_intersect(a, b)), 0), 0), 6) AS likeness FROM t"""
)
def s1_u4_next_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy("seg_id")
    own = fx.segments(spark, sf_dir).select("video_id", "seg_id", "text", F.lead("text").over(w).alias("next"))
    return own.select("video_id", "seg_id", F.round(tx.jaccard(F.col("text"), F.col("next")), 6).alias("likeness"))


# Energy.
REGIONS_SQL = (
    fx.SEGMENTS_SQL
    + r""",
flagged AS (
    SELECT video_id, seg_id, start, "end" AS e, CASE WHEN start - max("end") OVER (PARTITION BY video_id ORDER BY start, seg_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0.45 THEN 0 ELSE 1 END AS fresh FROM segments WHERE "end" > start
),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY start, seg_id) AS island FROM flagged),
regions AS (
    SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY island)::INTEGER AS region_id, round(s, 3) AS start, round(e, 3) AS "end"
    FROM (SELECT video_id, island, min(start) AS s, max(e) AS e FROM grouped GROUP BY ALL) WHERE e - s >= 0.12
)"""
)
EVENTS_SQL = (
    REGIONS_SQL
    + ","
    + fx.WINDOWS_SQL
    + r""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY rms, win_idx) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM windows),
stats AS (
    SELECT video_id, any_value(n) AS n, max(rms) FILTER (i = n // 2) AS median, max(rms) FILTER (i = least(n * 80 // 100, n - 1)) AS high
    FROM ranked GROUP BY video_id
),
locals AS (
    SELECT *, list_sort(list(rms) OVER (PARTITION BY video_id ORDER BY win_idx ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING)) AS near FROM windows
),
judged AS (
    SELECT l.video_id, l.win_idx, l.win_idx * 0.5::DOUBLE AS time, l.rms, s.median, s.high, greatest(near[len(near) // 2 + 1], s.median * 0.5::DOUBLE) AS base,
        EXISTS (SELECT 1 FROM regions r WHERE r.video_id = l.video_id AND l.win_idx * 0.5 >= r.start AND l.win_idx * 0.5 <= r."end") AS in_speech
    FROM locals l JOIN stats s USING (video_id) WHERE s.n >= 3 AND s.median >= 50 AND l.rms >= 50
),
events_found AS (
    SELECT * FROM (SELECT video_id, win_idx, time, rms, in_speech, CASE WHEN rms > base * CASE WHEN in_speech THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END THEN 'spike'
        WHEN in_speech AND rms >= high AND rms > median * 1.5::DOUBLE THEN 'high' END AS kind FROM judged) WHERE kind IS NOT NULL
)"""
)
MOMENTS_SQL = (
    EVENTS_SQL
    + r""",
cut AS (SELECT *, CASE WHEN time - lag(time + 0.5::DOUBLE) OVER (PARTITION BY video_id ORDER BY time) <= 2.0 THEN 0 ELSE 1 END AS fresh FROM events_found),
moments AS (
    SELECT video_id, moment_id, min(time) AS start, max(time) + 0.5::DOUBLE AS "end", max(rms) AS peak_rms, CASE WHEN bool_or(kind = 'spike') THEN 'spike' ELSE 'high' END AS kind,
        bool_and(in_speech) AS in_speech
    FROM (SELECT *, CAST(sum(fresh) OVER (PARTITION BY video_id ORDER BY time) AS BIGINT) AS moment_id FROM cut) GROUP BY video_id, moment_id
)"""
)


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return energy.speech_regions(fx.segments(spark, sf_dir))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return energy.energy_events(fx.energy_windows(spark, sf_dir), _regions(spark, sf_dir))


def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return energy.energy_moments(_events(spark, sf_dir))


@register(f"WITH {REGIONS_SQL} SELECT * FROM regions")
def w4_speech_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir)


@register(f"WITH {EVENTS_SQL} SELECT video_id, n, median, high FROM stats")
def a3_median_and_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_values(fx.energy_windows(spark, sf_dir), ["video_id"], "rms", 80.0)


@register(f"WITH {EVENTS_SQL} SELECT video_id, win_idx, near[len(near) // 2 + 1] AS local FROM locals")
def w2_local_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return energy.local_medians(fx.energy_windows(spark, sf_dir), 20).select("video_id", "win_idx", "local")


@register(
    f"""WITH {EVENTS_SQL} SELECT w.video_id, w.win_idx, EXISTS (SELECT 1 FROM regions r WHERE r.video_id = w.video_id AND w.win_idx * 0.5 >= r.start
    AND w.win_idx * 0.5 <= r."end") AS in_speech FROM windows w"""
)
def j6_in_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return energy.in_speech(fx.energy_windows(spark, sf_dir), _regions(spark, sf_dir)).select("video_id", "win_idx", "in_speech")


@register(f"WITH {EVENTS_SQL} SELECT * FROM events_found")
def p10_p11_energy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir)


@register(f"WITH {MOMENTS_SQL} SELECT * FROM moments")
def w3_c2_energy_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moments(spark, sf_dir)


@register(f"WITH {MOMENTS_SQL} SELECT kind, in_speech, count(*) AS n, max(peak_rms) AS peak_rms FROM moments GROUP BY ALL")
def a4_moment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return energy.moment_counts(_moments(spark, sf_dir))


SAMPLES_SQL = r"""
vectors AS (SELECT label::BIGINT AS video_id, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) AS k, embedding FROM embeddings WHERE label IS NOT NULL),
samples AS (SELECT video_id, k * 64 + generate_subscripts(embedding, 1) - 1 AS sample_idx, CAST(trunc(unnest(embedding)::DOUBLE * 10000) AS BIGINT) AS amp FROM vectors)"""


@register(
    f"""WITH {SAMPLES_SQL} SELECT video_id, sample_idx // 100 AS win_idx, round(sqrt(sum(amp::DOUBLE * amp::DOUBLE) / 100), 6) AS rms FROM samples
    GROUP BY ALL HAVING count(*) = 100"""
)
def a2_rms_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label is not null")
    vectors = vectors.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    rows = vectors.select(F.col("label").cast("long").alias("video_id"), "k", F.posexplode("embedding").alias("i", "x"))
    samples = rows.select("video_id", (F.col("k") * 64 + F.col("i")).alias("sample_idx"), (F.col("x").cast("double") * 10000).cast("long").alias("amp"))
    return energy.rms_windows(samples, 100).withColumn("rms", F.round("rms", 6))


@register(
    f"WITH {fx.WINDOWS_SQL} SELECT video_id, win_idx, round(CASE WHEN m > 0 THEN rms / m ELSE rms END, 6) AS env FROM (SELECT *, max(rms) OVER (PARTITION BY video_id) AS m FROM windows)"
)
def a17_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = energy.max_normalized(fx.energy_windows(spark, sf_dir), ["video_id"], "rms", "env")
    return out.select("video_id", "win_idx", F.round("env", 6).alias("env"))


# Requests.
CHUNKS_SQL = (
    fx.SEGMENTS_SQL
    + r""",
spans AS (SELECT video_id, min_by(start, seg_id) AS t0, max_by("end", seg_id) AS t1 FROM segments GROUP BY 1),
chunked AS (
    SELECT s.video_id, s.seg_id, s.start, s."end", s.text, k.chunk_id FROM segments s JOIN spans p USING (video_id),
        LATERAL (SELECT unnest(range(0, greatest(1, CAST(ceil((p.t1 - p.t0) / 480) AS BIGINT)))) AS chunk_id) k
    WHERE CASE WHEN p.t1 - p.t0 <= 624 THEN k.chunk_id = 0 ELSE s."end" > p.t0 + k.chunk_id * 480 AND s.start < p.t0 + k.chunk_id * 480 + 540 END
)"""
)


@register(f"WITH {CHUNKS_SQL} SELECT video_id, seg_id, chunk_id FROM chunked")
def j7_chunk_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.assign_chunks(fx.segments(spark, sf_dir)).select("video_id", "seg_id", "chunk_id")


@register(
    f"""WITH {CHUNKS_SQL}, g AS (SELECT *, lead(start) OVER (PARTITION BY video_id, chunk_id ORDER BY seg_id) - "end" AS gap FROM chunked)
    SELECT video_id, chunk_id, seg_id, round(gap, 6) AS gap, CASE WHEN gap >= 1.0 THEN 'pause' WHEN gap >= 0.5 THEN 'gap' END AS kind FROM g"""
)
def w1_gap_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = requests.assign_chunks(fx.segments(spark, sf_dir)).withColumn("gap", requests.gap_seconds(["video_id", "chunk_id"]))
    return own.select("video_id", "chunk_id", "seg_id", F.round("gap", 6).alias("gap"), requests.gap_kind(F.col("gap")).alias("kind"))


@register(
    f"""WITH {MOMENTS_SQL} SELECT s.video_id, s.seg_id, arg_min(m.moment_id, m.start) AS moment_id, arg_min(m.kind, m.start) AS moment_kind
    FROM segments s LEFT JOIN moments m ON m.video_id = s.video_id AND m."end" > s.start AND m.start < s."end" GROUP BY ALL"""
)
def j1_line_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.match_moments(fx.segments(spark, sf_dir), _moments(spark, sf_dir)).select("video_id", "seg_id", "moment_id", "moment_kind")


@register(
    f"""WITH {MOMENTS_SQL}, used AS (SELECT DISTINCT s.video_id, arg_min(m.moment_id, m.start) AS moment_id FROM segments s JOIN moments m
    ON m.video_id = s.video_id AND m."end" > s.start AND m.start < s."end" GROUP BY s.video_id, s.seg_id)
    SELECT video_id, moment_id, start FROM moments ANTI JOIN used USING (video_id, moment_id) WHERE NOT in_speech"""
)
def j2_unmatched_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    moments = _moments(spark, sf_dir)
    return requests.unmatched_moments(moments, requests.match_moments(fx.segments(spark, sf_dir), moments)).select("video_id", "moment_id", "start")


@register(
    f"""WITH {CHUNKS_SQL}, n AS (SELECT video_id, count(DISTINCT chunk_id) AS n FROM chunked GROUP BY 1)
    SELECT video_id, n AS n_chunks, CAST(least(greatest(10, ceil(30 / n * 1.5)), 30) AS INTEGER) AS max_clips FROM n"""
)
def a14_chunk_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = requests.assign_chunks(fx.segments(spark, sf_dir)).groupBy("video_id").agg(F.count_distinct("chunk_id").alias("n_chunks"))
    return n.withColumn("max_clips", requests.chunk_budget(F.col("n_chunks"), 30))


@register(
    f"""WITH {fx.SEGMENTS_SQL} SELECT video_id, string_agg(text, chr(10) ORDER BY seg_id) AS transcript, count(*) AS n_lines FROM segments WHERE trim(text) <> '' GROUP BY 1"""
)
def a6_a7_transcript_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.compact_transcript(fx.segments(spark, sf_dir))


@register(f'WITH {fx.SEGMENTS_SQL} SELECT video_id, max_by("end", seg_id) AS duration FROM segments GROUP BY 1')
def a16_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.transcript_durations(fx.segments(spark, sf_dir))


# Selection.
SCORED_SQL = (
    fx.SEGMENTS_SQL
    + ","
    + fx.CLIPS_SQL
    + r""",
scored AS (SELECT *, (score_emotion * 4 + score_hook * 3 + score_retention * 2 + score_personality)::DOUBLE / 10 AS clip_score FROM clips),
gated AS (
    SELECT *, CASE WHEN clip_score = 0 THEN 'no_scores' WHEN "end" - start < 15 OR "end" - start > 180 THEN 'duration' WHEN clip_score < 60 THEN 'low_score' END AS reject FROM scored
)"""
)
# One-dimensional suppression as a recursion over clips in order of score; taken holds what stays.
NMS_SQL = (
    SCORED_SQL
    + r""",
queue AS (
    SELECT video_id, clip_ord, start AS s, "end" AS e, clip_score, score_emotion,
        row_number() OVER (PARTITION BY video_id ORDER BY clip_score DESC, score_emotion DESC, clip_ord) AS i FROM gated WHERE reject IS NULL
),
nms AS (
    SELECT video_id, clip_ord, i, true AS ok, [{'s': s, 'e': e}] AS taken FROM queue WHERE i = 1
    UNION ALL
    SELECT q.video_id, q.clip_ord, q.i, k.ok, CASE WHEN k.ok THEN list_append(n.taken, {'s': q.s, 'e': q.e}) ELSE n.taken END
    FROM nms n JOIN queue q ON q.video_id = n.video_id AND q.i = n.i + 1,
        LATERAL (SELECT len(n.taken) < 30 AND NOT coalesce(list_bool_or(list_transform(n.taken, lambda t:
            greatest(0, least(q.e, t.e) - greatest(q.s, t.s)) / least(q.e - q.s, t.e - t.s) > 0.5)), false) AS ok) k
),
chosen AS (SELECT q.*, row_number() OVER (PARTITION BY q.video_id ORDER BY clip_score DESC, score_emotion DESC, q.clip_ord)::INTEGER AS rank
    FROM queue q JOIN nms n USING (video_id, clip_ord) WHERE n.ok)"""
)


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.clips(fx.segments(spark, sf_dir))


@register(f'WITH {SCORED_SQL} SELECT video_id, clip_ord, clip_score, reject FROM gated')
def p8_p9_s4_s5_clip_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.gate(selection.score_clips(_clips(spark, sf_dir))).select("video_id", "clip_ord", "clip_score", "reject")


@register(f"WITH RECURSIVE {NMS_SQL} SELECT video_id, clip_ord, rank, clip_score FROM chosen")
def f3_c4_select_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select_clips(_clips(spark, sf_dir)).select("video_id", "clip_ord", "rank", "clip_score")


# Dedup over chunks as a recursion; held is the list that stays, changed in place.
SAME_SQL = (
    SCORED_SQL
    + r""",
line AS (
    SELECT video_id, {'o': clip_ord, 's': start, 'e': "end", 'v': clip_score} AS c, row_number() OVER (PARTITION BY video_id ORDER BY start, clip_score DESC, clip_ord) AS i
    FROM scored WHERE clip_score > 0
),
fold AS (
    SELECT video_id, i, [c] AS held FROM line WHERE i = 1
    UNION ALL
    SELECT l.video_id, l.i, CASE WHEN k.at IS NULL THEN list_append(f.held, l.c) WHEN l.c.e - l.c.s > f.held[k.at].e - f.held[k.at].s + 5
            OR (abs((l.c.e - l.c.s) - (f.held[k.at].e - f.held[k.at].s)) <= 5 AND l.c.v > f.held[k.at].v)
        THEN list_transform(f.held, lambda h, j: CASE WHEN j = k.at THEN l.c ELSE h END) ELSE f.held END
    FROM fold f JOIN line l ON l.video_id = f.video_id AND l.i = f.i + 1,
        LATERAL (SELECT list_min(list_filter(list_transform(f.held, lambda h, j: CASE WHEN greatest(0, least(h.e, l.c.e) - greatest(h.s, l.c.s)) / least(h.e - h.s, l.c.e - l.c.s) > 0.7
            THEN j END), lambda x: x IS NOT NULL)) AS at) k
),
rest AS (SELECT video_id, unnest(held) AS c FROM (SELECT video_id, max_by(held, i) AS held FROM fold GROUP BY 1))"""
)


@register(f'WITH RECURSIVE {SAME_SQL} SELECT video_id, c.o AS clip_ord, c.s AS start, c.e AS "end", c.v AS clip_score FROM rest')
def f4_merge_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = selection.score_clips(_clips(spark, sf_dir)).where("reject is null")
    return selection.merge_chunks(scored).select("video_id", "clip_ord", "start", "end", "clip_score")


# Suppression for each of the three minimums at once; the strictest that keeps a clip counts.
RELAXED_SQL = (
    SCORED_SQL
    + r""",
fit AS (SELECT s.*, f.floor FROM scored s, (VALUES (85.0::DOUBLE), (70.0::DOUBLE), (55.0::DOUBLE)) f(floor) WHERE clip_score > 0 AND clip_score >= f.floor AND "end" - start BETWEEN 15 AND 180),
waiting AS (SELECT video_id, floor, clip_ord, start AS s, "end" AS e, clip_score, score_emotion, row_number() OVER (PARTITION BY video_id, floor ORDER BY clip_score DESC, score_emotion DESC, clip_ord) AS i FROM fit),
picked AS (
    SELECT video_id, floor, clip_ord, i, true AS ok, [{'s': s, 'e': e}] AS taken FROM waiting WHERE i = 1
    UNION ALL
    SELECT q.video_id, q.floor, q.clip_ord, q.i, k.ok, CASE WHEN k.ok THEN list_append(n.taken, {'s': q.s, 'e': q.e}) ELSE n.taken END
    FROM picked n JOIN waiting q ON q.video_id = n.video_id AND q.floor = n.floor AND q.i = n.i + 1,
        LATERAL (SELECT len(n.taken) < 30 AND NOT coalesce(list_bool_or(list_transform(n.taken, lambda t:
            greatest(0, least(q.e, t.e) - greatest(q.s, t.s)) / least(q.e - q.s, t.e - t.s) > 0.5)), false) AS ok) k
),
strictest AS (SELECT video_id, max(floor) AS floor FROM picked GROUP BY 1)"""
)


@register(
    f"""WITH RECURSIVE {RELAXED_SQL} SELECT w.video_id, w.clip_ord, w.floor, row_number() OVER (PARTITION BY w.video_id ORDER BY w.clip_score DESC, w.score_emotion DESC, w.clip_ord)::INTEGER AS rank, w.clip_score
    FROM waiting w JOIN picked p USING (video_id, floor, clip_ord) JOIN strictest USING (video_id, floor) WHERE p.ok"""
)
def k9_relaxed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    strict = selection.SelectRules(min_score=85.0)
    return selection.relax_scores(_clips(spark, sf_dir), strict).select("video_id", "clip_ord", "floor", "rank", "clip_score")


@register(
    f"""WITH {SCORED_SQL}, r AS (SELECT video_id, clip_ord, row_number() OVER (PARTITION BY video_id ORDER BY clip_score DESC, score_emotion DESC, clip_ord)::INTEGER AS rank FROM scored)
    SELECT * FROM r WHERE rank <= 24"""
)
def k1_k2_k5_w16_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = selection.rerank(selection.score_clips(_clips(spark, sf_dir)))
    return selection.top_clips(ranked, 24).select("video_id", "clip_ord", "rank")


@register(
    f"""WITH {SCORED_SQL} SELECT a.video_id, a.clip_ord, round(greatest(0, least(a."end", b."end") - greatest(a.start, b.start)) / least(a."end" - a.start, b."end" - b.start), 6) AS overlap
    FROM clips a JOIN clips b ON a.video_id = b.video_id AND b.clip_ord = (SELECT min(c.clip_ord) FROM clips c WHERE c.video_id = a.video_id AND c.clip_ord > a.clip_ord)"""
)
def s6_neighbour_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy("clip_ord")
    own = _clips(spark, sf_dir).select("video_id", "clip_ord", "start", "end", F.lead("start").over(w).alias("s2"), F.lead("end").over(w).alias("e2"))
    ratio = tx.overlap_ratio(F.col("start"), F.col("end"), F.col("s2"), F.col("e2"))
    return own.where("s2 is not null").select("video_id", "clip_ord", F.round(ratio, 6).alias("overlap"))


# Boundaries.
_WEAK = ", ".join(f"'{x}'" for x in boundaries.WEAK_STARTS)
_POWER = ", ".join(f"'{x}'" for x in boundaries.POWER_STARTS)
_BAD = ", ".join(f"'{x}'" for x in boundaries.BAD_ENDS)
_GOOD = ", ".join(f"'{x}'" for x in boundaries.GOOD_ENDS)
# Chosen clips; their lines as they were said; starts and ends moved by the rules of starts and endings; what of it is used.
ADJUSTED_SQL = (
    NMS_SQL
    + fx.WORDS_SQL[len(fx.SEGMENTS_SQL) :]
    + rf""",
picked AS (
    SELECT c.video_id, c.clip_ord, c.s AS start, c.e, t.text AS hook, t.closing
    FROM chosen c JOIN (SELECT video_id, seg_id AS clip_ord, text, lead(text, 2) OVER (PARTITION BY video_id ORDER BY seg_id) AS closing FROM segments) t USING (video_id, clip_ord)
),
ws AS (
    SELECT p.video_id, p.clip_ord, trim(w.word) AS word, trim(lower(trim(w.word)), '.,!?;:') AS norm, w.seg_id, w.word_pos, w.w_start, w.w_end, w.seg_start, w.seg_end
    FROM picked p JOIN words w ON w.video_id = p.video_id AND w.w_end > p.start - 6.5 AND w.w_start < p.e + 16
),
asked AS (
    SELECT video_id, clip_ord, 'hook' AS kind, trim(hook) AS line, start - 0.5 AS a, least(start + 5.0, e) + 0.5 AS b FROM picked
    UNION ALL SELECT video_id, clip_ord, 'closing', trim(closing), greatest(e - 8.0, start) - 0.5, e + 5.0 + 0.5 FROM picked
),
seen AS (
    SELECT w.*, k.kind, k.line, row_number() OVER (PARTITION BY w.video_id, w.clip_ord, k.kind ORDER BY w.w_start, w.seg_id, w.word_pos) - 1 AS i
    FROM ws w JOIN asked k ON k.video_id = w.video_id AND k.clip_ord = w.clip_ord WHERE w.seg_end >= k.a AND w.seg_start <= k.b AND w.w_end > k.a AND w.w_start < k.b
),
parts AS (
    SELECT video_id, clip_ord, kind, len(q) AS m, unnest(q) AS x, generate_subscripts(q, 1) - 1 AS k
    FROM (SELECT *, list_filter(string_split_regex(lower(line), '\s+'), lambda x: x <> '') AS q FROM asked)
),
met AS (
    SELECT p.video_id, p.clip_ord, p.kind, n.i - p.k AS pos, any_value(p.m) AS m, count(*) FILTER (n.norm = p.x) AS equal,
        count(*) FILTER (n.norm <> '' AND (contains(p.x, n.norm) OR contains(n.norm, p.x))) AS alike, count(*) AS held
    FROM parts p JOIN seen n ON n.video_id = p.video_id AND n.clip_ord = p.clip_ord AND n.kind = p.kind AND n.i >= p.k GROUP BY ALL
),
place AS (SELECT video_id, clip_ord, kind, min(pos) AS pos, any_value(m) AS m FROM met WHERE held = m AND (equal = m OR alike >= greatest(1, m - 1)) GROUP BY ALL),
said AS (
    SELECT n.video_id, n.clip_ord, n.kind, any_value(n.line) AS line, string_agg(n.word, ' ' ORDER BY n.i) AS said, min_by(n.w_start, n.i) AS s, max_by(n.w_end, n.i) AS e
    FROM place p JOIN seen n ON n.video_id = p.video_id AND n.clip_ord = p.clip_ord AND n.kind = p.kind AND n.i >= p.pos AND n.i < p.pos + p.m GROUP BY ALL
),
fixed AS (
    SELECT p.video_id, p.clip_ord, p.start AS llm_start, p.e AS llm_end, CASE WHEN h.s IS NULL THEN p.start ELSE greatest(p.start, h.s - 0.12) END AS start,
        coalesce(c.e + 0.25, p.e) AS e, coalesce(h.said, p.hook) AS hook, coalesce(c.said, p.closing) AS closing_line
    FROM picked p LEFT JOIN said h ON h.video_id = p.video_id AND h.clip_ord = p.clip_ord AND h.kind = 'hook' AND lower(h.said) <> lower(h.line)
    LEFT JOIN said c ON c.video_id = p.video_id AND c.clip_ord = p.clip_ord AND c.kind = 'closing' AND lower(c.said) <> lower(c.line)
),
about AS (
    SELECT f.video_id, f.clip_ord, f.start, f.e, w.word, w.norm, w.seg_id, w.word_pos, w.w_start, w.w_end FROM fixed f JOIN ws w ON w.video_id = f.video_id AND w.clip_ord = f.clip_ord
    WHERE w.seg_end >= f.start - 6.0 AND w.seg_start <= f.e + 6.0 AND w.w_end > f.start - 6.0 AND w.w_start < f.e + 6.0
),
first_words AS (SELECT *, row_number() OVER (PARTITION BY video_id, clip_ord ORDER BY w_start, seg_id, word_pos) - 1 AS i FROM about WHERE w_start >= start - 0.2 AND w_start <= start + 4.0),
content AS (SELECT *, coalesce(min(i) FILTER (i < 5 AND norm NOT IN ({_WEAK})) OVER (PARTITION BY video_id, clip_ord), 0) AS c FROM first_words WHERE i < 8),
strong AS (SELECT video_id, clip_ord, min_by(w_start, i) FILTER (i = c) AS plain, min_by(w_start, i) FILTER (i >= c AND i < c + 3 AND norm IN ({_POWER})) AS power FROM content GROUP BY ALL),
begun AS (SELECT f.*, greatest(f.start, coalesce(k.power - 0.1, k.plain - 0.12, f.start)) AS s FROM fixed f LEFT JOIN strong k USING (video_id, clip_ord)),
bounds AS (SELECT video_id, clip_ord, min_by(w_start, {{'a': w_start, 'b': seg_id, 'c': word_pos}}) + 5.0 AS least FROM about GROUP BY ALL),
last_words AS (
    SELECT a.*, g.s, b.least, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY a.video_id, a.clip_ord) AS n, coalesce(lead(a.w_start) OVER w - a.w_end, 0) AS gap, right(a.word, 1) AS mark
    FROM about a JOIN bounds b ON b.video_id = a.video_id AND b.clip_ord = a.clip_ord JOIN begun g ON g.video_id = a.video_id AND g.clip_ord = a.clip_ord
    WHERE a.w_end >= greatest(0, a.e - 6.0) AND a.w_end <= least(a.e + 5.0, g.s + 180.0) WINDOW w AS (PARTITION BY a.video_id, a.clip_ord ORDER BY a.w_start, a.seg_id, a.word_pos)
),
valued AS (
    SELECT *, (i < n - 1 AND gap >= 0.6) OR mark IN ('.', '?', '!', '。', '؟') AS is_break, w_end >= least AND w_end <= s + 180.0 AS fits,
        CASE WHEN w_end - e >= 0 THEN (w_end - e) * 1.5 ELSE (e - w_end) * 4.0 END - (CASE WHEN gap >= 1.2 THEN 30 WHEN gap >= 0.8 THEN 22 WHEN gap >= 0.5 THEN 14 WHEN gap >= 0.3 THEN 8 ELSE 0 END
        + CASE WHEN norm IN ({_BAD}) THEN 0 ELSE 25 END + CASE WHEN norm IN ({_GOOD}) THEN 20 ELSE 0 END + CASE WHEN mark IN ('.', '?', '!', '。') THEN 20 ELSE 0 END + CASE WHEN mark IN ('?', '!') THEN 10 ELSE 0 END) AS v FROM last_words
),
ends AS (
    SELECT video_id, clip_ord, min_by(w_end, {{'v': v, 'i': i}}) FILTER (is_break AND fits) AS best, max_by(w_end, i) FILTER (is_break) AS last_break,
        max_by(w_end, i) FILTER (w_end <= e AND norm NOT IN ({_BAD})) AS plain, max_by(w_end, i) AS last FROM valued GROUP BY ALL
),
ended AS (
    SELECT b.*, k.least IS NOT NULL AS has_words, CASE WHEN g.last IS NULL THEN b.e WHEN g.last_break IS NULL THEN coalesce(g.plain + 0.25, least(b.e, g.last + 0.3))
        WHEN g.best IS NULL THEN least(b.e, g.last_break + 0.2) ELSE g.best + 0.25 END AS t
    FROM begun b LEFT JOIN ends g USING (video_id, clip_ord) LEFT JOIN bounds k USING (video_id, clip_ord)
),
tried AS (SELECT *, t - s < 5.0 AS short, t - s < 5.0 AND e - s >= 5.0 AS keep_end, t - s < 5.0 AND e - s < 5.0 AND t - start >= 5.0 AS keep_start FROM ended),
used AS (SELECT *, CASE WHEN keep_start THEN start ELSE s END AS s2, least(CASE WHEN keep_end THEN e ELSE t END, CASE WHEN keep_start THEN start ELSE s END + 180.0) AS e2 FROM tried),
adjusted AS (
    SELECT *, has_words AND (NOT short OR keep_end OR keep_start) AND (s2 > start + 0.2 OR abs(e2 - e) > 0.4) AS boundary_moved FROM used
),
edges AS (
    SELECT video_id, clip_ord, llm_start, llm_end, CASE WHEN boundary_moved THEN s2 ELSE start END AS start, CASE WHEN boundary_moved THEN e2 ELSE e END AS "end", boundary_moved, hook, closing_line FROM adjusted
)"""
)


def _spans(segs: DataFrame, *more: str) -> DataFrame:
    """Keys and edges of the clips: what is written once to gather their words."""
    return fx.clips(segs).select("video_id", "clip_ord", "start", "end", *more)


@register(
    f"""WITH RECURSIVE {ADJUSTED_SQL} SELECT video_id, clip_ord, llm_start, llm_end, round(start, 6) AS start, round("end", 6) AS "end", boundary_moved, hook, closing_line FROM edges"""
)
def c5_adjust_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = fx.segments(spark, sf_dir)
    out = boundaries.adjust_boundaries(selection.select_clips(fx.clips(segs)), fx.words(segs))
    return out.select("video_id", "clip_ord", "llm_start", "llm_end", _sec("start"), _sec("end"), "boundary_moved", "hook", "closing_line")


NEAR_SQL = (
    fx.WORDS_SQL
    + ","
    + fx.CLIPS_SQL
    + r""",
near AS (
    SELECT c.video_id, c.clip_ord, c.start, c."end" AS e, w.word, w.seg_id, w.word_pos, w.w_start, w.w_end,
        row_number() OVER (PARTITION BY c.video_id, c.clip_ord ORDER BY w.w_start, w.seg_id, w.word_pos) - 1 AS i, count(*) OVER (PARTITION BY c.video_id, c.clip_ord) AS n
    FROM clips c JOIN words w ON w.video_id = c.video_id AND w.w_end > c.start AND w.w_start < c."end"
)"""
)
_TIGHT = ", ".join(f"'{x}'" for x in boundaries.TIGHT_FILLERS)


@register(
    f"""WITH {NEAR_SQL},
    d AS (SELECT *, count(*) OVER f / greatest(last(w_end) OVER f - w_start, 0.1) AS density FROM near
        WINDOW f AS (PARTITION BY video_id, clip_ord ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
    lo AS (SELECT *, coalesce(min(i) FILTER (density >= 0.5 AND i + 3 < n) OVER (PARTITION BY video_id, clip_ord), 0) AS lo FROM d),
    t AS (SELECT * REPLACE (i - lo AS i) FROM lo WHERE i >= lo),
    b AS (SELECT *, count(*) OVER f / greatest(w_end - first(w_start) OVER f, 0.1) AS back FROM t
        WINDOW f AS (PARTITION BY video_id, clip_ord ORDER BY i ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)),
    hi AS (SELECT *, coalesce(max(i) FILTER (back >= 0.5 AND i >= 3) OVER (PARTITION BY video_id, clip_ord), max(i) OVER (PARTITION BY video_id, clip_ord)) AS hi FROM b),
    u AS (SELECT *, coalesce(min(i) FILTER (i < 3 AND trim(lower(trim(word)), '.,!?;:') NOT IN ({_TIGHT})) OVER (PARTITION BY video_id, clip_ord), 0) AS f FROM hi WHERE i <= hi),
    g AS (SELECT video_id, clip_ord, any_value(start) AS s, any_value(e) AS e, min_by(w_start, i) - 0.15 AS a, max_by(w_end, i) + 0.5 AS b FROM u WHERE i >= f GROUP BY ALL),
    r AS (SELECT video_id, clip_ord, s, e, greatest(s, a) AS a, least(e, b) AS b FROM g)
    SELECT c.video_id, c.clip_ord, coalesce(b - a >= 5.0, false) AS tightened, round(CASE WHEN b - a >= 5.0 THEN a ELSE c.start END, 6) AS start,
        round(CASE WHEN b - a >= 5.0 THEN b ELSE c."end" END, 6) AS "end" FROM clips c LEFT JOIN r USING (video_id, clip_ord)"""
)
def c6_w7_w8_w9_tighten(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = fx.segments(spark, sf_dir)
    return boundaries.tighten(_spans(segs), fx.words(segs)).select("video_id", "clip_ord", "tightened", _sec("start"), _sec("end"))


@register(
    f"""WITH {fx.WORDS_SQL}, g AS (SELECT *, lead(w_start) OVER (PARTITION BY video_id ORDER BY w_start, seg_id, word_pos) - w_end AS gap, right(word, 1) AS mark, trim(lower(word), '.,!?;:') AS norm FROM words)
    SELECT video_id, seg_id, word_pos, coalesce(gap >= 0.6, false) OR mark IN ('.', '?', '!', '。', '؟') AS is_break,
    CASE WHEN gap >= 1.2 THEN 30 WHEN gap >= 0.8 THEN 22 WHEN gap >= 0.5 THEN 14 WHEN gap >= 0.3 THEN 8 ELSE 0 END + CASE WHEN norm IN ({_BAD}) THEN 0 ELSE 25 END
    + CASE WHEN norm IN ({_GOOD}) THEN 20 ELSE 0 END + CASE WHEN mark IN ('.', '?', '!', '。') THEN 20 ELSE 0 END + CASE WHEN mark IN ('?', '!') THEN 10 ELSE 0 END AS score FROM g"""
)
def w10_w11_ending_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries.ending_scores(fx.word_arrays(fx.segments(spark, sf_dir)))


@register(f"WITH {NEAR_SQL} SELECT video_id, clip_ord, seg_id, word_pos, w_start, w_end FROM near")
def j3_j4_words_of_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = fx.segments(spark, sf_dir)
    near = boundaries.near_words(_spans(segs), fx.words(segs), 0.0, 0.0).select("video_id", "clip_ord", F.explode_outer("ws").alias("w")).where("w is not null")
    return near.select("video_id", "clip_ord", "w.seg_id", "w.word_pos", F.col("w.s").alias("w_start"), F.col("w.e").alias("w_end"))


@register(
    rf"""WITH {NEAR_SQL}, said AS (SELECT video_id, seg_id AS clip_ord, list_filter(string_split_regex(lower(coalesce(lead(text, 2) OVER (PARTITION BY video_id ORDER BY seg_id), '')), '\s+'), lambda x: x <> '')[2:4] AS three FROM segments),
    asked AS (SELECT c.video_id, c.clip_ord, list_transform(s.three, lambda x, i: CASE WHEN i = 2 THEN x || 'x' ELSE x END) AS q FROM clips c JOIN said s USING (video_id, clip_ord)),
    parts AS (SELECT video_id, clip_ord, len(q) AS m, unnest(q) AS x, generate_subscripts(q, 1) - 1 AS k FROM asked),
    met AS (
        SELECT p.video_id, p.clip_ord, n.i - p.k AS pos, any_value(p.m) AS m, count(*) FILTER (t.w = p.x) AS equal,
            count(*) FILTER (p.x <> '' AND t.w <> '' AND (contains(p.x, t.w) OR contains(t.w, p.x))) AS alike, count(*) AS held
        FROM parts p JOIN near n ON n.video_id = p.video_id AND n.clip_ord = p.clip_ord AND n.i >= p.k, LATERAL (SELECT trim(lower(trim(n.word)), '.,!?;:') AS w) t GROUP BY ALL
    ),
    place AS (SELECT video_id, clip_ord, min(pos) AS pos FROM met WHERE held = m AND (equal = m OR alike >= greatest(1, m - 1)) GROUP BY ALL)
    SELECT a.video_id, a.clip_ord, array_to_string(a.q, ' ') AS query, n.seg_id, n.word_pos::INTEGER AS word_pos FROM asked a LEFT JOIN place p USING (video_id, clip_ord)
    LEFT JOIN near n ON n.video_id = p.video_id AND n.clip_ord = p.clip_ord AND n.i = p.pos"""
)
def j19_phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three words of each clip's last line, one of them altered, sought in the clip."""
    segs = fx.segments(spark, sf_dir)
    near = boundaries.near_words(_spans(segs, "closing_line"), fx.word_arrays(segs), 0.0, 0.0)
    three = F.slice(tx.tokens(F.lower("closing_line")), 2, 3)
    query = F.array_join(F.transform(three, lambda x, i: F.when(i == 1, F.concat(x, F.lit("x"))).otherwise(x)), " ")
    found = boundaries.find_phrase(near.withColumn("query", query), "ws", "query", "hit")
    first = F.get("hit", F.lit(0))
    return found.select("video_id", "clip_ord", "query", first["seg_id"].alias("seg_id"), first["word_pos"].alias("word_pos"))


# Subtitles and silence.
CLIP_WORDS_SQL = (
    NEAR_SQL
    + r""",
clip_words AS (
    SELECT c.video_id, c.clip_ord, row_number() OVER (PARTITION BY c.video_id, c.clip_ord ORDER BY w.w_start, w.seg_id, w.word_pos) - 1 AS n, trim(w.word) AS word,
        greatest(0, w.w_start - c.start) AS start, greatest(0, w.w_end - c.start) AS "end"
    FROM clips c JOIN words w ON w.video_id = c.video_id AND (w.w_start + w.w_end) / 2 >= c.start AND (w.w_start + w.w_end) / 2 <= c."end" AND w.seg_end >= c.start AND w.seg_start <= c."end"
),
phrases AS (
    SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY clip_ord, phrase_no) - 1 AS phrase_id FROM (
        SELECT video_id, clip_ord, n // 5 AS phrase_no, string_agg(word, ' ' ORDER BY n) AS text, min_by(start, n) AS start, max_by("end", n) AS "end", count(*) AS n_words FROM clip_words GROUP BY ALL)
)"""
)


def _clip_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = fx.segments(spark, sf_dir)
    return subtitles.clip_word_arrays(_spans(segs), fx.word_arrays(segs))


def _phrase_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = fx.segments(spark, sf_dir)
    return subtitles.phrase_arrays(subtitles.clip_word_arrays(_spans(segs), fx.word_arrays(segs), in_place=True))


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.phrase_texts(_phrase_words(spark, sf_dir))


def _translations(phrases: DataFrame) -> DataFrame:
    """What a model might answer for all phrases: capitals; every eleventh answer is missing and every
    thirteenth useless, so that the fallbacks have work; others have words more or less than the phrase."""
    pick, shout = F.pmod("phrase_id", F.lit(5)), F.upper(F.replace("text", F.lit("ß"), F.lit("ss")))
    text = F.when(F.pmod("phrase_id", F.lit(13)) == 0, F.concat(F.lit("<unk> <unk> "), shout)).when(pick == 1, F.concat(shout, F.lit(" AND MORE")))
    text = text.when((pick == 2) & (F.col("n_words") > 1), F.regexp_replace(shout, r" [^ ]*$", "")).otherwise(shout)
    return phrases.where(F.pmod("phrase_id", F.lit(11)) != 0).select("video_id", "phrase_id", text.alias("text"))


@register(f'WITH {CLIP_WORDS_SQL} SELECT video_id, clip_ord, n, word, round(start, 6) AS start, round("end", 6) AS "end" FROM clip_words')
def j5_clip_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _clip_words(spark, sf_dir).select("video_id", "clip_ord", F.inline_outer("ws")).where("n is not null")
    return words.withColumns({"start": F.round("start", 6), "end": F.round("end", 6)})


@register(
    f"""WITH {CLIP_WORDS_SQL} SELECT video_id, clip_ord, phrase_no, phrase_id, phrase_id // 80 AS batch, text, round(start, 6) AS start, round("end", 6) AS "end", n_words FROM phrases"""
)
def a5_w17_w18_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrases(spark, sf_dir).withColumns({"start": F.round("start", 6), "end": F.round("end", 6)})


@register(
    f"""WITH {CLIP_WORDS_SQL}, a AS (SELECT *, CASE WHEN phrase_id % 13 = 0 THEN '<unk> <unk> ' || u WHEN phrase_id % 5 = 1 THEN u || ' AND MORE' WHEN phrase_id % 5 = 2 AND n_words > 1 THEN regexp_replace(u, ' [^ ]*$', '') ELSE u END AS t
    FROM (SELECT *, upper(replace(text, 'ß', 'ss')) AS u FROM phrases)) SELECT video_id, phrase_id FROM a WHERE phrase_id % 11 = 0 OR (phrase_id % 13 = 0 AND 2.0 / (n_words + 2) > 0.2) OR length(t) < 2"""
)
def p15_j10_u5_missing_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = _phrases(spark, sf_dir)
    return subtitles.missing_translations(phrases, _translations(phrases)).select("video_id", "phrase_id")


# Spreading new words over a phrase's time as a recursion over them: v holds the old words, w the new ones.
SPREAD_SQL = (
    CLIP_WORDS_SQL
    + r""",
answered AS (
    SELECT p.video_id, p.clip_ord, p.phrase_no, CASE WHEN phrase_id % 11 = 0 OR phrase_id % 13 = 0 OR length(a.t) < 2 THEN NULL ELSE string_split(a.t, ' ') END AS w, v.s, v.e, v.old
    FROM phrases p JOIN (SELECT video_id, clip_ord, n // 5 AS phrase_no, list(start ORDER BY n) AS s, list("end" ORDER BY n) AS e, list(word ORDER BY n) AS old FROM clip_words GROUP BY ALL) v USING (video_id, clip_ord, phrase_no),
        LATERAL (SELECT CASE WHEN phrase_id % 5 = 1 THEN u || ' AND MORE' WHEN phrase_id % 5 = 2 AND n_words > 1 THEN regexp_replace(u, ' [^ ]*$', '') ELSE u END AS t FROM (SELECT upper(replace(text, 'ß', 'ss')) AS u)) a
),
uneven AS (
    SELECT *, len(w) AS m, len(old) AS k, list_sum(list_transform(e, lambda x, i: x - s[i])) / len(w) AS talk FROM answered WHERE w IS NOT NULL AND len(w) <> len(old)
),
pauses AS (
    SELECT video_id, clip_ord, phrase_no, pos, sum(pause) AS pause FROM (
        SELECT video_id, clip_ord, phrase_no, s[j + 2] - e[j + 1] AS pause, greatest(0, CASE WHEN greatest(1, m - 1) >= k - 1 THEN j WHEN k - 1 > 1 THEN least(m - 2, CAST(round_even(j * (m - 2) / (k - 2), 0) AS BIGINT)) ELSE 0 END) AS pos
        FROM (SELECT *, unnest(range(0, k - 1)) AS j FROM uneven)) GROUP BY ALL
),
said AS (
    SELECT video_id, clip_ord, phrase_no, 0 AS i, s[1] AS now FROM uneven
    UNION ALL
    SELECT u.video_id, u.clip_ord, u.phrase_no, d.i + 1, d.now + u.talk + CASE WHEN u.e[-1] > d.now + u.talk THEN least(coalesce(p.pause, 0), u.e[-1] - (d.now + u.talk)) ELSE 0 END
    FROM said d JOIN uneven u ON u.video_id = d.video_id AND u.clip_ord = d.clip_ord AND u.phrase_no = d.phrase_no AND d.i + 1 < u.m
    LEFT JOIN pauses p ON p.video_id = d.video_id AND p.clip_ord = d.clip_ord AND p.phrase_no = d.phrase_no AND p.pos = d.i
),
timed_words AS (
    SELECT video_id, clip_ord, phrase_no, i AS k, w[i + 1] AS word, now AS start, now + talk AS "end" FROM said JOIN uneven USING (video_id, clip_ord, phrase_no)
    UNION ALL
    SELECT video_id, clip_ord, phrase_no, unnest(range(0, len(old))), unnest(coalesce(w, old)), unnest(s), unnest(e) FROM answered WHERE w IS NULL OR len(w) = len(old)
)"""
)


@register(f'WITH RECURSIVE {SPREAD_SQL} SELECT video_id, clip_ord, phrase_no, k::INTEGER AS k, word, round(start, 5) AS start, round("end", 5) AS "end" FROM timed_words')
def c8_f9_j9_j17_translated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = _phrase_words(spark, sf_dir)
    out = subtitles.translated_phrases(phrases, _translations(subtitles.phrase_texts(phrases)))
    return out.withColumns({"start": F.round("start", 5), "end": F.round("end", 5)})


_CLOCK = "(cs{0} // 360000)::VARCHAR || ':' || lpad((cs{0} // 6000 % 60)::VARCHAR, 2, '0') || ':' || lpad((cs{0} // 100 % 60)::VARCHAR, 2, '0') || '.' || lpad((cs{0} % 100)::VARCHAR, 2, '0')"
# Grouping as a recursion over the words of each clip.
LINES_SQL = (
    CLIP_WORDS_SQL
    + r""",
lined AS (
    SELECT video_id, clip_ord, n, 0 AS line_no, start AS b, "end" AS last, 1 AS size FROM clip_words WHERE n = 0
    UNION ALL
    SELECT w.video_id, w.clip_ord, w.n, l.line_no + k.fresh, CASE WHEN k.fresh = 1 THEN w.start ELSE l.b END, w."end", CASE WHEN k.fresh = 1 THEN 1 ELSE l.size + 1 END
    FROM lined l JOIN clip_words w ON w.video_id = l.video_id AND w.clip_ord = l.clip_ord AND w.n = l.n + 1,
        LATERAL (SELECT CASE WHEN l.size >= 4 OR w."end" - l.b > 2.5 OR w.start - l.last > 0.5 THEN 1 ELSE 0 END AS fresh) k
),
shown AS (
    SELECT l.video_id, l.clip_ord, l.line_no, string_agg(w.word, ' ' ORDER BY l.n) AS text, min_by(w.start, l.n) AS start, max_by(w."end", l.n) AS e, count(*) AS n_words
    FROM lined l JOIN clip_words w USING (video_id, clip_ord, n) GROUP BY ALL
),
clamped AS (
    SELECT *, least(e, coalesce(lead(start) OVER (PARTITION BY video_id, clip_ord ORDER BY line_no) - 0.04::DOUBLE, e)) AS cut FROM shown
),
lines_found AS (SELECT * REPLACE (CASE WHEN cut <= start THEN start + 0.1::DOUBLE ELSE cut END AS cut) FROM clamped)"""
)


@register(
    f"""WITH RECURSIVE {LINES_SQL} SELECT video_id, clip_ord, line_no, text, round(start, 6) AS start, round(cut, 6) AS "end", n_words,
    'Dialogue: 0,' || {_CLOCK.format(1)} || ',' || {_CLOCK.format(2)} || ',Default,,0,0,0,,' || text AS dialogue
    FROM (SELECT *, CAST(round_even(greatest(start, 0) * 100, 0) AS BIGINT) AS cs1, CAST(round_even(greatest(cut, 0) * 100, 0) AS BIGINT) AS cs2 FROM lines_found)"""
)
def c9_f5_w15_subtitle_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = subtitles.dialogue(subtitles.array_lines(_clip_words(spark, sf_dir)))
    return out.withColumns({"start": F.round("start", 6), "end": F.round("end", 6)})


SILENCE_SQL = (
    CLIP_WORDS_SQL
    + r""",
broken AS (SELECT *, CASE WHEN start - lag("end") OVER w <= 1.5 THEN 0 ELSE 1 END AS fresh FROM clip_words WINDOW w AS (PARTITION BY video_id, clip_ord ORDER BY start, n)),
spoken AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id, clip_ord ORDER BY start, n) AS island FROM broken),
runs AS (SELECT video_id, clip_ord, island, min_by(start, n) AS s, max_by("end", n) AS e FROM spoken GROUP BY ALL),
keep AS (
    SELECT c.video_id, c.clip_ord, coalesce(r.island, 1) AS region_id, CASE WHEN r.island IS NULL THEN 0 ELSE greatest(0, r.s - 0.2::DOUBLE) END AS start,
        CASE WHEN r.island IS NULL THEN c."end" - c.start ELSE least(r.e + 0.2::DOUBLE, c."end" - c.start) END AS "end", c."end" - c.start AS duration
    FROM clips c LEFT JOIN runs r USING (video_id, clip_ord)
)"""
)


def _keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _clip_words(spark, sf_dir).withColumn("duration", F.col("end") - F.col("start"))
    return silence.region_arrays(words).select("video_id", "clip_ord", "duration", "ws", "regions")


@register(
    f"""WITH {SILENCE_SQL} SELECT video_id, clip_ord, CAST(region_id AS BIGINT) AS region_id, round(start, 6) AS start, round("end", 6) AS "end",
    round(coalesce(sum("end" - start) OVER (PARTITION BY video_id, clip_ord ORDER BY region_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS new_start FROM keep"""
)
def w5_w14_keep_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keep(spark, sf_dir).select("video_id", "clip_ord", F.inline_outer("regions")).withColumns({c: F.round(c, 6) for c in ("start", "end", "new_start")})


@register(
    f"""WITH {SILENCE_SQL} SELECT video_id, clip_ord, count(*) AS n_regions, round(sum("end" - start), 6) AS kept, round(any_value(duration) - sum("end" - start), 6) AS saved FROM keep GROUP BY ALL"""
)
def a8_kept_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _keep(spark, sf_dir).withColumn("kept", silence.kept_of(F.col("regions")))
    own = own.select("video_id", "clip_ord", F.size("regions").cast("long").alias("n_regions"), "kept", (F.col("duration") - F.col("kept")).alias("saved"))
    return own.withColumns({c: F.round(c, 6) for c in ("kept", "saved")})


@register(
    f"""WITH {SILENCE_SQL}, ok AS (SELECT video_id, clip_ord FROM keep GROUP BY ALL HAVING any_value(duration) - sum("end" - start) >= 2 AND sum("end" - start) >= 5 AND count(*) > 1),
    placed_regions AS (SELECT *, coalesce(sum("end" - start) OVER (PARTITION BY video_id, clip_ord ORDER BY region_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS new_start
        FROM keep SEMI JOIN ok USING (video_id, clip_ord)),
    hit AS (SELECT w.video_id, w.clip_ord, w.n, w.word, w.start, w."end", r.start AS rs, r.new_start, row_number() OVER (PARTITION BY w.video_id, w.clip_ord, w.n ORDER BY r.region_id) AS k
        FROM clip_words w JOIN placed_regions r ON r.video_id = w.video_id AND r.clip_ord = w.clip_ord AND (w.start + w."end") / 2 >= r.start AND (w.start + w."end") / 2 <= r."end")
    SELECT video_id, clip_ord, n, word, round(greatest(0, start + new_start - rs), 4) AS start, round(greatest(0, "end" + new_start - rs), 4) AS "end" FROM hit WHERE k = 1"""
)
def c10_p16_j8_retimed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _keep(spark, sf_dir)
    own = own.where(silence.is_worth_cutting(F.col("regions"), F.col("duration")))
    moved = silence.retimed(F.col("ws"), F.col("regions"))
    return own.select("video_id", "clip_ord", F.inline_outer(moved)).where("n is not null").withColumns({c: F.round(c, 4) for c in ("start", "end")})


# Crops.
@register(
    f"""WITH {fx.BOXES_SQL}, l AS (SELECT clip_id, time, count(*)::INTEGER AS n, any_value(cx) FILTER (r = 1) AS cx FROM
    (SELECT *, row_number() OVER (PARTITION BY clip_id, time ORDER BY area DESC, box_ord) AS r FROM boxes WHERE conf >= 0.5) GROUP BY ALL) SELECT clip_id, time, n, cx::DOUBLE AS cx FROM l"""
)
def p12_k3_confident_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = F.get("boxes", F.lit(0))
    own = crops.confident(fx.detections(spark, sf_dir))
    return own.select("clip_id", "time", F.size("boxes").alias("n"), ((big["x1"] + big["x2"]) / 2.0).alias("cx"))


@register(
    f"""WITH {fx.BOXES_SQL}, s AS (SELECT clip_id, avg(cx) OVER (PARTITION BY clip_id ORDER BY time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sx FROM largest),
    m AS (SELECT clip_id, list_sort(list(sx))[len(list(sx)) // 2 + 1] AS mx FROM s GROUP BY 1)
    SELECT clip_id, CAST(greatest(0, least(trunc(mx - 303.0), 1920 - 606)) AS INTEGER) AS x, 0 AS y, 606 AS w, 1080 AS h FROM m"""
)
def a13_w6_static_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crops.static_crop(crops.confident(fx.detections(spark, sf_dir)), fx.frames(spark, sf_dir))


# The exponential pan as a recursion over a clip's segments of three seconds.
@register(
    f"""WITH RECURSIVE {fx.BOXES_SQL}, grouped AS (SELECT clip_id, CAST(floor(time / 3) AS BIGINT) AS seg, list_sort(list(cx)) AS v FROM largest GROUP BY ALL),
    spans AS (SELECT clip_id, unnest(range(0, CAST(floor(max(time) / 3) AS BIGINT) + 1)) AS seg FROM largest GROUP BY 1),
    mids AS (SELECT s.clip_id, s.seg, v[len(v) // 2 + 1] AS mx FROM spans s LEFT JOIN grouped g ON g.clip_id = s.clip_id AND g.seg = s.seg),
    pan AS (
        SELECT clip_id, seg, CASE WHEN mx IS NULL THEN 960::DOUBLE ELSE 960::DOUBLE * 0.3::DOUBLE + mx * 0.7::DOUBLE END AS cx FROM mids WHERE seg = 0
        UNION ALL
        SELECT m.clip_id, m.seg, CASE WHEN m.mx IS NULL THEN p.cx ELSE p.cx * 0.3::DOUBLE + m.mx * 0.7::DOUBLE END FROM pan p JOIN mids m ON m.clip_id = p.clip_id AND m.seg = p.seg + 1
    )
    SELECT clip_id, seg * 3::DOUBLE AS time, CAST(greatest(0, least(trunc(cx - 303), 1314)) AS INTEGER) AS x, 606 AS w FROM pan"""
)
def f7_a12_dynamic_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crops.dynamic_crops(crops.confident(fx.detections(spark, sf_dir)), fx.frames(spark, sf_dir)).select("clip_id", "time", "x", "w")


# Two people far apart keep their tracks; the one whose box comes first in the first frame is track 0.
TRACKS_SQL = (
    fx.BOXES_SQL
    + r""",
placed_boxes AS (SELECT clip_id, time, box_ord AS person, cx, row_number() OVER (PARTITION BY clip_id, time ORDER BY area DESC, box_ord) - 1 AS k FROM boxes WHERE conf >= 0.5),
front AS (SELECT clip_id, person AS first_person FROM placed_boxes WHERE time = 1 AND k = 0),
tracks AS (SELECT b.clip_id, b.time, b.k, CASE WHEN b.person = f.first_person THEN 0 ELSE 1 END AS track_id, b.cx FROM placed_boxes b JOIN front f USING (clip_id))"""
)


# Three people, two of whom cross: boxes of a frame in the order in which they are taken, largest first.
FRAMES_SQL = r"""
ways AS (SELECT doc_id AS clip_id, length(text) AS n, unnest(range(60)) AS t FROM documents),
people AS (
    SELECT clip_id, t, 0 AS k, 200 + t * (20 + n % 7) AS cx, 340 AS y1, 80000 - (t + n) % 5 AS area, true AS there FROM ways WHERE (t + n) % 17 <> 0
    UNION ALL SELECT clip_id, t, 1, 1700 - t * (18 + n % 11), 360, 80000 - (t * 3 + clip_id) % 5, true FROM ways WHERE (t + n) % 17 <> 0
    UNION ALL SELECT clip_id, t, 2, 960 + (t * 37 + n) % 90, 320, 80000 - (t * 7 + n) % 5, (t + clip_id) % 9 >= 3 FROM ways WHERE (t + n) % 17 <> 0
),
frames AS (SELECT clip_id, t::DOUBLE AS time, list({'cx': cx::DOUBLE, 'y1': y1} ORDER BY area DESC, k) AS boxes FROM people WHERE there GROUP BY clip_id, t)"""


def tracks_sql(frames: str, stale: float) -> str:
    """The greedy rule as a recursion over the frames of each clip. A box wishes for the nearest live track; of
    the boxes with one wish the nearest has it, and the others start tracks, numbered by their distances."""
    return rf"""
turns AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY time) AS i FROM {frames}),
follow AS (
    SELECT clip_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(track INTEGER, x DOUBLE, y DOUBLE, seen DOUBLE)[]) AS live, 0 AS n, CAST(NULL AS DOUBLE) AS time,
        CAST([] AS STRUCT(box INTEGER, track INTEGER, cx DOUBLE, y1 INTEGER)[]) AS done
    FROM turns WHERE i = 1
    UNION ALL
    SELECT clip_id, i, list_concat(
            list_filter(near, lambda v: NOT list_contains(list_transform(done, lambda d: d.track), v.track)),
            list_transform(done, lambda d: {{'track': d.track, 'x': d.cx, 'y': d.y1 + 200.0::DOUBLE, 'seen': time}})
        ), n + len(list_filter(done, lambda d: d.track >= n)), time, done
    FROM (
        SELECT clip_id, i, near, n, time, list_transform(range(1, len(sorted) + 1), lambda k: {{
            'box': CAST(sorted[k].box AS INTEGER),
            'track': CASE WHEN fresh[k] THEN CAST(n + len(list_filter(fresh[:k - 1], lambda f: f)) AS INTEGER) ELSE sorted[k].wish.track END,
            'cx': boxes[sorted[k].box + 1].cx, 'y1': boxes[sorted[k].box + 1].y1
        }}) AS done
        FROM (
            SELECT *, list_transform(range(1, len(sorted) + 1), lambda k: sorted[k].wish.track < 0
                OR list_contains(list_transform(sorted[:k - 1], lambda s: s.wish.track), sorted[k].wish.track)) AS fresh
            FROM (
                SELECT *, list_sort(list_transform(range(1, len(boxes) + 1), lambda k: {{
                    'wish': list_min(list_append(list_transform(near, lambda v: {{
                        'cost': sqrt((boxes[k].cx - v.x) * (boxes[k].cx - v.x) + (boxes[k].y1 + 200 - v.y) * (boxes[k].y1 + 200 - v.y)), 'track': v.track
                    }}), {{'cost': 'inf'::DOUBLE, 'track': -1}})), 'box': k - 1
                }})) AS by_wish, list_sort(list_transform(by_wish, lambda s: {{'cost': s.wish.cost, 'box': s.box, 'wish': s.wish}})) AS sorted
                FROM (
                    SELECT t.clip_id, t.i, t.time, t.boxes, f.n, list_filter(f.live, lambda v: t.time - v.seen <= {stale}) AS near
                    FROM follow f JOIN turns t ON t.clip_id = f.clip_id AND t.i = f.i + 1
                )
            )
        )
    )
),
tracks AS (
    SELECT clip_id, time, d.box AS box_ord, d.track AS track_id, (d.cx - 100)::INTEGER AS x1, d.y1::INTEGER AS y1, (d.cx + 100)::INTEGER AS x2, (d.y1 + 400)::INTEGER AS y2
    FROM (SELECT clip_id, time, unnest(done) AS d FROM follow)
)"""


@register(f"WITH RECURSIVE {FRAMES_SQL}, {tracks_sql('frames', 3.0)} SELECT * FROM tracks")
def f6_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crops.assign_tracks(crops.confident(fx.crossing(spark, sf_dir)), stale=3.0)


SPEAKER_SQL = r"""
mouth AS (SELECT doc_id AS clip_id, k AS track_id, unnest(range(60)) AS i FROM documents, (VALUES (0), (1)) v(k)),
signal AS (SELECT clip_id, track_id, i, CAST((clip_id * 7 + track_id * 31 + i * 13) % 100 AS DOUBLE) / 100 AS score FROM mouth),
grid AS (SELECT doc_id AS clip_id, k AS track_id, unnest(range(120)) AS win_idx FROM documents, (VALUES (0), (1)) v(k)),
placed AS (SELECT *, CAST(win_idx * 59 AS DOUBLE) / 119 AS x FROM grid),
spread AS (
    SELECT p.clip_id, p.track_id, p.win_idx, a.score + (b.score - a.score) * (p.x - floor(p.x)) AS v FROM placed p
    JOIN signal a ON a.clip_id = p.clip_id AND a.track_id = p.track_id AND a.i = floor(p.x)
    JOIN signal b ON b.clip_id = p.clip_id AND b.track_id = p.track_id AND b.i = least(floor(p.x) + 1, 59)
),
scaled AS (SELECT *, CASE WHEN max(v) OVER w > 0 THEN v / max(v) OVER w ELSE v END AS value FROM spread WINDOW w AS (PARTITION BY clip_id, track_id)),
loud AS (SELECT clip_id, track_id, win_idx, value, CAST((clip_id * 3 + win_idx * 17) % 100 AS DOUBLE) / 100 AS env FROM scaled),
speaking AS (
    SELECT clip_id, win_idx, CASE WHEN any_value(env) < 0.04 THEN -1 ELSE arg_max(track_id, {'c': value * env, 't': -track_id}) END::INTEGER AS track_id FROM loud GROUP BY ALL
)"""


@register(f"WITH {SPEAKER_SQL} SELECT clip_id, track_id, win_idx, round(value, 6) AS value FROM scaled")
def w20_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = fx.frames(spark, sf_dir).select("clip_id", F.lit(120).cast("long").alias("n"))
    return crops.resample(fx.mouths(spark, sf_dir), windows).withColumn("value", F.round("value", 6))


def _speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = fx.frames(spark, sf_dir).select("clip_id", F.lit(120).cast("long").alias("n"))
    return crops.active_speaker(crops.resample(fx.mouths(spark, sf_dir), windows), fx.envelope(spark, sf_dir))


@register(f"WITH {SPEAKER_SQL} SELECT * FROM speaking")
def f10_j21_active_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _speakers(spark, sf_dir)


@register(
    f"""WITH {SPEAKER_SQL}, segs AS (SELECT doc_id AS clip_id, unnest(range(60)) AS seg FROM documents),
    votes AS (SELECT s.clip_id, s.seg, p.track_id, count(*) AS n, min(p.win_idx) AS first FROM segs s JOIN speaking p ON p.clip_id = s.clip_id AND p.win_idx BETWEEN s.seg * 2 AND s.seg * 2 + 2
        WHERE p.track_id >= 0 GROUP BY ALL),
    won AS (SELECT clip_id, seg, track_id FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, seg ORDER BY n DESC, first) AS r FROM votes) WHERE r = 1)
    SELECT s.clip_id, s.seg, coalesce(last_value(w.track_id IGNORE NULLS) OVER (PARTITION BY s.clip_id ORDER BY s.seg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1)::INTEGER AS track_id
    FROM segs s LEFT JOIN won w USING (clip_id, seg)"""
)
def a10_w21_segment_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = fx.frames(spark, sf_dir).select("clip_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long"))).alias("seg"))
    return crops.segment_speakers(_speakers(spark, sf_dir), segs)


def _speaker_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = crops.assign_tracks(crops.confident(fx.detections(spark, sf_dir)), stale=3.0)
    return crops.speaker_crops(tracks, _speakers(spark, sf_dir), fx.frames(spark, sf_dir))


# The pan that follows the speaker of each second as a recursion.
FOLLOW_SQL = (
    SPEAKER_SQL
    + ", "
    + TRACKS_SQL
    + r""",
clip_seconds AS (SELECT doc_id AS clip_id, unnest(range(60)) AS seg FROM documents),
ballot AS (SELECT s.clip_id, s.seg, p.track_id, count(*) AS n, min(p.win_idx) AS first FROM clip_seconds s JOIN speaking p ON p.clip_id = s.clip_id AND p.win_idx BETWEEN s.seg * 2 AND s.seg * 2 + 2 WHERE p.track_id >= 0 GROUP BY ALL),
elected AS (SELECT clip_id, seg, track_id FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, seg ORDER BY n DESC, first) AS r FROM ballot) WHERE r = 1),
speaker AS (
    SELECT s.clip_id, s.seg, coalesce(last_value(w.track_id IGNORE NULLS) OVER (PARTITION BY s.clip_id ORDER BY s.seg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1)::INTEGER AS track_id
    FROM clip_seconds s LEFT JOIN elected w USING (clip_id, seg)
),
goals AS (SELECT s.clip_id, s.seg, s.track_id, t.cx::DOUBLE AS mx FROM speaker s LEFT JOIN tracks t ON t.clip_id = s.clip_id AND t.time = s.seg AND t.track_id = s.track_id),
view AS (
    SELECT clip_id, seg, track_id, CASE WHEN mx IS NULL THEN 960::DOUBLE ELSE 960::DOUBLE * 0.3::DOUBLE + mx * 0.7::DOUBLE END AS cx FROM goals WHERE seg = 0
    UNION ALL
    SELECT g.clip_id, g.seg, g.track_id, CASE WHEN g.mx IS NULL THEN v.cx WHEN v.track_id >= 0 AND v.track_id <> g.track_id THEN g.mx ELSE v.cx * 0.3::DOUBLE + g.mx * 0.7::DOUBLE END
    FROM view v JOIN goals g ON g.clip_id = v.clip_id AND g.seg = v.seg + 1
),
keyframes AS (SELECT clip_id, seg::DOUBLE AS time, CAST(greatest(0, least(trunc(cx - 303), 1314)) AS INTEGER) AS x, 0::INTEGER AS y, 606::INTEGER AS w, 1080::INTEGER AS h, track_id FROM view)"""
)


@register(f"WITH RECURSIVE {FOLLOW_SQL} SELECT * FROM keyframes")
def c12_f8_speaker_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _speaker_crops(spark, sf_dir)


@register(
    f"""WITH RECURSIVE {FOLLOW_SQL}, ahead AS (SELECT *, lead(x) OVER w AS nx, lead(track_id) OVER w AS nt FROM keyframes WINDOW w AS (PARTITION BY clip_id ORDER BY time)),
    asked AS (SELECT doc_id AS clip_id, unnest(range(240)) / 4.0::DOUBLE AS t FROM documents)
    SELECT q.clip_id, q.t, round(a.x + CASE WHEN a.nt = a.track_id THEN (a.nx - a.x) * (q.t - a.time) ELSE 0 END, 6)::DOUBLE AS x, 0.0::DOUBLE AS y FROM asked q JOIN ahead a ON a.clip_id = q.clip_id AND a.time = floor(q.t)"""
)
def j22_w22_crop_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crop at each quarter second: keyframes joined as of the query's time."""
    times = fx.frames(spark, sf_dir).select("clip_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(239)), lambda i: i / 4.0)).alias("t"))
    out = crops.crop_at(crops.keyframe_spans(_speaker_crops(spark, sf_dir)), times)
    return out.withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


# Model replies, rewrites, caches.
# The replies in SQL: where the cut ones break off, the objects that are whole are counted by their lengths.
REPLIES_SQL = (
    SCORED_SQL
    + r""",
objects AS (
    SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY clip_ord) - 1 AS item, '{"start":' || start::VARCHAR || ',"end":' || "end"::VARCHAR || ',"title":"Clip ' || clip_ord || '","score_emotion":' || score_emotion
        || ',"score_hook":' || score_hook || ',"score_retention":' || score_retention || ',"score_personality":' || score_personality || '}' AS o FROM scored
),
ends AS (SELECT *, sum(length(o) + 2) OVER (PARTITION BY video_id ORDER BY item) - 1 AS pos, sum(length(o) + 2) OVER (PARTITION BY video_id) AS whole FROM objects),
replied AS (SELECT *, video_id % 6 AS kind FROM ends WHERE video_id % 6 <> 5 AND (video_id % 6 <> 4 OR pos <= whole * 7 // 10)),
replies AS (
    SELECT v.video_id, coalesce(n, 0)::INTEGER AS n_items, CASE WHEN v.video_id % 6 = 5 OR n IS NULL THEN 'failed' WHEN v.video_id % 6 = 4 THEN 'partial' ELSE 'ok' END AS status
    FROM (SELECT DISTINCT video_id FROM clips) v LEFT JOIN (SELECT video_id, count(*) AS n FROM replied GROUP BY 1) r USING (video_id)
)"""
)


@register(f"WITH {REPLIES_SQL} SELECT * FROM replies")
def l1_parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = responses.parse_responses(fx.responses(spark, sf_dir), ["video_id"])
    return parsed.select("video_id", "status", F.size("items").alias("n_items"))


@register(
    f"""WITH RECURSIVE {REPLIES_SQL},
    line_up AS (SELECT video_id, item, start AS s, "end" AS e, clip_score, score_emotion, row_number() OVER (PARTITION BY video_id ORDER BY clip_score DESC, score_emotion DESC, item) AS i
        FROM replied WHERE clip_score >= 60 AND "end" - start BETWEEN 15 AND 180),
    kept_items AS (
        SELECT video_id, item, i, true AS ok, [{{'s': s, 'e': e}}] AS taken FROM line_up WHERE i = 1
        UNION ALL
        SELECT q.video_id, q.item, q.i, k.ok, CASE WHEN k.ok THEN list_append(n.taken, {{'s': q.s, 'e': q.e}}) ELSE n.taken END
        FROM kept_items n JOIN line_up q ON q.video_id = n.video_id AND q.i = n.i + 1,
            LATERAL (SELECT len(n.taken) < 30 AND NOT coalesce(list_bool_or(list_transform(n.taken, lambda t:
                greatest(0, least(q.e, t.e) - greatest(q.s, t.s)) / least(q.e - q.s, t.e - t.s) > 0.5)), false) AS ok) k
    )
    SELECT *, 'Moment #' || rank AS title FROM (SELECT l.video_id, l.item::INTEGER AS clip_ord, row_number() OVER (PARTITION BY l.video_id ORDER BY clip_score DESC, score_emotion DESC, l.item)::INTEGER AS rank,
        l.s AS start, l.e AS "end", clip_score FROM line_up l JOIN kept_items k USING (video_id, item) WHERE k.ok)"""
)
def l1_c4_clips_from_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = responses.parse_responses(fx.responses(spark, sf_dir), ["video_id"])
    raw = responses.clip_items(parsed, ["video_id"]).withColumnRenamed("item_ord", "clip_ord").drop("extra")
    return selection.select_clips(raw).select("video_id", "clip_ord", "rank", "start", "end", "clip_score", "title")


@register(
    f"""WITH {REPLIES_SQL} SELECT video_id, CASE WHEN video_id % 5 = 0 THEN '{responses.RETRY_SUFFIXES[0]}' ELSE '{responses.RETRY_SUFFIXES[1]}' END AS suffix
    FROM replies WHERE video_id % 12 = 4 OR (video_id % 6 = 4 AND status = 'failed')"""
)
def l2_retry_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.responses(spark, sf_dir).withColumn("raw", F.when(F.pmod("video_id", F.lit(12)) == 4, F.concat(F.lit("{"), F.substring("raw", 2, 20))).otherwise(F.col("raw")))
    raw = raw.withColumn("attempt", (F.col("video_id") % 5).cast("int"))
    return responses.retry_requests(responses.parse_responses(raw, ["video_id"]), raw, ["video_id"], attempt="attempt")


REFINED_SQL = (
    SCORED_SQL
    + r""",
old AS (SELECT video_id, clip_ord AS clip_id, 'Clip ' || clip_ord AS title, row_number() OVER (PARTITION BY video_id ORDER BY clip_score DESC, score_emotion DESC, clip_ord) AS rank, clip_score FROM scored),
new AS (SELECT video_id, clip_id + CASE WHEN clip_id % 7 = 0 THEN 10000 ELSE 0 END AS clip_id, CASE WHEN clip_id % 3 = 0 THEN ' ' ELSE upper(title) END AS title FROM old WHERE clip_id % 5 <> 0)"""
)


@register(
    f"""WITH {REFINED_SQL}, j AS (SELECT coalesce(o.video_id, n.video_id) AS video_id, coalesce(o.clip_id, n.clip_id) AS clip_id, coalesce(nullif(trim(n.title), ''), o.title) AS title,
    o.rank, o.clip_score FROM old o FULL JOIN new n ON o.video_id = n.video_id AND o.clip_id = n.clip_id)
    SELECT video_id, clip_id, title, row_number() OVER (PARTITION BY video_id ORDER BY clip_score DESC NULLS LAST, rank NULLS LAST, clip_id)::INTEGER AS rank FROM j"""
)
def j11_u2_merge_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = selection.rerank(selection.score_clips(_clips(spark, sf_dir))).withColumnRenamed("clip_ord", "clip_id")
    old = old.select("video_id", F.col("clip_id").cast("long").alias("clip_id"), "title", "rank", "clip_score")
    title = F.when(F.col("clip_id") % 3 == 0, " ").otherwise(F.upper("title"))
    moved = F.col("clip_id") + F.when(F.col("clip_id") % 7 == 0, 10000).otherwise(0)
    new = old.where("clip_id % 5 != 0").select("video_id", moved.alias("clip_id"), title.alias("title"))
    return refine.merge_refined(old, new, ("title",)).select("video_id", "clip_id", "title", "rank")


@register(
    f"""WITH {fx.SEGMENTS_SQL} SELECT DISTINCT video_id, CASE WHEN video_id % 3 = 0 THEN 'missing' WHEN video_id % 3 = 1 THEN 'fresh' ELSE 'stale' END AS state FROM segments"""
)
def src9_src10_c13_cache_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = fx.segments(spark, sf_dir).select("video_id").distinct()
    params = videos.select("video_id", F.explode(F.array(*(F.lit(s) for s in cache.STEPS))).alias("step")).withColumn("param", F.lit("v1"))
    changed = params.withColumn("param", F.when((F.col("step") == "transcribe") & (F.col("video_id") % 3 == 2), "v0").otherwise(F.col("param")))
    held = cache.chain_signatures(changed.where("video_id % 3 != 0")).withColumn("payload", F.lit("{}"))
    wanted = cache.chain_signatures(params).where("step = 'build'")
    return cache.status(wanted, held).select("video_id", "state")


@register(
    r"""SELECT conv_id, CAST(turn AS BIGINT) AS line_no, CASE turn % 4 WHEN 1 THEN 'WARN' WHEN 2 THEN 'ERROR' ELSE 'INFO' END AS level, CASE WHEN turn % 4 IN (1, 2) THEN one ELSE trim(one) END AS message
    FROM (SELECT *, ltrim(replace(replace(text, chr(10), ' '), chr(13), ' ')) AS one, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 2 AND text IS NOT NULL"""
)
def k6_s27_recent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, flat = F.col("turn") % 4, F.ltrim(F.translate("text", "\n\r", "  "))
    line = F.when(kind == 1, F.concat(F.lit(" [WARN]  "), flat)).when(kind == 2, F.concat(F.lit("\x1b[31m[ERROR]\x1b[0m "), flat)).otherwise(flat)
    logs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("line_no"), line.alias("line"))
    out = media.recent_lines(logs, 2).where("line is not null")
    return out.select(F.col("job_id").alias("conv_id"), "line_no", "level", "message")


@register(
    f"""WITH {fx.SEGMENTS_SQL}, {fx.CLIPS_SQL} SELECT video_id, clip_ord, round(greatest(0, start - 0.35), 6) AS cut_start, round("end" + 0.35, 6) AS cut_end FROM clips"""
)
def s30_cut_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clip_files.cut_list(_clips(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("cut_start", "cut_end")})


@register(
    f"""WITH {fx.SEGMENTS_SQL} SELECT video_id, 0 AS clip_ord, least(greatest(min_by(start, seg_id), 0), max_by("end", seg_id)) AS start, max_by("end", seg_id) AS "end", 100.0::DOUBLE AS clip_score FROM segments GROUP BY 1"""
)
def s29_full_video_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = fx.segments(spark, sf_dir)
    return clip_files.full_video_clips(transcripts.transcript_durations(segs), segs).select("video_id", "clip_ord", "start", "end", "clip_score")


@register(
    r"""WITH d AS (SELECT *, [NULL, '', ' Auto ', 'keep-original', 'EN', 'English', 'id', ' Bahasa Indonesia', 'fr'][doc_id % 9 + 1] AS option FROM documents),
    t AS (SELECT *, NOT (coalesce(lower(lang), '') = 'en' AND doc_id % 10 / 10.0 > 0.6) AS translate, CASE WHEN coalesce(option, '') = '' THEN 'en' WHEN doc_id % 9 IN (2, 3) THEN 'auto' ELSE lower(trim(option)) END AS target FROM d)
    SELECT doc_id, translate, target, CASE WHEN doc_id % 9 IN (4, 5) THEN 'English' WHEN doc_id % 9 IN (6, 7) THEN 'Indonesian' ELSE trim(option) END AS label,
    CASE WHEN target = 'auto' THEN 'refine_keep' WHEN target IN ('en', 'english') THEN CASE WHEN translate THEN 'refine_to_english' ELSE 'improve' END ELSE 'refine_to_target' END AS prompt FROM t"""
)
def p14_s15_s18_prompt_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    p, lang = F.col("doc_id") % 10 / 10.0, F.col("lang")
    options = F.array(*(F.lit(x) for x in (None, "", " Auto ", "keep-original", "EN", "English", "id", " Bahasa Indonesia", "fr")))
    option = F.get(options, (F.col("doc_id") % 9).cast("int"))
    return docs.select(
        "doc_id", refine.should_translate(lang, p).alias("translate"), refine.target_language(option).alias("target"), refine.target_label(option).alias("label"),
        refine.refine_prompt_key(option, lang, p).alias("prompt"),
    )


# Scalar functions over whole tables.
@register(
    r"""SELECT doc_id, CASE WHEN generic THEN coalesce(nullif(substr(regexp_replace(array_to_string(w[1:8], ' '), '[.!?]+$', ''), 1, 80), ''), 'Moment #' || (doc_id % 90 + 1)) ELSE title END AS title,
    generic FROM (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w, CASE doc_id % 4 WHEN 0 THEN 'Clip ' || doc_id WHEN 1 THEN 'clip 7:' WHEN 2 THEN '' ELSE 'The story of ' || doc_id END AS title,
    doc_id % 4 <> 3 AS generic FROM documents)"""
)
def p7_s13_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kind, doc = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    title = F.when(kind == 0, F.concat(F.lit("Clip "), doc)).when(kind == 1, "clip 7:").when(kind == 2, "").otherwise(F.concat(F.lit("The story of "), doc))
    own = docs.select("doc_id", "text", title.alias("t"), (F.col("doc_id") % 90 + 1).alias("rank"))
    none = F.lit(None).cast("string")
    return own.select("doc_id", tx.real_title(F.col("t"), F.col("text"), none, none, F.col("rank")).alias("title"), tx.is_generic_title(F.col("t")).alias("generic"))


@register(
    r"""SELECT doc_id, CASE WHEN length(flat) <= 60 THEN flat ELSE rtrim(substr(flat, 1, 59)) || '…' END AS preview FROM
    (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS flat FROM documents)"""
)
def s14_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", tx.preview(F.col("text"), 60).alias("preview"))


@register(
    f"""WITH {fx.SEGMENTS_SQL} SELECT video_id, seg_id, (cs // 360000)::VARCHAR || ':' || lpad((cs // 6000 % 60)::VARCHAR, 2, '0') || ':' || lpad((cs // 100 % 60)::VARCHAR, 2, '0') || '.' || lpad((cs % 100)::VARCHAR, 2, '0') AS at
    FROM (SELECT video_id, seg_id, s_ms // 10 AS cs FROM segments)"""
)
def s9_clock_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.segments(spark, sf_dir).select("video_id", "seg_id", tx.ass_time(F.col("start")).alias("at"))


@register(
    r"""SELECT p_partkey, w, h, w * 1.0::DOUBLE / h > 0.7 AS vertical, w * 1.0::DOUBLE / h < 1.3 AS horizontal, abs(w * 1.0::DOUBLE / h - 1) > 0.15 AS square, cw - cw % 2 AS crop_w, ch - ch % 2 AS crop_h FROM (
    SELECT *, CASE WHEN 0.5625 < w * 1.0::DOUBLE / h THEN CAST(trunc(h * 0.5625::DOUBLE) AS INTEGER) ELSE w END AS cw, CASE WHEN 0.5625 < w * 1.0::DOUBLE / h THEN h ELSE CAST(trunc(w / 0.5625::DOUBLE) AS INTEGER) END AS ch
    FROM (SELECT p_partkey, CAST(400 + p_partkey % 1700 AS INTEGER) AS w, CAST(400 + p_partkey * 7 % 1700 AS INTEGER) AS h FROM part))"""
)
def p13_s20_crop_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    own = parts.select("p_partkey", (400 + F.col("p_partkey") % 1700).cast("int").alias("w"), (400 + F.col("p_partkey") * 7 % 1700).cast("int").alias("h"))
    w, h = crops.crop_size(F.col("w"), F.col("h"), 0.5625)
    needs = [crops.needs_crop(F.col("w"), F.col("h"), k).alias(k) for k in ("vertical", "horizontal", "square")]
    return own.select("p_partkey", "w", "h", *needs, w.alias("crop_w"), h.alias("crop_h"))


@register(
    f"""WITH {fx.BOXES_SQL}, b AS (SELECT clip_id, time, cx, row_number() OVER (PARTITION BY clip_id, time ORDER BY area DESC, box_ord) AS r FROM boxes WHERE conf >= 0.5),
    m AS (SELECT clip_id, list_sort(list(cx - 100))[count(*) // 2 + 1] AS x1, list_sort(list(cx + 100))[count(*) // 2 + 1] AS x2 FROM b WHERE r = 1 GROUP BY 1)
    SELECT clip_id, CAST(trunc((x1 + x2) / 2.0 - 365) AS INTEGER) AS face_x, 280 AS face_y, 730 AS face_w, 520 AS face_h FROM m"""
)
def s21_a12_split_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = crops.split_layout(crops.confident(fx.detections(spark, sf_dir)), fx.frames(spark, sf_dir))
    return out.select("clip_id", "face_x", "face_y", "face_w", "face_h")


@register(
    f"""WITH RECURSIVE {ADJUSTED_SQL} SELECT video_id, count(*) AS n, round(sum(llm_end - llm_start) - sum("end" - start), 6) AS removed,
    round((sum(llm_end - llm_start) - sum("end" - start)) / count(*), 6) AS per_clip FROM edges GROUP BY 1"""
)
def a9_time_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = fx.segments(spark, sf_dir)
    out = selection.time_removed(boundaries.adjust_boundaries(selection.select_clips(fx.clips(segs)), fx.words(segs)))
    return out.withColumns({c: F.round(c, 6) for c in ("removed", "per_clip")})


@register(
    r"""SELECT source, count(*) FILTER (text <> '') AS processed, count(*) FILTER (text = '' OR text IS NULL) AS failed FROM documents GROUP BY source"""
)
def a18_c14_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", F.coalesce(F.col("text") != "", F.lit(False)).alias("ok"))
    return media.batch_summary(docs.withColumn("source_video", F.lit("")), ("source",)).drop("failed_videos")


@register(
    f"""WITH {fx.SEGMENTS_SQL}, talk AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seg_id, text FROM conversations WHERE trim(text) <> '')
    SELECT 'documents' AS origin, video_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM segments GROUP BY 2 UNION ALL
    SELECT 'conversations', conv_id, count(*), sum(length(text))::BIGINT FROM talk GROUP BY 2"""
)
def u1_u6_union_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fx.segments(spark, sf_dir).select(F.lit("documents").alias("origin"), "video_id", "text")
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("trim(text) != ''")
    both = own.unionByName(talk.select(F.lit("conversations").alias("origin"), F.col("conv_id").alias("video_id"), "text"))
    return both.groupBy("origin", "video_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@register(
    r"""SELECT event_id, TRY_CAST(nullif(raw, '') AS DOUBLE) AS v FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'x' || event_id ELSE event_id || '.5' END AS raw FROM events)"""
)
def s28_optional_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    doc, kind = F.col("event_id").cast("string"), F.col("event_id") % 3
    raw = F.when(kind == 0, "").when(kind == 1, F.concat(F.lit("x"), doc)).otherwise(F.concat(doc, F.lit(".5")))
    return events.select("event_id", tx.optional_float(raw).alias("v"))
