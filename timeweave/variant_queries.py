"""Registered queries of variants, gates and rules that the main queries do not reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeweave import fixtures as fx
from timeweave.functions import text as tx
from timeweave.operators import boundaries, crops, refine, requests, responses, selection, transcript
from timeweave.queries import _BAD, _GOOD, _POWER, _WEAK, CHUNKS_SQL, MARKED_SQL, MERGED_SQL, MOMENTS_SQL, SCORED_SQL, _clips, _moments, _spans, register

# Words around each clip as boundaries.near_words takes them, sorted by start, segment, place.
AROUND_SQL = (
    fx.WORDS_SQL
    + ","
    + fx.CLIPS_SQL
    + r""",
around AS (
    SELECT c.video_id, c.clip_ord, c.start, c."end" AS e, trim(w.word) AS word, trim(lower(trim(w.word)), '.,!?;:') AS norm, w.seg_id, w.word_pos, w.w_start, w.w_end
    FROM clips c JOIN words w ON w.video_id = c.video_id AND w.w_end > c.start - 6.5 AND w.w_start < c."end" + 16
)"""
)


def _around(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = fx.segments(spark, sf_dir)
    near = boundaries.near_words(_spans(segs), fx.words(segs), 6.5, 16.0)
    return near.withColumn("ws", F.coalesce("ws", F.array().cast(near.schema["ws"].dataType)))


@register(
    f"""WITH {AROUND_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id, clip_ord ORDER BY w_start, seg_id, word_pos) - 1 AS i FROM around WHERE w_start >= start - 0.2 AND w_start <= start + 4.0),
    c AS (SELECT *, coalesce(min(i) FILTER (i < 5 AND norm NOT IN ({_WEAK})) OVER (PARTITION BY video_id, clip_ord), 0) AS content FROM n WHERE i < 8),
    p AS (SELECT video_id, clip_ord, any_value(start) AS start, min_by(w_start, i) FILTER (i = content) AS plain, min_by(w_start, i) FILTER (i >= content AND i < content + 3 AND norm IN ({_POWER})) AS power FROM c GROUP BY ALL)
    SELECT k.video_id, k.clip_ord, round(greatest(k.start, coalesce(p.power - 0.1, p.plain - 0.12, k.start)), 6) AS moved FROM clips k LEFT JOIN p USING (video_id, clip_ord)"""
)
def w13_strong_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = boundaries.strong_start(_around(spark, sf_dir), "ws", "moved", 4.0)
    return out.select("video_id", "clip_ord", F.round("moved", 6).alias("moved"))


@register(
    f"""WITH {AROUND_SQL},
    bounds AS (SELECT video_id, clip_ord, min_by(w_start, {{'a': w_start, 'b': seg_id, 'c': word_pos}}) + 5.0 AS least FROM around GROUP BY ALL),
    n AS (SELECT a.*, b.least, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY a.video_id, a.clip_ord) AS n, coalesce(lead(w_start) OVER w - w_end, 0) AS gap, right(word, 1) AS mark
        FROM around a JOIN bounds b USING (video_id, clip_ord) WHERE w_end >= greatest(0, e - 6.0) AND w_end <= least(e + 5.0, start + 180.0)
        WINDOW w AS (PARTITION BY a.video_id, a.clip_ord ORDER BY w_start, seg_id, word_pos)),
    j AS (SELECT *, (i < n - 1 AND gap >= 0.6) OR mark IN ('.', '?', '!', '。', '؟') AS is_break, w_end >= least AND w_end <= start + 180.0 AS fits,
        CASE WHEN w_end - e >= 0 THEN (w_end - e) * 1.5 ELSE (e - w_end) * 4.0 END - (CASE WHEN gap >= 1.2 THEN 30 WHEN gap >= 0.8 THEN 22 WHEN gap >= 0.5 THEN 14 WHEN gap >= 0.3 THEN 8 ELSE 0 END
        + CASE WHEN norm IN ({_BAD}) THEN 0 ELSE 25 END + CASE WHEN norm IN ({_GOOD}) THEN 20 ELSE 0 END + CASE WHEN mark IN ('.', '?', '!', '。') THEN 20 ELSE 0 END + CASE WHEN mark IN ('?', '!') THEN 10 ELSE 0 END) AS v FROM n),
    g AS (SELECT video_id, clip_ord, any_value(e) AS e, min_by(w_end, {{'v': v, 'i': i}}) FILTER (is_break AND fits) AS best, max_by(w_end, i) FILTER (is_break) AS last_break,
        max_by(w_end, i) FILTER (w_end <= e AND norm NOT IN ({_BAD})) AS plain, max_by(w_end, i) AS last FROM j GROUP BY ALL)
    SELECT k.video_id, k.clip_ord, round(CASE WHEN g.e IS NULL THEN k."end" WHEN last_break IS NULL THEN coalesce(plain + 0.25, least(g.e, last + 0.3)) WHEN best IS NULL THEN least(g.e, last_break + 0.2) ELSE best + 0.25 END, 6) AS moved
    FROM clips k LEFT JOIN g USING (video_id, clip_ord)"""
)
def w12_best_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = boundaries.BoundaryRules()
    out = boundaries.best_ending(_around(spark, sf_dir), "ws", F.col("start") + rules.max_duration, "moved", rules)
    return out.select("video_id", "clip_ord", F.round("moved", 6).alias("moved"))


# Requests: times are whole milliseconds, so halves round up as Spark formats them.
_TENTHS = "CASE WHEN {0} % 1000 = 0 THEN ({0} // 1000)::VARCHAR ELSE (({0} + 50) // 100 // 10)::VARCHAR || '.' || (({0} + 50) // 100 % 10)::VARCHAR END"
_FIXED = "(round({0} * 10)::BIGINT // 10)::VARCHAR || '.' || (round({0} * 10)::BIGINT % 10)::VARCHAR"
REQUESTS_SQL = (
    MOMENTS_SQL
    + ", "
    + CHUNKS_SQL[CHUNKS_SQL.index("spans AS (") :]
    + rf""",
touching AS (SELECT s.video_id, s.seg_id, m.moment_id, m.start AS ms, m.kind FROM segments s JOIN moments m ON m.video_id = s.video_id AND m."end" > s.start AND m.start < s."end"),
marks AS (SELECT video_id, seg_id, arg_min(moment_id, ms) AS moment_id, arg_min(kind, ms) AS kind FROM touching GROUP BY ALL),
shown AS (
    SELECT c.video_id, c.chunk_id, c.seg_id, c.start, c."end", '[' || {_TENTHS.format("s.s_ms")} || '-' || {_TENTHS.format("(s.s_ms + s.n_words * s.ms)")} || '] ' || c.text
        || CASE m.kind WHEN 'spike' THEN ' [ENERGY SPIKE]' WHEN 'high' THEN ' [HIGH ENERGY]' ELSE '' END
        || coalesce(CASE WHEN g >= 999 THEN ' [PAUSE ' || g // 1000 || '.' || g % 1000 // 100 || 's]' WHEN g >= 500 THEN ' [gap 0.' || g // 10 || 's]' END, '') AS line
    FROM (SELECT *, CAST(round((lead(start) OVER (PARTITION BY video_id, chunk_id ORDER BY seg_id) - "end") * 1000) AS BIGINT) AS g FROM chunked) c
    JOIN segments s USING (video_id, seg_id) LEFT JOIN marks m USING (video_id, seg_id)
),
chunk_lines AS (SELECT video_id, chunk_id, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY seg_id) AS transcript, min(start) AS t0, max("end") AS t1 FROM shown GROUP BY ALL),
silent AS (SELECT * FROM moments m WHERE NOT in_speech AND NOT EXISTS (SELECT 1 FROM marks k WHERE k.video_id = m.video_id AND k.moment_id = m.moment_id)),
tails AS (
    SELECT c.video_id, c.chunk_id, string_agg('[' || {_FIXED.format("m.start")} || '-' || {_FIXED.format('m."end"')} || '] ' || CASE m.kind WHEN 'spike' THEN 'ENERGY SPIKE' ELSE 'HIGH ENERGY' END, chr(10) ORDER BY m.start) AS tail
    FROM chunk_lines c JOIN silent m ON m.video_id = c.video_id AND m."end" > c.t0 AND m.start < c.t1 GROUP BY ALL
),
asked AS (SELECT c.video_id, c.chunk_id, n_lines, transcript || coalesce(chr(10) || chr(10) || '[MOMENTS WITHOUT WORDS]' || chr(10) || tail, '') AS transcript, count(*) OVER (PARTITION BY c.video_id) AS n FROM chunk_lines c LEFT JOIN tails USING (video_id, chunk_id))"""
)


def _chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.marked_chunks(fx.segments(spark, sf_dir), _moments(spark, sf_dir))


@register(f"WITH {REQUESTS_SQL} SELECT video_id, chunk_id, n_lines, md5(transcript) AS digest, length(transcript) AS chars FROM asked")
def a6_s8_s16_chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _chunk_texts(spark, sf_dir)
    return texts.select("video_id", "chunk_id", "n_lines", F.md5("transcript").alias("digest"), F.length("transcript").cast("long").alias("chars"))


@register(
    f"""WITH {REQUESTS_SQL}, b AS (SELECT *, CAST(least(greatest(10, ceil(30 / n * 1.5)), 30) AS INTEGER) AS max_clips FROM asked)
    SELECT video_id, chunk_id, max_clips, md5('At most ' || max_clips || ' clips in English.' || chr(10) || chr(10) || transcript) AS prompt FROM b"""
)
def s17_j_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = spark.createDataFrame(
        [("select", "At most {MAX_CLIPS} clips in {TARGET_LANGUAGE}.\n\n{TRANSCRIPT}"), ("other", "{TRANSCRIPT}")], "section string, template string"
    )
    out = requests.llm_requests(_chunk_texts(spark, sf_dir), prompts, "select", "English")
    return out.withColumn("prompt", F.md5("prompt"))


# The same over cleaned transcripts, whose lines are merged segments. Gaps between them are differences of
# doubles, which Spark rounds by their decimal digits.
_GAP = "WHEN gap >= 1.0 THEN ' [PAUSE ' || CAST(round(CAST(gap::VARCHAR AS DECIMAL(34, 17)), 1) AS DECIMAL(18, 1)) || 's]' WHEN gap >= 0.5 THEN ' [gap ' || CAST(round(CAST(gap::VARCHAR AS DECIMAL(34, 17)), 2) AS DECIMAL(18, 2)) || 's]' END"
_MS_GAP = "WHEN g >= 999 THEN ' [PAUSE ' || g // 1000 || '.' || g % 1000 // 100 || 's]' WHEN g >= 500 THEN ' [gap 0.' || g // 10 || 's]' END"
CLEAN_REQUESTS_SQL = (
    MERGED_SQL
    + MOMENTS_SQL[len(fx.SEGMENTS_SQL) :]
    + """,
clean AS (SELECT *, CAST(round(start * 1000) AS BIGINT) AS s_ms, CAST(round("end" * 1000) AS BIGINT) AS e_ms FROM merged)"""
    + REQUESTS_SQL[len(MOMENTS_SQL) :].replace("segments", "clean").replace("(s.s_ms + s.n_words * s.ms)", "s.e_ms").replace(_MS_GAP, _GAP)
    .replace("(SELECT *, CAST(round(", '(SELECT *, lead(start) OVER (PARTITION BY video_id, chunk_id ORDER BY seg_id) - "end" AS gap, CAST(round(')
)


@register(
    f"""WITH RECURSIVE {CLEAN_REQUESTS_SQL}, b AS (SELECT *, CAST(least(greatest(10, ceil(30 / n * 1.5)), 30) AS INTEGER) AS max_clips FROM asked)
    SELECT video_id, chunk_id, max_clips, 'At most ' || max_clips || ' clips in English.' || chr(10) || chr(10) || transcript AS prompt FROM b"""
)
def c3_llm_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = requests.marked_chunks(transcript.clean_transcript(fx.segments(spark, sf_dir)), _moments(spark, sf_dir))
    prompts = spark.createDataFrame([("select", "At most {MAX_CLIPS} clips in {TARGET_LANGUAGE}.\n\n{TRANSCRIPT}")], "section string, template string")
    return requests.llm_requests(texts, prompts, "select", "English")


@register(
    f"""WITH {CHUNKS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id, chunk_id ORDER BY seg_id) AS i, count(*) OVER (PARTITION BY video_id, chunk_id) AS n FROM chunked WHERE (video_id + chunk_id) % 3 = 0)
    SELECT video_id, chunk_id, seg_id, CASE WHEN i <= n // 2 THEN 1 ELSE 2 END AS part FROM n WHERE n > 1"""
)
def w19_halved_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = requests.assign_chunks(fx.segments(spark, sf_dir))
    return requests.halved(own, own.where("(video_id + chunk_id) % 3 = 0")).select("video_id", "chunk_id", "seg_id", "part")


@register(
    f"""WITH {MARKED_SQL}, c AS (SELECT video_id, drop_reason, count(*) AS n FROM marked WHERE drop_reason IS NOT NULL GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, drop_reason)::INTEGER AS place FROM c"""
)
def k7_ranked_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.ranked_reasons(fx.segments(spark, sf_dir).withColumn("drop_reason", transcript.drop_reason()))


@register(f"WITH {SCORED_SQL} SELECT * FROM (SELECT video_id, clip_ord, row_number() OVER (PARTITION BY video_id ORDER BY clip_ord)::INTEGER AS example FROM clips) WHERE example <= 3")
def k8_example_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.example_clips(_clips(spark, sf_dir)).select("video_id", "clip_ord", "example")


FACES_SQL = r"""
faces AS (SELECT l_orderkey AS box_id, l_linenumber AS face_ord, l_linenumber * 10 AS x1, (l_quantity::BIGINT % 7 + 3)::DOUBLE / 10 AS conf, CASE l_linestatus WHEN 'O' THEN 'f' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'm' END END AS gender, l_partkey * 100000 + l_suppkey AS face_id FROM lineitem)"""


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x1 = (F.col("l_linenumber") * 10).cast("int")
    gender = F.when(F.col("l_linestatus") == "O", "f").when(F.col("l_linenumber") % 2 == 0, "m")
    return items.select(
        F.col("l_orderkey").alias("box_id"), F.col("l_linenumber").alias("face_ord"), x1.alias("x1"), x1.alias("y1"), (x1 + 5).alias("x2"), (x1 + 5).alias("y2"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("face_id"),
        ((F.col("l_quantity").cast("long") % 7 + 3).cast("double") / 10).alias("conf"), gender.alias("gender"),
    )


@register(
    f"""WITH {FACES_SQL} SELECT box_id, x1::INTEGER AS x1, conf FROM (SELECT *, row_number() OVER (PARTITION BY box_id ORDER BY conf DESC, face_ord) AS r FROM faces WHERE conf >= 0.5) WHERE r = 1"""
)
def k4_best_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crops.best_face(_faces(spark, sf_dir), ["box_id"]).select("box_id", "face.x1", "face.conf")


@register(f"WITH {FACES_SQL} SELECT box_id AS clip_id, face_ord % 2 AS track_id, arg_min(gender, {{'a': face_ord, 'b': face_id}}) AS gender FROM faces WHERE gender IS NOT NULL GROUP BY ALL")
def a11_track_genders(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _faces(spark, sf_dir).select(F.col("box_id").alias("clip_id"), (F.col("face_ord") % 2).alias("track_id"), "gender", F.col("face_ord").cast("double").alias("time"), F.col("face_id").alias("box_ord"))
    return crops.track_gender(own)


@register(
    r"""SELECT p_partkey, round(greatest(0, least(x + w, 500) - greatest(x, 200)) * greatest(0, least(y + h, 400) - greatest(y, 100)) / greatest(1, w * h), 6)::DOUBLE AS share, (x + x + w) / 2.0::DOUBLE AS cx, round(y * 0.35::DOUBLE + (y + h) * 0.65::DOUBLE, 6) AS cy
    FROM (SELECT p_partkey, p_partkey % 450 AS x, p_partkey * 7 % 350 AS y, p_partkey % 90 AS w, p_partkey * 3 % 80 AS h FROM part)"""
)
def s7_s22_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    own = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (key % 450).alias("x1"), (key * 7 % 350).alias("y1"), (key % 90).alias("w"), (key * 3 % 80).alias("h"))
    own = own.withColumns({"x2": F.col("x1") + F.col("w"), "y2": F.col("y1") + F.col("h")})
    b = F.struct(F.lit(200).alias("x1"), F.lit(100).alias("y1"), F.lit(500).alias("x2"), F.lit(400).alias("y2"))
    cx, cy = crops.face_centre(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return own.select("p_partkey", F.round(crops.box_overlap(F.struct("x1", "y1", "x2", "y2"), b), 6).alias("share"), cx.alias("cx"), F.round(cy, 6).alias("cy"))


@register(
    r"""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CASE WHEN p_partkey = 0 THEN 30 ELSE round(p_partkey / 1001.0::DOUBLE, 6) END WHEN 1 THEN p_partkey::DOUBLE WHEN 2 THEN 30 WHEN 3 THEN 30 WHEN 4 THEN 30 ELSE 29.97 END::DOUBLE AS fps FROM part"""
)
def s19_frame_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, kind = F.col("p_partkey").cast("string"), F.col("p_partkey") % 6
    text = F.when(kind == 0, F.concat(key, F.lit("/1001"))).when(kind == 1, key).when(kind == 2, F.concat(key, F.lit("/0")))
    text = text.when(kind == 3, "N/A").when(kind == 5, "29.97")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.round(tx.frame_rate(text), 6).alias("fps"))


@register(
    r"""SELECT doc_id AS video_id, CASE WHEN doc_id % 2 = 0 THEN 'mine' ELSE 'made' END AS title, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'made caption' END AS caption,
    CASE WHEN doc_id % 3 = 0 THEN 'caption,hook' WHEN doc_id % 5 = 0 THEN 'hook' ELSE '' END AS missing FROM documents"""
)
def s31_single_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("video_id"))
    v = F.col("video_id")
    videos = docs.withColumns({"user_title": F.when(v % 2 == 0, "mine").otherwise(" "), "user_caption": F.lit("")})
    made = docs.withColumns({f: F.lit(f"made {f}") for f in refine.TEXT_FIELDS}).withColumns(
        {"title": F.lit("made"), "caption": F.when(v % 3 != 0, "made caption"), "hook": F.when((v % 3 == 0) | (v % 5 == 0), " ").otherwise("made hook")}
    )
    return refine.single_metadata(videos, made).select("video_id", "title", "caption", F.array_join("missing", ",").alias("missing"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = selection.rerank(selection.score_clips(_clips(spark, sf_dir))).withColumn("clip_id", F.col("clip_ord").cast("long"))
    return old.select("video_id", "clip_id", "title", F.lit("old caption").alias("caption"), F.lit("old topic").alias("topic"), "rank", "clip_score")


RANKED_SQL = (
    SCORED_SQL
    + r""",
old AS (SELECT video_id, clip_ord::BIGINT AS clip_id, 'Clip ' || clip_ord AS title, row_number() OVER (PARTITION BY video_id ORDER BY clip_score DESC, score_emotion DESC, clip_ord)::INTEGER AS rank, clip_score FROM scored)"""
)


@register(
    f"""WITH {RANKED_SQL} SELECT video_id, clip_id, CASE WHEN clip_id % 4 = 0 THEN '' WHEN clip_id % 4 = 1 THEN upper(title) ELSE title END AS title,
    CASE WHEN clip_id % 6 = 0 THEN 'new caption' ELSE 'old caption' END AS caption, 'old topic' AS topic FROM old"""
)
def j12_j13_updated_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles are overwritten where the answer has them, blank ones too; other fields as far as they are given."""
    old = _ranked(spark, sf_dir)
    titles = old.where("clip_id % 4 < 2").select("video_id", "clip_id", F.lit("title").alias("field"), F.when(F.col("clip_id") % 4 == 0, "").otherwise(F.upper("title")).alias("value"))
    captions = old.where("clip_id % 6 = 0").select("video_id", "clip_id", F.lit("caption").alias("field"), F.lit("new caption").alias("value"))
    both = refine.update_fields(old, titles.unionByName(captions), ("title", "caption", "topic"))
    return both.select("video_id", "clip_id", "title", "caption", "topic")


@register(
    f"""WITH {RANKED_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY -clip_id) AS answer_ord FROM old WHERE clip_id % 3 <> 0)
    SELECT video_id, clip_id, CASE WHEN clip_id % 2 = 0 THEN 'better ' || clip_id ELSE title END AS title, row_number() OVER (PARTITION BY video_id ORDER BY answer_ord)::INTEGER AS rank FROM a"""
)
def j14_kept_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _ranked(spark, sf_dir)
    order = F.row_number().over(Window.partitionBy("video_id").orderBy(-F.col("clip_id")))
    title = F.when(F.col("clip_id") % 2 == 0, F.concat(F.lit("better "), "clip_id")).otherwise("")
    answer = old.where("clip_id % 3 != 0").select("video_id", "clip_id", order.alias("answer_ord"), title.alias("title"))
    return refine.keep_answered(old, answer, ("title",)).select("video_id", "clip_id", "title", "rank")


@register(
    r"""SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) OR doc_id % 4 = 3 THEN 'content' ELSE 'reasoning' END AS field, CASE WHEN doc_id % 4 = 3 THEN 'failed' WHEN doc_id % 4 = 2 THEN 'balanced' ELSE 'ok' END AS status,
    CASE WHEN doc_id % 4 = 3 THEN 0 ELSE 1 END::INTEGER AS n FROM documents"""
)
def l3_preferred_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content that parses, content beside reasoning that parses too, reasoning alone, neither."""
    docs, kind = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), F.col("doc_id") % 4
    content = F.when(kind < 2, '[{"start": 1}]').otherwise("nothing to say")
    reasoning = F.when((kind == 1) | (kind == 2), 'I think [{"start": 2}] fits').otherwise("no")
    both = docs.select("doc_id", F.explode(F.array(F.struct(F.lit("content").alias("field"), content.alias("raw")), F.struct(F.lit("reasoning").alias("field"), reasoning.alias("raw")))).alias("r"))
    parsed = responses.parse_responses(both.select("doc_id", "r.field", "r.raw"), ["doc_id", "field"])
    out = responses.prefer_content(parsed, ["doc_id"])
    return out.select("doc_id", "field", "status", F.size("items").alias("n"))


@register(
    f"""WITH {RANKED_SQL}, n AS (SELECT video_id, clip_id, upper(title) AS title FROM old WHERE video_id % 4 IN (0, 1) AND clip_id % 5 <> 0)
    SELECT o.video_id, o.clip_id, CASE WHEN n.title IS NULL OR o.clip_id % 3 = 0 THEN o.title ELSE n.title END AS title,
    row_number() OVER (PARTITION BY o.video_id ORDER BY clip_score DESC, rank, o.clip_id)::INTEGER AS rank FROM old o LEFT JOIN n ON n.video_id = o.video_id AND n.clip_id = o.clip_id"""
)
def l4_c7_refined_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a rewriting model: lists, fenced lists, refusals and lists of no objects."""
    old = _ranked(spark, sf_dir)
    title = F.when(F.col("clip_id") % 3 == 0, " ").otherwise(F.upper("title"))
    items = old.where("clip_id % 5 != 0").groupBy("video_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("clip_id", title.alias("title"))))).alias("j"))
    kind = F.col("video_id") % 4
    raw = F.when(kind == 0, F.col("j")).when(kind == 1, F.concat(F.lit("```json\n"), "j", F.lit("\n```"))).when(kind == 2, "Sorry, no.").otherwise("[1, 2, 3]")
    parsed = responses.parse_responses(items.select("video_id", raw.alias("raw")), ["video_id"])
    return refine.refine_clips(old, parsed, ("title",)).select("video_id", "clip_id", "title", "rank")


@register(
    r"""SELECT doc_id, substr(sha1('{"p0":"' || doc_id || '","p1":"' || source || '","p2":null}'), 1, 12) AS sig FROM documents"""
)
def s23_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest itself, not only whether two agree."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", tx.signature(F.col("doc_id"), F.col("source"), F.lit(None).cast("string")).alias("sig"))
