"""Hand-made cases: thresholds at, below and above, ties, and rules that folds must keep."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from timeweave.functions.intervals import gathered, level_of, overlap_join
from timeweave.functions.stats import first_seen_mode, ranked_values
from timeweave.operators import boundaries, crops, energy, refine, requests, responses, selection, silence, subtitles, transcript

SEG = "video_id long, seg_id long, start double, end double, text string, no_speech_prob double"
WORD = "video_id long, seg_id long, word_pos int, word string, w_start double, w_end double, seg_start double, seg_end double"


@pytest.mark.parametrize(
    ("row", "reason"),
    [
        ((0.0, 0.29, "hi", 0.0), "short_dur"),
        ((0.0, 0.3, "hi", 0.0), None),
        ((0.0, 1.0, "   ", 0.0), "few_words"),
        ((0.0, 1.0, "hi", 0.91), "no_speech"),
        ((0.0, 1.0, "hi", 0.9), "music"),
        ((0.0, 1.0, "hi", 0.75), None),
        ((0.0, 1.0, "[Laughter] hi", 0.8), None),
        ((0.0, 1.0, "[laughter]", 0.95), "no_speech"),
        ((0.0, 1.0, "La laa la", 0.0), "music"),
        ((0.0, 1.0, "la na", 0.0), None),
        ((0.0, 1.0, "♪ love", 0.0), "music"),
        ((0.0, 10.0, "hi", 0.0), None),
        ((0.0, 10.1, "hi", 0.0), "slow_speech"),
        ((0.0, 1.0, " ".join("a" * 15), 0.0), None),
        ((0.0, 1.0, " ".join("a" * 16), 0.0), "hallucination"),
        ((0.0, 1.0, None, None), "few_words"),
    ],
)
def test_reason_cascade(spark, row, reason):
    df = spark.createDataFrame([(1, 0, *row)], SEG)
    assert df.select(transcript.drop_reason().alias("r")).first()["r"] == reason


def test_duplicates_look_back_twelve_kept(spark):
    texts = ["same words here"] + [f"text number {i} alone" for i in range(12)] + ["Same  words here", "same words here"]
    rows = [(1, i, i * 2.0, i * 2.0 + 1.0, t, 0.0) for i, t in enumerate(texts)]
    got = [r["drop_reason"] for r in transcript.mark_segments(spark.createDataFrame(rows, SEG)).orderBy("seg_id").collect()]
    assert got == [None] * 14 + ["duplicate"]


def test_merge_caps(spark):
    rows = [(1, 0, 0.0, 30.0, "a", 0.1), (1, 1, 31.0, 60.0, "b", 0.2), (1, 2, 60.5, 61.0, "c", 0.3), (1, 3, 62.0, 63.0, "d", 0.4), (1, 4, 64.1, 65.0, "e", 0.5)]
    got = [(r["seg_id"], r["end"], r["text"], r["n_merged"], r["no_speech_prob"]) for r in transcript.merge_segments(spark.createDataFrame(rows, SEG)).orderBy("seg_id").collect()]
    assert got == [(0, 60.0, "a b", 2, 0.1), (2, 63.0, "c d", 2, 0.3), (4, 65.0, "e", 1, 0.5)]


def test_fold_does_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = [(v, i, i * 1.5, i * 1.5 + rng.random(), rng.choice(["a b c", "a b d", "x y", "la la"]), 0.0) for v in range(20) for i in range(40)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SEG)
    results = [sorted(map(tuple, transcript.clean_transcript(df.repartition(n)).collect())) for n in (1, 7)]
    assert results[0] == results[1]
    marked = transcript.mark_segments(df)
    stats = transcript.clean_stats(marked, transcript.merge_segments(marked.where("drop_reason is null"))).collect()
    assert all(r["after_filter"] + r["dropped"] == r["original"] == 40 for r in stats)


def test_upper_median_and_nearest_rank(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([4, 1, 3, 2])], "k int, i int, v double")
    row = ranked_values(df, ["k"], "v", 80.0).first()
    assert (row["n"], row["median"], row["high"]) == (4, 3.0, 4.0)


def test_ranks_of_a_long_series(spark):
    """Against a plain sort: many ties, one hot key, nulls, infinities, and a sketch so coarse that ranks lie
    outside of its ranges."""
    rng = random.Random(5)
    series = {"hot": [rng.choice((0.0, 1.0, rng.random())) for _ in range(4000)], "one": [2.5], "two": [3.0, -3.0], "same": [7.0] * 50}
    series["odd"] = [float("inf"), -float("inf"), 1e300, -1e-300, 0.5, 0.25]
    rows = [(k, v) for k, vs in series.items() for v in vs] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    for percent in (0.0, 80.0, 100.0):
        want = {(k, len(vs), sorted(vs)[len(vs) // 2], sorted(vs)[min(int(len(vs) * percent / 100), len(vs) - 1)]) for k, vs in series.items()}
        for accuracy in (3, 10_000):
            assert {tuple(r) for r in ranked_values(df, ["k"], "v", percent, accuracy).collect()} == want


def test_first_seen_mode(spark):
    df = spark.createDataFrame([(1, 5, 0), (1, 2, 1), (1, 2, 2), (1, 5, 3), (2, 9, 0)], "k int, v int, i int")
    assert {tuple(r) for r in first_seen_mode(df, ["k"], "v", "i").collect()} == {(1, 5), (2, 9)}


def test_overlap_join_equals_nested_loops(spark):
    rng = random.Random(2)
    span = lambda: (lambda a: (a, a + rng.choice([0, 0.5, 3, 40])))(round(rng.uniform(0, 100), 1))
    left = [(rng.randint(0, 2), i, *span()) for i in range(80)]
    right = [(rng.randint(0, 2), i, *span()) for i in range(80)]
    a = spark.createDataFrame(left, "k int, i int, s double, e double")
    b = spark.createDataFrame(right, "k int, j int, rs double, re double")
    got = overlap_join(a, b, ["k"], ("s", "e"), ("rs", "re"), (F.col("re") > F.col("s")) & (F.col("rs") < F.col("e")), 7.0)
    want = {(x[1], y[1]) for x in left for y in right if x[0] == y[0] and y[3] > x[2] and y[2] < x[3]}
    rows = [(r["i"], r["j"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_speech_regions_merge_at_the_gap(spark):
    rows = [(1, 0, 0.0, 1.0, "a", 0.0), (1, 1, 1.45, 2.0, "b", 0.0), (1, 2, 1.5, 1.6, "in", 0.0), (1, 3, 2.5, 2.6, "short", 0.0), (1, 4, 9.0, 8.0, "bad", 0.0)]
    got = [(r["start"], r["end"]) for r in energy.speech_regions(spark.createDataFrame(rows, SEG)).collect()]
    assert got == [(0.0, 2.0)]


def test_moments_merge_at_two_seconds(spark):
    events = [(1, 0, 0.0, 100.0, "high", True), (1, 5, 2.5, 300.0, "spike", True), (1, 11, 5.5, 200.0, "high", False)]
    got = energy.energy_moments(spark.createDataFrame(events, "video_id long, win_idx long, time double, rms double, kind string, in_speech boolean")).orderBy("start").collect()
    assert [(r["start"], r["end"], r["peak_rms"], r["kind"], r["in_speech"]) for r in got] == [(0.0, 3.0, 300.0, "spike", True), (5.5, 6.0, 200.0, "high", False)]


def test_quiet_and_short_videos_have_no_events(spark):
    rows = [(1, i, i * 0.5, 10.0) for i in range(30)] + [(2, 0, 0.0, 900.0), (2, 1, 0.5, 900.0)] + [(3, i, i * 0.5, 2000.0 if i == 9 else 100.0) for i in range(30)]
    windows = spark.createDataFrame(rows, "video_id long, win_idx long, t double, rms double")
    regions = spark.createDataFrame([], "video_id long, region_id int, start double, end double")
    got = energy.energy_events(windows, regions).collect()
    assert [(r["video_id"], r["win_idx"], r["kind"], r["in_speech"]) for r in got] == [(3, 9, "spike", False)]


def test_chunks_overlap_and_short_videos_are_one(spark):
    long = [(1, i, i * 100.0, i * 100.0 + 50.0, "t", 0.0) for i in range(15)]
    short = [(2, i, i * 100.0, i * 100.0 + 50.0, "t", 0.0) for i in range(6)]
    got = requests.assign_chunks(spark.createDataFrame(long + short, SEG)).collect()
    by = lambda v, k: sorted(r["seg_id"] for r in got if (r["video_id"], r["chunk_id"]) == (v, k))
    assert by(2, 0) == list(range(6)) and by(1, 0) == list(range(6)) and by(1, 1) == list(range(5, 11)) and by(1, 2) == list(range(10, 15))


def test_request_lines(spark):
    rows = [(1, 0, 0.0, 2.5, "one", 0.0), (1, 1, 3.0, 4.0, "two", 0.0), (1, 2, 5.5, 6.0, "three", 0.0)]
    segs = spark.createDataFrame(rows, SEG).withColumns({"chunk_id": F.lit(0), "moment_kind": F.when(F.col("seg_id") == 1, "spike")})
    moments = spark.createDataFrame([(1, 1, 5.0, 5.4, "high", False)], "video_id long, moment_id long, start double, end double, kind string, in_speech boolean")
    text = requests.chunk_texts(requests.transcript_lines(segs), moments).first()["transcript"]
    assert text.split("\n") == ["[0-2.5] one [gap 0.50s]", "[3-4] two [ENERGY SPIKE] [PAUSE 1.5s]", "[5.5-6] three", "", "[MOMENTS WITHOUT WORDS]", "[5.0-5.4] HIGH ENERGY"]


OBJECTS = [{"start": 1, "title": "a ]} b"}, {"start": 2, "title": 'q"x'}]


@pytest.mark.parametrize(
    ("raw", "status", "n"),
    [
        (json.dumps(OBJECTS), "ok", 2),
        ("```json\n" + json.dumps(OBJECTS) + "\n```", "ok", 2),
        ("<think>[1, 2\n</think>" + json.dumps(OBJECTS), "ok", 2),
        ("User Safety: safe\nSafety Categories: none\n" + json.dumps(OBJECTS), "ok", 2),
        (json.dumps({"n": 1, "clips": OBJECTS}), "ok", 2),
        ("Here you go: " + json.dumps(OBJECTS) + " enjoy", "balanced", 2),
        (json.dumps(OBJECTS)[:-8], "partial", 1),
        (json.dumps(OBJECTS)[:10], "failed", 0),
        ("no", "failed", 0),
        (None, "failed", 0),
        ("[]", "ok", 0),
        ("[1, 2]", "ok", 0),
    ],
)
def test_replies(spark, raw, status, n):
    df = spark.createDataFrame([(1, raw)], "video_id long, raw string")
    row = responses.parse_responses(df, ["video_id"]).first()
    assert (row["status"], len(row["items"])) == (status, n)


def test_retry_only_for_broken_json(spark):
    df = spark.createDataFrame([(1, "no"), (2, "{ broken"), (3, "[]")], "video_id long, raw string")
    got = responses.retry_requests(responses.parse_responses(df, ["video_id"]), df, ["video_id"]).collect()
    assert [r["video_id"] for r in got] == [2]


def clip_rows(rng, videos=30):
    rows = []
    for v in range(videos):
        for k in range(rng.randint(1, 25)):
            start = round(rng.uniform(0, 300), 1)
            rows.append((v, k, start, start + rng.choice([16.0, 20.0, 30.0, 60.0]), *(rng.randint(50, 100) for _ in range(4)), "t"))
    return rows


CLIP = "video_id long, clip_ord int, start double, end double, score_emotion int, score_hook int, score_retention int, score_personality int, title string"


def ratio(a, b):
    return max(0, min(a[1], b[1]) - max(a[0], b[0])) / min(a[1] - a[0], b[1] - b[0])


def test_suppression_against_plain_python(spark):
    rows = clip_rows(random.Random(3))
    got = {(r["video_id"], r["clip_ord"]): r["rank"] for r in selection.select_clips(spark.createDataFrame(rows, CLIP)).collect()}
    want = {}
    for v in range(30):
        mine = [(-(4 * r[4] + 3 * r[5] + 2 * r[6] + r[7]) / 10, -r[4], r[1], r[2], r[3]) for r in rows if r[0] == v]
        taken = []
        for c in sorted(mine):
            if -c[0] >= 60 and not any(ratio(c[3:], t[3:]) > 0.5 for t in taken):
                taken.append(c)
                want[v, c[2]] = len(taken)
    assert got == want


def test_merge_chunks_prefers_longer_or_better(spark):
    rows = [(1, 0, 0.0, 20.0, 80, 80, 80, 80, "a"), (1, 1, 1.0, 27.0, 60, 60, 60, 60, "b"), (1, 2, 2.0, 26.0, 90, 90, 90, 90, "c"), (1, 3, 100.0, 120.0, 70, 70, 70, 70, "d")]
    scored = selection.score_clips(spark.createDataFrame(rows, CLIP))
    assert sorted(r["title"] for r in selection.merge_chunks(scored).collect()) == ["c", "d"]


def test_merge_chunks_compares_lengths_as_its_sql_does(spark):
    """33.305 s against 28.305 s: in doubles neither above 28.305 + 5 nor within 5 of it."""
    rows = [(1, 0, 28.511, 56.816, 60, 60, 60, 60, "a"), (1, 1, 32.196, 65.501, 90, 90, 90, 90, "b")]
    assert not 65.501 - 32.196 > 56.816 - 28.511 + 5 and (65.501 - 32.196) - (56.816 - 28.511) > 5
    scored = selection.score_clips(spark.createDataFrame(rows, CLIP))
    assert [r["title"] for r in selection.merge_chunks(scored).collect()] == ["a"]


def test_a_clip_with_only_a_total_is_no_high_score(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 20.0, None, None, None, None, "x", 88.0)], CLIP + ", clip_score double")
    scored = selection.score_clips(df)
    assert scored.first()["reject"] is None and selection.gate(scored).first()["reject"] == "low_score"


def test_relaxed_scores_keep_the_strictest(spark):
    rows = [(1, 0, 0.0, 20.0, 50, 50, 50, 50, "a"), (2, 0, 0.0, 20.0, 90, 90, 90, 90, "b"), (2, 1, 50.0, 70.0, 50, 50, 50, 50, "c")]
    got = {(r["title"], r["floor"]) for r in selection.relax_scores(spark.createDataFrame(rows, CLIP)).collect()}
    assert got == {("a", 45.0), ("b", 60.0)}


def words_of(text, start=0.0, step=0.4, pause=None):
    rows, at = [], start
    for i, w in enumerate(text.split()):
        rows.append((1, 0, i, w, round(at, 3), round(at + 0.3, 3)))
        at += step + (pause or {}).get(i, 0)
    return [(*r, start, rows[-1][5]) for r in rows]


def adjusted(spark, words, start, end, hook="", closing=""):
    clips = spark.createDataFrame([(1, 0, start, end, hook, closing)], "video_id long, clip_ord int, start double, end double, hook string, closing_line string")
    return boundaries.adjust_boundaries(clips, spark.createDataFrame(words, WORD)).first()


def test_start_skips_weak_words_to_a_power_word(spark):
    words = words_of("uh so like why does this work and more words come here until the end of it all then. " + "x " * 10, step=0.5)
    row = adjusted(spark, words, 0.0, 8.0)
    assert row["boundary_moved"] and abs(row["start"] - 1.4) < 1e-9


def test_end_extends_to_finish_a_sentence(spark):
    text = "people often ask me about this thing that we always do in the morning and because of it is done. next part goes on and on"
    words = words_of(text, step=0.5, pause={19: 1.5})
    row = adjusted(spark, words, 0.0, 8.6)
    assert abs(row["end"] - (words[19][5] + 0.25)) < 1e-9


def test_lines_are_set_to_what_was_said(spark):
    words = words_of("hello everyone today we talk about many good things for a long while until it is finally over.", step=0.5)
    row = adjusted(spark, words, 0.0, 8.0, hook="today we spoke about")
    assert row["hook"] == "today we talk about"


def test_clip_without_words_stays(spark):
    row = adjusted(spark, words_of("a b c"), 500.0, 520.0, hook="x")
    assert (row["start"], row["end"], row["boundary_moved"], row["hook"]) == (500.0, 520.0, False, "x")


def test_translations_keep_pauses_and_missing_phrases(spark):
    words = spark.createDataFrame([(1, 0, i, w, s, s + 0.5) for i, (w, s) in enumerate([("a", 0.0), ("b", 1.0), ("c", 1.5), ("d", 4.0), ("e", 4.5), ("f", 6.0)])], "video_id long, clip_ord int, n int, word string, start double, end double")
    phrases = subtitles.phrases(words)
    translated = spark.createDataFrame([(1, 0, "one two three")], "video_id long, phrase_id int, text string")
    got = [(r["word"], round(r["start"], 3), round(r["end"], 3)) for r in subtitles.translated_words(words, phrases, translated).orderBy("phrase_no", "k").collect()]
    assert [g[0] for g in got] == ["one", "two", "three", "f"] and got[-1] == ("f", 6.0, 6.5)
    assert got[0][1] == 0.0 and got[2][2] <= 5.0 + 1e-9 and abs(sum(e - s for _, s, e in got[:3]) - 2.5) < 1e-6
    assert [r["phrase_id"] for r in subtitles.missing_translations(phrases, translated).collect()] == [1]


def test_unusable_translations(spark):
    rows = [(1, 0, "<unk> a b"), (1, 1, "<unk> a b c d e"), (1, 2, "x"), (1, 3, " "), (1, None, "good text")]
    got = subtitles.usable_translations(spark.createDataFrame(rows, "video_id long, phrase_id int, text string")).collect()
    assert [r["phrase_id"] for r in got] == [1]


def test_subtitle_lines_break_and_do_not_touch(spark):
    rows = [(1, 0, i, w, s, e) for i, (w, s, e) in enumerate([("a", 0.0, 0.3), ("b", 0.4, 0.7), ("c", 0.8, 1.0), ("d", 1.0, 1.3), ("e", 1.3, 1.6), ("f", 2.2, 2.3), ("g", 2.3, 4.9)])]
    words = spark.createDataFrame(rows, "video_id long, clip_ord int, n int, word string, start double, end double")
    got = [(r["text"], round(r["end"], 3)) for r in subtitles.subtitle_lines(words).orderBy("line_no").collect()]
    assert got == [("a b c d", 1.26), ("e", 1.6), ("f", 2.26), ("g", 4.9)]


def test_silence_regions_and_retiming(spark):
    rows = [(1, 0, 0, "a", 1.0, 1.5), (1, 0, 1, "b", 3.0, 6.0), (1, 0, 2, "c", 9.0, 12.0)]
    words = spark.createDataFrame(rows, "video_id long, clip_ord int, n int, word string, start double, end double")
    clips = spark.createDataFrame([(1, 0, 15.0), (2, 0, 4.0)], "video_id long, clip_ord int, duration double")
    regions = silence.keep_regions(words, clips)
    got = sorted((r["video_id"], r["start"], r["end"], round(r["new_start"], 3)) for r in regions.collect())
    assert got == [(1, 0.8, 6.2, 0.0), (1, 8.8, 12.2, 5.4), (2, 0.0, 4.0, 0.0)]
    good = silence.worth_cutting(regions, clips)
    moved = {r["word"]: round(r["start"], 3) for r in silence.retime_words(words, good).collect()}
    assert moved == {"a": 0.2, "b": 2.2, "c": 5.6}
    with pytest.raises(ValueError):
        silence.keep_regions(words, clips, max_silence=0.3)


def box(cx, conf=0.9, cy=540):
    return {"x1": cx - 100, "y1": cy - 200, "x2": cx + 100, "y2": cy + 200, "conf": conf, "area": 80_000}


DETECTION = "clip_id long, time double, boxes array<struct<x1: int, y1: int, x2: int, y2: int, conf: double, area: int>>"


def test_tracks_are_stable_for_people_who_stay(spark):
    frames = [(1, float(t), [box(480 + t % 3), box(1440 - t % 3)]) for t in range(10)]
    got = crops.assign_tracks(spark.createDataFrame(frames, DETECTION)).collect()
    assert {(r["track_id"], r["x1"] < 900) for r in got} == {(0, True), (1, False)}
    gap = [(1, 0.0, [box(480)]), (1, 5.0, [box(480)])]
    assert {r["track_id"] for r in crops.assign_tracks(spark.createDataFrame(gap, DETECTION)).collect()} == {0, 1}


def speakers(spark, mouths, env):
    m = spark.createDataFrame([(1, k, i, float(v)) for k, s in enumerate(mouths) for i, v in enumerate(s)], "clip_id long, track_id int, sample_idx int, score double")
    e = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(env)], "clip_id long, win_idx long, env double")
    n = spark.createDataFrame([(1, len(env))], "clip_id long, n long")
    return [r["track_id"] for r in crops.active_speaker(crops.resample(m, n), e).orderBy("win_idx").collect()]


def test_speaker_follows_the_mouth_and_silence_has_none(spark):
    assert speakers(spark, [[1] * 5 + [0] * 5, [0] * 5 + [1] * 5], [1] * 10) == [0] * 5 + [1] * 5
    assert speakers(spark, [[1] * 10, [1] * 10], [0, 0, 1, 1, 0, 0, 1, 1, 0, 0]) == [-1, -1, 0, 0, -1, -1, 0, 0, -1, -1]


def test_crops_stay_in_the_frame_and_jump_between_speakers(spark):
    frames = [(1, float(t), [box(300), box(1700)]) for t in range(6)]
    video = spark.createDataFrame([(1, 1920, 1080)], "clip_id long, width int, height int")
    tracks = crops.assign_tracks(spark.createDataFrame(frames, DETECTION))
    who = spark.createDataFrame([(1, i, 0 if i < 6 else 1) for i in range(13)], "clip_id long, win_idx long, track_id int")
    got = crops.speaker_crops(tracks, who, video).orderBy("time").collect()
    assert all(0 <= r["x"] <= 1920 - r["w"] and r["w"] == 606 and r["h"] == 1080 for r in got)
    assert [r["track_id"] for r in got] == [0, 0, 0, 1, 1, 1] and got[3]["x"] == 1920 - 606
    static = crops.static_crop(spark.createDataFrame([(1, 0.0, [box(960)])], DETECTION), video).first()
    assert (static["x"], static["w"]) == (657, 606)


def test_crop_as_of_time(spark):
    keys = spark.createDataFrame([(1, 0.0, 0, 0, 1), (1, 2.0, 10, 0, 1), (1, 4.0, 90, 0, 2)], "clip_id long, time double, x int, y int, track_id int")
    times = spark.createDataFrame([(1, t) for t in (0.0, 1.0, 2.0, 3.9, 4.0, 60.0)], "clip_id long, t double")
    got = [r["x"] for r in crops.crop_at(crops.keyframe_spans(keys), times).orderBy("t").collect()]
    assert got == [0.0, 5.0, 10.0, 10.0, 90.0, 90.0]


def test_rewrites_lose_no_clip(spark):
    old = spark.createDataFrame([(1, 1, "a", "t", 1, 90.0), (1, 2, "b", "u", 2, 80.0)], "video_id long, clip_id long, title string, topic string, rank int, clip_score double")
    new = spark.createDataFrame([(1, 2, "B", " "), (1, 9, "new", "n")], "video_id long, clip_id long, title string, topic string")
    got = {(r["clip_id"], r["title"], r["topic"], r["rank"]) for r in refine.merge_refined(old, new, ("title", "topic")).collect()}
    assert got == {(1, "a", "t", 1), (2, "B", "u", 2), (9, "new", "n", 3)}
    change = spark.createDataFrame([(1, 1, "title", ""), (1, 2, "topic", "z")], "video_id long, clip_id long, field string, value string")
    got = {(r["clip_id"], r["title"], r["topic"]) for r in refine.update_fields(old, change, ("title", "topic")).collect()}
    assert got == {(1, "", "t"), (2, "b", "z")}
    answer = spark.createDataFrame([(1, 2, 0, "C")], "video_id long, clip_id long, answer_ord int, title string")
    assert [(r["clip_id"], r["title"], r["rank"]) for r in refine.keep_answered(old, answer, ("title",)).collect()] == [(2, "C", 1)]


def test_tighten_by_hand(spark):
    words = words_of("uh um so the point starts here and goes on for quite some time until we stop", start=2.0, step=0.5)
    clips = spark.createDataFrame([(1, 0, 0.0, 30.0)], "video_id long, clip_ord int, start double, end double")
    row = boundaries.tighten(clips, spark.createDataFrame(words, WORD)).first()
    assert row["tightened"] and abs(row["start"] - (3.0 - 0.15)) < 1e-9 and abs(row["end"] - (words[-1][5] + 0.5)) < 1e-9


WITH_WORDS = "video_id long, seg_id long, start double, end double, text string, no_speech_prob double, words array<struct<word: string, start: double>>"


def one_video(n, seed=4):
    rng, rows, at = random.Random(seed), [], 0.0
    for i in range(n):
        text = f"w{rng.randrange(9)} v{rng.randrange(3)}"
        length = rng.choice([0.5, 2.0, 7.0])
        rows.append((1, i, at, at + length, text, 0.0, [(w, at) for w in text.split()]))
        at += length + rng.choice([0.1, 0.4, 1.5])
    return rows


@pytest.mark.parametrize("block_rows", [1, 3, 7, 1000])
def test_folds_in_blocks_equal_the_plain_fold(spark, block_rows):
    rows, rules = one_video(120), transcript.CleanRules()
    seen, merged = [], []
    for _, i, s, e, text, _, words in rows:
        own = set(text.split())
        if any(len(own & k) >= rules.dup_threshold * len(own | k) for k in seen[-rules.dup_window :]):
            continue
        seen.append(own)
        if merged and s - merged[-1][1] <= rules.merge_gap and e - merged[-1][0] <= rules.max_merge_duration:
            now = merged[-1]
            merged[-1] = (now[0], e, now[2] + " " + text, now[3], now[4] + words)
        else:
            merged.append((s, e, text, i, words))
    frame = spark.createDataFrame(rows, WITH_WORDS).repartition(5)
    got = transcript.clean_transcript(frame, rules, block_rows).orderBy("seg_id").collect()
    assert [(r["start"], r["end"], r["text"], r["seg_id"], [tuple(w) for w in r["words"]]) for r in got] == merged
    marked = transcript.mark_segments(frame, rules, block_rows)
    assert marked.where("drop_reason is null").count() == len(seen)
    apart = transcript.merge_segments(marked.where("drop_reason is null"), rules, block_rows).orderBy("seg_id").collect()
    assert apart == got


def test_folds_take_empty_tables_and_null_keys(spark):
    empty = spark.createDataFrame([], WITH_WORDS)
    assert transcript.clean_transcript(empty).count() == transcript.mark_segments(empty).count() == 0
    odd = [(None, 0, 0.0, 1.0, "a b", None, None), (None, 1, 1.0, 2.0, "a b", 0.0, []), (2, 0, 0.0, 1.0, None, 0.0, None)]
    got = transcript.mark_segments(spark.createDataFrame(odd, WITH_WORDS)).collect()
    assert sorted(map(repr, (r["drop_reason"] for r in got))) == ["'duplicate'", "'few_words'", "None"]


def scored_clips(seed, n=70):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.choice([rng.uniform(0, 900), rng.randrange(0, 900, 50)])
        out.append((rng.randint(1, 3), i, float(s), float(s + rng.choice([15, 20, 40, 90, 170])), rng.randint(40, 99), rng.randint(0, 5)))
    return out


SCORED = "video_id long, clip_ord long, start double, end double, clip_score int, score_emotion int"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_islands_give_what_one_pass_gives(spark, seed):
    rows, rules = scored_clips(seed), selection.SelectRules(max_clips=5)

    def ratio(a, b):
        return max(0.0, min(a[3], b[3]) - max(a[2], b[2])) / min(a[3] - a[2], b[3] - b[2])

    want, merged = [], []
    for video in (1, 2, 3):
        own, taken, held = [r for r in rows if r[0] == video], [], []
        for r in sorted(own, key=lambda r: (-r[4], -r[5], r[1])):
            if len(taken) < rules.max_clips and all(ratio(r, t) <= rules.max_overlap for t in taken):
                taken.append(r)
        for r in sorted(own, key=lambda r: (r[2], -r[4], r[1])):
            k = next((k for k, h in enumerate(held) if ratio(r, h) > rules.same_overlap), None)
            if k is None:
                held.append(r)
            else:
                more = (r[3] - r[2]) - (held[k][3] - held[k][2])
                if more > rules.longer_by or (abs(more) <= rules.longer_by and r[4] > held[k][4]):
                    held[k] = r
        want += taken
        merged += held
    frame = spark.createDataFrame(rows, SCORED).repartition(4)
    assert sorted(map(tuple, selection.suppress_overlaps(frame, rules).collect())) == sorted(want)
    assert sorted(map(tuple, selection.merge_chunks(frame, rules).collect())) == sorted(merged)
    assert selection.suppress_overlaps(frame.limit(0), rules).count() == 0


def test_overlap_join_equals_nested_loops_at_any_length(spark):
    rng = random.Random(5)

    def side(n):
        return [(rng.randint(0, 2), i, lo := rng.uniform(0, 5000), lo + rng.choice([0, 1, 50, 400, 5000, 1e6, 1e9])) for i in range(n)]

    left, right = side(120), side(120)
    a, b = spark.createDataFrame(left, "k int, i int, s double, e double"), spark.createDataFrame(right, "k int, j int, s2 double, e2 double")
    want = sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[3] > y[2] and x[2] < y[3])
    predicate = (F.col("e") > F.col("s2")) & (F.col("s") < F.col("e2"))
    got = overlap_join(a, b, ["k"], ("s", "e"), ("s2", "e2"), predicate, 5.0)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want
    rows = spark.createDataFrame([(0.0, 1e9)], "lo double, hi double").select(level_of(F.col("lo"), F.col("hi"), 5.0).alias("level"))
    assert 5.0 * 64 * 4 ** (rows.first()["level"] - 1) * 5 > 1e9  # five bins at most


def test_crop_at_carries_the_last_keyframe(spark):
    spans = crops.keyframe_spans(spark.createDataFrame([(1, 1.0, 10, 0, 7), (1, 3.0, 20, 4, 7), (1, 2000.0, 90, 9, 8)], "clip_id long, time double, x int, y int, track_id int"))
    times = spark.createDataFrame([(1, t) for t in (0.0, 1.0, 2.0, 3.0, 1999.0, 2000.0, 1e9)] + [(2, 1.0)], "clip_id long, t double")
    got = {r["t"]: (r["x"], r["y"]) for r in crops.crop_at(spans, times).collect()}
    assert got == {0.0: (10, 0), 1.0: (10, 0), 2.0: (15, 2), 3.0: (20, 4), 1999.0: (20, 4), 2000.0: (90, 9), 1e9: (90, 9)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gathered_equals_nested_loops_at_any_length(spark):
    rng = random.Random(11)
    a = [(k, i, s, s + rng.choice([0.0, 3.0, 70.0, 400.0, 9_000.0, 500_000.0])) for k in (1, 2) for i, s in enumerate(rng.uniform(-900, 90_000) for _ in range(40))]
    b = [(k, i, s, s + rng.choice([0.1, 2.0, 300.0])) for k in (1, 3) for i, s in enumerate(rng.uniform(-1_000, 95_000) for _ in range(300))]
    left, right = spark.createDataFrame(a, "k long, i int, s double, e double"), spark.createDataFrame(b, "k long, j int, s2 double, e2 double")
    item = F.struct("s2", "j", "e2")
    got = gathered(left, right, ["k"], ("s", "e"), ("s2", "e2"), item, lambda row, x: (x["e2"] > row["s"]) & (x["s2"] < row["e"]), "near", 5.0)
    want = {(k, i): [j for _, j in sorted((s2, j) for kk, j, s2, e2 in b if kk == k and e2 > s and s2 < e)] for k, i, s, e in a}
    assert {(r["k"], r["i"]): [x["j"] for x in r["near"]] for r in got.collect()} == want


def test_words_of_clips_are_not_shuffled_in_pairs(spark):
    words = spark.createDataFrame(words_of("a b c d e f g h i j k l"), WORD).repartition("video_id")
    clips = spark.createDataFrame([(1, i, float(i), i + 3.0) for i in range(5)], "video_id long, clip_ord int, start double, end double").repartition("video_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = boundaries.near_words(clips, words, 0.0, 0.0)
        lines = subtitles.array_lines(subtitles.clip_word_arrays(clips, words))
        retimed = silence.region_arrays(subtitles.clip_word_arrays(clips, words).withColumn("duration", F.col("end") - F.col("start")))
        # one shuffle of each input and none of a clip's words
        assert [plan_of(df).count("Exchange hashpartitioning") for df in (near, lines, retimed)] == [2, 2, 2]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ending_scores_order_lines_not_words(spark):
    line = "video_id long, seg_id long, ws array<struct<word_pos int, word string, w_start double, w_end double>>"
    rows = [(1, 0, [(0, "so", 0.0, 0.3), (1, "done", 1.6, 2.0)]), (1, 1, []), (1, 2, [(0, "the", 2.7, 3.0)])]
    out = boundaries.ending_scores(spark.createDataFrame(rows, line))
    got = [(r["seg_id"], r["word_pos"], r["is_break"], r["score"]) for r in out.orderBy("seg_id", "word_pos").collect()]
    assert got == [(0, 0, True, 30), (0, 1, True, 14 + 25 + 20), (2, 0, False, 0)]
    plan = plan_of(out)
    assert plan.index("Generate inline") < plan.index("Window")  # words come last


def test_speaker_joins_broadcast_nothing(spark):
    signal = spark.createDataFrame([(1, 0, 0, 0.5)], "clip_id long, track_id int, sample_idx int, score double")
    windows = spark.createDataFrame([(1, 2)], "clip_id long, n long")
    envelope = spark.range(1, 2).select(F.col("id").alias("clip_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("win_idx"), F.lit(0.5).alias("env"))
    segs = spark.range(1, 2).select(F.col("id").alias("clip_id"), F.explode(F.array(F.lit(0).cast("long"))).alias("seg"))
    out = crops.segment_speakers(crops.active_speaker(crops.resample(signal, windows), envelope), segs)
    assert plan_of(out.hint("merge")).count("BroadcastExchange") <= 1  # the clips' numbers of windows
