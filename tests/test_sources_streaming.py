"""Files in and out, the step cache, and streams against their batch twins."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeweave.operators import crops, energy, transcript
from timeweave.sources import cache, clips, media, pcm, transcripts
from timeweave.streaming import live

SEGMENT = {"start": 0.0, "end": 1.0, "text": "[music] hi", "words": [{"word": "hi", "start": 0.1, "end": 0.4}], "no_speech_prob": 0.2}


def test_transcripts_in_both_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"segments": [SEGMENT, SEGMENT], "language_info": {"language": "en", "language_probability": 0.9}}))
    (tmp_path / "b.json").write_text(json.dumps([SEGMENT]))
    (tmp_path / "c.json").write_text("")
    (tmp_path / "d.json").write_text("{broken")
    df = transcripts.read_transcripts(spark, str(tmp_path))
    got = sorted((r["video_id"], r["seg_id"], r["language"], r["language_probability"], r["non_speech_event"]) for r in df.collect())
    assert got == [("a", 0, "en", 0.9, True), ("a", 1, "en", 0.9, True), ("b", 0, "unknown", 0.0, True)]
    words = transcripts.explode_words(df).collect()
    assert len(words) == 3 and words[0]["w_end"] == 0.4
    transcripts.write_transcripts(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    assert {r["duration"] for r in transcripts.transcript_durations(df).collect()} == {1.0}


def test_clips_files(spark, tmp_path):
    schema = T.StructType.fromDDL("title string, start double")
    (tmp_path / "good.json").write_text('[{"title": "a", "start": 1}, {"title": "b", "start": 2}]')
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "bad.json").write_text('[{"title": "a"')
    rows, rejects = clips.read_clips(spark, str(tmp_path), schema)
    assert [(r["clip_ord"], r["title"]) for r in rows.orderBy("clip_ord").collect()] == [(0, "a"), (1, "b")]
    assert {r["path"].rpartition("/")[2] for r in rejects.collect()} == {"bad.json"}
    own = spark.createDataFrame([(1, 0, "t", 0.5)], "video_id long, clip_id long, title string, _llm_start double")
    clips.save_clips(own, str(tmp_path / "t"), ["video_id", "clip_id"])
    assert "_llm_start" not in spark.read.parquet(str(tmp_path / "t/clips")).columns
    assert clips.load_clips(spark, str(tmp_path / "t"), ["video_id", "clip_id"]).first()["_llm_start"] == 0.5
    files = spark.createDataFrame([(1, "rank03_x.mp4", 1572864), (1, "other.mp4", 0)], "video_id long, name string, length long")
    ranked = spark.createDataFrame([(1, 3, "t")], "video_id long, rank int, title string")
    got = {(r["name"], r["size_mb"], r["title"]) for r in clips.attach_files(files, ranked).collect()}
    assert got == {("rank03_x.mp4", 1.5, "t"), ("other.mp4", 0.0, None)}


def test_media_catalog_and_pcm(spark, tmp_path):
    for name in ("b.MP4", "a.mkv", "note.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r["stem"] for r in media.media_catalog(spark, str(tmp_path)).collect()) == ["a", "b"]
    samples = np.random.default_rng(1).integers(-3000, 3000, 2500).astype("<i2")
    (tmp_path / "v.s16le").write_bytes(samples.tobytes())
    got = {r["win_idx"]: r["rms"] for r in media.pcm_windows(spark, str(tmp_path), 1000).collect()}
    assert set(got) == {0, 1}
    table = spark.createDataFrame([(1, i, int(v)) for i, v in enumerate(samples)], "video_id long, sample_idx long, amp int")
    want = {r["win_idx"]: r["rms"] for r in energy.rms_windows(table, 1000).collect()}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    done = spark.createDataFrame([("a", True), ("c", False), ("b", False)], "source_video string, ok boolean")
    assert tuple(media.batch_summary(done).first()) == (1, 2, ["b", "c"])


def test_recordings_are_cut_by_windows(spark, tmp_path):
    """Every split, parts in order, empty and short recordings; the plan covers each whole window once."""
    rng = np.random.default_rng(2)
    sounds = {"1": rng.integers(-3000, 3000, 1234), "2": rng.integers(-3000, 3000, 99), "3": rng.integers(-9, 9, 300), "4": np.array([], int)}
    parts = [(v, i, s[i : i + 77].astype("<i2").tobytes()) for v, s in sounds.items() for i in range(0, max(1, len(s)), 77)]
    parts += [("1", 10_000, None), (None, 0, b"xx")]
    folder = str(tmp_path / "sound")
    media.write_pcm(spark.createDataFrame(parts, "video_id string, i long, content binary").repartition(3), folder, "i")
    assert sorted(p.name for p in (tmp_path / "sound").iterdir()) == [f"{v}.s16le" for v in sorted(sounds)]
    assert all((tmp_path / "sound" / f"{v}.s16le").read_bytes() == s.astype("<i2").tobytes() for v, s in sounds.items())
    want = {(v, w): np.sqrt(np.square(s[w * 100 : w * 100 + 100].astype(float)).mean()) for v, s in sounds.items() for w in range(len(s) // 100)}
    for split in (1, 200, 500, 1 << 20):
        got = [(r["video_id"], r["win_idx"], r["rms"]) for r in media.pcm_windows(spark, folder, 100, split).collect()]
        assert len(got) == len(want) and all(abs(want[v, w] - x) < 1e-9 for v, w, x in got)
    plan = pcm.plan_ranges([("a/x.s16le", 4_000_000_001), ("a/y.s16le", 0), ("a/z.s16le", 2400)], 100, 1 << 20)
    assert sum(n for p in plan for *_, n in p.pieces) == 20_000_000 + 12
    assert all(sum(n for *_, n in p.pieces) * 200 <= 1 << 20 for p in plan)


def test_recording_above_two_gib(spark, tmp_path):
    path = tmp_path / "long.s16le"
    with open(path, "wb") as f:
        f.truncate(2**31 + 32_000)
        f.seek(2**31)
        f.write(np.full(8000, 5, "<i2").tobytes())
    found = media.pcm_windows(spark, str(tmp_path), 8000)
    loud = {134217: 2176, 134218: 5824}
    assert {(r["win_idx"], round(r["rms"], 6)) for r in found.where("rms > 0").collect()} == {(w, round((25 * n / 8000) ** 0.5, 6)) for w, n in loud.items()}
    assert found.count() == (2**31 + 32_000) // 16_000


def test_step_cache(spark, tmp_path):
    params = spark.createDataFrame([(v, s, "p") for v in (1, 2) for s in cache.STEPS], "video_id long, step string, param string")
    wanted = cache.chain_signatures(params)
    store = cache.StepCache(spark, str(tmp_path / "cache"))
    assert store.rows().count() == 0 and cache.stale(wanted, store.rows()).count() == 10
    store.put(wanted.where("video_id = 1").withColumn("payload", F.lit("x")))
    store.put(wanted.where("video_id = 2 and step = 'energy'").withColumn("payload", F.lit("y")))
    assert cache.stale(wanted, store.rows()).count() == 4
    changed = cache.chain_signatures(params.withColumn("param", F.when((F.col("step") == "energy") & (F.col("video_id") == 1), "q").otherwise(F.col("param"))))
    state = {(r["video_id"], r["step"]): r["state"] for r in cache.status(changed, store.rows()).collect()}
    assert state[1, "prefilter"] == "fresh" and state[1, "energy"] == state[1, "build"] == "stale" and state[2, "build"] == "missing"
    store.clear("energy")
    assert store.rows().where("step = 'energy'").count() == 0 and store.rows().count() == 4
    store.clear()
    assert store.rows().count() == 0
    videos = spark.createDataFrame([(1, " ", "u"), (2, None, None)], "video_id long, user_title string, user_caption string")
    cached = spark.createDataFrame([(1, "c", "c")], "video_id long, title string, caption string")
    made = spark.createDataFrame([(1, "g", "g"), (2, "g", "g")], "video_id long, title string, caption string")
    assert {tuple(r) for r in cache.merged_metadata(videos, cached, made).collect()} == {(1, "c", "u"), (2, "g", "g")}


def test_step_cache_survives_crashes_and_second_writers(spark, tmp_path, monkeypatch):
    rows = lambda v, s, p: spark.createDataFrame([(v, s, "sig", p)], cache.CACHE)
    held = lambda: {(r["video_id"], r["step"]): r["payload"] for r in store.rows().collect()}
    store, other = (cache.StepCache(spark, str(tmp_path / "cache")) for _ in range(2))
    store.put(rows(1, "energy", "a"))
    store.put(rows(1, "energy", "b"))
    store.put(rows(2, "select", "c"))
    before = {(1, "energy"): "b", (2, "select"): "c"}
    assert held() == before

    def crash(*_):
        raise OSError("lost")

    for change in (lambda: store.put(rows(3, "build", "d")), store.compact, lambda: store.clear("energy")):
        with monkeypatch.context() as m, pytest.raises(OSError):
            m.setattr(cache.StepCache, "_commit", crash)
            change()
        assert held() == before

    plain = cache.StepCache._commit

    def beaten(change):
        """The first commit of ``store`` finds that ``other`` has made ``change`` in between."""

        def commit(self, number, live):
            if self is store and not done:
                done.append(True)
                change()
            return plain(self, number, live)

        done = []
        return commit

    with monkeypatch.context() as m:
        m.setattr(cache.StepCache, "_commit", beaten(lambda: other.put(rows(3, "build", "d"))))
        store.put(rows(4, "build", "e"))
    assert held() == before | {(3, "build"): "d", (4, "build"): "e"}
    with monkeypatch.context() as m:
        m.setattr(cache.StepCache, "_commit", beaten(lambda: (other.put(rows(1, "energy", "f")), other.clear("select"))))
        store.compact()
    after = {(1, "energy"): "f", (3, "build"): "d", (4, "build"): "e"}
    assert held() == after and len(store._newest()[1]) == 2
    with monkeypatch.context() as m:
        m.setattr(cache.StepCache, "_commit", beaten(other.compact))
        store.compact()
    assert held() == after and len(store._newest()[1]) == 1
    assert store.vacuum() == 0 and store.vacuum(-1.0) > 0 and held() == after
    with monkeypatch.context() as m:
        m.setattr(cache.StepCache, "_commit", beaten(lambda: other.clear()))
        store.compact()
    assert held() == {}


T0 = datetime(2024, 1, 1)


def streamed(spark, tmp_path, rows, schema, build, mode="append"):
    """Rows written as files of a stream; what the query wrote to memory."""
    source = str(tmp_path / uuid.uuid4().hex)
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    name = "t" + uuid.uuid4().hex
    stream = spark.readStream.schema(T.StructType.fromDDL(schema)).option("maxFilesPerTrigger", 1).parquet(source)
    query = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def test_live_rms_agrees_with_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    amps = rng.integers(-1000, 1000, 40)
    schema = "video_id long, ts timestamp, amp int"
    rows = [(1, T0 + timedelta(milliseconds=50 * i), int(a)) for i, a in enumerate(amps)]
    got = streamed(spark, tmp_path, [rows, [(1, T0 + timedelta(hours=1), 0)]], schema, live.live_rms).orderBy("window").collect()
    table = spark.createDataFrame([(1, i, int(a)) for i, a in enumerate(amps)], "video_id long, sample_idx long, amp int")
    want = [r["rms"] for r in energy.rms_windows(table, 10).orderBy("win_idx").collect()]
    assert np.allclose([r["rms"] for r in got], want)


def test_live_moments_agree_with_batch(spark, tmp_path):
    times = [0.0, 2.5, 5.5, 6.0, 20.0]
    events = [(1, i, t, 100.0 + i, "spike" if i == 1 else "high", i != 2) for i, t in enumerate(times)]
    batch = energy.energy_moments(spark.createDataFrame(events, "video_id long, win_idx long, time double, rms double, kind string, in_speech boolean"))
    want = [(r["start"], r["peak_rms"], r["kind"], r["in_speech"]) for r in batch.orderBy("start").collect()]
    rows = [(v, T0 + timedelta(seconds=t), rms, kind, speech) for v, _, t, rms, kind, speech in events]
    closing = [(1, T0 + timedelta(hours=1), 1.0, "high", True)]
    late = [(1, T0 + timedelta(seconds=1), 9999.0, "spike", True)]
    out = streamed(spark, tmp_path, [rows, closing, late, [(1, T0 + timedelta(hours=1, seconds=1), 1.0, "high", True)]], "video_id long, ts timestamp, rms double, kind string, in_speech boolean", live.live_moments)
    got = [((r["session_window"]["start"] - T0).total_seconds(), r["peak_rms"], r["kind"], r["in_speech"]) for r in out.orderBy("session_window").collect()]
    assert got == want


def test_live_reasons(spark, tmp_path):
    schema = "video_id long, seg_id long, ts timestamp, start double, end double, text string, no_speech_prob double"
    rows = [(1, i, T0 + timedelta(seconds=i), 0.0, 1.0, t, 0.0) for i, t in enumerate(["hi", "la la", "hi there", ""])]
    out = streamed(spark, tmp_path, [rows, [(1, 9, T0 + timedelta(hours=1), 0.0, 1.0, "x", 0.0)]], schema, live.live_reasons)
    assert {(r["drop_reason"], r["n"]) for r in out.collect()} == {("kept", 2), ("music", 1), ("few_words", 1)}


FAR = T0 + timedelta(days=2)


def test_live_distinct_agrees_with_batch(spark, tmp_path):
    texts = ["a b c", "a b c", "x y"] + [f"t{i} u{i}" for i in range(12)] + ["A B  c", "x y"]
    rows = [(v, T0 + timedelta(seconds=i), i, t) for v in (1, 2) for i, t in enumerate(texts)]
    mixed = [r for r in rows if r[2] < 8][::-1]  # rows wait for the watermark, so their order within it is free
    parts = [mixed, [r for r in rows if r[2] >= 8], [(1, FAR, 99, "end")]]
    got = streamed(spark, tmp_path, parts, "video_id long, ts timestamp, seg_id long, text string", live.live_distinct)
    seg = spark.createDataFrame([(v, i, i * 2.0, i * 2.0 + 1, t, 0.0) for v, _, i, t in rows], "video_id long, seg_id long, start double, end double, text string, no_speech_prob double")
    want = transcript.mark_segments(seg).where("drop_reason is null")
    assert sorted((r["video_id"], r["seg_id"]) for r in got.collect()) == sorted((r["video_id"], r["seg_id"]) for r in want.collect())


def test_live_distinct_drops_late_rows_and_forgets_silent_keys(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    parts = [
        [(1, at(0), 0, "a b"), (2, at(0), 0, "c d")],
        [(1, at(300), 1, "x y")],
        [(2, at(301), 1, "c d")],  # key 2 still knows its text
        [(1, at(10), 2, "late")],  # later than the watermark
        [(1, at(4000), 3, "x y")],  # after more than the time to live key 1 has forgotten
        [(3, FAR, 0, "end")],
    ]
    got = streamed(spark, tmp_path, parts, "video_id long, ts timestamp, seg_id long, text string", lambda s: live.live_distinct(s, ttl_seconds=600.0))
    assert sorted((r["video_id"], r["seg_id"]) for r in got.collect()) == [(1, 0), (1, 1), (1, 3), (2, 0)]


def test_live_distinct_remembers_over_a_long_line(spark, tmp_path):
    """A document of two equal lines with one of 632 words, two hours of speech, between them."""
    from timeweave import queries, round_trip_queries  # noqa: F401

    text = "\n".join(["Nicht aulich sch der.", " ".join(["Der"] * 632), "Nicht aulich sch der."])
    spark.createDataFrame([(8290, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["t3_live_distinct"](spark, str(tmp_path))
    assert sorted(r["seg_id"] for r in got.collect()) == [0, 1]


def test_live_tracks_agree_with_batch(spark, tmp_path):
    def box(cx):
        return (cx - 100, 340, cx + 100, 740)

    schema = "clip_id long, ts timestamp, time double, boxes array<struct<x1: int, y1: int, x2: int, y2: int>>"
    rows = [(c, T0 + timedelta(seconds=t * 0.5), t * 0.5, [box(480 + 7 * (t % 4)), box(1400 - 9 * (t % 3))][:: 1 if t % 2 else -1]) for c in (1, 2) for t in range(12)]
    parts = [[r for r in rows if r[2] < 3][::-1], [r for r in rows if r[2] >= 3], [(9, FAR, 0.0, [])]]
    got = streamed(spark, tmp_path, parts, schema, live.live_tracks)
    want = crops.assign_tracks(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rules_in_order_hold_one_value_and_give_no_empty_frames():
    import pandas as pd

    class Held:
        exists, get, now, wake = False, None, 0, None

        def getCurrentWatermarkMs(self):
            return self.now

        def update(self, value):
            self.exists, self.get = True, value

        def remove(self):
            self.exists, self.get = False, None

        def setTimeoutTimestamp(self, ms):
            self.wake = ms

    rule, held = live.SuppressNear(transcript.CleanRules(), 10.0), Held()
    assert list(rule((1,), iter([pd.DataFrame({"ms": [2000, 1000], "seg_id": [1, 0], "text": ["a b", "A b"]})]), held)) == [] and held.wake == 1000
    held.now = 1500
    assert [f.values.tolist() for f in rule((1,), iter([]), held)] == [[[1, 0, "A b"]]] and held.wake == 2000
    held.now = 3000
    assert list(rule((1,), iter([]), held)) == [] and held.exists and held.wake == 12000
    held.now = 12000
    assert list(rule((1,), iter([]), held)) == [] and not held.exists


def test_packed_subtitles_hold_the_files_of_clips(spark, tmp_path):
    from timeweave.operators import subtitles

    words = [(v, c, n, f"w{n}", n * 0.4, n * 0.4 + 0.3) for v in range(6) for c in range(5) for n in range(v + 1)]
    arrays = subtitles.word_arrays(spark.createDataFrame(words, "video_id long, clip_ord long, n long, word string, start double, end double"))
    subtitles.write_dialogue(subtitles.array_lines(arrays), str(tmp_path / "each"))
    subtitles.pack_dialogue(arrays, str(tmp_path / "packed"))
    want, got = subtitles.read_dialogue(spark, str(tmp_path / "each")), subtitles.read_packed(spark, str(tmp_path / "packed"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 30
    assert len(list((tmp_path / "packed").rglob("*.parquet"))) <= 4


def test_fingerprints_are_joined_without_words(spark, tmp_path):
    from timeweave import queries, round_trip_queries  # noqa: F401

    texts = [(i, "\n".join(["one two three", "\t", f"four {i}"])) for i in range(3, 12)] + [(12, "\t")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["src7_j18_word_fingerprints"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(i, 5, f"cached {i}" if i % 3 == 2 else None) for i in range(3, 12)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "collect_list" not in plan


def test_tracks_pass_over_frames_without_boxes(spark):
    box = {"x1": 0, "y1": 0, "x2": 10, "y2": 10}
    rows = [(1, 0.0, [box, {**box, "x1": 90, "x2": 100}]), (1, 0.5, None), (1, 1.0, []), (1, 1.2, [{**box, "x1": 80, "x2": 90}]), (2, 0.0, [box]), (2, 9.0, [box])]
    df = spark.createDataFrame(rows, "clip_id long, time double, boxes array<struct<x1: int, y1: int, x2: int, y2: int>>")
    got = sorted((r["clip_id"], r["time"], r["box_ord"], r["track_id"], r["x1"]) for r in crops.assign_tracks(df, stale=3.0).collect())
    assert got == [(1, 0.0, 0, 0, 0), (1, 0.0, 1, 1, 90), (1, 1.2, 0, 1, 80), (2, 0.0, 0, 0, 0), (2, 9.0, 0, 1, 0)]


def test_registered_queries_are_consistent():
    import __spark_entry__ as entry

    names, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(names) and len(names) > 40
