"""Steps whose input used to be made again for each of their reads, and joins that used to shuffle what is dealt already."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave import queries, round_trip_queries
from timeweave.operators import energy, requests, responses, selection, transcript
from timeweave.streaming import live

SF = "/root/testdata/sf0.001"
SEG = "video_id long, seg_id long, start double, end double, text string, no_speech_prob double"


def counted(df: DataFrame, column: str):
    """``df`` and the number of times that a value of ``column`` has been made."""
    made = df.sparkSession.sparkContext.accumulator(0)

    def same(x):
        made.add(1)
        return x

    return df.withColumn(column, F.udf(same, df.schema[column].dataType).asNondeterministic()(column)), made


def plan_of(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_replies_are_read_once(spark, tmp_path):
    raws = ['[{"a": 1}]', "```json\n[{\"a\": 1}, {\"b\": 2}]\n```", '{"clips": [{"a": 1}, 3]}', '[{"a": 1}, {"b"', '[1, {"a": 1}]', "[]", "no", None]
    spark.createDataFrame(list(enumerate(raws)), "k int, raw string").coalesce(1).write.parquet(str(tmp_path / "raw"))
    out = responses.parse_responses(spark.read.parquet(str(tmp_path / "raw")), ["k"])
    got = [(r["status"], r["items"]) for r in out.orderBy("k").collect()]
    assert got[:3] == [("ok", ['{"a":1}']), ("ok", ['{"a":1}', '{"b":2}']), ("ok", ['{"a": 1}'])]
    assert got[3:] == [("partial", ['{"a": 1}']), ("ok", ['{"a": 1}']), ("ok", []), ("failed", []), ("failed", [])]
    assert plan_of(out).count("FileScan") == 1


def test_clips_are_made_once_for_their_islands(spark):
    rows = [(1, i, i * 40.0, i * 40.0 + 50.0, 90 - i, 50) for i in range(6)]
    clips, made = counted(spark.createDataFrame(rows, "video_id long, clip_ord int, start double, end double, clip_score int, score_emotion int"), "start")
    assert selection.suppress_overlaps(clips).count() == 6 and made.value == 6


def test_reasons_are_found_once_a_segment(spark, monkeypatch):
    rows = [(v, i, i * 2.0, i * 2.0 + 1.0, f"text {v} of {i}", 0.0) for v in range(5) for i in range(20)]
    made = spark.sparkContext.accumulator(0)
    reason = F.udf(lambda t: made.add(1), "string").asNondeterministic()
    monkeypatch.setattr(transcript, "drop_reason", lambda *a: reason("text"))
    assert transcript.clean_transcript(spark.createDataFrame(rows, SEG)).agg(F.sum("n_merged")).first()[0] == 100
    assert made.value == 100


def test_windows_of_energy_are_made_once(spark):
    windows = [(1, i, i * 0.5, 900.0 if i == 30 else 100.0) for i in range(60)]
    df, made = counted(spark.createDataFrame(windows, "video_id long, win_idx long, t double, rms double"), "rms")
    regions = spark.createDataFrame([(1, 1, 0.0, 30.0)], "video_id long, region_id int, start double, end double")
    got = energy.energy_events(df, regions).collect()
    assert [(r["win_idx"], r["kind"], r["in_speech"]) for r in got] == [(30, "spike", True)] and made.value == 60


def test_a_replayed_stream_makes_its_rows_once(spark):
    rows = spark.range(40).select((F.col("id") % 3).alias("video_id"), F.timestamp_seconds(F.col("id") * 20).alias("ts"), F.col("id").alias("amp"))
    own, made = counted(rows, "amp")
    own = own.where("amp >= 0").repartition(2, "video_id")  # as behind gates and joins: one row asks for all
    closing = {"video_id": F.lit(-1), "ts": F.lit("2100-01-01").cast("timestamp"), "amp": F.lit(0)}
    part = F.floor(F.unix_seconds("ts") / 200).cast("int")
    out = round_trip_queries._replayed(own, part, "once", closing, lambda s: live.live_rms(s, "1 minute"))
    assert out.agg(F.sum("n")).first()[0] == 40 and made.value == 40


def test_marked_chunks_make_segments_and_moments_once(spark):
    segs, texts = counted(spark.createDataFrame([(1, 0, 0.0, 2.0, "a", 0.0), (1, 1, 3.0, 4.0, "b", 0.0)], SEG), "text")
    moments = spark.createDataFrame([(1, 0, 0.5, 1.0, "spike", True), (1, 1, 2.2, 2.7, "high", False)], "video_id long, moment_id long, start double, end double, kind string, in_speech boolean")
    moments, kinds = counted(moments, "kind")
    got = requests.marked_chunks(segs, moments).collect()
    assert [(r["chunk_id"], r["n_lines"], r["transcript"]) for r in got] == [
        (0, 2, "[0-2] a [ENERGY SPIKE] [PAUSE 1.0s]\n[3-4] b\n\n[MOMENTS WITHOUT WORDS]\n[2.2-2.7] HIGH ENERGY")
    ]
    assert (texts.value, kinds.value) == (2, 2)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", ["f10_j21_active_speaker", "a10_w21_segment_speakers"])
def test_clips_are_shuffled_before_their_rows_are_made(spark: SparkSession, name):
    plan = plan_of(queries.QUERIES[name](spark, SF))
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
