from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from timeweave.functions import text as tx


def one(spark, expression, **columns):
    names = list(columns)
    kinds = {str: "string", int: "int", float: "double", type(None): "string"}
    schema = ", ".join(f"{n} {kinds[type(columns[n])]}" for n in names)
    return spark.createDataFrame([tuple(columns.values())], schema).select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("title", "generic"), [(None, True), ("", True), ("Clip", True), ("clip 12", True), ("Clip 3:", True), ("Clip 3 – ", True), ("Clip art", False), ("How to", False)]
)
def test_generic_titles(spark, title, generic):
    assert one(spark, tx.is_generic_title(F.col("t")), t=title) == generic


def test_real_title(spark):
    def title(t, topic, hook, rank=3):
        return one(spark, tx.real_title(F.col("t"), F.col("topic"), F.col("hook"), F.lit(None).cast("string"), F.col("rank")), t=t, topic=topic, hook=hook, rank=rank)

    assert title("Real", "x", "y") == "Real"
    assert title("Clip 1", "one two three four five six seven eight nine", "") == "one two three four five six seven eight"
    assert title("Clip 1", " ", "why so?!") == "why so"
    assert title("", None, None) == "Moment #3"


@pytest.mark.parametrize(("raw", "score"), [("87.5", 88), ("88.5", 88), ("-3", 0), ("250", 100), ("x", 0), (None, 0), ("NaN", 0)])
def test_scores(spark, raw, score):
    assert one(spark, tx.to_score(F.col("r")), r=raw) == score


def test_clip_score_is_exact(spark):
    c = [F.lit(x) for x in (77, 81, 93, 64)]
    assert one(spark, tx.clip_score(*c), r="x") == 80.1


@pytest.mark.parametrize(
    ("a", "b", "want"), [("a b", "A  b", 1.0), ("a b c", "a b d", 0.5), ("", "", 0.0), ("a b", "a b", 1.0), (None, "a", 0.0)]
)
def test_jaccard_uses_unicode_space(spark, a, b, want):
    assert one(spark, tx.jaccard(F.col("a"), F.col("b")), a=a, b=b) == want


def test_small_forms(spark):
    assert one(spark, tx.norm_word(F.col("w")), w="?Hello,!") == "hello"
    assert one(spark, tx.ass_time(F.col("s")), s=3723.456) == "1:02:03.46"
    assert one(spark, tx.ass_time(F.col("s")), s=-1.0) == "0:00:00.00"
    assert one(spark, tx.clip_filename(F.lit(3), F.col("t")), t="What? A  day!") == "rank03_What_A_day.mp4"
    assert one(spark, tx.preview(F.col("t"), 6), t="  one\n two ") == "one t…"
    assert one(spark, tx.frame_rate(F.col("r")), r="30000/1001") == 30000 / 1001
    assert one(spark, tx.frame_rate(F.col("r")), r="0/0") == 30.0
    assert one(spark, F.concat_ws("|", *tx.split_log(F.col("l"))), l="\x1b[32m[WARN]\x1b[0m low disk") == "WARN|low disk"
    assert one(spark, F.concat_ws("|", *tx.split_log(F.col("l"))), l="plain") == "INFO|plain"
    assert one(spark, tx.overlap_ratio(F.lit(0.0), F.lit(10.0), F.lit(5.0), F.lit(9.0)), r="x") == 1.0
