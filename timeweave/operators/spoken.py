"""Words as items that clips gather: of a table with a row a word, or of lines that hold their words as an array."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from timeweave.functions.arrays import sizes_of
from timeweave.functions.intervals import gathered, gathered_in_place


def _words_of_lines(lines: pa.StructArray) -> tuple[np.ndarray, pa.StructArray]:
    """How many words that are not blank each line has, and the words, blanks cut at their ends."""
    n = sizes_of(lines.field("ws"))
    w, of = lines.field("ws").flatten(), np.repeat(np.arange(len(n)), n)
    word = pc.utf8_trim(w.field("word"), " ")
    said = pc.fill_null(pc.not_equal(word, ""), False).to_numpy(zero_copy_only=False)
    if not said.all():
        w, word, of = w.filter(pa.array(said)), word.filter(pa.array(said)), of[said]
    line = lambda c: lines.field(c).take(pa.array(of))
    columns = [w.field("w_start"), line("seg_id"), w.field("word_pos"), w.field("w_end"), word, line("seg_start"), line("seg_end")]
    return np.bincount(of, minlength=len(n)), pa.StructArray.from_arrays(columns, ["s", "seg_id", "word_pos", "e", "word", "seg_start", "seg_end"])


def gathered_words(clips: DataFrame, words: DataFrame, span: tuple[str, str], holds: Callable, width: float, made: tuple[Callable, DataType] | None = None, in_place: bool = False) -> DataFrame:
    """``clips`` (video_id, ...) with ``ws``: the words that ``holds`` (see ``gathered``), blank ones left out, as s, seg_id,
    word_pos, e, word, seg_start, seg_end, sorted so. ``words`` has a row a word (video_id, seg_id, word_pos, word, w_start,
    w_end, seg_start, seg_end) or, with less to pack, a row a line (video_id, seg_id, start, end, ws: word_pos, word,
    w_start, w_end). ``in_place`` (see ``gathered_in_place``) keeps clips dealt by video and makes nothing."""
    ends = ("s", "e")
    if "ws" in words.columns:
        line = F.struct("seg_id", F.col("start").alias("seg_start"), F.col("end").alias("seg_end"), "ws")
        if in_place:
            entry = lambda x: F.struct(x["w_start"].alias("s"), "seg_id", x["word_pos"].alias("word_pos"), x["w_end"].alias("e"), F.trim(x["word"]).alias("word"), F.col("start").alias("seg_start"), F.col("end").alias("seg_end"))
            words = words.withColumn("_said", F.filter(F.transform("ws", entry), lambda x: x["word"] != ""))
            own = words.withColumns({"_from": F.array_min("_said.s"), "_to": F.array_max("_said.e")})
            return gathered_in_place(clips, own, ["video_id"], span, ("_from", "_to"), F.col("_said"), holds, "ws", width)
        own = words.withColumns({"_from": F.array_min("ws.w_start"), "_to": F.array_max("ws.w_end")})
        if made is None:
            kinds = words.schema["ws"].dataType.elementType
            fields = [("s", kinds["w_start"]), ("seg_id", words.schema["seg_id"]), ("word_pos", kinds["word_pos"]), ("e", kinds["w_end"])]
            fields += [("word", kinds["word"]), ("seg_start", words.schema["start"]), ("seg_end", words.schema["end"])]
            made = (None, StructType())
            for name, field in fields:
                made[1].add(name, field.dataType)
        return gathered(clips, own, ["video_id"], span, ("_from", "_to"), line, holds, "ws", width, made, _words_of_lines, ends)
    own = words.where(F.trim("word") != "").withColumn("word", F.trim("word"))
    item = F.struct(F.col("w_start").alias("s"), "seg_id", "word_pos", F.col("w_end").alias("e"), "word", "seg_start", "seg_end")
    if in_place:
        return gathered_in_place(clips, own, ["video_id"], span, ("w_start", "w_end"), F.array(item), holds, "ws", width)
    return gathered(clips, own, ["video_id"], span, ("w_start", "w_end"), item, holds, "ws", width, made, None, ends)
