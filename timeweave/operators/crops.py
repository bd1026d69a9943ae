"""Following people: boxes, tracks, the active speaker, and where to place the crop.

Rows a second or a window come from exploded arrays, which Spark's estimates take for one row each; joins of them
say that they merge, else tables of any size would be broadcast and built in the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from timeweave.functions.intervals import running_max
from timeweave.functions.stats import upper_median_of

SILENCE, AUDIO_WINDOW = 0.04, 0.5


def confident(detections: DataFrame, least: float = 0.5) -> DataFrame:
    """``detections`` (clip_id, time, boxes) with weak boxes and then empty frames dropped; largest box
    first, equal ones in their order."""
    numbered = F.transform("boxes", lambda b, i: F.struct((-b["area"]).alias("k"), i.alias("i"), b.alias("b")))
    kept = F.filter(numbered, lambda x: x["b"]["conf"] >= least)
    out = detections.withColumn("boxes", F.transform(F.array_sort(kept), lambda x: x["b"]))
    return out.where(F.size("boxes") > 0)


def best_face(faces: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """The most confident face per key; the first of equal ones by face_ord."""
    return faces.where(F.col("conf") >= least).groupBy(*keys).agg(F.min_by(F.struct("x1", "y1", "x2", "y2", "conf"), F.struct(-F.col("conf"), F.col("face_ord"))).alias("face"))


def needs_crop(width: Column, height: Column, layout: str) -> Column:
    aspect = width / height
    rules = {"vertical": aspect > 0.7, "horizontal": aspect < 1.3, "square": F.abs(aspect - 1) > 0.15}
    return rules[layout]


def crop_size(width: Column, height: Column, aspect: float) -> tuple[Column, Column]:
    """Largest crop of the aspect, both sides even."""
    narrow = F.lit(aspect) < width / height
    w = F.when(narrow, (height * aspect).cast("int")).otherwise(width)
    h = F.when(narrow, height).otherwise((width / aspect).cast("int"))
    return (w - w % 2).cast("int"), (h - h % 2).cast("int")


def place(centre: Column, size: Column, whole: Column) -> Column:
    """Start of a crop of ``size`` about ``centre``, held within the frame."""
    return F.greatest(F.lit(0), F.least((centre - size / 2.0).cast("int"), whole - size)).cast("int")


def _centres(detections: DataFrame) -> DataFrame:
    big = F.get("boxes", F.lit(0))
    return detections.select("clip_id", "time", ((big["x1"] + big["x2"]) / 2.0).alias("cx"), ((big["y1"] + big["y2"]) / 2.0).alias("cy"))


def static_crop(detections: DataFrame, videos: DataFrame, aspect: float = 9 / 16, window: int = 5) -> DataFrame:
    """clip_id, x, y, w, h: upper median of the largest box's centre, averaged over ``window`` frames
    where there are more frames than that. ``videos``: clip_id, width, height."""
    order = Window.partitionBy("clip_id").orderBy("time")
    near = order.rowsBetween(-(window // 2), window // 2)
    own = _centres(detections).withColumn("n", F.count("*").over(Window.partitionBy("clip_id")))
    smooth = lambda c: F.when(F.col("n") > window, F.avg(c).over(near)).otherwise(F.col(c))
    own = own.withColumns({"sx": smooth("cx"), "sy": smooth("cy")})
    mid = own.groupBy("clip_id").agg(upper_median_of(F.collect_list("sx")).alias("mx"), upper_median_of(F.collect_list("sy")).alias("my"))
    w, h = crop_size(F.col("width"), F.col("height"), aspect)
    out = mid.join(videos, "clip_id").withColumns({"w": w, "h": h})
    return out.select("clip_id", place(F.col("mx"), F.col("w"), F.col("width")).alias("x"), place(F.col("my"), F.col("h"), F.col("height")).alias("y"), "w", "h")


def panned(segs: DataFrame, keep: tuple[str, ...] = (), jump: str | None = None) -> DataFrame:
    """clip_id, seg, ``keep``, width, height, cx, cy of rows (clip_id, seg, mx, my, width, height): an
    exponential pan from the frame's centre; where mx is null the view holds. Where the value of column
    ``jump`` is another than in the segment before (and that was not negative), the view moves at once.

    A clip's segments are one array, folded where it stands."""
    fields = ["seg", *keep, "width", "height", "mx", "my"]
    own = segs.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("segs"))
    at = "struct<x:double,y:double,who:int,views:array<struct<x:double,y:double>>>"

    def step(held: Column, s: Column) -> Column:
        x, y = F.coalesce(held["x"], s["width"] / 2), F.coalesce(held["y"], s["height"] / 2)
        who = s[jump].cast("int") if jump else F.lit(-1)
        cut = (held["who"] >= 0) & (held["who"] != who)
        follow = lambda old, new: F.when(new.isNull(), old).when(cut, new).otherwise(old * 0.3 + new * 0.7)
        x, y = follow(x, s["mx"]), follow(y, s["my"])
        view = F.struct(x.alias("x"), y.alias("y"))
        return F.struct(x.alias("x"), y.alias("y"), who.alias("who"), F.concat(held["views"], F.array(view)).alias("views"))

    none = F.struct(
        F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(-1).alias("who"), F.array().cast("array<struct<x:double,y:double>>").alias("views")
    ).cast(at)
    views = F.aggregate("segs", none, step, lambda held: held["views"])
    rows = own.select("clip_id", F.explode(F.arrays_zip(F.col("segs").alias("s"), views.alias("v"))).alias("z"))
    return rows.select("clip_id", *(F.col(f"z.s.{c}").alias(c) for c in ["seg", *keep, "width", "height"]), F.col("z.v.x").alias("cx"), F.col("z.v.y").alias("cy"))


def _dense(detections: DataFrame, step: float) -> DataFrame:
    """(clip_id, seg) for every segment up to a clip's last detection."""
    last = detections.groupBy("clip_id").agg(F.max("time").alias("_t"))
    return last.select("clip_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_t") / step))).alias("seg"))


def dynamic_crops(detections: DataFrame, videos: DataFrame, aspect: float = 9 / 16, step: float = 3.0) -> DataFrame:
    """clip_id, time, x, y, w, h for every ``step`` seconds: the pan follows the upper median centre."""
    seg = _centres(detections).withColumn("seg", F.floor(F.col("time") / step))
    mid = seg.groupBy("clip_id", "seg").agg(upper_median_of(F.collect_list("cx")).alias("mx"), upper_median_of(F.collect_list("cy")).alias("my"))
    own = _dense(detections, step).join(mid, ["clip_id", "seg"], "left").join(videos.select("clip_id", "width", "height"), "clip_id")
    pan = panned(own)
    w, h = crop_size(F.col("width"), F.col("height"), aspect)
    pan = pan.withColumns({"w": w, "h": h})
    return pan.select(
        "clip_id", (F.col("seg") * step).alias("time"), place(F.col("cx"), F.col("w"), F.col("width")).alias("x"), place(F.col("cy"), F.col("h"), F.col("height")).alias("y"), "w", "h"
    )


class _Tracks:
    """Greedy tracks: each box proposes the nearest live track; nearer boxes choose first, a box that gets
    none starts a track. A track not seen for longer than ``stale`` seconds is gone and forgotten, so state
    is the tracks in sight. ``live`` maps a track to its last centre and time, ``count`` is the next track."""

    def __init__(self, stale: float, most: float | None, live: dict[int, tuple[float, float, float]] | None = None, count: int = 0) -> None:
        self.stale, self.most = stale, most
        self.live, self.count = dict(live or {}), count

    def follow(self, now: float, centres: list[tuple[float, float]]) -> list[int]:
        """The tracks of the boxes of a frame, which have these centres."""
        for t in [t for t, v in self.live.items() if not now - v[2] <= self.stale]:
            del self.live[t]
        wish = []
        for c in centres:
            cost, track = math.inf, -1
            for t, v in self.live.items():
                d = math.dist(c, v[:2])
                if d < cost or (d == cost and t < track):
                    cost, track = d, t
            wish.append((cost, track))
        taken, out = set(), [0] * len(centres)
        for k in sorted(range(len(centres)), key=lambda b: wish[b][0]):
            cost, track = wish[k]
            if track < 0 or track in taken or (self.most is not None and cost > self.most):
                track = self.count
                self.count += 1
            self.live[track] = (*centres[k], now)
            taken.add(track)
            out[k] = track
        return out


TRACK_SCHEMA = "clip_id long, time double, box_ord int, track_id int, x1 int, y1 int, x2 int, y2 int"


def assign_tracks(detections: DataFrame, stale: float = 1.0, most: float | None = None) -> DataFrame:
    """clip_id, time, box_ord, track_id and the box. Frames in order of time. Boxes stay columns of Arrow; only
    centres and tracks become Python numbers."""

    arrow = to_arrow_schema(StructType.fromDDL(TRACK_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for batch in batches:
            sizes = batch.column("boxes").value_lengths().fill_null(0).to_numpy()
            boxes = batch.column("boxes").flatten()
            x1, y1, x2, y2 = (boxes.field(c) for c in ("x1", "y1", "x2", "y2"))
            middle = lambda a, b: ((a.to_numpy(zero_copy_only=False) + b.to_numpy(zero_copy_only=False).astype("float64")) / 2).tolist()
            centres, at, tracks = list(zip(middle(x1, x2), middle(y1, y2))), 0, []
            for clip, time, n in zip(batch.column("clip_id").to_pylist(), batch.column("time").to_pylist(), sizes.tolist()):
                if step is None or clip != now:
                    now, step = clip, _Tracks(stale, most)
                tracks += step.follow(time, centres[at : at + n])
                at += n
            frame = np.repeat(np.arange(len(sizes)), sizes)
            order = np.arange(len(frame)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            columns = [batch.column("clip_id").take(pa.array(frame)), batch.column("time").take(pa.array(frame)), pa.array(order), pa.array(tracks, pa.int32()), x1, y1, x2, y2]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return detections.select("clip_id", "time", "boxes").repartition("clip_id").sortWithinPartitions("clip_id", "time").mapInArrow(run, TRACK_SCHEMA)


def resample(signal: DataFrame, windows: DataFrame) -> DataFrame:
    """clip_id, track_id, win_idx, value: a track's samples (sample_idx, score) stretched over a clip's
    ``windows`` (clip_id, n) by linear interpolation, then over the largest value if that is above 0. The
    samples of one track of a clip are one array."""
    samples = F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "score"))), lambda x: x["score"])
    own = signal.groupBy("clip_id", "track_id").agg(samples.alias("s")).join(windows.select("clip_id", "n"), "clip_id")
    last = (F.size("s") - 1).cast("double")

    def value(w: Column) -> Column:
        x = F.when(F.col("n") > 1, w * last / (F.col("n") - 1)).otherwise(F.lit(0.0))
        low = F.least(F.floor(x), F.size("s") - 1).cast("int")
        a, b = F.get("s", low), F.get("s", F.least(low + 1, F.size("s") - 1))
        return a + (b - a) * (x - low)

    own = own.withColumn("v", F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), value))
    own = own.withColumn("top", F.array_max("v")).select("clip_id", "track_id", "top", F.posexplode("v").alias("win_idx", "value"))
    scaled = F.when(F.col("top") > 0, F.col("value") / F.col("top")).otherwise(F.col("value"))
    return own.select("clip_id", "track_id", F.col("win_idx").cast("long").alias("win_idx"), scaled.alias("value"))


def active_speaker(resampled: DataFrame, envelope: DataFrame, silence: float = SILENCE) -> DataFrame:
    """clip_id, win_idx, track_id: the track of largest value times loudness, the first track on ties; -1
    where the envelope (clip_id, win_idx, env) is below ``silence`` or no track has a value. The envelope has a
    window once. Both tables are one, grouped by window: a group, unlike a join, stays where clips are dealt already."""
    heard = envelope.select("clip_id", "win_idx", "env", F.lit(True).alias("_heard"))
    both = resampled.select("clip_id", "win_idx", "track_id", "value").unionByName(heard, allowMissingColumns=True)
    both = both.withColumn("env", F.max("env").over(Window.partitionBy("clip_id", "win_idx")))
    best = F.min_by("track_id", F.when(F.col("track_id").isNotNull(), F.struct(-F.col("value") * F.col("env"), "track_id")))
    own = both.groupBy("clip_id", "win_idx").agg(best.alias("track_id"), F.first("env").alias("env"), F.bool_or("_heard").alias("_heard")).where("_heard")
    return own.select("clip_id", "win_idx", F.coalesce(F.when(F.col("env") >= silence, F.col("track_id")), F.lit(-1)).alias("track_id"))


def segment_speakers(speakers: DataFrame, segments: DataFrame, step: float = 1.0) -> DataFrame:
    """clip_id, seg, track_id: the most frequent speaker of the audio windows of each segment, the first
    seen on ties; a segment without one keeps the speaker before it, -1 at the beginning. ``segments`` (clip_id,
    seg) has each once. Windows name the segments that they lie in and are grouped with them, so that rows stay
    where clips are dealt already."""
    first = F.floor(F.col("seg") * step / AUDIO_WINDOW)
    last = F.floor((F.col("seg") + 1) * step / AUDIO_WINDOW)
    at = F.col("win_idx") * AUDIO_WINDOW / step
    near = F.explode(F.sequence(F.floor(at) - 2, F.floor(at + AUDIO_WINDOW / step) + 1))  # these and some more
    said = speakers.where("track_id >= 0").withColumn("seg", near).where((first <= F.col("win_idx")) & (F.col("win_idx") <= last))
    both = said.select("clip_id", "seg", "track_id", "win_idx").unionByName(segments.select("clip_id", "seg"), allowMissingColumns=True)
    counts = both.groupBy("clip_id", "seg", "track_id").agg(F.count("*").alias("_n"), F.min("win_idx").alias("_first"))
    known = F.col("track_id").isNotNull()  # rows without a track are the segments
    mode = F.min_by("track_id", F.when(known, F.struct(-F.col("_n"), F.col("_first"))))
    own = counts.groupBy("clip_id", "seg").agg(mode.alias("track_id"), F.bool_or(~known).alias("_asked")).where("_asked")
    w = Window.partitionBy("clip_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    return own.select("clip_id", "seg", F.coalesce(F.last("track_id", ignorenulls=True).over(w), F.lit(-1)).alias("track_id"))


def face_centre(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Middle across, two thirds down: the mouth of a face."""
    return (x1 + x2) / 2.0, y1 * 0.35 + y2 * 0.65


def speaker_crops(tracks: DataFrame, speakers: DataFrame, videos: DataFrame, aspect: float = 9 / 16, step: float = 1.0) -> DataFrame:
    """clip_id, time, x, y, w, h, track_id: the crop of each segment at the first box of its speaker.
    ``tracks`` may have face (struct); it is preferred to the box."""
    segs = _dense(tracks, step)
    who = segment_speakers(speakers, segs, step)
    box = F.struct("x1", "y1", "x2", "y2")
    if "face" in tracks.columns:
        box = F.coalesce(F.struct("face.x1", "face.y1", "face.x2", "face.y2"), box)
    seen = tracks.withColumns({"seg": F.floor(F.col("time") / step), "_b": box})
    seen = seen.groupBy("clip_id", "seg", "track_id").agg(F.min_by("_b", F.struct("time", "box_ord")).alias("b"))
    mx, my = face_centre(F.col("b.x1"), F.col("b.y1"), F.col("b.x2"), F.col("b.y2"))
    own = who.join(seen.hint("merge"), ["clip_id", "seg", "track_id"], "left").withColumns({"mx": mx, "my": my}).drop("b")
    own = own.hint("merge").join(videos.select("clip_id", "width", "height"), "clip_id")
    pan = panned(own, ("track_id",), "track_id")
    w, h = crop_size(F.col("width"), F.col("height"), aspect)
    pan = pan.withColumns({"w": w, "h": h})
    return pan.select(
        "clip_id", (F.col("seg") * step).alias("time"), place(F.col("cx"), F.col("w"), F.col("width")).alias("x"),
        place(F.col("cy"), F.col("h"), F.col("height")).alias("y"), "w", "h", "track_id",
    )


def track_gender(tracks: DataFrame) -> DataFrame:
    """clip_id, track_id, gender: the first that is known."""
    return tracks.where("gender is not null").groupBy("clip_id", "track_id").agg(F.min_by("gender", F.struct("time", "box_ord")).alias("gender"))


def keyframe_spans(crops: DataFrame) -> DataFrame:
    """``crops`` with until, dx, dy: to the next keyframe the crop moves evenly, but holds where the track
    changes; behind the last it holds for ever (until is null)."""
    w = Window.partitionBy("clip_id").orderBy("time")
    until, who = F.lead("time").over(w), F.lead("track_id").over(w)
    slope = lambda c: F.when((who == F.col("track_id")) & (until > F.col("time")), (F.lead(c).over(w) - F.col(c)) / (until - F.col("time"))).otherwise(F.lit(0.0))
    return crops.select("*", until.alias("until"), slope("x").alias("dx"), slope("y").alias("dy"))


def crop_at(spans: DataFrame, times: DataFrame, width: float = 600.0) -> DataFrame:
    """clip_id, t, x, y of the crop at query ``times`` (clip_id, t); the first keyframe also holds before it,
    from time 0 on.

    An as-of join: keyframes and queries are one series, along which the last keyframe is carried. Stretches
    of ``width`` seconds are ordered apart, so no row is made for time that passes and no task holds a clip.
    """
    frame = F.struct("time", "x", "y", "dx", "dy")
    keys = spans.select("clip_id", F.col("time").alias("t"), F.lit(0).alias("_q"), frame.alias("_k"))
    none = F.lit(None).cast(keys.schema["_k"].dataType)
    asked = times.select("clip_id", F.col("t").cast("double").alias("t"), F.lit(1).alias("_q"), none.alias("_k"))
    series = running_max(keys.unionByName(asked), ["clip_id"], ["t", "_q"], F.floor(F.col("t") / width), F.col("_k"), "_at", True)
    first = spans.groupBy("clip_id").agg(F.min(frame).alias("_first"))
    hit = series.where("_q = 1").hint("merge").join(first, "clip_id").where(F.col("t") >= F.least(F.lit(0.0), F.col("_first.time")))
    hit = hit.select("clip_id", "t", F.coalesce("_at", "_first").alias("k"))
    past = F.greatest(F.lit(0.0), F.col("t") - F.col("k.time"))
    return hit.select("clip_id", "t", (F.col("k.x") + F.col("k.dx") * past).alias("x"), (F.col("k.y") + F.col("k.dy") * past).alias("y"))


def box_overlap(a: Column, b: Column) -> Column:
    """Shared area over the area of ``a`` (one pixel at least)."""
    zero = F.lit(0)
    across = F.greatest(zero, F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    down = F.greatest(zero, F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    return across * down / F.greatest(F.lit(1), (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]))


def median_box(detections: DataFrame) -> DataFrame:
    """clip_id, x1, y1, x2, y2: the upper median of each edge of the largest box."""
    big = F.get("boxes", F.lit(0))
    rows = detections.where(F.size("boxes") > 0).select("clip_id", *(big[e].alias(e) for e in ("x1", "y1", "x2", "y2")))
    return rows.groupBy("clip_id").agg(*(upper_median_of(F.collect_list(e)).alias(e) for e in ("x1", "y1", "x2", "y2")))


def split_layout(detections: DataFrame, videos: DataFrame, out_w: int = 1080, out_h: int = 1920, share: float = 0.4, pad: float = 0.3) -> DataFrame:
    """clip_id and the crops of a layout with the person above and the whole scene below: face_x, face_y,
    face_w, face_h, scene_x, scene_y, scene_w, scene_h.

    The person's median box is padded to the aspect of the upper part, a fifth of the frame wide at least;
    without detections the lower left of the frame stands for the person. All sides are even.
    """
    top = int(out_h * share) // 2 * 2
    bottom = (out_h - top) // 2 * 2
    face, scene = out_w / (out_h - bottom), out_w / bottom
    edge = {"x1": F.lit(0), "y1": F.floor(F.col("height") / 2), "x2": F.floor(F.col("width") / 3), "y2": F.col("height")}
    own = videos.select("clip_id", "width", "height").join(median_box(detections), "clip_id", "left")
    own = own.withColumns({k: F.coalesce(F.col(k), v) for k, v in edge.items()})
    wide, high = F.greatest(F.col("x2") - F.col("x1"), F.lit(1)) * (1 + pad), F.greatest(F.col("y2") - F.col("y1"), F.lit(1)) * (1 + pad)
    own = own.withColumns({"_w": F.when(wide / high > face, wide.cast("int")), "_h": high.cast("int")})
    own = own.withColumns({"_w": F.coalesce("_w", (F.col("_h") * face).cast("int")), "_h": F.when(F.col("_w").isNotNull(), (F.col("_w") / face).cast("int")).otherwise(F.col("_h"))})
    least = (F.col("width") * 0.2).cast("int")
    own = own.withColumns({"_h": F.when(F.col("_w") < least, (least / face).cast("int")).otherwise(F.col("_h")), "_w": F.greatest("_w", least)})
    even = lambda c, most: F.greatest(F.lit(2), (F.least(c, most) - F.least(c, most) % 2)).cast("int")
    own = own.withColumns({"face_w": even(F.col("_w"), F.col("width")), "face_h": even(F.col("_h"), F.col("height"))})
    sw, sh = crop_size(F.col("width"), F.col("height"), scene)
    own = own.withColumns({"scene_w": sw, "scene_h": sh})
    return own.select(
        "clip_id",
        place((F.col("x1") + F.col("x2")) / 2.0, F.col("face_w"), F.col("width")).alias("face_x"),
        place((F.col("y1") + F.col("y2")) / 2.0, F.col("face_h"), F.col("height")).alias("face_y"),
        "face_w",
        "face_h",
        F.floor((F.col("width") - F.col("scene_w")) / 2).cast("int").alias("scene_x"),
        F.floor((F.col("height") - F.col("scene_h")) / 2).cast("int").alias("scene_y"),
        "scene_w",
        "scene_h",
    )
