"""Audio energy: RMS windows, spikes against a local baseline, and their clusters.

Local medians need neighbouring windows only, so long series are cut in blocks with a halo of
``radius`` windows on both sides and no task orders a whole series for them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeweave.functions.intervals import islands, overlap_join
from timeweave.functions.stats import ranked_values, upper_median_of
from timeweave.functions.stored import stored

BLOCK = 10_000


@dataclass(frozen=True)
class EnergyRules:
    """window and gaps in seconds; the rest are ratios and an RMS floor."""

    window: float = 0.5
    radius: int = 20
    spike: float = 2.0
    spike_outside: float = 3.0
    high_percent: float = 80.0
    high_over_median: float = 1.5
    floor: float = 50.0
    merge_gap: float = 2.0
    speech_gap: float = 0.45
    min_speech: float = 0.12


def rms_windows(samples: DataFrame, per_window: int) -> DataFrame:
    """video_id, win_idx, rms of (video_id, sample_idx, amp); a window that is not full is left out."""
    own = samples.withColumns({"win_idx": F.floor(F.col("sample_idx") / per_window), "_a": F.col("amp").cast("double")})
    out = own.groupBy("video_id", "win_idx").agg(F.sqrt(F.sum(F.col("_a") * F.col("_a")) / per_window).alias("rms"), F.count("*").alias("_n"))
    return out.where(F.col("_n") == per_window).drop("_n")


def max_normalized(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """``value`` over its largest per key, unchanged where that is not above 0. A join of one row a key,
    so that no key has to fit in a task."""
    top = df.groupBy(*keys).agg(F.max(value).alias("_top"))
    return df.join(top, keys).withColumn(out, F.when(F.col("_top") > 0, F.col(value) / F.col("_top")).otherwise(F.col(value))).drop("_top")


def speech_regions(segs: DataFrame, rules: EnergyRules = EnergyRules()) -> DataFrame:
    """video_id, region_id, start, end: segments merged over gaps up to speech_gap, short ones dropped."""
    usable = segs.where("end > start").select("video_id", "seg_id", "start", "end")
    marked = islands(usable, ["video_id"], ["start", "seg_id"], "start", "end", rules.speech_gap, running=True)
    merged = marked.groupBy("video_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    merged = merged.where(F.col("end") - F.col("start") >= rules.min_speech)
    w = Window.partitionBy("video_id").orderBy("island")
    return merged.select("video_id", F.row_number().over(w).alias("region_id"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


def in_speech(windows: DataFrame, regions: DataFrame, width: float = 30.0) -> DataFrame:
    """``windows`` (with t) and in_speech: t lies in a region, ends included. Regions are disjoint."""
    r = regions.select("video_id", F.col("start").alias("_rs"), F.col("end").alias("_re"))
    w = windows.withColumns({"_t0": F.col("t"), "_t1": F.col("t")})
    hits = overlap_join(w, r, ["video_id"], ("_t0", "_t1"), ("_rs", "_re"), (F.col("t") >= F.col("_rs")) & (F.col("t") <= F.col("_re")), width, long=("right",))
    hit = hits.select("video_id", "win_idx").distinct().withColumn("_hit", F.lit(True))
    return windows.join(hit, ["video_id", "win_idx"], "left").withColumn("in_speech", F.coalesce("_hit", F.lit(False))).drop("_hit")


def local_medians(windows: DataFrame, radius: int) -> DataFrame:
    """``windows`` and local: the upper median of the windows within ``radius`` places."""
    last = F.floor((F.col("win_idx") + radius) / BLOCK)
    first = F.floor(F.greatest(F.col("win_idx") - radius, F.lit(0)) / BLOCK)
    haloed = windows.withColumn("_block", F.explode(F.sequence(first, last)))
    w = Window.partitionBy("video_id", "_block").orderBy("win_idx").rowsBetween(-radius, radius)
    out = haloed.withColumn("local", upper_median_of(F.collect_list("rms").over(w)))
    return out.where(F.col("_block") == F.floor(F.col("win_idx") / BLOCK)).drop("_block")


def energy_events(windows: DataFrame, regions: DataFrame, rules: EnergyRules = EnergyRules()) -> DataFrame:
    """video_id, win_idx, time, rms, kind (spike or high), in_speech of (video_id, win_idx, t, rms).

    Videos with fewer than three windows or a median below the floor give nothing; so do windows below
    the floor. win_idx counts without gaps from 0. Windows are written once, and so are those above the floor
    with their local medians, as ranks and regions read them several times.
    """
    windows = stored(windows.select("video_id", "win_idx", "t", "rms"), "windows")
    stats = ranked_values(windows, ["video_id"], "rms", rules.high_percent)
    stats = stats.where((F.col("n") >= 3) & (F.col("median") >= rules.floor))
    loud = local_medians(windows, rules.radius).join(stats, "video_id").where(F.col("rms") >= rules.floor)
    own = in_speech(stored(loud, "loud"), regions)
    base = F.greatest(F.col("local"), F.col("median") * 0.5)
    spike = F.col("rms") > base * F.when(F.col("in_speech"), rules.spike).otherwise(rules.spike_outside)
    high = F.col("in_speech") & (F.col("rms") >= F.col("high")) & (F.col("rms") > F.col("median") * rules.high_over_median)
    kind = F.when(spike, "spike").when(high, "high")
    return own.withColumn("kind", kind).where("kind is not null").select("video_id", "win_idx", F.col("t").alias("time"), "rms", "kind", "in_speech")


def energy_moments(events: DataFrame, rules: EnergyRules = EnergyRules()) -> DataFrame:
    """video_id, moment_id, start, end, peak_rms, kind, in_speech: events whose gaps are within merge_gap."""
    spans = events.withColumn("_end", F.col("time") + rules.window)
    marked = islands(spans, ["video_id"], ["time", "win_idx"], "time", "_end", rules.merge_gap, running=False)
    return marked.groupBy("video_id", F.col("island").alias("moment_id")).agg(
        F.min("time").alias("start"),
        F.max("_end").alias("end"),
        F.max("rms").alias("peak_rms"),
        F.when(F.bool_or(F.col("kind") == "spike"), "spike").otherwise("high").alias("kind"),
        F.bool_and("in_speech").alias("in_speech"),
    )


def moment_counts(moments: DataFrame) -> DataFrame:
    """kind, in_speech, n and the largest peak_rms of all moments."""
    return moments.groupBy("kind", "in_speech").agg(F.count("*").alias("n"), F.max("peak_rms").alias("peak_rms"))
