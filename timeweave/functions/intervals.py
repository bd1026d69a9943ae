"""Interval joins and merges on time-stamped rows.

A bare range predicate plans as a nested loop. Here the time line is cut into bins, bins join with the keys,
and the exact predicate is checked behind. An interval of up to MOST_BINS narrow bins has a row for each. A
longer one stands at a level of wider bins, STEP times as wide from level to level, of which it touches
five at most, be it an hour or a century. The other side's rows look it up there; they are only made
for levels that occur. A pair that shares several bins is kept in the first one only.

``gathered`` is for intervals that want what touches them as one array: it packs the other side instead, and
needs no shuffle of pairs. Pairs are found in arrays of a batch of packs, not one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

from timeweave.functions.arrays import Fields, list_of, places, sizes_of, starts_of
from timeweave.functions.stored import stored

MOST_BINS, STEP, MOST_LEVELS = 64, 4, 24
#: Pairs that a worker looks at together, unless one stretch has more.
MOST_PAIRS = 1 << 19


def level_of(lo: Column, hi: Column, width: float) -> Column:
    """0 for intervals of up to MOST_BINS bins and for those that end before they start, else the lowest level
    of whose bins the interval is no longer than STEP."""
    length = (hi - lo) / width
    level = F.greatest(F.lit(1), F.least(F.ceil(F.log(float(STEP), length / MOST_BINS)), F.lit(MOST_LEVELS)))
    return F.when(length > MOST_BINS, level).otherwise(F.lit(0)).cast("int")


def _bin_width(level: Column, width: float) -> Column:
    return F.when(level == 0, F.lit(float(width))).otherwise(F.pow(F.lit(float(STEP)), level - 1) * (MOST_BINS * width))


def _placed(df: DataFrame, lo: str, hi: str, places: Column, width: float) -> DataFrame:
    """A row for each (side, level) of ``places`` and each bin of that level that the interval touches."""
    own = df.withColumn("_x", F.explode(places))
    wide = _bin_width(F.col("_x.level"), width)
    first, last = F.floor(F.col(lo) / wide), F.floor(F.col(hi) / wide)
    own = own.withColumns({"_first": first, "_bin": F.explode(F.sequence(first, F.greatest(first, last)))})
    return own.withColumns({"_side": F.col("_x.side"), "_level": F.col("_x.level")}).drop("_x")


def overlap_join(
    left: DataFrame, right: DataFrame, keys: list[str], l_range: tuple[str, str], r_range: tuple[str, str],
    predicate: Column, width: float, how: str = "inner", long: tuple[str, ...] = ("left", "right"),
) -> DataFrame:
    """Join rows whose closed ranges touch and for which ``predicate`` holds.

    ``l_range`` and ``r_range`` name the columns of the ranges, widened already by any tolerance; column
    names other than ``keys`` must differ between the sides. ``how`` is inner or left_anti; rows of the left
    side that hold a null are always kept by left_anti. ``width`` is that of the narrowest bins. Which levels
    the long intervals of each side have, a handful of numbers, is found by a subquery; a side that is asked
    is written once for that. A side left out of ``long``, such as words, is not asked: its rows are right
    at any length, but a long one has all its bins.
    """
    left = stored(left, "left") if "left" in long else left
    right = stored(right, "right") if "right" in long else right
    level = lambda side, lo, hi: level_of(F.col(lo), F.col(hi), width) if side in long else F.lit(0)
    l, r = left.withColumn("_own", level("left", *l_range)), right.withColumn("_own", level("right", *r_range))
    none = F.array().cast("array<int>")
    above = lambda side, df: df.where("_own > 0").agg(F.collect_set("_own")).scalar() if side in long else none
    at = lambda side, level: F.struct(F.lit(side).alias("side"), level.alias("level"))
    # a pair meets where the longer interval stands: side 0 is where left ones do, side 1 where right ones do
    own, seen = F.col("_own"), F.col("_seen")
    l, r = l.withColumn("_seen", above("right", r)), r.withColumn("_seen", above("left", l))
    l_more = F.transform(F.filter(seen, lambda x: x > own), lambda x: at(1, x))
    l_places = F.when(F.size(seen) == 0, F.array(at(0, own))).otherwise(F.concat(F.array(at(0, own)), l_more))
    r_own = F.array(F.when(own > 0, at(1, own)).otherwise(at(0, own)))
    r_more = F.transform(F.filter(seen, lambda x: x >= own), lambda x: at(0, x))
    r_places = F.when(F.size(seen) == 0, r_own).otherwise(F.concat(r_own, r_more))
    l = _placed(l, *l_range, l_places, width).drop("_own", "_seen").withColumnRenamed("_first", "_lf")
    r = _placed(r, *r_range, r_places, width).drop("_own", "_seen").withColumnRenamed("_first", "_rf")
    pairs = l.join(r, [*keys, "_side", "_level", "_bin"]).where((F.col("_bin") == F.greatest("_lf", "_rf")) & predicate)
    if how == "inner":
        return pairs.drop("_side", "_level", "_bin", "_lf", "_rf")
    if how == "left_anti":
        return left.join(pairs.select(*left.columns).distinct(), left.columns, "left_anti")
    raise ValueError(how)


def _in_order(item: pa.StructArray, sizes: np.ndarray) -> pa.StructArray:
    """Items sorted within groups of these sizes by their numbers, the first field first."""
    names = [f.name for f in item.type if pa.types.is_integer(f.type) or pa.types.is_floating(f.type)]
    group, x = np.repeat(np.arange(len(sizes)), sizes), Fields(item)
    first = x[names[0]]
    if ((first[1:] > first[:-1]) | (group[1:] != group[:-1])).all():
        return item
    return item.take(pa.array(np.lexsort([*(x[c] for c in reversed(names)), group])))


def _touching(
    rows: pa.Array, packs: pa.Array, l_range: tuple[str, str], ends: tuple[str, str], holds: Callable, made: Callable | None, unpacked: Callable | None
) -> Iterator[pa.Array]:
    """For the rows of each stretch the items they touch, as arrays of arrays, some stretches at a time."""
    rows_at, packs_at = starts_of(sizes_of(rows)), starts_of(sizes_of(packs))
    row, item = rows.flatten(), packs.flatten()
    n, item = unpacked(item) if unpacked else (np.ones(len(item), np.int64), item)
    items_at = starts_of(n)[packs_at]
    item = _in_order(item, np.diff(items_at))
    clip, entry = Fields(row), Fields(item)
    low, high = np.fmin(entry[ends[0]], entry[ends[1]]), np.fmax(entry[ends[0]], entry[ends[1]])
    first, last = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    lo, hi = clip[l_range[0]], clip[l_range[1]]
    for g in range(len(rows)):  # what ends before a row and what starts behind it is never looked at
        own, i, j = slice(rows_at[g], rows_at[g + 1]), items_at[g], items_at[g + 1]
        first[own] = i + np.searchsorted(np.fmax.accumulate(high[i:j]), lo[own], "left")
        last[own] = i + np.searchsorted(np.fmin.accumulate(low[i:j][::-1])[::-1], hi[own], "right")
    sizes = np.maximum(last - first, 0)
    before = starts_of(sizes)
    g = 0
    while g < len(rows):
        to = max(int(np.searchsorted(before[rows_at], before[rows_at[g]] + MOST_PAIRS, "right")) - 1, g + 1)
        a, b = int(rows_at[g]), int(rows_at[to])
        at, of = places(first[a:b], sizes[a:b]), np.repeat(np.arange(a, b), sizes[a:b])
        good = np.asarray(holds(Fields(row, of), Fields(item, at)), bool)
        at, of = at[good], of[good]
        own = np.bincount(of - a, minlength=b - a)
        found = item.take(pa.array(at)) if made is None else made(Fields(row, of), item, at, np.arange(len(of)) - np.repeat(starts_of(own)[:-1], own))
        yield list_of(list_of(found, own), np.diff(rows_at[g : to + 1]))
        g = to


def gathered(
    left: DataFrame, right: DataFrame, keys: list[str], l_range: tuple[str, str], r_range: tuple[str, str],
    item: Column, holds: Callable, name: str, width: float = 30.0, made: tuple[Callable | None, DataType] | None = None,
    unpacked: Callable | None = None, ends: tuple[str, str] | None = None,
) -> DataFrame:
    """``left`` with array ``name``: the ``item`` of each row of ``right`` whose closed range touches that of the
    left row and for which ``holds(left row, item)``, in order of the items, which begin with the start of their
    range. The array is empty where there are none. ``left`` is written once, so it should be narrow.

    ``holds`` gets the fields of many pairs as NumPy arrays, NaN for null, and uses their operators only. ``made`` is a
    function of the left rows, the array of items, places in it and counts from 0 that gives an Arrow array of
    what stands for these items, and the type of its elements. Where a row of ``right`` is many items, such as a line of
    words, ``unpacked`` makes of an Arrow array of them how many items each is, and the items. ``ends`` names the fields of
    an item that are its range, if not those of ``r_range``.

    What a stretch of time may ask for is packed. A left row stands in one stretch, at the level
    that is long enough for it; the right ones are dealt to every stretch that may ask for them, mostly one. Rows, packs
    and stretches stay where their keys are: where both sides come dealt by the keys, nothing is shuffled, else
    the right ones are, once. Pairs never are. A row holds a stretch, a few times as long as its longest interval.
    """
    lo, hi = l_range
    left = stored(left, "left")
    longest = lambda level: F.pow(F.lit(float(STEP)), level) * (MOST_BINS * width * 1.001)
    stretch = lambda t, level: F.floor(t / (STEP * longest(level)) + 0.5)
    own = left.withColumn("_level", level_of(F.col(lo), F.col(hi), width))
    levels = own.agg(F.collect_set("_level")).scalar()
    # the number of parts is named: what a part is made into is many times its size, so small parts should not become one
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = own.withColumn("_stretch", stretch(F.col(lo), F.col("_level"))).repartition(parts, *keys)
    own = own.groupBy(*keys, "_level", "_stretch").agg(F.collect_list(F.struct(*(c for c in left.columns if c not in keys))).alias("_rows"))

    span = [F.col(c).cast("double") for c in r_range]
    packs = right.select(*keys, F.least(*span).alias("_lo"), F.greatest(*span).alias("_hi"), item.alias("_item"))
    packs = packs.withColumn("_level2", F.explode(levels))
    first, last = stretch(F.col("_lo") - longest(F.col("_level2")), F.col("_level2")), stretch(F.col("_hi"), F.col("_level2"))
    # outer, as below: else the range of an item, and so its words, would be found for a filter first
    packs = packs.withColumn("_stretch2", F.explode_outer(F.sequence(first, last))).where("_stretch2 is not null")
    packs = packs.groupBy(*keys, "_level2", "_stretch2").agg(F.collect_list("_item").alias("_packs"))

    # joined on the keys alone, by which both sides may be dealt already; the rest is no equality of columns
    same = (F.col("_level") - F.col("_level2") == 0) & (F.col("_stretch") - F.col("_stretch2") == 0)
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    met = own.alias("l").join(packs.hint("merge").alias("r"), [*on, same], "left").select(*(F.col(f"l.{k}").alias(k) for k in keys), "_rows", "_packs")

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for rows, near in batches:
            yield from _touching(rows, near, l_range, ends or r_range, holds, made and made[0], unpacked)

    kind = made[1] if made else right.select(item.alias("i")).schema["i"].dataType
    met = met.withColumn("_found", F.arrow_udf(run, ArrayType(ArrayType(kind)))("_rows", "_packs"))
    # outer, as no list of rows is empty: else the optimizer asks for its size first and so finds everything twice
    rows = met.select(*keys, F.explode_outer(F.arrays_zip("_rows", "_found")).alias("_f"))
    return rows.select(*(F.col(c) if c in keys else F.col(f"_f._rows.{c}").alias(c) for c in left.columns), F.col("_f._found").alias(name))


def gathered_in_place(
    left: DataFrame, right: DataFrame, keys: list[str], l_range: tuple[str, str], r_range: tuple[str, str],
    items: Column, holds: Callable[[Column, Column], Column], name: str, width: float = 30.0,
) -> DataFrame:
    """As ``gathered``, found by Spark's own expressions, and slower: but the rows stay dealt by the keys, while a Python
    function's are not known to be, so that what is grouped by the keys behind it would be shuffled with all its items.

    ``items`` is the array of a right row, such as the words of a line; rows that touch the left one are looked through."""
    lo, hi = l_range
    left = stored(left, "left")
    longest = lambda level: F.pow(F.lit(float(STEP)), level) * (MOST_BINS * width * 1.001)
    stretch = lambda t, level: F.floor(t / (STEP * longest(level)) + 0.5)
    own = left.withColumn("_level", level_of(F.col(lo), F.col(hi), width))
    levels = own.agg(F.collect_set("_level")).scalar()
    own = own.withColumn("_stretch", stretch(F.col(lo), F.col("_level"))).repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    own = own.groupBy(*keys, "_level", "_stretch").agg(F.collect_list(F.struct(*(c for c in left.columns if c not in keys))).alias("_rows"))

    span = [F.col(c).cast("double") for c in r_range]
    packs = right.select(*keys, F.least(*span).alias("_lo"), F.greatest(*span).alias("_hi"), items.alias("_items"))
    packs = packs.withColumn("_level2", F.explode(levels))
    first, last = stretch(F.col("_lo") - longest(F.col("_level2")), F.col("_level2")), stretch(F.col("_hi"), F.col("_level2"))
    packs = packs.withColumn("_stretch2", F.explode_outer(F.sequence(first, last))).where("_stretch2 is not null")
    packs = packs.groupBy(*keys, "_level2", "_stretch2").agg(F.collect_list(F.struct("_lo", "_hi", "_items")).alias("_packs"))

    # joined on the keys alone, by which both sides may be dealt already; the rest is no equality of columns
    same = (F.col("_level") - F.col("_level2") == 0) & (F.col("_stretch") - F.col("_stretch2") == 0)
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    met = own.alias("l").join(packs.hint("merge").alias("r"), [*on, same], "left").select(*(F.col(f"l.{k}").alias(k) for k in keys), "_rows", "_packs")

    def items(row: Column) -> Column:
        near = F.filter("_packs", lambda p: (p["_hi"] >= row[lo]) & (p["_lo"] <= row[hi]))
        return F.sort_array(F.filter(F.flatten(F.transform(near, lambda p: p["_items"])), lambda x: holds(row, x)))

    none = F.array().cast(met.select(F.flatten(F.transform("_packs", lambda p: p["_items"])).alias("i")).schema["i"].dataType)
    found = F.transform("_rows", lambda row: F.struct(row.alias("row"), F.coalesce(items(row), none).alias(name)))
    # outer, as no list of rows is empty: else the optimizer asks for its size first and so finds everything twice
    rows = met.select(*keys, F.explode_outer(found).alias("_f"))
    return rows.select(*(F.col(c) if c in keys else F.col(f"_f.row.{c}").alias(c) for c in left.columns), F.col(f"_f.{name}").alias(name))


def islands(df: DataFrame, keys: list[str], order: list[str], start: str, end: str, gap: float, running: bool) -> DataFrame:
    """Add ``island``: it rises where a row starts more than ``gap`` after the latest end before it
    (``running``) or after the row before it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)) if running else F.lag(end).over(w)
    fresh = F.when(before.isNull() | (F.col(start) - before > gap), 1).otherwise(0)
    return df.withColumn("_f", fresh).withColumn("island", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_f")


def running_max(df: DataFrame, keys: list[str], order: list[str], chunk: Column, value: Column, name: str, inclusive: bool) -> DataFrame:
    """Add ``name``: the greatest ``value`` of a key's rows before this one, or up to it, in ``order``.

    ``chunk`` is a number that never falls along the order. Rows are ordered within a chunk only, and chunks,
    of which there are far fewer, within a key: no task sorts all rows of a key. Nulls are passed over.
    """
    own = df.withColumns({"_chunk": chunk, "_value": value})
    past = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = own.groupBy(*keys, "_chunk").agg(F.max("_value").alias("_top"))
    earlier = chunks.withColumn("_before", F.max("_top").over(past)).drop("_top")
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = own.withColumn("_own", F.max("_value").over(within)).join(earlier.hint("merge"), [*keys, "_chunk"])
    return out.withColumn(name, F.greatest("_own", "_before")).drop("_chunk", "_value", "_own", "_before")


def overlap_islands(df: DataFrame, keys: list[str], order: list[str], start: str, end: str, width: float, name: str = "island") -> DataFrame:
    """Add ``name``: the start and order of the first row of each island; rows of different islands of a
    key never overlap. ``order`` begins with ``start``; chunks of ``width`` seconds are ordered apart. ``df`` is
    written once, as it is read four times."""
    df = stored(df, "spans")
    chunk = F.floor(F.col(start) / width)
    own = running_max(df, keys, order, chunk, F.col(end), "_reach", False)
    fresh = F.when(F.col("_reach").isNull() | (F.col(start) >= F.col("_reach")), F.struct(*order))
    return running_max(own, keys, order, chunk, fresh, name, True).drop("_reach")
