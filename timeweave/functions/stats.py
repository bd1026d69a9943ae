"""Order statistics with the rules the operators need; Spark's own differ for even counts and ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_median_of(values: Column) -> Column:
    """The element at n div 2 of the sorted array (the upper one of two), which holds no nulls. sort_array orders
    plain values by code that is compiled; array_sort would call a comparison for each pair."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def ranked_values(df: DataFrame, keys: list[str], value: str, percent: float, accuracy: int = 10_000) -> DataFrame:
    """Per key: n, the upper median, and the nearest-rank value ``sorted[min(int(n * percent / 100), n - 1)]``.
    Rows without a value do not count; a key without any is left out.

    No series is sorted whole. A quantile sketch gives each rank a narrow range of values, counts say whether the
    rank lies below, in or above it, and the rank is looked up among the distinct values of that one part. The
    sketch only decides how many values are left to sort, some ``8 / accuracy`` of the key's; the result is exact
    whatever it says. ``df`` is read three times.
    """
    v = F.col(value)
    own = df.select(*keys, value).where(v.isNotNull())
    shares = {"median": 0.5, "high": percent / 100}
    margin = 4 / accuracy
    marks = F.array(*(F.lit(min(max(s + d, 0.0), 1.0)) for s in shares.values() for d in (-margin, margin)))
    sketch = own.groupBy(*keys).agg(F.percentile_approx(value, marks, accuracy).alias("_m"))
    ends = {name: (F.col("_m")[2 * i], F.col("_m")[2 * i + 1]) for i, name in enumerate(shares)}
    part = {name: F.when(v < low, 0).when(v > high, 2).otherwise(1) for name, (low, high) in ends.items()}
    sums = [F.count_if(part[name] <= k).alias(f"_{name}{k}") for name in shares for k in (0, 1)]
    counted = own.join(sketch, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.first("_m").alias("_m"), *sums)
    n = F.col("n")
    at = {"median": F.floor(n / 2), "high": F.least(F.floor(n * percent / 100), n - 1)}
    looked_up = []
    for name, i in at.items():
        below, upto = F.col(f"_{name}0"), F.col(f"_{name}1")
        side = F.when(i < below, 0).when(i < upto, 1).otherwise(2)
        before = F.when(i < below, 0).when(i < upto, below).otherwise(upto)
        looked_up.append(F.struct(F.lit(name).alias("name"), side.alias("side"), (i - before).alias("at")))
    chosen = counted.select(*keys, "n", "_m", F.struct(*(x.alias(name) for x, name in zip(looked_up, at))).alias("_c"))
    hits = F.array(*(F.when(part[name] == F.col(f"_c.{name}.side"), F.col(f"_c.{name}")) for name in at))
    left = own.join(chosen, keys).select(*keys, "n", value, F.explode(F.array_compact(hits)).alias("_h"))
    distinct = left.groupBy(*keys, "n", "_h.name", "_h.at", value).agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*keys, "name").orderBy(value))
    found = distinct.withColumn("_u", upto).where((F.col("_u") - F.col("_k") <= F.col("at")) & (F.col("at") < F.col("_u")))
    return found.groupBy(*keys).agg(F.first("n").alias("n"), *(F.max(F.when(F.col("name") == name, v)).alias(name) for name in at))


def first_seen_mode(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Per key the most frequent value; of equally frequent ones that seen first."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col("_first"))).alias(value))
