"""Registered queries of files, caches, streams and variants against their DuckDB twins on the smallest tables."""

from __future__ import annotations

import math
import os
from datetime import datetime, timedelta

import pytest

import __spark_entry__
from timeweave import round_trip_queries, variant_queries

SF = "/root/testdata/sf0.001"
ORACLES = __spark_entry__.oracle_sql()
NAMES = [n for m in (round_trip_queries, variant_queries) for n, q in vars(m).items() if n in ORACLES and getattr(q, "__module__", "") == m.__name__]


def squares(n: int, total: int) -> list[int]:
    """n numbers below 1000 whose squares make ``total``; n - 4 of them are near the mean."""
    own = [math.isqrt(total // n)] * (n - 4)
    left = total - sum(a * a for a in own)
    for a in range(min(999, math.isqrt(left)), -1, -1):
        for b in range(min(a, math.isqrt(left - a * a)), -1, -1):
            rest = left - a * a - b * b
            for c in range(min(b, math.isqrt(rest)), -1, -1):
                d = math.isqrt(rest - c * c)
                if d > c:
                    break
                if c * c + d * d == rest:
                    return [*own, a, b, c, d]
    raise ValueError(total)


NEAR_TIES = [squares(37, 10491038), squares(41, 10917700), squares(57, 41208361), squares(59, 15584344)]


@pytest.fixture(scope="module")
def db():
    import duckdb

    base = duckdb.connect()
    for table in sorted(os.listdir(SF)):
        base.execute(f"create view {table.removesuffix('.parquet')} as select * from read_parquet('{SF}/{table}{'/*' if os.path.isdir(f'{SF}/{table}') else ''}')")
    return base


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_twin(spark, db, name):
    got = __spark_entry__.queries()[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = db.execute(f"select {columns} from ({ORACLES[name]})").fetchall()
    rows = list(map(tuple, got.collect()))
    assert sorted(map(repr, rows)) == sorted(map(repr, want)) and rows


def both_ways(spark, name, rows, path):
    """Rows of a query over events, and of its SQL."""
    import duckdb

    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").coalesce(1).write.parquet(f"{path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{path}/events.parquet/*.parquet'")
    got = __spark_entry__.queries()[name](spark, str(path))
    want = db.execute(f"select {', '.join(got.columns)} from ({ORACLES[name]})").fetchall()
    return sorted(map(tuple, got.collect())), sorted(want)


@pytest.mark.parametrize("name", ["t1_live_rms", "t1_late_rows"])
def test_live_windows_round_milliseconds_as_their_twin(spark, tmp_path, name):
    """Times just before a minute, one of them before a stretch of event time too, and late rows at the watermark."""
    ends = [datetime(2024, 1, d, 12, 5) for d in (2, 9, 17, 25)] + [datetime(2024, 1, 8), datetime(1969, 12, 31, 23, 50)]
    micros = [-501, -500, -499, -1, 0, 499, 500]
    times = [t + timedelta(microseconds=u) for t in ends for u in micros]
    times += [t + timedelta(seconds=s, microseconds=u) for t in ends for s in (-60, -5, 5, 65) for u in micros]
    got, want = both_ways(spark, name, [(i, t, i % 3) for i, t in enumerate(times, 1)], tmp_path)
    assert got == want and want


def test_live_rms_rounds_as_its_twin(spark, tmp_path):
    """Means of 37, 41, 57 and 59 squares whose roots lie so near to a tie that the digits and the scaled number round apart."""
    day, rows, k = datetime(2024, 1, 2), [], 0
    for user, amps in enumerate(NEAR_TIES):
        for amp in amps:
            k += 1 + ((1000 * (k + 1) + amp) % 7 == 0)  # no late rows
            rows.append((1000 * k + amp, day + timedelta(seconds=k % 60), user))
    got, want = both_ways(spark, "t1_live_rms", rows, tmp_path)
    assert got == want and sorted(r[3] for r in want) == [37, 41, 57, 59]
