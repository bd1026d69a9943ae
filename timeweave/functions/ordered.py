"""Ordered folds: rules in which each step depends on what earlier steps kept.

``blocked_fold`` takes keys of any length: rows are dealt by ranges of key and order and cut into blocks;
every block is run from the state in which a key begins, and those whose block before left another state
are run again from that one, until none is left. A rule that forgets (the last few texts, an open merge)
settles after a round or two.

``scan_groups`` takes groups that are small by their nature, many to a task, and keeps some rows of each.
``ordered_scan`` streams a key's rows through a step object; its state is all that is held.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from timeweave.functions.stored import stored

BATCH = 4096
BLOCK_ROWS = 4096


class Step(Protocol):
    """State of one key: ``add`` takes a row and gives rows that are final, ``end`` gives the rest."""

    def add(self, row: dict[str, Any]) -> Iterable[dict[str, Any]]: ...

    def end(self) -> Iterable[dict[str, Any]]: ...


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], step: Callable[[], Step], schema: StructType | str) -> DataFrame:
    """Stream the rows of each key, in a total order, through ``step()``; rows of ``schema`` come out."""
    out_type = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out_type)
        now, state, rows = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if state is None or key != now:
                    if state is not None:
                        rows.extend(state.end())
                    now, state = key, step()
                rows.extend(state.add(row))
                if len(rows) >= BATCH:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows = []
        if state is not None:
            rows.extend(state.end())
        yield pa.RecordBatch.from_pylist(rows, arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out_type)


class Fold(Protocol):
    """A rule over rows in order: ``run`` takes the state before some rows and their columns as lists, and
    gives the state behind them and a list for each column decided. States are JSON values."""

    def begin(self) -> Any: ...

    def run(self, state: Any, *columns: list) -> tuple[Any, tuple[list, ...]]: ...


def _borders(keys: list[list], most: int) -> list[int]:
    """Where blocks begin in rows sorted by key, and the end of the rows."""
    n, out = len(keys[0]), [0]
    for i in range(1, n):
        if i - out[-1] == most or any(k[i] != k[i - 1] for k in keys):
            out.append(i)
    return [*out, n] if n else [0]


def blocked_fold(
    df: DataFrame, keys: list[str], order: list[str], uses: list[str], fold: Fold, decided: str, block_rows: int = BLOCK_ROWS,
    derive: Callable[[DataFrame], DataFrame] = lambda dealt: dealt,
) -> DataFrame:
    """``df`` with the columns ``decided`` (DDL) that ``fold`` gives for each row from the columns ``uses``.

    ``order`` is total within a key; nulls come first in both. The blocks are written once, with what the
    first round decides; later rounds rewrite blocks that were run from another state than was left to them.
    ``derive`` adds columns to the dealt rows, row by row: before, they would be made twice, as ranges ask for a sample.
    """
    extra = StructType.fromDDL(decided)
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    dealt = derive(df.repartitionByRange(*by).sortWithinPartitions(*by))
    plain = dealt.schema
    lists = StructType([f for f in plain if f.name in keys]).add("_block", LongType())
    for f in plain:
        lists = lists.add(f"_l_{f.name}", ArrayType(f.dataType))
    ends = StructType().add("_left", StringType())
    for f in extra:
        ends = ends.add(f"_d_{f.name}", ArrayType(f.dataType))
    first = StructType([*lists, *ends])
    begin = json.dumps(fold.begin())

    def outcome(states: list[str], columns: list[list[list]]) -> list[pa.Array]:
        left, found = [], [[] for _ in extra]
        for came, *values in zip(states, *columns):
            state, lots = fold.run(json.loads(came), *values)
            left.append(json.dumps(state))
            for held, lot in zip(found, lots):
                held.append(lot)
        types = to_arrow_schema(ends)
        return [pa.array(left, pa.string()), *(pa.array(held, types.field(i + 1).type) for i, held in enumerate(found))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            at = _borders([batch.column(k).to_pylist() for k in keys], block_rows)
            offsets, heads = pa.array(at, pa.int32()), pa.array(at[:-1], pa.int64())
            lots = {c: pa.ListArray.from_arrays(offsets, batch.column(c)) for c in plain.names}
            done = outcome([begin] * len(heads), [lots[c].to_pylist() for c in uses])
            numbers = pa.array(range(block, block + len(heads)), pa.int64())
            block += len(heads)
            own = [batch.column(f.name).take(heads) for f in plain if f.name in keys]
            yield pa.RecordBatch.from_arrays([*own, numbers, *lots.values(), *done], first.names)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = outcome(batch.column("_due").to_pylist(), [batch.column(f"_l_{c}").to_pylist() for c in uses])
            yield pa.RecordBatch.from_arrays([batch.column("_block"), batch.column("_due"), *done], ["_block", "_came", *ends.names])

    blocks = stored(dealt.mapInArrow(cut, first), "blocks")
    redone = None
    w = Window.partitionBy(*keys).orderBy("_block")
    while True:
        now = blocks.select(*keys, "_block", "_left").withColumn("_came", F.lit(begin))
        if redone is not None:
            newer = redone.select("_block", F.col("_left").alias("_l"), F.col("_came").alias("_c"))
            now = now.join(newer, "_block", "left").select(*keys, "_block", F.coalesce("_l", "_left").alias("_left"), F.coalesce("_c", "_came").alias("_came"))
        due = now.withColumn("_due", F.coalesce(F.lag("_left").over(w), F.lit(begin))).where("_due != _came").select("_block", "_due")
        due = stored(due, "due")
        if due.isEmpty():
            break
        fresh = blocks.select("_block", *(f"_l_{c}" for c in uses)).join(due, "_block")
        fresh = fresh.mapInArrow(again, StructType([*StructType().add("_block", LongType()).add("_came", StringType()), *ends]))
        if redone is not None:
            fresh = fresh.unionByName(redone.join(due, "_block", "left_anti"))
        redone = stored(fresh, "redone")
    names = [f"_d_{f.name}" for f in extra]
    if redone is not None:
        newer = redone.select("_block", *(F.col(c).alias(f"{c}_") for c in names))
        blocks = blocks.join(newer, "_block", "left").withColumns({c: F.coalesce(f"{c}_", c) for c in names})
    zipped = F.arrays_zip(*(F.col(f"_l_{c}").alias(c) for c in plain.names), *(F.col(f"_d_{f.name}").alias(f.name) for f in extra))
    return blocks.select(F.inline(zipped))


def scan_groups(df: DataFrame, keys: list[str], order: list[str], uses: list[str], pick: Callable[..., list[int]]) -> DataFrame:
    """Of each group of rows with equal ``keys``, in ``order``, those at the places that ``pick`` gives for
    the columns ``uses`` as lists. A group is held by its task; many groups share one. Nulls are a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None

        def kept(rows: pa.RecordBatch, at: list[int]) -> pa.RecordBatch:
            columns = [rows.column(c).to_pylist() for c in uses]
            places = [lo + i for lo, hi in zip(at, at[1:]) for i in pick(*(c[lo:hi] for c in columns))]
            return rows.take(pa.array(places, pa.int64()))

        for batch in batches:
            if rest is not None and rest.num_rows:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0] if batch.num_rows else rest
            if not batch.num_rows:
                continue
            at = _borders([batch.column(k).to_pylist() for k in keys], batch.num_rows)
            if len(at) > 2:
                yield kept(batch.slice(0, at[-2]), at[:-1])
            rest = batch.slice(at[-2])
        if rest is not None and rest.num_rows:
            yield kept(rest, [0, rest.num_rows])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, df.schema)
