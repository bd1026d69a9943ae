"""Repairing conversations: the cheapest edits that make the turns follow ``(system? (user assistant)+)?``.

Rows of a conversation are read by turn (nulls first; rows of one turn by role, then by a digest of role
and text). A row is kept, given another role or deleted, and empty turns are put in before it; what these
edits cost is a shortest path over four states (nothing yet, after system, after user, after assistant).
Hirschberg's divide and conquer finds it in linear space: cost vectors run forward to the middle and
backward from the end, the crossing is fixed, and both halves are solved alone. Among cheapest paths the
one with the least string of initials is wanted; forward vectors carry the order of their states' least
strings, which is enough, since each ends with the edit of the same row and so none begins another.

A conversation may be of any length. Rows are dealt by ranges of the reading order, so a long conversation
lies in many tasks, and cut into blocks of BLOCK_ROWS. A block is summed up as a table of costs from state
to state; the same divide and conquer over these tables gives the states between blocks, and blocks are
then solved apart. Only the digest of a repaired conversation is taken by one task, which streams the rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import materialize

BLOCK_ROWS = 4096
WHITE = " \t\n\x0b\f\r"
FAULTS = ("none", "blank", "duplicate", "truncated")
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # the state after a user or assistant turn, whichever must come
TAIL = (0, 2, 1, 0)  # turns still to be put in at the end
ROLE = {USER: "user", ASSISTANT: "assistant"}
INITIALS = ("", "s", "u", "a")
FAR = 1 << 60

# cost and order of going from state to state; the order compares ways from one state only
Table = tuple[tuple[tuple[int, object], ...], ...]


# ------------------------------------------------------------------------------------------ shortest paths


@functools.cache
def step(initial: int, fault: int) -> Table:
    """The table of one row: its order is the string of edits, insertions first."""
    best: list[list[tuple[int, object]]] = [[(FAR, "")] * 4 for _ in STATES]
    for s in STATES:
        at = s
        for inserted in range(3):
            ways = [(DELETE, "D", at)]
            if fault not in (1, 2):
                more = TRUNCATED if fault == 3 else 0
                ways.append((REROLE + more, "R", NEXT[at]))
                if initial and (initial == NEXT[at] or (initial == SYSTEM and at == NOTHING)):
                    ways.append((more, "K", initial))
            for cost, edit, t in ways:
                best[s][t] = min(best[s][t], (INSERT * inserted + cost, "I" * inserted + edit)) if best[s][t][0] < FAR else (INSERT * inserted + cost, "I" * inserted + edit)
            at = NEXT[at]
    return tuple(map(tuple, best))


@dataclass
class Vector:
    cost: list[int]
    rank: list[int]  # order of the least strings that lead to the states

    def through(self, table: Table) -> Vector:
        cost, keys = [FAR] * 4, {}
        for t in STATES:
            ways = [(self.cost[s] + table[s][t][0], self.rank[s], table[s][t][1]) for s in STATES if self.cost[s] < FAR and table[s][t][0] < FAR]
            if ways:
                cost[t], *keys[t] = min(ways)
        rank = [4] * 4
        for r, t in enumerate(sorted(keys, key=keys.__getitem__)):
            rank[t] = r
        return Vector(cost, rank)


def start_at(state: int) -> Vector:
    return Vector([0 if s == state else FAR for s in STATES], [0 if s == state else 4 for s in STATES])


def forward(items: Sequence[Table], lo: int, hi: int, vector: Vector) -> Vector:
    for i in range(lo, hi):
        vector = vector.through(items[i])
    return vector


def backward(items: Sequence[Table], lo: int, hi: int, cost: list[int]) -> list[int]:
    for i in range(hi - 1, lo - 1, -1):
        cost = [min(items[i][s][t][0] + cost[t] for t in STATES) for s in STATES]
    return cost


def crossings(items: Sequence[Table], first: int, last: int) -> list[int]:
    """States before, between and after the items on the least of the cheapest paths from ``first`` to ``last``."""
    out = [first] * (len(items) + 1)
    out[-1] = last
    todo = [(0, len(items))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        ahead = forward(items, lo, mid, start_at(out[lo]))
        behind = backward(items, mid, hi, [0 if s == out[hi] else FAR for s in STATES])
        out[mid] = min(STATES, key=lambda s: (ahead.cost[s] + behind[s], ahead.rank[s]))
        todo += [(lo, mid), (mid, hi)]
    return out


def summary(items: Sequence[Table]) -> Table:
    """The table of a block of items."""
    ends = [forward(items, 0, len(items), start_at(s)) for s in STATES]
    return tuple(tuple(zip(v.cost, v.rank)) for v in ends)


def last_state(items: Sequence[Table]) -> tuple[int, int]:
    """State after all items on the least of the cheapest whole paths, and the cost of the path."""
    end = forward(items, 0, len(items), start_at(NOTHING))
    state = min(STATES, key=lambda s: (end.cost[s] + INSERT * TAIL[s], end.rank[s]))
    return state, end.cost[state] + INSERT * TAIL[state]


def edits(items: Sequence[Table], first: int, last: int) -> str:
    path = crossings(items, first, last)
    return "".join(items[i][path[i]][path[i + 1]][1] for i in range(len(items)))


# ----------------------------------------------------------------------------------------------- passes


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text; nulls of the key, role and text count as one blank) with
    faults put in by CRC-32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties the text, 2 removes its
    full stops, exclamation and question marks, 3 repeats the row, 4 makes its role user. A dropped row stays
    with ``dropped`` true, so that no conversation is lost."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(kind == 4, "user").otherwise(blank("role"))
    copies = F.array_repeat(kind == 0, F.when(kind == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("dropped"))


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE))


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows (with ``dropped``: those were never there) with ``initial`` (1 to 3 for s, u, a; else 0) and ``fault``: the first that holds of blank (1, no
    character but white space), duplicate (2, role and text were seen earlier), truncated (3, the last
    character that is no white space ends no sentence); 0 if none holds."""
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    own = rows.withColumns({"digest": digest, "id": F.monotonically_increasing_id()})
    own = materialize(own, "rows")
    earliest = F.min(F.struct(F.col("turn").isNotNull(), "turn", "id"))["id"]
    firsts = own.where("not dropped").groupBy("conv_id", "digest").agg(earliest.alias("id")).select("id", F.lit(True).alias("_first"))
    initial = F.when(F.col("role").startswith("s"), 1).when(F.col("role").startswith("u"), 2).when(F.col("role").startswith("a"), 3).otherwise(0)
    bare = _trimmed(F.col("text"))
    fault = F.when(bare == "", 1).when(F.col("_first").isNull(), 2).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    return own.join(firsts, "id", "left").withColumns({"initial": initial, "fault": fault}).drop("_first")


PLACED = "block long, idx int, initial int, fault int, role string, text string"


def _placed(marked: DataFrame) -> DataFrame:
    """Rows in reading order with their block and their place in it; no block holds two conversations."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("id")]
    kind = marked.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, idx, now = (TaskContext.get().partitionId() << 32) - 1, BLOCK_ROWS, object()
        for batch in batches:
            blocks, places = [], []
            for conv in batch.column("conv_id").to_pylist():
                if conv != now or idx == BLOCK_ROWS:
                    now, block, idx = conv, block + 1, 0
                blocks.append(block)
                places.append(idx)
                idx += 1
            arrays = [batch.column("conv_id"), pa.array(blocks, pa.int64()), pa.array(places, pa.int32())]
            arrays += [batch.column(c) for c in ("initial", "fault", "role", "text")]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "block", "idx", "initial", "fault", "role", "text"])

    own = marked.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "initial", "fault", "role", "text")
    return own.mapInArrow(run, f"conv_id {kind}, {PLACED}")


def _items(codes: list[int]) -> list[Table]:
    """The tables of rows from 4 * initial + fault."""
    return [step(c // 4, c % 4) for c in codes]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tables = [summary(_items(c)) for c in batch.column("codes").to_pylist()]
        costs = [[table[s][t][0] for s in STATES for t in STATES] for table in tables]
        ranks = [[table[s][t][1] for s in STATES for t in STATES] for table in tables]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("block"), pa.array(costs, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int32()))],
            ["conv_id", "block", "costs", "ranks"],
        )


def _linked(group: pa.Table) -> pa.Table:
    """States before and after each block of a conversation, and the cost of the whole."""
    rows = sorted(group.to_pylist(), key=lambda r: r["block"])
    items = [tuple(tuple((r["costs"][4 * s + t], r["ranks"][4 * s + t]) for t in STATES) for s in STATES) for r in rows]
    last, cost = last_state(items)
    path = crossings(items, NOTHING, last)
    columns = [pa.array([r["block"] for r in rows], pa.int64()), *(pa.array(c, pa.int32()) for c in (path[:-1], path[1:]))]
    columns += [pa.array([i == len(rows) - 1 for i in range(len(rows))]), pa.array([cost] * len(rows), pa.int64())]
    return pa.Table.from_arrays(columns, ["block", "first", "last", "ends", "cost"])


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        audits = []
        for codes, first, last, ends in zip(*(batch.column(c).to_pylist() for c in ("codes", "first", "last", "ends"))):
            audits.append(edits(_items(codes), first, last) + "I" * (TAIL[last] if ends else 0))
        yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("first"), pa.array(audits, pa.string())], ["block", "first", "audit"])


def _digests(kind: str):  # noqa: ANN202
    """Streams rows in order with their block's edits: a digest and the whole audit of each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, whole, lines, state, at = object(), "", None, 0, 0, 0
        audits: list[str] = []
        names = ["conv_id", "audit", "repaired_sha256"]

        def put(line: str) -> None:
            nonlocal lines
            whole.update((("\n" if lines else "") + line).encode())
            lines += 1

        def insert() -> None:
            nonlocal state, at
            while at < len(held) and held[at] == "I":
                state, at = NEXT[state], at + 1
                put(f"{ROLE[state]}:")

        def done() -> pa.RecordBatch:
            insert()
            return pa.RecordBatch.from_arrays([pa.array([now], conv_type), pa.array(["".join(audits)]), pa.array([whole.hexdigest()])], names)

        conv_type = None
        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for conv, idx, initial, role, text, first, audit in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "idx", "initial", "role", "text", "first", "audit"))):
                if conv != now:
                    if whole is not None:
                        yield done()
                    now, whole, lines, audits, held, at = conv, hashlib.sha256(), 0, [], "", 0
                if idx == 0:
                    insert()
                    held, at, state = audit, 0, first
                    audits.append(audit)
                insert()
                edit, at = held[at], at + 1
                if edit == "K":
                    state = initial
                    put(f"{role}:{text}")
                elif edit == "R":
                    state = NEXT[state]
                    put(f"{ROLE[state]}:{text}")
        if whole is not None:
            yield done()

    return run


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation
    in rows of conv_id, turn, role, text and, if any, ``dropped``: rows that count for their conv_id alone.

    Nulls of conv_id are one conversation; null turns come first and make no gap; role and text must not be
    null (``damage`` fills them). A conversation without rows has zeros, an empty audit and the hash of no
    text. Other columns are ignored.
    """
    rows = rows if "dropped" in rows.columns else rows.withColumn("dropped", F.lit(False))
    marked = with_faults(rows.select("conv_id", "turn", "role", "text", "dropped").withColumn("dropped", F.coalesce("dropped", F.lit(False))))
    marked = materialize(marked, "marked")
    kind = marked.schema["conv_id"].dataType.simpleString()

    per_turn = marked.groupBy("conv_id", "turn").agg(
        *(F.count_if((F.col("fault") == i) & ~F.col("dropped")).alias(FAULTS[i]) for i in (1, 2, 3)), F.count_if(~F.col("dropped")).alias("n")
    )
    there = F.when(F.col("n") > 0, F.col("turn"))
    gaps = F.max(there) - F.min(there) + 1 - F.count(there)
    stats = per_turn.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *(F.sum(c).alias(c) for c in FAULTS[1:]))

    placed = materialize(_placed(marked.where("not dropped")), "placed")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", (4 * F.col("initial") + F.col("fault")).alias("c")))), lambda x: x["c"])
    blocks = materialize(placed.groupBy("conv_id", "block").agg(ordered.alias("codes")), "blocks")
    arrays = f"conv_id {kind}, block long, costs array<long>, ranks array<int>"
    linked = blocks.mapInArrow(_summed, arrays).groupBy("conv_id").applyInArrow(_linked, "block long, first int, last int, ends boolean, cost long")
    linked = materialize(linked, "linked")
    solved = blocks.join(linked, "block").select("block", "codes", "first", "last", "ends").mapInArrow(_solved, "block long, first int, audit string")
    stream = placed.join(solved, "block").repartition("conv_id").sortWithinPartitions("conv_id", "block", "idx")
    digests = stream.select("conv_id", "idx", "initial", "role", "text", "first", "audit").mapInArrow(
        _digests(kind), f"conv_id {kind}, audit string, repaired_sha256 string"
    )

    # neighbours that may not follow each other: inside blocks, and from a block to the next of its conversation
    legal = [4 * SYSTEM + USER, 4 * USER + ASSISTANT, 4 * ASSISTANT + USER]
    initials = F.transform("codes", lambda c: F.floor(c / 4).cast("int"))
    pairs = F.zip_with(F.slice("i", 1, F.size("i") - 1), F.slice("i", 2, F.size("i") - 1), lambda a, b: 4 * a + b)
    own = blocks.withColumn("i", initials)
    inside = own.select("conv_id", "block", F.size(F.filter(pairs, lambda p: ~p.isin(legal))).alias("bad"), F.col("i")[0].alias("head"), F.element_at("i", -1).alias("tail"))
    borders = inside.groupBy("conv_id").agg(F.sum("bad").alias("bad"), F.array_sort(F.collect_list(F.struct("block", "head", "tail"))).alias("b"))
    between = F.zip_with(F.slice("b", 1, F.size("b") - 1), F.slice("b", 2, F.size("b") - 1), lambda x, y: 4 * x["tail"] + y["head"])
    illegal = borders.select("conv_id", (F.col("bad") + F.size(F.filter(between, lambda p: ~p.isin(legal)))).cast("long").alias("illegal"))
    costs = blocks.select("conv_id", "block").join(linked.where("ends").select("block", "cost"), "block").select("conv_id", "cost")

    out = stats
    for more in (illegal, costs, digests):
        key = more.withColumnRenamed("conv_id", "_c")
        out = out.join(key, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    none = hashlib.sha256().hexdigest()
    return out.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", F.coalesce("illegal", F.lit(0).cast("long")).alias("illegal"),
        F.coalesce("cost", F.lit(0).cast("long")).alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"),
    )
