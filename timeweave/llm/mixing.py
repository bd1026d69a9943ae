"""Mixing sources to target weights, by packed blocks and seeded index permutations.

The words of a source are packed, in a fixed order of its documents, into blocks of ``block`` words.
The mix is a row of slots, cut into shards of ``shard`` slots. How many slots a source gets is fixed for
the whole mix first: whole epochs, then a part of one whose words meet the target to within a block, its
last block (which may be short) drawn by its words; what remains is rounded systematically over the
sources. The counts of a shard are then a multinomial draw given those totals (multivariate
hypergeometric): the slots of a range of shards are drawn apart into two halves again and again, each time
by a generator keyed by the range, so every shard finds its own counts without the others' and the counts
add up to the totals. Runs of GROUP shards, about as many slots as numpy's draw can hold, get their part
of the totals by systematic rounding. The k-th slot of a source takes block pi(k mod n) of its n blocks,
where pi is a pseudorandom permutation keyed by source and epoch k div n (a Feistel network with cycle
walking), in the last epoch of the whole blocks; blocks meet slots by index. No block is taken more
than ``most`` times, and within an epoch none is taken twice.

Only one row a source (name, size) reaches the driver; everything else is rows in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeweave.llm.common import materialize
from timeweave.llm.textkernel import _SPACE, PIECE, column_bytes, mix

WEIGHTS = (5, 2, 1)
BLOCK, SHARD, SEED = 64, 1024, 17
MAX_SOURCES = 1_000_000
GROUP_SLOTS = 1 << 28


def word_sizes(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Number of words of each text, split at ASCII white space."""
    out, row, n = np.zeros(len(offs) - 1, np.int64), 0, len(offs) - 1
    while row < n:
        last = row + 1
        while last < n and offs[last + 1] - offs[row] <= PIECE:
            last += 1
        base = int(offs[row])
        for at in range(base, int(offs[last]), 8 * PIECE):
            solid = ~_SPACE[data[max(at - 1, base) : min(at + 8 * PIECE, int(offs[last]))]]
            begins = solid[1:] & ~solid[:-1] if at > base else np.concatenate((solid[:1], solid[1:] & ~solid[:-1]))
            if last - row == 1:
                out[row] += int(begins.sum())
            else:
                cuts = offs[row:last] - base
                inside = cuts[(cuts > 0) & (cuts < len(solid))]
                begins[inside] = solid[inside]
                sums = np.concatenate(([0], np.cumsum(begins)))
                out[row:last] = np.diff(sums[offs[row : last + 1] - base])
        row = last
    return out


KEY = ["_id", "_null_id", "_digest"]


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with KEY, by which rows equal in doc_id and text are alike."""
    own = F.col("doc_id").cast("long")
    return docs.select(
        own.alias("doc_id"), "source", "text", F.coalesce(own, F.lit(-1)).alias("_id"), own.isNull().alias("_null_id"), F.xxhash64("text").alias("_digest")
    )


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, KEY and size (words; null text: 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pa.array(word_sizes(*column_bytes(batch.column(5))), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], size], ["doc_id", "source", *KEY, "size"])

    schema = "doc_id long, source string, _id long, _null_id boolean, _digest long, size long"
    return _keyed(docs).select("doc_id", "source", *KEY, "text").mapInArrow(run, schema)


def water_fill(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Targets by weight that add up to share * sum(sizes); none exceeds most * its size, and what a
    target may not hold is shared again by weight among the others."""
    caps = [most * s for s in sizes]
    left, free, target = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        level = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * level > caps[i]]
        if not over:
            for i in free:
                target[i] = weights[i] * level
            break
        for i in sorted(over):
            target[i] = float(caps[i])
            left -= caps[i]
            free.remove(i)
    return target


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Pseudorandom permutation of range(n), keyed: four Feistel rounds on halves of equal width,
    walked until the value is below n."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for r in range(4):
            with np.errstate(over="ignore"):
                salt = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xC2B2AE3D27D4EB4F) % 2**64)
                left, right = right, left ^ (mix(right ^ salt) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def systematic(expected: np.ndarray, start: float) -> np.ndarray:
    """Whole numbers next to ``expected`` whose running sums follow those of ``expected`` from ``start`` on."""
    whole = np.floor(expected)
    return (whole + np.diff(np.floor(np.cumsum(np.concatenate(([start], expected - whole)))))).astype(np.int64)


def slot_totals(sizes: np.ndarray, targets: np.ndarray, most: int, block: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each source: whole epochs, and how many whole blocks and whether the last block the part of an
    epoch after them has. Expected words are the target, and differ from it by less than two blocks."""
    some = np.maximum(sizes, 1)
    epochs = np.where(sizes > 0, np.minimum(np.floor(targets / some + 1e-12), most), 0).astype(np.int64)
    words = np.where((sizes > 0) & (epochs < most), np.maximum(targets - epochs * sizes, 0), 0)
    wholes = np.maximum(-(-sizes // block) - 1, 0)  # all blocks but the last
    end, chance = sizes - wholes * block, words / some
    starts = np.random.Generator(np.random.Philox(key=[seed, 0])).random(2)
    last = systematic(chance, starts[0])
    rest = (words - last * end) / block
    # Where the last block alone is more than the words, or all others are fewer, the other case makes up.
    rest = np.where((words < end) & (last == 1), 0, rest)
    rest = np.where((words < end) & (last == 0), wholes * chance / np.maximum(1 - chance, 1e-12), rest)
    many = (words >= end) & (words > wholes * block)
    rest = np.where(many & (last == 0), wholes, rest)
    rest = np.where(many & (last == 1), wholes * (2 - 1 / np.maximum(chance, 1e-12)), rest)
    return epochs, np.minimum(systematic(np.clip(rest, 0, wholes), starts[1]), wholes), last


def dealt(totals: np.ndarray, starts: np.ndarray, done: float) -> np.ndarray:
    """Slots of each source in the share ``done`` of the mix; slot j of a source lies at (j + start) / total."""
    return np.clip(np.ceil(totals * done - starts), 0, totals).astype(np.int64) if done < 1 else totals


def shard_counts(totals: np.ndarray, starts: np.ndarray, shards: int, group: int, seed: int, first: int, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, slots of each source before it, slots of each source in it) for shards first to end - 1 of all.

    Shard sizes differ by one slot at most within a group of ``group`` shards."""

    def halves(low: int, high: int, before: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if high <= first or low >= end:
            return
        if high - low == 1:
            yield low, before, counts
            return
        middle = (low + high) // 2
        rng = np.random.Generator(np.random.Philox(key=[seed, low << 32 | high]))
        slots = int(counts.sum()) * (middle - low) // (high - low)
        left = rng.multivariate_hypergeometric(counts, slots, method="marginals") if counts.any() else counts
        yield from halves(low, middle, before, left)
        yield from halves(middle, high, before + left, counts - left)

    for low in range(first // group * group, end, group):
        high = min(low + group, shards)
        before = dealt(totals, starts, low / shards)
        yield from halves(low, high, before, dealt(totals, starts, high / shards) - before)


@dataclass
class Mix:
    """sources: idx, source, source_size, target, blocks. documents: one row a document with idx, its
    first word's offset in the source, size, and KEY. slots: shard, slot, idx, block, epoch."""

    sources: DataFrame
    documents: DataFrame
    slots: DataFrame
    block: int


def mix_plan(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: int = 2,
    block: int = BLOCK,
    shard: int = SHARD,
    seed: int = SEED,
) -> Mix:
    """Plan a mix of all rows of ``docs`` (doc_id, source, text).

    Sources are ordered by code point, a null source last, and weigh ``weights`` in turn. Texts that
    are null, empty or blank have size 0 and are never taken. Rows that repeat a doc_id are separate
    documents; the order within a source is by hash of doc_id and text, then doc_id, size and row, so it
    does not depend on partitions but for rows equal in all of these. A very long text lies in many blocks.
    Extra columns are ignored. An empty table gives an empty plan.
    """
    spark = docs.sparkSession
    measured = materialize(sized(docs).withColumn("_row", F.monotonically_increasing_id()), "sized")
    totals = measured.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    found = [(r["source"], int(r["size"]), int(r["n"])) for r in totals.limit(MAX_SOURCES + 1).toLocalIterator()]
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [x[1] for x in found]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(found))], share, most)
    blocks = [-(-s // block) for s in sizes]
    epochs, wholes, lasts = slot_totals(np.array(sizes, np.int64), np.array(targets, float), most, block, seed)
    n_blocks = np.array(blocks, np.int64)
    slots_of = epochs * n_blocks + wholes + lasts
    n_slots = int(slots_of.sum())
    starts = np.random.Generator(np.random.Philox(key=[seed, 1])).random(len(found))
    rows = [(i, x[0], x[0] is None, x[0] or "", s, t, b) for i, (x, s, t, b) in enumerate(zip(found, sizes, targets, blocks))]
    sources = spark.createDataFrame(
        rows, "idx int, source string, _null boolean, _name string, source_size long, target double, blocks long"
    )

    # Offsets within a source: buckets by hash of doc_id and text, so that no task holds a whole source, or
    # all rows without an id.
    n_buckets = 1 + sum(x[2] for x in found) // 20_000
    keyed = measured.withColumns({"_null": F.col("source").isNull(), "_name": F.coalesce("source", F.lit(""))})
    keyed = keyed.join(sources.select("idx", "_null", "_name"), ["_null", "_name"]).drop("_null", "_name")
    keyed = keyed.withColumn("_b", F.pmod(F.xxhash64("doc_id", "_digest"), F.lit(n_buckets)))
    inner = Window.partitionBy("idx", "_b").orderBy("doc_id", "size", "_row").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("idx").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = keyed.groupBy("idx", "_b").agg(F.sum("size").alias("_t"))
    base = base.select("idx", "_b", F.coalesce(F.sum("_t").over(outer), F.lit(0)).alias("_base"))
    placed = keyed.withColumn("_l", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(base, ["idx", "_b"])
    documents = placed.withColumn("offset", F.col("_base") + F.col("_l")).drop("_b", "_base", "_l")

    n_shards = -(-n_slots // shard)
    names = ["shard", "slot", "idx", "block", "epoch"]
    group = max(1, GROUP_SLOTS // shard)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(0).to_pylist()
            if not wanted:
                continue
            for k, before, counts in shard_counts(slots_of, starts, n_shards, group, seed + 2, wanted[0], wanted[-1] + 1):
                idx = np.repeat(np.arange(len(counts)), counts)
                ordinal = np.arange(len(idx)) - np.repeat(np.cumsum(counts) - counts - before, counts)
                slot = np.random.Generator(np.random.Philox(key=[seed + 1, k])).permutation(len(idx))
                epoch, taken = ordinal // n_blocks[idx], ordinal % n_blocks[idx]
                has = np.flatnonzero(counts)
                firsts = (np.cumsum(counts) - counts)[has]
                for i, at, n in zip(has.tolist(), firsts.tolist(), counts[has].tolist()):
                    for e in np.unique(epoch[at : at + n]).tolist():
                        here = at + np.flatnonzero(epoch[at : at + n] == e)
                        key = (seed * 1_000_003 + i) * 1_000_003 + e
                        if e < epochs[i]:
                            taken[here] = permuted(taken[here], int(n_blocks[i]), key)
                        else:
                            full = here[taken[here] < wholes[i]]
                            taken[here[taken[here] >= wholes[i]]] = n_blocks[i] - 1
                            taken[full] = permuted(taken[full], int(n_blocks[i]) - 1, key)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(slot), k), pa.int64()), pa.array(slot, pa.int32()), pa.array(idx, pa.int32()),
                        pa.array(taken, pa.int64()), pa.array(epoch, pa.int32()),
                    ],
                    names,
                )

    parts = max(1, min(n_shards, 1 + n_shards // 64))  # about 64 shards a task: its rows grow by the slot
    slots = spark.range(0, n_shards, 1, parts).mapInArrow(deal, "shard long, slot int, idx int, block long, epoch int")
    return Mix(sources, documents, slots, block)


def pieces(plan: Mix) -> DataFrame:
    """The part of each document in each block: the document's columns with block, from_word, n_words."""
    size = F.lit(plan.block)
    blocks = F.sequence(F.floor(F.col("offset") / size), F.floor((F.col("offset") + F.col("size") - 1) / size))
    out = plan.documents.where("size > 0").withColumn("block", F.explode(blocks))
    begin = F.greatest(F.col("block") * size, F.col("offset"))
    end = F.least((F.col("block") + 1) * size, F.col("offset") + F.col("size"))
    return out.withColumns({"from_word": begin - F.col("offset"), "n_words": end - begin})


def document_shares(plan: Mix) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes of the document) for every row."""
    # Spark sizes slots by the shards they are made from, so it would broadcast them; they grow with the corpus.
    takes = plan.slots.groupBy("idx", "block").agg(F.count("*").alias("times")).hint("merge")
    used = pieces(plan).select("_row", "idx", "block", "n_words").join(takes, ["idx", "block"])
    used = used.groupBy("_row").agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"))
    kept = plan.documents.select("_row", "doc_id", "size", "idx").join(used, "_row", "left")
    kept = kept.join(plan.sources.select("idx", "source_size", "target"), "idx")
    return kept.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_blocks(plan: Mix, docs: DataFrame) -> DataFrame:
    """The mix itself: shard, slot, source, block, epoch, n_words, doc_ids and text of every slot.

    ``docs`` is the table of the plan. Texts meet their offsets by doc_id and digest, copies of a row one
    to one. A block's words are joined by single blanks; at most ``block`` words meet in a row."""
    copy = F.row_number().over(Window.partitionBy(*KEY).orderBy("_digest"))
    texts = _keyed(docs).select("text", *KEY).withColumn("_k", copy)
    rows = plan.documents.withColumn("_k", F.row_number().over(Window.partitionBy(*KEY).orderBy("_row")))
    size, schema = plan.block, "idx int, block long, offset long, _row long, doc_id long, n_words long, text string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for idx, offset, row, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(5))):
                words, at = (text or "").encode().split(), 0
                while at < len(words):
                    block = (offset + at) // size
                    to = min(len(words), at + (block + 1) * size - (offset + at))
                    out.append((idx, block, offset, row, doc_id, to - at, b" ".join(words[at:to]).decode()))
                    at = to
            columns = list(zip(*out)) if out else [()] * 7
            types = [pa.int32(), *[pa.int64()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in schema.split(", ")])

    placed = rows.where("size > 0").join(texts, [*KEY, "_k"]).select("idx", "offset", "_row", "doc_id", "text")
    part = placed.mapInArrow(cut, schema).select("idx", "block", F.struct("offset", "_row", "doc_id", "n_words", "text").alias("p"))
    packed = part.groupBy("idx", "block").agg(F.array_sort(F.collect_list("p")).alias("p"))
    packed = packed.select(
        "idx",
        "block",
        F.aggregate("p.n_words", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_words"),
        F.col("p.doc_id").alias("doc_ids"),
        F.array_join("p.text", " ").alias("text"),
    )
    out = plan.slots.hint("merge").join(packed, ["idx", "block"]).join(plan.sources.select("idx", "source"), "idx")
    return out.select("shard", "slot", "source", "block", "epoch", "n_words", "doc_ids", "text")
