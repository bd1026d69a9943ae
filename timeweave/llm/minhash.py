"""MinHash near-duplicate groups: one-permutation hashing, optimal densification, banded stars.

Steps, each a Spark job over rows or classes of equal shingle sets:

1. ``signatures``: one pass over the texts. A 64-bit hash of each distinct shingle falls in one of
   ``bands * rows`` bins by its high bits; the smallest hash of a bin is the bin's value, and an
   empty bin copies the bin that its own fixed random order of bins reaches first (optimal
   densification). Bands of ``rows`` bins make bucket keys.
2. Rows with equal sets form a class, so exact copies cost one comparison however many there are.
3. Each bucket with two or more classes becomes a star: the class that meets the most others in all
   its buckets is the hub and gets an edge from each other member. A bucket of m classes gives m - 1
   edges, and the buckets of one group mostly agree on the hub, so the edges are few.
4. Edges are confirmed on the full sets, and components are taken.
5. What a star can lose, a link between two leaves of one hub, is recovered: members that are still
   outside their hub's component are compared with the members of other components in their buckets,
   found by the rare shingles that any link must share. Nothing is capped.

With 40 bands of 5 bins a pair of likeness 0.8 shares no band with probability 1e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeweave.llm.common import discard, materialize
from timeweave.llm.graph import components
from timeweave.llm.textkernel import documents_words, mix, shingle_hashes

BANDS, ROWS = 40, 5
SIGNATURE = "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>"


def probe_orders(bins: int) -> np.ndarray:
    """A fixed random order of all bins for each bin, in which an empty bin looks for a value."""
    rng = np.random.Generator(np.random.PCG64(77))
    return np.stack([rng.permutation(bins) for _ in range(bins)]).astype(np.int32)


def one_permutation(hashes: np.ndarray, bins: int, probes: np.ndarray) -> np.ndarray:
    """Signature of a set given as sorted distinct 64-bit hashes."""
    which = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(which[1:] != which[:-1]) + 1))
    full = np.zeros(bins, bool)
    full[which[first]] = True
    values = np.zeros(bins, np.uint64)
    values[which[first]] = hashes[first]
    empty = np.flatnonzero(~full)
    if len(empty):
        found = full[probes[empty]].argmax(axis=1)
        values[empty] = values[probes[empty, found]]
    return values


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    table = signature.reshape(bands, rows)
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(rows):
            key = mix(key ^ table[:, k])
    return key.view(np.int64)


def _set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, width: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key (of the distinct shingles) and band keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = probe_orders(bands * rows)
        for batch in batches:
            sizes, keys, found = [], [], []
            for _, words, _, _ in documents_words(batch.column(2)):
                hashes = np.unique(shingle_hashes(words, width))
                sizes.append(len(hashes))
                keys.append(_set_key(hashes) if len(hashes) else None)
                found.append(band_keys(one_permutation(hashes, bands * rows, probes), bands, rows) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "set_key", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, SIGNATURE)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """node, full sorted shingle set of the rows of ``docs`` (node, set_key, text) whose set has the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(held: list[tuple]) -> pa.RecordBatch:
            sets = pa.array([x.view(np.int64) for _, x in held], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([n for n, _ in held], pa.int64()), sets], ["node", "shingles"])

        for batch in batches:
            held, size = [], 0
            nodes, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row, words, _, _ in documents_words(batch.column(2)):
                hashes = np.unique(shingle_hashes(words, width))
                if _set_key(hashes) != keys[row]:
                    continue  # another row of this doc_id
                held.append((nodes[row], hashes))
                size += len(hashes)
                if size > 500_000:
                    yield batch_of(held)
                    held, size = [], 0
            yield batch_of(held)

    return docs.select("node", "set_key", "text").mapInArrow(run, "node long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _leaf_pairs(members: DataFrame, hubs: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that stars may have lost: both are leaves of one bucket, a is outside the component of
    its hub, b in another component than a. A bucket of two classes has lost nothing: its only pair is the
    star's own.

    A shingle counts only if two of these classes hold it, one of them an outside one; what cannot match
    comes first in the order, then shingles by rarity. Sets of the wanted likeness share one of their first
    n - ceil(n * percent / 100) + 1 shingles, and from the places of the first one they share, at most the
    shingles behind it can be common; other pairs are no links and make no row.
    """
    leaves = members.where("size > 2").join(hubs.select("key", "hub"), "key").where("node != hub")
    named = groups.select("node", "component")
    leaves = leaves.select("key", "node", "n", "hub").join(named, "node", "left")
    at_hub = named.select(F.col("node").alias("hub"), F.col("component").alias("hub_component"))
    leaves = leaves.join(at_hub, "hub", "left").select(
        "key", "node", "n", F.coalesce("component", "node").alias("component"), F.coalesce("hub_component", "hub").alias("hub_component")
    )
    leaves = materialize(leaves.withColumn("out", F.col("component") != F.col("hub_component")), "leaves")
    open_keys = leaves.where("out").select("key").distinct()
    nodes = leaves.join(open_keys, "key", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("component").alias("component"), F.max("out").alias("out"))
    nodes = materialize(nodes, "open")
    discard(leaves)
    shingles = sets.join(nodes.select("node", "out"), "node").select("node", "out", F.explode("shingles").alias("s"))
    often = shingles.groupBy("s").agg(F.count("*").alias("df"), F.max("out").alias("any_out")).where("df > 1 and any_out")
    w = Window.partitionBy("node")
    able = shingles.join(often.select("s", "df"), "s").withColumns(
        {"i": F.row_number().over(w.orderBy("df", "s")), "m": F.count("*").over(w)}
    )
    able = able.select("s", "node", "i", "m").join(nodes, "node").withColumn("i", F.col("n") - F.col("m") + F.col("i"))
    first = able.where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).drop("m")
    first = materialize(first, "prefixes")
    x = first.where("out").select("s", *(F.col(c).alias(f"x{c}") for c in ("node", "n", "component", "i")))
    y = first.select("s", *(F.col(c).alias(f"y{c}") for c in ("node", "n", "component", "i")))
    most = F.least(F.col("xn") - F.col("xi"), F.col("yn") - F.col("yi")) + 1
    fits = (100 + percent) * most >= percent * (F.col("xn") + F.col("yn"))
    pairs = x.join(y, "s").where((F.col("xcomponent") != F.col("ycomponent")) & fits)
    pairs = materialize(pairs.select(F.greatest("xnode", "ynode").alias("a"), F.least("xnode", "ynode").alias("b")).distinct(), "leaf-pairs")
    discard(first, nodes)
    return pairs


def _grouped(docs: DataFrame, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id of every row; see ``near_duplicates``."""
    full = materialize(signatures(docs, width, bands, rows), "signatures")
    classes = (
        full.where("n_shingles > 0 and doc_id is not null")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    banded = materialize(classes, "banded")
    marks = materialize(full.drop("bands"), "marks")
    discard(full)
    classes = materialize(banded.drop("bands"), "classes")

    keys = banded.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = materialize(keys.join(shared, "key"), "buckets")
    discard(banded)

    # The hub of a bucket is the class that meets the most others in all its buckets.
    met = buckets.groupBy("node").agg(F.sum("size").alias("met")).join(classes.select("node", "n"), "node")
    members = materialize(buckets.join(met, "node"), "members")
    discard(buckets)
    centre = F.struct(-F.col("met"), F.xxhash64("node"))
    hubs = members.groupBy("key").agg(F.min(F.struct(centre, "node", "n")).alias("h"))
    hubs = materialize(hubs.select("key", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n")), "hubs")

    def sizes_fit(x: str, y: str) -> F.Column:
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    stars = (
        members.join(hubs, "key")
        .where((F.col("node") != F.col("hub")) & sizes_fit("n", "hub_n"))
        .select(F.greatest("hub", "node").alias("a"), F.least("hub", "node").alias("b"))
        .distinct()
    )
    stars = materialize(stars, "stars")
    wanted = stars.select(F.col("a").alias("node")).union(stars.select("b")).union(members.where("size > 2").select("node")).distinct()
    wanted = classes.join(wanted, "node", "left_semi").select("node", "set_key", F.col("first_id").alias("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id")
    sets = materialize(shingle_sets(texts, width).dropDuplicates(["node"]), "sets")

    links = materialize(_confirmed(stars, sets, percent), "links")
    groups = components(links)
    leaf_pairs = _leaf_pairs(members, hubs, groups, sets, percent)
    missed = materialize(leaf_pairs.join(stars, ["a", "b"], "left_anti"), "missed")
    discard(members, hubs, stars, leaf_pairs, groups)
    both = materialize(links.union(_confirmed(missed, sets, percent)), "links")
    discard(sets, missed, links)
    groups = components(both)
    discard(both)

    named = classes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_set = materialize(named.join(smallest, "component").select("set_key", F.col("component_id").alias("_c")), "components")
    discard(classes, groups)
    out = marks.join(by_set, "set_key", "left")
    return out.select(
        "doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id")).alias("component_id")
    )


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Words are split at ASCII white space and A-Z lower-cased; a set holds the distinct runs of
    ``width`` words, or the whole text as one run if it is shorter. A null, empty or blank text has an
    empty set and links with nothing: its component is itself. A row with a null doc_id takes part in
    no link and has a null component and kept false. Rows that repeat a doc_id are ordinary copies of
    each other if their sets are linked; equal rows are alike in every column. A very long text is read
    in pieces; its set is held whole. Extra columns are ignored. An empty table gives an empty result.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return _grouped(docs, width, percent, bands, rows).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Pipeline stage: one row of each group of near copies stays, that of smallest doc_id, of several
    texts under it that of smallest hash; the rows that stay are unchanged.

    Rows equal in doc_id and text are one document, whatever their other columns; the least of them in
    those columns stays. Texts without words are in no group and stay, as do rows with a null doc_id,
    repeated or not.
    """
    rows = _grouped(docs, width, percent, BANDS, ROWS).where("doc_id is not null")
    group = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    own = materialize(rows.select("doc_id", "text_hash", group.alias("g")), "rows")
    best = own.where("g is not null").groupBy("g").agg(F.min(F.struct("doc_id", "text_hash")).alias("b"))
    best = best.select("b.*")
    gone = own.where("g is not null").select("doc_id", "text_hash").distinct().join(best, ["doc_id", "text_hash"], "left_anti")
    gone = materialize(gone.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")), "gone")
    discard(own)
    # What goes grows with the corpus, so it is never broadcast: texts are dealt once, by id and hash, and the
    # window finds them dealt already.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    left = keyed.join(gone.hint("merge"), ["id", "hash"], "left_anti")
    first = F.row_number().over(Window.partitionBy("id", "hash").orderBy("row"))
    return left.withColumn("first", first).where("first = 1 or id is null").select("row.*")
