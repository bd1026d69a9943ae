"""SimHash fingerprints of documents and the search for near ones, in DataFrame functions only.

Terms are pairs of neighbouring words; a pair's weight is its length in characters, at most
MAX_WEIGHT, so pairs of short function words count less. Each occurrence votes with its weight for the
64 bits of its hash. Two bits share a 64-bit sum (lanes of 32 bits), so 32 sums hold all votes and the
aggregate stays in generated code; a text may weigh up to 2**31.

``near_counts`` finds all fingerprints within a Hamming radius by permuted block tables: the 64 bits
are cut in radius + 2 blocks, fingerprints within the radius agree on two blocks at least, and there is
a table for each pair of blocks. A pair of fingerprints is counted in the first table it agrees in.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.llm.common import materialize, words_array

MAX_WEIGHT = 16
ROWS_A_BUCKET = 2000
CHUNK = 512
KNOTS = 64
HOT = 1000  # a fingerprint of more than one in so many rows is joined by broadcast; there are fewer than that
_LANES = 0x0000000100000001


def _long(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >= 1 << 63 else value).cast("long")


def terms(text: Column) -> tuple[Column, Column]:
    """The words, and from them as column _words array<struct<h, w>>: hash and weight of each pair of words; of the word itself if there is one only."""
    words = words_array(text)

    def pair(i: Column) -> Column:
        a, b = F.col("_words")[i], F.col("_words")[i + 1]
        weight = F.least(F.length(a) + F.length(b), F.lit(MAX_WEIGHT)).cast("long")
        return F.struct(F.xxhash64(a, b).alias("h"), weight.alias("w"))

    alone = F.array(F.struct(F.xxhash64(F.col("_words")[0]).alias("h"), F.lit(1).cast("long").alias("w")))
    several = F.transform(F.sequence(F.lit(0), F.size("_words") - 2), pair)
    return words, F.when(F.size("_words") > 1, several).when(F.size("_words") == 1, alone)


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and the fingerprint ``fp`` (long) of the text of each row; ``keys`` tell rows apart.

    A text without words, empty or null has fingerprint 0. Equal texts have equal fingerprints.
    """
    words, pairs = terms(F.col(text))
    votes = texts.select(*keys, words.alias("_words")).select(*keys, F.explode_outer(pairs).alias("_t"))
    votes = votes.select(*keys, F.col("_t.h").alias("_h"), F.col("_t.w").alias("_w"))
    lanes = [F.sum(F.shiftrightunsigned("_h", j).bitwiseAND(_long(_LANES)) * F.col("_w")).alias(f"_s{j}") for j in range(32)]
    summed = votes.groupBy(*keys).agg(F.sum("_w").alias("_total"), *lanes)
    bits = []
    for j in range(32):
        low, high = F.col(f"_s{j}").bitwiseAND(_long(0xFFFFFFFF)), F.shiftrightunsigned(f"_s{j}", 32)
        bits += [F.when(low * 2 > F.col("_total"), _long(1 << j)).otherwise(_long(0))]
        bits += [F.when(high * 2 > F.col("_total"), _long(1 << (j + 32))).otherwise(_long(0))]
    return summed.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _ordered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (b, rn, doc_id, text, next_text) in descending doc_id, cut in ranges b so that no task orders
    them all, and the ranges' order (b, next_b).

    Between KNOTS quantiles of doc_id the ranges are of equal width, so ids that lie far off or thin stretch
    one part only; rows without an id are cut by the hash of their text, the order that they have."""
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    n, with_id = own.agg(F.count("*"), F.count("doc_id")).first()
    knots = sorted({int(x) for x in own.approxQuantile("doc_id", [k / KNOTS for k in range(KNOTS + 1)], 0.002)}) or [0]
    slices = 1 + with_id // (KNOTS * ROWS_A_BUCKET)
    edges = F.array(*(F.lit(k).cast("long") for k in [*knots, knots[-1] + 1]))
    part = F.greatest(F.lit(1), F.least(F.size(F.filter(edges, lambda k: k <= F.col("doc_id"))), F.lit(len(knots))))
    low, high = F.get(edges, part - 1), F.get(edges, part)
    inside = F.floor((F.col("doc_id").cast("double") - low) / (high - low) * slices)
    held = F.greatest(F.lit(0), F.least(inside, F.lit(slices - 1)))
    parts = 1 + (n - with_id) // ROWS_A_BUCKET
    hashed = F.xxhash64("text")
    without = F.floor((hashed.cast("double") / 2.0**64 + 0.5) * parts) - parts - 1
    own = own.withColumns({"h": hashed, "b": F.when(F.col("doc_id").isNull(), without).otherwise(part * slices + held).cast("long")})
    w = Window.partitionBy("b").orderBy(F.col("doc_id").desc(), F.col("h").desc(), F.col("text").desc())
    rows = own.withColumns({"rn": F.row_number().over(w), "next_text": F.lead("text").over(w)}).drop("h")
    heads = own.groupBy("b").agg(F.max(F.struct("doc_id", "h", "text")).alias("h")).select("b", F.col("h.text").alias("head"))
    ranges = Window.orderBy(F.col("b").desc())
    order = own.select("b").distinct().select("b", F.lead("b").over(ranges).alias("next_b"), F.first("b").over(ranges).alias("top"))
    order = order.select("b", F.coalesce("next_b", "top").alias("next_b"))
    follow = order.join(heads.withColumnRenamed("b", "next_b"), "next_b").select("b", "head")
    rows = rows.join(follow, "b").withColumn("next_text", F.coalesce("next_text", "head")).drop("head")
    return rows, order


def compare_edited(docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id,
    n_near of every row of ``docs`` (doc_id, text).

    The edited text has the last floor(n_chars / 2) code points replaced by as many first ones of the
    next document, in descending doc_id; the first document follows the last. A null text is empty.
    Rows that repeat a doc_id follow each other by falling hash of the text; rows with a null doc_id come last.
    class_id is the smallest doc_id with the same fingerprint, n_near the number of other fingerprints
    within ``radius`` bits. Extra columns are ignored; an empty table gives an empty result.
    """
    rows, order = _ordered(docs)
    cut = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.select("b", "rn", "doc_id", F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"))
    kinds = rows.select(
        "b", "rn", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.posexplode(F.array("text", "edited")).alias("kind", "t"),
    )
    keys = ["b", "rn", "doc_id", "n_chars", "edited_sha256"]
    marked = fingerprints(kinds, [*keys, "kind"], "t").groupBy(*keys).agg(
        F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp")
    )
    marked = materialize(marked, "fingerprints")
    w = Window.partitionBy("b").orderBy("rn")
    heads = marked.where("rn = 1").select(F.col("b").alias("next_b"), F.col("fp").alias("head"))
    follow = materialize(order, "ranges").join(heads, "next_b").select("b", "head")
    nexts = marked.withColumn("next_fp", F.lead("fp").over(w)).join(follow, "b")
    nexts = nexts.withColumn("next_fp", F.coalesce("next_fp", "head"))
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")), "classes")
    near = near_counts(classes.select("fp"), radius)
    return _with_classes(nexts, classes.join(near, "fp")).select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "class_id", "n_near",
    )


def _with_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` (b, rn, fp, ...) with class_id and n_near of their fingerprint. The rows of a large class are
    spread over all tasks: their class is broadcast, and in the shuffle their own number stands for it."""
    held = materialize(classes, "near")
    total = held.agg(F.sum("copies")).first()[0] or 0
    large = F.col("copies") * HOT > total
    hot = held.where(large).select("fp", F.struct("class_id", "n_near").alias("hot"))
    cold = held.where(~large).select(F.col("fp").alias("key"), F.struct("class_id", "n_near").alias("cold"))
    own = rows.join(F.broadcast(hot), "fp", "left")
    own = own.withColumn("key", F.when(F.col("hot").isNull(), F.col("fp")).otherwise(F.xxhash64("b", "rn")))
    own = own.join(cold, "key", "left").withColumn("found", F.coalesce("hot", "cold"))
    return own.withColumns({"class_id": F.col("found.class_id"), "n_near": F.col("found.n_near")}).drop("key", "hot", "cold", "found")


def block_masks(radius: int) -> list[int]:
    """Bit masks of the tables: every pair of radius + 2 blocks of nearly equal width."""
    n = radius + 2
    edges = [round(64 * k / n) for k in range(n + 1)]
    blocks = [((1 << edges[k + 1]) - 1) & ~((1 << edges[k]) - 1) for k in range(n)]
    return [a | b for a, b in combinations(blocks, 2)]


def near_counts(fps: DataFrame, radius: int = 3) -> DataFrame:
    """fp, n_near: for each of the distinct fingerprints, how many others are within ``radius`` bits.

    A bucket of a block table is cut in chunks of about CHUNK fingerprints, held as arrays; a member
    meets the chunks of its bucket, so pairs are looked at inside rows and never become rows. Members are
    dealt by chunk, so a large bucket is spread over as many tasks as it has chunks.
    """
    if not 0 <= radius <= 14:
        raise ValueError("radius must be 0 to 14")
    masks = block_masks(radius)
    keys = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(_long(m)).alias("key")) for t, m in enumerate(masks)))
    rows = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = materialize(rows.join(sizes, ["t", "key"]).select("t", "key", "fp", F.ceil(F.col("n") / CHUNK).alias("parts")), "blocks")
    chunk = F.pmod(F.xxhash64("fp", "t"), F.col("parts"))
    chunks = rows.groupBy("t", "key", chunk.alias("c")).agg(F.collect_list("fp").alias("others"))

    def first_table(x: Column) -> Column:
        out = F.lit(len(masks))
        for t in reversed(range(len(masks))):
            out = F.when(x.bitwiseAND(_long(masks[t])) == 0, F.lit(t)).otherwise(out)
        return out

    def close(other: Column) -> Column:
        x = other.bitwiseXOR(F.col("fp"))
        return (F.bit_count(x) <= radius) & (x != 0) & (first_table(x) == F.col("t"))

    members = rows.select("t", "key", "fp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("c"))
    found = members.join(chunks, ["t", "key", "c"])
    found = found.select("fp", F.size(F.filter("others", close)).alias("m")).groupBy("fp").agg(F.sum("m").alias("m"))
    return fps.join(found, "fp", "left").select("fp", F.coalesce("m", F.lit(0)).cast("long").alias("n_near"))
