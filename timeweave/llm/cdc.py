"""Substring dedup by content-defined chunking.

A gear rolling hash over the last 32 bytes cuts texts into chunks of MIN_CHUNK to MAX_CHUNK bytes
wherever its high bits are zero. Cuts depend on the content alone, so after an insertion they fall in
step again and a passage that two documents share has the same chunks in both, but for its ends. Chunks
are compared by a 128-bit digest; a digest found in two or more documents is shared, and belongs to the
smallest doc_id that has it. Consecutive shared chunks form a span. Its ends are then moved out to where
the texts really part: the bytes beside it are compared with those beside the same chunk in the first and
in the last document that holds it, at most REACH bytes either way. Spans of ``least_words`` or more count.

A passage of 50 words of two letters has some 150 bytes, and is found by a chunk that lies in it whole; chunks
of 64 bytes at most leave room for one behind the first cut that both documents make.

The chunk table is rows in Spark, grouped and joined by digest, so a passage that very many documents hold
costs a row for each of them and no pairs; ends are compared with two documents, however many hold them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeweave.llm.common import discard, materialize
from timeweave.llm.textkernel import _SPACE, PIECE, column_bytes

MIN_CHUNK, MAX_CHUNK, CUT_BITS = 12, 64, 5
LEAST_WORDS, REACH = 50, 512
HOT, SALTS = 10_000, 64
WINDOW = 32
_GEAR = np.random.Generator(np.random.PCG64(31)).integers(0, 2**32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: the sum of gear[b] << age over the WINDOW bytes up to it, built by doubling
    the window five times."""
    h = _GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)  # the right side is computed first
        step *= 2
    return h


def cut_candidates(data: np.ndarray) -> np.ndarray:
    """Ends (exclusive) at which the gear hash has CUT_BITS high zero bits."""
    return np.flatnonzero(gear(data) >> np.uint32(32 - CUT_BITS) == 0) + 1


def _forced(data: np.ndarray, at: int) -> int:
    """Where to end a chunk from ``at`` on that meets no candidate: at the last place of largest hash, so that
    texts which repeat a word without end are cut in step too."""
    low = max(at + MIN_CHUNK, WINDOW)
    h = gear(data[low - WINDOW : at + MAX_CHUNK])[WINDOW - 1 :]
    return low + len(h) - 1 - int(h[::-1].argmax())


def chunk_ends(candidates: list[int], data: np.ndarray) -> list[int]:
    """Chunk ends of a text: the first candidate from MIN_CHUNK on, within MAX_CHUNK."""
    ends, at = [], 0
    for c in [*candidates, len(data)]:
        while c - at > MAX_CHUNK:
            at = _forced(data, at)
            ends.append(at)
        if c - at >= MIN_CHUNK or (c == len(data) and c > at):
            at = c
            ends.append(at)
    return ends


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """(row, bytes, chunk ends) of each text. A window that reaches into the text before cannot matter,
    since candidates that early are below MIN_CHUNK or are left out."""
    data, offs = column_bytes(column)
    row, n = 0, len(offs) - 1
    while row < n:
        last = row + 1
        while last < n and offs[last + 1] - offs[row] <= PIECE:
            last += 1
        base = int(offs[row])
        parts = []
        for at in range(base, int(offs[last]), PIECE):
            begin = max(base, at - WINDOW)
            found = cut_candidates(data[begin : min(at + PIECE, int(offs[last]))]) + begin
            parts.append(found[found > at])
        found = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        edges = np.searchsorted(found, offs[row : last + 1], side="right")
        for k in range(last - row):
            a, b = int(offs[row + k]), int(offs[row + k + 1])
            own = found[edges[k] : edges[k + 1]] - a
            yield row + k, data[a:b], chunk_ends(own[own >= WINDOW].tolist(), data[a:b])
        row = last


def word_starts(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each word, words being parted by ASCII white space."""
    solid = ~_SPACE[data]
    out = solid.copy()
    out[1:] &= ~solid[:-1]
    return out


def chunk_table(docs: DataFrame) -> DataFrame:
    """doc_id, d1, d2 (digest), start, size, words (that begin in it) of every chunk of every text, in bytes
    of its UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(ids: list, counts: list, digests: list, ends: list, starts: list, words: list) -> pa.RecordBatch:
            pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            begin, end = np.array(starts, np.int32), np.array(ends, np.int32)
            where = pa.array(np.repeat(np.arange(len(ids)), counts), pa.int32())
            n_words = np.concatenate([*words, np.zeros(0, np.int64)]).astype(np.int32)
            columns = [pa.array(ids, pa.int64()).take(where), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array(begin), pa.array(end - begin), pa.array(n_words)], ["doc_id", "d1", "d2", "start", "size", "words"]
            )

        for batch in batches:
            doc_ids = batch.column(0)
            ids, counts, digests, ends, starts, words = [], [], [], [], [], []
            for row, data, own in _texts(batch.column(1)):
                raw, at = data.tobytes(), 0
                for to in own:
                    digests.append(hashlib.blake2b(raw[at:to], digest_size=16).digest())
                    starts.append(at)
                    at = to
                if own:
                    words.append(np.add.reduceat(word_starts(data).astype(np.int64), [0, *own[:-1]]))
                ends += own
                ids.append(doc_ids[row].as_py())
                counts.append(len(own))
                if len(digests) > 100_000:
                    yield batch_of(ids, counts, digests, ends, starts, words)
                    ids, counts, digests, ends, starts, words = [], [], [], [], [], []
            yield batch_of(ids, counts, digests, ends, starts, words)

    wanted = docs.select(F.col("doc_id").cast("long"), "text")
    return wanted.mapInArrow(run, "doc_id long, d1 long, d2 long, start int, size int, words int")


def _shared_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, d1, d2, start, size, words, owner, last, run of the chunks that two or more documents hold: owner
    and last are the smallest and largest doc_id that hold it, neighbours of one document have one run.

    A digest that makes up more than one in HOT of all chunks, of which there are HOT at most, is joined in
    SALTS parts, so no task meets all of its rows."""
    place = F.col("start").cast("long") * 65536 + F.col("size") * 256 + F.col("words")
    table = chunk_table(docs.where("doc_id is not null"))
    chunks = materialize(table.select("doc_id", "d1", "d2", place.alias("p")), "chunks")
    held = chunks.groupBy("d1", "d2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    held = materialize(held.where("owner < last"), "held")
    hot = held.where(F.col("n") > chunks.count() // HOT).select("d1", "d2", F.lit(True).alias("hot"))
    hot = F.broadcast(hot)  # HOT rows at most
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    salted = lambda part: F.when(F.col("hot"), F.xxhash64("d1", part)).otherwise(F.col("d1"))
    left = chunks.join(hot, ["d1", "d2"], "left").select(salted(salt).alias("k"), "d2", "doc_id", "p")
    parts = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))
    right = held.join(hot, ["d1", "d2"], "left").withColumn("part", parts).select(salted(F.col("part")).alias("k"), "d1", "d2", "owner", "last")
    shared = left.join(right, ["k", "d2"]).drop("k")
    w = Window.partitionBy("doc_id").orderBy("p", "owner")
    end = lambda c: F.floor(c / 65536) + F.pmod(F.floor(c / 256), F.lit(256))
    before = F.lag("p").over(w)
    runs = shared.withColumns({"new": F.coalesce(F.floor(F.col("p") / 65536) > end(before), F.lit(True)), "again": F.coalesce(F.col("p") == before, F.lit(False))})
    runs = runs.withColumn("run", F.sum(F.col("new").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.where("not again").select(
        "doc_id", "d1", "d2", F.floor(F.col("p") / 65536).cast("int").alias("start"), F.pmod(F.floor(F.col("p") / 256), F.lit(256)).cast("int").alias("size"),
        F.pmod("p", F.lit(256)).cast("int").alias("words"), "owner", "last", "run",
    )
    runs = materialize(runs, "runs")
    discard(chunks, held)
    return runs


def _beside(docs: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, pos, ahead, bytes: up to REACH bytes of the text before or (ahead) from ``pos`` on, for places
    (doc_id, pos, ahead). Several texts of one doc_id give a row each."""
    wanted = places.groupBy("doc_id").agg(F.collect_set(F.struct("pos", "ahead")).alias("at"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id").select("doc_id", "text", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["doc_id", "pos", "ahead", "bytes"], [pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
        for batch in batches:
            rows, size = [], 0
            for doc_id, text, at in zip(*batch.columns):
                raw = (text.as_py() or "").encode()
                for place in at.as_py():
                    pos, ahead = place["pos"], place["ahead"]
                    rows.append((doc_id.as_py(), pos, ahead, raw[pos : pos + REACH] if ahead else raw[max(0, pos - REACH) : pos]))
                    size += len(rows[-1][3])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows, size = [], 0
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return texts.mapInArrow(run, "doc_id long, pos int, ahead boolean, bytes binary")


def common_run(a: bytes, b: bytes, ahead: bool) -> int:
    """Length of the common beginning (``ahead``) or end of two byte strings."""
    n = min(len(a), len(b))
    x, y = (np.frombuffer(v, np.uint8) for v in ((a[:n], b[:n]) if ahead else (a[len(a) - n :][::-1], b[len(b) - n :][::-1])))
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else n


def _reaches(docs: DataFrame, chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, run, back, forth, more_words: bytes by which a span's ends move out, and the words that begin there."""
    sides = F.array(
        F.struct(F.lit(False).alias("ahead"), F.col("start").alias("pos"), F.col("first").alias("edge"), F.lit(0).alias("shift")),
        F.struct(F.lit(True).alias("ahead"), F.col("end").alias("pos"), F.col("final").alias("edge"), F.col("final.size").alias("shift")),
    )
    edges = spans.select("doc_id", "run", F.explode(sides).alias("s")).select("doc_id", "run", "s.ahead", "s.pos", "s.shift", "s.edge.d1", "s.edge.d2", "s.edge.owner", "s.edge.last")
    held_at = chunks.where("doc_id = owner or doc_id = last").groupBy("d1", "d2").agg(
        F.min(F.when(F.col("doc_id") == F.col("owner"), F.col("start"))).alias("owner_at"), F.min(F.when(F.col("doc_id") == F.col("last"), F.col("start"))).alias("last_at")
    )
    edges = edges.join(materialize(held_at, "places"), ["d1", "d2"])
    others = F.array(*(F.struct(F.col(d).alias("o_id"), (F.col(f"{d}_at") + F.col("shift")).cast("int").alias("o_pos")) for d in ("owner", "last")))
    pairs = edges.select("doc_id", "run", "ahead", "pos", F.explode(others).alias("o")).select("doc_id", "run", "ahead", "pos", "o.*")
    pairs = materialize(pairs.where("o_id != doc_id"), "edges")
    places = pairs.select("doc_id", "pos", "ahead").union(pairs.select("o_id", "o_pos", "ahead")).distinct()
    beside = materialize(_beside(docs, places), "beside")
    own = pairs.join(beside.withColumnRenamed("bytes", "mine"), ["doc_id", "pos", "ahead"])
    theirs = beside.select(F.col("doc_id").alias("o_id"), F.col("pos").alias("o_pos"), "ahead", F.col("bytes").alias("other"))
    both = own.join(theirs, ["o_id", "o_pos", "ahead"]).select("doc_id", "run", "ahead", "mine", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved, words = [], []
            for ahead, mine, other in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                n = common_run(mine, other, ahead)
                starts = word_starts(np.frombuffer(mine, np.uint8))
                if ahead and len(starts):
                    starts[0] = False  # it may belong to the word at the end of the span
                moved.append(n)
                words.append(int((starts[:n] if ahead else starts[len(starts) - n :]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(moved, pa.int32()), pa.array(words, pa.int32())], ["doc_id", "run", "ahead", "moved", "words"])

    found = both.mapInArrow(run, "doc_id long, run long, ahead boolean, moved int, words int")
    best = found.groupBy("doc_id", "run", "ahead").agg(F.max(F.struct("moved", "words")).alias("m"))
    side = lambda ahead, field: F.max(F.when(F.col("ahead") == ahead, F.col(f"m.{field}")))
    return best.groupBy("doc_id", "run").agg(side(False, "moved").alias("back"), side(True, "moved").alias("forth"), F.sum("m.words").alias("more_words"))


def _spans(docs: DataFrame, chunks: DataFrame, least_words: int) -> DataFrame:
    edge = F.struct("d1", "d2", "owner", "last", "size")
    spans = chunks.groupBy("doc_id", "run").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"), F.min("owner").alias("owner"),
        F.min_by(edge, F.struct("start", "size")).alias("first"), F.max_by(edge, F.struct("start", "size")).alias("final"),
        F.count("*").alias("chunks"), F.sum("words").alias("words"),
        F.sum(F.when(F.col("owner") < F.col("doc_id"), F.col("size")).otherwise(0)).alias("repeated"),
    )
    spans = materialize(spans, "spans")
    out = spans.join(_reaches(docs, chunks, spans), ["doc_id", "run"], "left")
    return out.select(
        "doc_id", "run", (F.col("start") - F.coalesce("back", F.lit(0))).alias("start"), (F.col("end") + F.coalesce("forth", F.lit(0))).alias("end"),
        "owner", "chunks", "repeated", (F.col("words") + F.coalesce("more_words", F.lit(0))).alias("words"),
    ).where(F.col("words") >= least_words)


def shared_spans(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, start, end (bytes), owner, chunks, repeated, words of each span that other documents hold too.

    owner is the smallest doc_id among the owners of the span's chunks; repeated counts the bytes of chunks
    that smaller doc_ids own. Spans of a document may overlap where their ends were moved out. Rows that
    repeat a doc_id are one document; rows with a null doc_id are compared with nothing. Null and empty
    texts have no chunks; very long texts are cut in pieces and compared whole. Extra columns are
    ignored. No tables, no rows.
    """
    return _spans(docs, _shared_chunks(docs), least_words).drop("run")


def repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row a document that shares a passage with another: doc_id, n_spans, shared_bytes,
    repeated_bytes (those that a smaller doc_id owns), owners (doc_ids, ascending), spans (start:end in
    bytes, comma-joined in order). Spans that touch are one. Documents without shared passages have no row."""
    found = shared_spans(docs, least_words)
    place = F.array_sort(F.collect_list(F.struct("start", "end")))
    merged = F.aggregate(
        "place", F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= s["start"]),
            F.concat(
                F.slice(done, F.lit(1), F.size(done) - 1),
                F.array(F.struct(F.get(done, F.size(done) - 1)["start"].alias("start"), F.greatest(F.get(done, F.size(done) - 1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))))),
    )
    by_doc = found.groupBy("doc_id").agg(
        place.alias("place"), F.sum("repeated").cast("long").alias("repeated_bytes"), F.array_sort(F.collect_set("owner")).alias("owners")
    )
    by_doc = by_doc.withColumn("place", merged)
    return by_doc.select(
        "doc_id", F.size("place").cast("long").alias("n_spans"),
        F.aggregate("place", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("shared_bytes"), "repeated_bytes", "owners",
        F.array_join(F.transform("place", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"),
    )


def remove_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without the chunks of its spans that a smaller doc_id owns; what a document owns stays in it,
    so every passage is left in one document at least. Bytes by which a span's ends were moved out stay.

    Cuts move inward to whole characters. All rows and columns stay; n_chars, if present, follows.
    """
    chunks = _shared_chunks(docs)
    long = _spans(docs, chunks, least_words).select("doc_id", "run")
    later = chunks.join(long, ["doc_id", "run"]).where("owner < doc_id")
    cuts = later.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("cuts"))
    names, at = docs.columns, docs.columns.index("text")
    row = docs.select(F.struct(*(docs[c] for c in names)).alias("row"))
    joined = row.join(cuts, row["row.doc_id"].cast("long") == cuts["doc_id"], "left").select("row.*", cuts["cuts"].alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for k, spans in enumerate(batch.column(len(names)).to_pylist()):
                if not spans or texts[k] is None:
                    continue
                whole: list[list[int]] = []
                for span in spans:
                    if whole and whole[-1][1] == span["start"]:
                        whole[-1][1] = span["end"]
                    else:
                        whole.append([span["start"], span["end"]])
                raw, out, done = texts[k].encode(), [], 0
                for a, b in whole:
                    b = min(b, len(raw))
                    while a < b and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while b < len(raw) and b > a and raw[b] & 0xC0 == 0x80:
                        b -= 1
                    out.append(raw[done:a])
                    done = max(done, b)
                texts[k] = b"".join([*out, raw[done:]]).decode()
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out
