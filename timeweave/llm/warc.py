"""WARC archives and their chunked record table.

Writing: each row of pages becomes one WARC/1.1 record, or several of at most ``chunk_bytes`` payload
bytes if the payload is larger (WARC segmentation: a first record and continuations, cut between
characters). Of records with equal payloads of ``least_bytes`` or more, the one of smallest page_id
holds the payload and the others are revisits without one. Every segment carries the SHA-256 of the
payload up to its end, so a reader can check as it goes and can say where a damaged record breaks.
Spark's text writer stores the records, a row each, gzipped; it works on any store that Spark writes.

Reading: archive files are decompressed as a stream, and every record, whoever wrote it, comes out as rows
of at most ``chunk_bytes`` each: record id, segment, chunk number, bytes, and the SHA-256 of the segment up
to there. No step holds a whole payload that is larger than a chunk: records of one chunk are hashed where
they stand, the chunks of larger ones are brought together by record id in order and hashed one after the
other. Damage does not end the reading: what is broken is marked, and reading goes on at the next record.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.llm.common import materialize

CHUNK_BYTES, LEAST_BYTES, FILE_BYTES = 1 << 16, 100, 32 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = (
    "record_id string, page_id long, record_type string, refers_to long, segment int, n_segments int, chunk_no int, n_chunks int, "
    "payload_bytes long, payload_digest string, running_digest string, damaged boolean, payload binary"
)
MOST_ROWS = 20_000  # of chunk_bytes at most, so no file comes near the 2 GiB that a binary cell can hold
_FEED = 1 << 18
_BATCH = 8 << 20


def cut_points(payload: bytes, size: int) -> list[int]:
    """Ends of chunks of at most ``size`` bytes that split no UTF-8 character; one chunk if empty."""
    ends, at = [], 0
    while len(payload) - at > size:
        to = at + size
        while to > at + 1 and payload[to] & 0xC0 == 0x80:
            to -= 1
        ends.append(to)
        at = to
    return [*ends, len(payload)]


def _head(fields: list[tuple[str, object]]) -> str:
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"


def records_of(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, record_id: str, size: int) -> Iterator[str]:
    """The record of a page as text, less the last CRLF, in segments if it is large."""
    digest = hashlib.sha256(payload).hexdigest()
    common = [
        ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", "_", url) if url else None),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", len(payload)),
        ("X-Page-ID", page_id),
    ]
    if refers_to is not None:
        head = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{record_id}>"), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        yield _head([*head, ("X-Segment-Count", 1), ("Content-Length", 0)]) + "\r\n"
        return
    ends, at, running = cut_points(payload, size), 0, hashlib.sha256()
    for k, to in enumerate(ends, 1):
        running.update(payload[at:to])
        many = len(ends) > 1
        head = [
            ("WARC-Type", "response" if k == 1 else "continuation"),
            ("WARC-Record-ID", f"<{record_id}>" if k == 1 else f"<{record_id}:{k}>"),
            *common,
            ("WARC-Segment-Number", k if many else None),
            ("WARC-Segment-Origin-ID", f"<{record_id}>" if k > 1 else None),
            ("WARC-Segment-Total-Length", len(payload) if many and k == len(ends) else None),
            ("X-Segment-Count", len(ends)),
            ("X-Running-Digest", f"sha256:{running.hexdigest()}"),
            ("Content-Length", to - at),
        ]
        yield _head(head) + payload[at:to].decode() + "\r\n"
        at = to


def write_archives(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, least_bytes: int = LEAST_BYTES) -> None:
    """Write ``pages`` (page_id, html[, url]) as gzipped WARC files in the folder ``path``.

    A null html is an empty payload. Rows equal in page_id and payload are each a response if no
    smaller page_id has the payload, else each a revisit; a row with a null page_id is a response. A very
    long html becomes many segments. An empty table writes no record. Columns of other names are ignored.
    """
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    own = pages.select(F.col("page_id").cast("long"), F.coalesce("html", F.lit("")).alias("html"), url.alias("url"))
    own = own.withColumn("digest", F.sha2("html", 256))
    marks = materialize(own.select("page_id", "digest", F.octet_length("html").alias("bytes")), "digests")
    first = marks.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    later = marks.join(first.where("first < last"), "digest").where("page_id > first")
    later = later.select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    total = marks.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    rows_a_file = min(MOST_ROWS, max(64, int(FILE_BYTES / (500 + total[1] / max(total[0], 1)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, size = [], 0
            for page, html, address, refers in zip(*batch.columns):
                n += 1
                for text in records_of(page.as_py(), address.as_py(), html.as_py().encode(), refers.as_py(), f"urn:page:{page.as_py()}:{part}.{n}", chunk_bytes):
                    out.append(text)
                    size += len(text)
                    if size > _BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                        out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    joined = own.join(later, ["page_id", "digest"], "left").select("page_id", "html", "url", "refers_to")
    writer = joined.mapInArrow(run, "value string").write.option("lineSep", "\r\n").option("compression", "gzip")
    writer.option("maxRecordsPerFile", rows_a_file).text(path)


class _Inflated:
    """Decompressed bytes of a file, taken piece by piece; several gzip members may follow each other."""

    def __init__(self, content: memoryview) -> None:
        self.content, self.at, self.buffer = content, 0, bytearray()
        self.gzip = bytes(content[:2]) == b"\x1f\x8b"
        self.stream = zlib.decompressobj(31)

    def _more(self) -> bool:
        if not self.gzip:
            piece = bytes(self.content[self.at : self.at + _FEED])
            self.at += len(piece)
            self.buffer += piece
            return bool(piece)
        while True:
            waiting = self.stream.unconsumed_tail
            if self.stream.eof:
                rest = self.stream.unused_data
                self.at -= len(rest)
                self.stream = zlib.decompressobj(31)
                waiting = b""
            if not waiting:
                waiting = bytes(self.content[self.at : self.at + _FEED])
                self.at += len(waiting)
            if not waiting:
                return False
            got = self.stream.decompress(waiting, _FEED)
            if got:
                self.buffer += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (found := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark))
            if not self._more():
                return None
        out = bytes(self.buffer[:found])
        del self.buffer[: found + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes, fewer where the file ends."""
        while len(self.buffer) < n and self._more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def skip(self, mark: bytes) -> bool:
        """Go on to the next ``mark``, which is left to be read; False at the end of the file."""
        while (found := self.buffer.find(mark)) < 0:
            del self.buffer[: max(0, len(self.buffer) - len(mark))]
            if not self._more():
                return False
        del self.buffer[:found]
        return True


def _number(text: str | None, default: int | None = None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d+", text) else default


def parse(content: memoryview, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Rows of CHUNKS from one archive file. A record that ends early or not where its length says has a last
    row that is damaged; so has a place where no record begins, without an id."""
    source = _Inflated(content)
    lost = (None, None, "damaged", None, 1, 1, 1, 1, 0, None, None, True, b"")
    try:
        while True:
            head = source.until(b"\r\n\r\n")
            if head is None:
                if source.buffer.strip():
                    yield lost
                return
            lines = head.decode(errors="replace").lstrip("\r\n").split("\r\n")
            f = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            length = _number(f.get("content-length"))
            if not lines[0].startswith("WARC/") or length is None or length < 0 or "warc-record-id" not in f:
                yield lost
                source.buffer[:0] = head[5:] + b"\r\n\r\n"  # a record may begin inside
                if not source.skip(b"WARC/1."):
                    return
                continue
            kind, origin = f.get("warc-type", "unknown"), f.get("warc-refers-to", "")
            digest = f.get("warc-payload-digest", "")
            n_chunks = max(1, -(-length // chunk_bytes))
            row = (
                f.get("warc-segment-origin-id", f["warc-record-id"]).strip("<>"), _number(f.get("x-page-id")),
                "response" if kind == "continuation" else kind, _number(origin.strip("<>").rpartition(":")[2]),
                _number(f.get("warc-segment-number"), 1), _number(f.get("x-segment-count"), 1),
            )
            size, named = _number(f.get("x-payload-length"), length), digest.removeprefix("sha256:").lower() if digest.startswith("sha256:") else None
            told, running, ends_well = f.get("x-running-digest", "").removeprefix("sha256:"), hashlib.sha256(), True
            for k in range(1, n_chunks + 1):
                piece = source.take(min(chunk_bytes, length - (k - 1) * chunk_bytes))
                ends_well = len(piece) == min(chunk_bytes, length - (k - 1) * chunk_bytes)
                if k == n_chunks and ends_well:
                    ends_well = source.take(4) == b"\r\n\r\n"
                running.update(piece)
                yield (*row, k, n_chunks, size, named, told or running.hexdigest(), not ends_well, piece)
                if not ends_well:
                    break
            if not ends_well and not source.skip(b"WARC/1."):
                return
    except zlib.error:
        yield lost


def read_chunks(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of the archives in ``path``: rows of CHUNKS, of ``chunk_bytes`` bytes at most."""
    types = [
        pa.string(), pa.int64(), pa.string(), pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.binary(),
    ]
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for row in parse(memoryview(content.as_buffer()), chunk_bytes):
                    rows.append(row)
                    size += len(row[-1]) + 300
                    if size > _BATCH:
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row a record, its payload checked: page_id, payload_bytes, payload_digest, record_type,
    refers_to, n_chunks (that it should have), intact (nothing is damaged or missing, and the digest of what
    was read is that of the head, where the head names a SHA-256; a revisit has nothing to check). Places
    where no record could be read have record_type damaged and are not intact. No chunks, no rows."""
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    alone = (F.col("n_segments") == 1) & (F.col("n_chunks") == 1)
    whole = F.coalesce(F.sha2("payload", 256) == F.col("payload_digest"), F.length("payload") == F.col("payload_bytes"))
    single = chunks.where(alone).select(*columns, "n_chunks", (~F.col("damaged") & ((F.col("record_type") == "revisit") | whole)).alias("intact"))
    schema = single.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema.fields]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_()]
        now, row, place, digest, length, ok, done = None, (), (0, 0, 0), None, 0, True, []

        def ended() -> tuple:
            segment, chunk, n_chunks = place
            whole = ok and segment == row[5] and chunk == n_chunks and length == row[1] and row[2] in (None, digest.hexdigest())
            return (*row[:5], row[5] + n_chunks - 1, whole)

        def batch_of() -> pa.RecordBatch:
            out = list(zip(*done)) if done else [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

        for batch in batches:
            at = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                record = at["record_id"][k].as_py()
                if record != now:
                    if now is not None:
                        done.append(ended())
                    now, digest, place, length, ok = record, hashlib.sha256(), (0, 0, 0), 0, True
                    row = tuple(at[c][k].as_py() for c in [*columns, "n_segments"])
                piece = at["payload"][k].as_buffer()
                digest.update(piece)
                length += piece.size
                segment, chunk, n_chunks = (at[c][k].as_py() for c in ("segment", "chunk_no", "n_chunks"))
                follows = (segment, chunk) == ((place[0], place[1] + 1) if place[1] < place[2] else (place[0] + 1, 1))
                told = at["running_digest"][k].as_py() if n_chunks == 1 else None
                ok = ok and follows and not at["damaged"][k].as_py() and told in (None, digest.hexdigest())
                place = (segment, chunk, n_chunks)
            if len(done) >= 10_000:
                yield batch_of()
                done = []
        if now is not None:
            done.append(ended())
        yield batch_of()

    many = chunks.where(~alone).repartition("record_id").sortWithinPartitions("record_id", "segment", "chunk_no")
    return single.unionByName(many.mapInArrow(run, schema))
