"""Token ids as files of fixed-length pages, coded with one canonical length-limited Huffman code.

A first pass encodes every text once and writes its ids; ids are counted over the whole corpus from there. The
counts, one for each id of the vocabulary, give code lengths of at most MAX_BITS (package-merge), and lengths
alone give the canonical codes. A second pass deals the ids out by ranges of doc_id and writes each range as one
file of pages of PAGE bytes, so files in the order of their names hold documents in ascending order of doc_id.
A page stands alone: it tells its file, the place of its first id there, the documents that have ids in it, and a
bit offset for every BLOCK ids. Readers take any page of any file and decode its blocks side by side through one
table.

A page, big-endian: HEADER; a DOCUMENT for each document; a 32-bit bit offset for each block; the codes,
first bit highest; zeros; one line feed, which lets Spark's text writer write pages.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.llm.common import delete_path, materialize, shared_dir

MAX_BITS = 20
BLOCK = 256
PAGE = 65536
MAGIC = b"TKP1"
# magic, CRC of the code lengths, file, first id in the file, ids, documents, blocks, CRC of what follows
HEADER = struct.Struct(">4sIIQIIII")
DOCUMENT = np.dtype([("doc_id", ">i8"), ("null", "u1"), ("start", ">u8"), ("n", ">u8")])
ROOM = 8 * (PAGE - 1 - HEADER.size - 16)  # bits; a word of codes may be begun, and another is read past the end
MAX_TOKENIZER_BYTES = 64 << 20
KNOWN_PIECES = 500_000
PART_CHARS = 1 << 16
BATCH_BYTES = 4 << 20
JOINED = 1000  # pieces that the library gets as one text
PART_IDS = 1 << 16  # ids in a row between the passes, at most
ROWS = 1000
CODED = "doc_id long, h long, row long, n long, at long, ids binary"
PIECES = "file int, doc_id long, start long, n long, at long, n_ids long, crc long"


# ------------------------------------------------------------------------------------------- the code


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``max_bits`` bits, 0 for ids that never occur.

    Package-merge: each round pairs the cheapest of a list into packages and merges these with the single
    ids; how many ids are among the first 2n - 2 of each list tells the lengths. Ties go to the smaller id.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids have no code of {max_bits} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    single, packages = [], np.empty(0)
    for _ in range(max_bits):
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        single.append(order < len(weights))
        merged = both[order][: len(order) // 2 * 2]
        packages = merged[::2] + merged[1::2]
    take, own = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for is_single in reversed(single):
        n = int(is_single[:take].sum())
        own[:n] += 1
        take = 2 * (take - n)
    lengths[used] = own
    return lengths


@dataclass
class Code:
    """Canonical codes of some lengths: shorter ones first, then smaller ids."""

    lengths: np.ndarray

    def __post_init__(self) -> None:
        self.crc = zlib.crc32(self.lengths.tobytes())
        self.bits = max(1, int(self.lengths.max(initial=0)))
        ids = np.flatnonzero(self.lengths)
        self.order = ids[np.argsort(self.lengths[ids], kind="stable")]
        n_bits = self.lengths[self.order].astype(np.uint64)
        share = np.uint64(1) << (np.uint64(self.bits) - n_bits)
        first = np.cumsum(share) - share  # the code with zeros behind it, up to the longest length
        self.codes = np.zeros(len(self.lengths), np.uint64)
        self.codes[self.order] = first >> (np.uint64(self.bits) - n_bits)
        self._share = share

    def table(self) -> np.ndarray:
        """For each run of ``bits`` bits, the id that it begins with, times 32, and the length of its code."""
        entry = (self.order.astype(np.uint32) << np.uint32(5)) | self.lengths[self.order]
        out = np.zeros(1 << self.bits, np.uint32)
        filled = np.repeat(entry, self._share.astype(np.int64))
        out[: len(filled)] = filled
        return out

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The codes of ``ids`` as 64-bit words, and the bit offset of every id."""
        n_bits = self.lengths[ids].astype(np.int64)
        if len(ids) and not n_bits.all():
            raise ValueError("an id without a code")
        end = np.cumsum(n_bits)
        at = end - n_bits
        word, over = at >> 6, (at & 63) + n_bits - 64
        codes = self.codes[ids]
        crossing = over > 0
        high = np.where(crossing, codes >> np.maximum(over, 0).astype(np.uint64), codes << np.maximum(-over, 0).astype(np.uint64))
        out = np.zeros((int(end[-1]) + 63 >> 6) if len(ids) else 0, np.uint64)
        if len(ids):
            fresh = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[fresh]] = np.bitwise_or.reduceat(high, fresh)
            out[word[crossing] + 1] |= codes[crossing] << (64 - over[crossing]).astype(np.uint64)
        return out.astype(">u8").tobytes(), at


def unpack(blocks: np.ndarray, sizes: np.ndarray, data: np.ndarray, code: Code, table: np.ndarray) -> np.ndarray:
    """The ids of blocks, one after the other: ``blocks`` are bit offsets into ``data``, ``sizes`` ids in each.

    All blocks are decoded side by side, an id of each at a time. ``data`` needs four bytes behind the last code.
    """
    begin = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint32)
    order = np.argsort(-sizes, kind="stable")
    at, put, sizes = blocks[order], begin[order], sizes[order]
    windows = np.ndarray((len(data) - 3,), ">u4", buffer=data, strides=(1,))  # 32 bits from every byte on
    shift, mask = 32 - code.bits, np.int64((1 << code.bits) - 1)
    for i in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(-sizes, -i, side="left"))
        at, put = at[:live], put[:live]
        found = table[(windows[at >> 3].astype(np.int64) >> (shift - (at & 7))) & mask]
        out[put + i] = found >> 5
        at = at + (found & 31)
    return out


# ------------------------------------------------------------------------------------------- the pages


def pages_of(batches: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], code: Code, file: int) -> Iterator[bytes]:
    """Pages of one file from (ids, doc_ids, counts) of documents in order; ``doc_ids`` is masked where null."""
    first, ids = 0, np.empty(0, np.uint32)
    docs = np.empty(0, DOCUMENT)
    at = 0  # where the next document starts
    for more, doc_ids, counts in batches:
        fresh = np.zeros(len(counts), DOCUMENT)
        fresh["doc_id"], fresh["null"] = np.ma.filled(doc_ids, 0), np.ma.getmaskarray(doc_ids)
        fresh["n"], fresh["start"] = counts, at + np.cumsum(counts) - counts
        at += int(counts.sum())
        ids, docs = np.concatenate([ids, more]), np.concatenate([docs, fresh])
        while True:
            page, taken, full = _page(ids, docs, code, file, first)
            if not full:  # more may follow
                break
            yield page
            first, ids = first + taken, ids[taken:]
            docs = docs[docs["start"] + docs["n"] > first]
    if len(ids):
        yield _page(ids, docs, code, file, first)[0]


def _page(ids: np.ndarray, docs: np.ndarray, code: Code, file: int, first: int) -> tuple[bytes, int, bool]:
    """The next page, how many ids it takes, and whether it is full; one that is not full is only built at the end."""
    near = ids[: ROOM // 6]
    cost = code.lengths[near].astype(np.int64)
    if len(near) < len(ids) and cost.sum() <= ROOM:  # a page of very short codes
        near = ids[: ROOM + 1]
        cost = code.lengths[near].astype(np.int64)
    starts = docs["start"].astype(np.int64) - first
    inside = np.maximum(starts, 0)
    np.add.at(cost, inside[inside < len(near)], 8 * DOCUMENT.itemsize)
    total = np.cumsum(cost)
    most = int(np.searchsorted(total, ROOM, side="right"))
    n = int(np.searchsorted(total, ROOM - 32 * (-(-most // BLOCK)), side="right"))
    full = n < len(ids)
    payload, offsets = code.pack(near[:n])
    own = docs[starts < n].astype(DOCUMENT).tobytes()  # joined arrays have the byte order of the machine
    body = own + offsets[::BLOCK].astype(">u4").tobytes() + payload
    body = body.ljust(PAGE - 1 - HEADER.size, b"\0")
    head = HEADER.pack(MAGIC, code.crc, file, first, n, len(own) // DOCUMENT.itemsize, -(-n // BLOCK), zlib.crc32(body))
    return head + body + b"\n", n, full


@dataclass
class Piece:
    """Ids of a document that lie in one page: ``at`` is their place in the document, ``n`` its whole length."""

    file: int
    doc_id: int | None
    start: int
    n: int
    at: int
    ids: np.ndarray


def read_pieces(pages: list[bytes], code: Code, table: np.ndarray) -> Iterator[Piece]:
    """The documents' pieces in some pages, whose blocks are decoded together; a damaged page is an error."""
    heads, docs, offsets, sizes = [], [], [], []
    for k, page in enumerate(pages):
        magic, crc, file, first, n, n_docs, n_blocks, body = HEADER.unpack_from(page)
        if magic != MAGIC or crc != code.crc or body != zlib.crc32(page[HEADER.size : PAGE - 1]):
            raise ValueError(f"a damaged page, or one of another code (file {file}, first id {first})")
        heads.append((file, first, n))
        docs.append(np.frombuffer(page, DOCUMENT, n_docs, HEADER.size))
        at = HEADER.size + n_docs * DOCUMENT.itemsize
        offsets.append(np.frombuffer(page, ">u4", n_blocks, at).astype(np.int64) + 8 * (k * PAGE + at + 4 * n_blocks))
        sizes.append(np.minimum(BLOCK, n - BLOCK * np.arange(n_blocks)))
    if not pages:
        return
    ids = unpack(np.concatenate(offsets), np.concatenate(sizes), np.frombuffer(b"".join(pages), np.uint8), code, table)
    begin = 0
    for (file, first, n), own in zip(heads, docs):
        lo = np.maximum(own["start"].astype(np.int64), first)
        hi = np.minimum((own["start"] + own["n"]).astype(np.int64), first + n)
        for d, a, b in zip(own.tolist(), lo.tolist(), hi.tolist()):
            yield Piece(file, None if d[1] else d[0], d[2], d[3], a - d[2], ids[begin + a - first : begin + b - first])
        begin += n


# ---------------------------------------------------------------------------------------- the checksum


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, whose bits are in reflected order."""
    out = 0
    while b:
        if b & 0x80000000:
            out ^= a
        a = (a >> 1) ^ (0xEDB88320 if a & 1 else 0)
        b = (b << 1) & 0xFFFFFFFF
    return out


def crc_before(crc: int, n_bytes: int) -> int:
    """What a piece of that CRC adds to the CRC of a whole in which ``n_bytes`` follow it: the parts are XORed."""
    power, bits = 0x00800000, n_bytes  # x to the 8th
    while bits and crc:
        if bits & 1:
            crc = _times(crc, power)
        power, bits = _times(power, power), bits >> 1
    return crc


# ----------------------------------------------------------------------------------------- the tokenizer


# A vocabulary with this splitting rule never joins what stands on both sides of such a blank.
_CUT = re.compile("(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")
_SAFE = r"\A[!-~À-ɏ](?s:.*[!-~À-ɏ])?\z"  # of Arrow, as the next two
# It always splits between a letter and one of these marks, and after a line feed between a mark and a letter.
_ENDS = (r"([A-Za-zÀ-ÖØ-öø-ɏ])([.,;:!?])", r"([!-~À-ɏ]\n)([A-Za-zÀ-ÖØ-öø-ɏ])")


class Encoder:
    """Ids of whole texts by a tokenizer of the tokenizers library.

    A byte-level vocabulary splits texts by a fixed rule before it merges, and always at a single blank
    between two marks; there texts are cut into words, words are cut at the ends of sentences and clauses, and
    each distinct piece is encoded once and looked up from then on; of more than KNOWN_PIECES those stay that were met
    again. New pieces that follow a blank are encoded JOINED at a time, with blanks between them; the ids that begin
    with a blank tell where each begins. Any other vocabulary, and any text with other blanks, is encoded
    without that. Parts of very long texts are encoded one by one between such cuts.
    """

    def __init__(self, source: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec, self.tokenizer, self.end_id = json.loads(source), Tokenizer.from_str(source), end_id
        rule = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and not spec.get("truncation") and not spec.get("padding")
        plain = plain and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec.get("added_tokens", []))
        self.cuts = plain and rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space", True)
        self.finer = not any(set(".,;:!?\n") & set(t["content"]) for t in spec.get("added_tokens", []))
        words = self.tokenizer.get_vocab(with_added_tokens=False)
        self.opens = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, bool)
        self.opens[[i for word, i in words.items() if word.startswith("Ġ")]] = True
        self._forget()

    def _forget(self) -> None:
        """Known pieces and in how many lookups they were met; ids of piece i are those from starts[i] on. In
        front of a piece stands a blank if none stands there in its text."""
        self.known, self.met = pa.array([], pa.large_string()), np.zeros(0, np.int32)
        self.ids, self.sizes, self.starts = np.empty(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _make_room(self) -> None:
        """Only pieces met more than once stay, and of those none if they are too many."""
        stay = np.flatnonzero(self.met > 1)
        if 2 * len(stay) > KNOWN_PIECES:
            return self._forget()
        n = self.sizes[stay]
        self.ids, self.sizes, self.starts = self._ids_at(stay), n, np.cumsum(n) - n
        self.known, self.met = self.known.take(pa.array(stay)), np.ones(len(stay), np.int32)

    def _ids_at(self, place: np.ndarray) -> np.ndarray:
        n = self.sizes[place]
        return self.ids[np.repeat(self.starts[place] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def _whole(self, text: str) -> np.ndarray:
        parts, at = [], 0
        while self.cuts and len(text) - at > PART_CHARS and (cut := _CUT.search(text, at + PART_CHARS)):
            parts.append(text[at : cut.start()])
            at = cut.start()
        found = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in [*parts, text[at:]]]
        return np.concatenate(found)

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        own = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(own), np.uint32), np.fromiter(map(len, own), np.int64, len(own))

    def _coded(self, pieces: pa.Array, led: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces and how many each has; all of them follow a blank, or none."""
        if not led:
            return self._one_by_one(pc.utf8_ltrim(pieces, characters=" ").to_pylist())
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), pa.scalar(" ", pa.large_string()))[0].as_py()
        ids = np.array(self.tokenizer.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, np.uint32)
        begin = np.flatnonzero(self.opens[ids])
        if len(begin) == len(pieces):  # a piece has no other blank, so each has one such id, its first
            return ids, np.diff(begin, append=len(ids))
        return self._one_by_one([" " + p for p in pieces.to_pylist()])

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where distinct pieces are among the known ones; those that are not are encoded first."""
        found = pc.index_in(pieces, value_set=self.known)
        if len(self.known) and len(self.known) + found.null_count > KNOWN_PIECES:
            self._make_room()
            found = pc.index_in(pieces, value_set=self.known)
        missing = np.asarray(found.is_null())
        place = np.array(found.fill_null(0))
        self.met[place[~missing]] += 1
        if found.null_count:
            fresh, before = pieces.filter(pa.array(missing)), len(self.known)
            bare = pc.starts_with(fresh, " ")
            fresh = pa.concat_arrays([own := fresh.filter(pc.invert(bare)), fresh.filter(bare)])
            lots = [self._coded(lot, i == 0) for i, x in enumerate((own, fresh[len(own) :])) for lot in _lots(x)]
            self.ids = np.concatenate([self.ids, *(ids for ids, _ in lots)])
            self.sizes = np.concatenate([self.sizes, *(n for _, n in lots)])
            self.starts = np.cumsum(self.sizes) - self.sizes
            self.known = pa.concat_arrays([self.known, fresh])
            self.met = np.concatenate([self.met, np.ones(len(fresh), np.int32)])
            bare = np.asarray(bare)
            place[missing] = before + np.where(bare, len(own) - 1 + np.cumsum(bare), np.cumsum(~bare) - 1)
        return place

    def _words(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words with a blank before each, how many each has, and which are safe to cut around;
        the others get none."""
        safe = np.asarray(pc.match_substring_regex(names, _SAFE))
        own = names.filter(pa.array(safe))
        for end in _ENDS if self.finer else ():
            own = pc.replace_substring_regex(own, end, r"\1 \2")
        sizes = np.zeros(len(names), np.int64)
        if not len(own):
            return np.empty(0, np.uint32), sizes, safe
        cut = pc.split_pattern(own, " ")
        starts, pieces = np.asarray(cut.offsets, np.int64)[:-1] - cut.offsets[0].as_py(), cut.flatten()
        led = np.zeros(len(pieces), bool)
        led[starts] = True
        coded = pc.if_else(pa.array(led), pieces, pc.binary_replace_slice(pieces, 0, 0, " ")).dictionary_encode()
        place = self._places(coded.dictionary)[np.asarray(coded.indices)]
        sizes[safe] = np.add.reduceat(self.sizes[place], starts)
        return self._ids_at(place), sizes, safe

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """How texts are put together: the first word of each, the distinct word at each place, ids of the distinct
        words and how many each has, places that are looked up, and what each text begins with by itself: its first
        word, which no blank leads, or all of a text that is not looked up."""
        cut = pc.split_pattern(texts.cast(pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        names, which = coded.dictionary, np.asarray(coded.indices)
        starts = np.asarray(cut.offsets, np.int64) - cut.offsets[0].as_py()
        ids, sizes, safe = self._words(names) if self.cuts else (np.empty(0, np.uint32), np.zeros(len(names), np.int64), np.zeros(len(names), bool))
        whole = np.logical_or.reduceat(~safe[which], starts[:-1])
        use = np.repeat(~whole, np.diff(starts))
        use[starts[:-1]] = False
        first = names.take(coded.indices.take(pa.array(starts[:-1]))).to_pylist()
        heads = self.tokenizer.encode_batch_fast(["" if w else f for f, w in zip(first, whole.tolist())], add_special_tokens=False)
        own = [self._whole(texts[i].as_py()) if w else np.array(h.ids, np.uint32) for i, (h, w) in enumerate(zip(heads, whole.tolist()))]
        return starts, which, ids, sizes, use, own

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's followed by the end id, and their number by text; null is empty."""
        if not len(texts):
            return np.empty(0, np.uint32), np.zeros(0, np.int64)
        starts, which, words, n_of, use, own = self._cut(texts.fill_null(""))
        sizes = np.where(use, n_of.astype(np.int32)[which], 0)
        n_own = np.fromiter(map(len, own), np.int64, len(own))
        counts = np.add.reduceat(sizes, starts[:-1]).astype(np.int64) + n_own + 1
        ends = np.cumsum(counts)
        out, looked_up = np.empty(int(ends[-1]), np.uint32), np.ones(int(ends[-1]), bool)
        for at, n, ids in zip((ends - counts).tolist(), n_own.tolist(), own):
            out[at : at + n] = ids
            looked_up[at : at + n] = False
        out[ends - 1], looked_up[ends - 1] = self.end_id, False
        if not use.any():
            return out, counts
        n = sizes[use]
        shift = (np.cumsum(n_of) - n_of).astype(np.int32)[which[use]] - (np.cumsum(n, dtype=np.int32) - n)
        out[looked_up] = words[np.repeat(shift, n) + np.arange(int(n.sum()), dtype=np.int32)]
        return out, counts

    def count(self, texts: pa.Array) -> np.ndarray:
        """How often each id occurs in what ``encode`` gives."""
        return np.bincount(self.encode(texts)[0])


def _lots(pieces: pa.Array) -> Iterator[pa.Array]:
    for at in range(0, len(pieces), JOINED):
        yield pieces.slice(at, JOINED)


def _slices(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of some BATCH_BYTES of the column, a row at least."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            most = (ends[at - 1] if at else 0) + BATCH_BYTES
            to = max(at + 1, int(np.searchsorted(ends, most, side="right")))
            yield batch.slice(at, to - at)
            at = to


_ENCODERS: dict[tuple[int, int], Encoder] = {}


def _encoder(source: str, end_id: int) -> Encoder:
    """One encoder a worker, which keeps what it knows from task to task."""
    key = (zlib.crc32(source.encode()), end_id)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(source, end_id)
    return _ENCODERS[key]


# ---------------------------------------------------------------------------------------------- Spark


def _shared_tokenizer(spark: SparkSession, path: str):  # noqa: ANN202
    """The vocabulary file, which the driver reads and sends to the workers, whatever its path on them."""
    if os.path.getsize(path) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{path} has more than {MAX_TOKENIZER_BYTES} bytes")
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _id_type(source: str, end_id: int) -> np.dtype:
    """How ids are kept between the passes: two bytes where the vocabulary allows it."""
    from tokenizers import Tokenizer

    return np.dtype("<u2" if max([end_id, *Tokenizer.from_str(source).get_vocab().values()]) < 1 << 16 else "<u4")


def _ids_in(column: pa.Array, kind: np.dtype) -> np.ndarray:
    """All ids of some rows of CODED, one after the other."""
    own = column.cast(pa.large_binary())
    ends = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
    return np.frombuffer(own.buffers()[2], kind, int(ends[-1] - ends[0]) // kind.itemsize, int(ends[0]))


def _coded_rows(batch: pa.RecordBatch, ids: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of CODED for a batch of (doc_id, h, row, text), whose texts have ``counts`` of ``ids``."""
    parts = -(-counts // PART_IDS)
    of = np.repeat(np.arange(len(counts)), parts)
    at = PART_IDS * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
    ends = np.concatenate([[0], np.cumsum(np.minimum(counts[of] - at, PART_IDS))])
    for i in range(0, len(of), ROWS):
        j = min(i + ROWS, len(of))
        offsets = ((ends[i : j + 1] - ends[i]) * ids.itemsize).astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(offsets), pa.py_buffer(ids[ends[i] : ends[j]].tobytes())])
        same = [batch.column(c).take(pa.array(of[i:j])) for c in range(3)]
        yield pa.RecordBatch.from_arrays([*same, pa.array(counts[of[i:j]]), pa.array(at[i:j]), data], ["doc_id", "h", "row", "n", "at", "ids"])


def encode(docs: DataFrame, shared, end_id: int, kind: np.dtype) -> DataFrame:  # noqa: ANN001
    """CODED: the ids of whole texts, ends included, in rows of at most PART_IDS. ``n`` is a document's number of ids,
    ``at`` the place of the row's first; ``row`` tells rows of one doc_id and text apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, end_id)
        for batch in _slices(batches, 3):
            ids, counts = encoder.encode(batch.column(3))
            yield from _coded_rows(batch, ids.astype(kind), counts)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"), "text")
    return own.mapInArrow(run, CODED)


def id_counts(coded: DataFrame, kind: np.dtype) -> DataFrame:
    """id, n over all rows of CODED: a row for each id of the vocabulary that occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1, np.int64)
        for batch in _slices(batches, 0):
            own = np.bincount(_ids_in(batch.column(0), kind))
            n, own = (n, own) if len(n) >= len(own) else (own, n)
            n[: len(own)] += own
        ids = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(n[ids], pa.int64())], ["id", "n"])

    return coded.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, max_bits: int = MAX_BITS) -> None:
    """Encode whole texts, each followed by ``end_id``, into ``path``: a table ``code`` of (id, bits) and files
    of ``pages``.

    Documents go by doc_id, nulls first, rows of one doc_id by a hash of their texts. A null or empty text
    is the end id alone; very long texts run over pages; an empty table gives a code and no pages. Repeated
    rows are documents of their own; columns other than doc_id and text are ignored. The counts that the
    driver gets are bounded by the vocabulary. Texts are read and encoded once; their ids lie in the shared folder
    until the pages are written.
    """
    spark = docs.sparkSession
    shared = _shared_tokenizer(spark, tokenizer_path)
    kind, between = _id_type(shared.value, end_id), shared_dir(spark, "ids")
    encode(docs, shared, end_id, kind).write.options(**{"compression": "zstd", "parquet.block.size": 32 << 20}).parquet(between)
    coded = spark.read.schema(CODED).parquet(between)
    counted = id_counts(coded, kind).toPandas()
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 0, np.int64)
    counts[counted["id"]] = counted["n"]
    lengths = code_lengths(counts, max_bits)
    book = [(i, int(b)) for i, b in enumerate(lengths.tolist()) if b]
    spark.createDataFrame(book, "id int, bits int").write.parquet(f"{path}/code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def documents() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for batch in _slices(batches, 3):
                own = batch.filter(pc.equal(batch.column(2), 0))  # rows that begin a document
                names = np.ma.array(own.column(0).fill_null(0).to_numpy(), mask=own.column(0).is_null().to_numpy(zero_copy_only=False))
                yield _ids_in(batch.column(3), kind).astype(np.uint32), names, own.column(1).to_numpy()

        for page in pages_of(documents(), Code(lengths), TaskContext.get().partitionId()):
            yield pa.RecordBatch.from_arrays([pa.array([page[:-1]], pa.binary())], ["value"])

    own = coded.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "row", "at").select("doc_id", "n", "at", "ids")
    own.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("compression", "none").text(f"{path}/pages")
    delete_path(spark, between)


def _code(spark: SparkSession, path: str) -> np.ndarray:
    book = spark.read.schema("id int, bits int").parquet(f"{path}/code").toPandas()
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 0, np.uint8)
    lengths[book["id"]] = book["bits"]
    return lengths


def _pieces(spark: SparkSession, path: str, pages_at_once: int):  # noqa: ANN202
    """An RDD of Piece: Spark's reader of fixed-length records splits the files between pages."""
    lengths = _code(spark, path)

    def run(pages: Iterator[bytes]) -> Iterator[Piece]:
        code, held = Code(lengths), []
        table = code.table()
        for page in pages:
            held.append(bytes(page))
            if len(held) == pages_at_once:
                yield from read_pieces(held, code, table)
                held = []
        yield from read_pieces(held, code, table)

    return spark.sparkContext.binaryRecords(f"{path}/pages/part-*", PAGE).mapPartitions(run)


def read_ids(spark: SparkSession, path: str, pages_at_once: int = 32) -> DataFrame:
    """file, doc_id, start (its first id's place in the file), n, at, ids: a row for each piece of a document
    that lies in one page; ``at`` is the piece's place in the document, whose pieces make n ids."""
    pieces = _pieces(spark, path, pages_at_once)
    schema = "file int, doc_id long, start long, n long, at long, ids array<int>"
    return pieces.map(lambda p: (p.file, p.doc_id, p.start, p.n, p.at, p.ids.tolist())).toDF(schema)


def read_digests(spark: SparkSession, path: str, pages_at_once: int = 32) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document in the files.

    A piece's part of its document's CRC does not depend on the other pieces, so parts are XORed; pieces
    that do not make the whole document are an error. The driver gets one number a file.
    """

    def digest(p: Piece) -> tuple:
        crc = zlib.crc32(p.ids.astype("<u4").tobytes())
        after = 4 * (p.n - p.at - len(p.ids))
        return p.file, p.doc_id, p.start, p.n, p.at, len(p.ids), crc_before(crc, after) if after else crc

    pieces = materialize(_pieces(spark, path, pages_at_once).map(digest).toDF(PIECES), "pieces")
    whole = pieces.groupBy("file", "start").agg(
        F.first("doc_id").alias("doc_id"), F.first("n").alias("n_tokens"), F.sum("n_ids").alias("_n"), F.bit_xor("crc").alias("ids_crc32")
    )
    ends = pieces.groupBy("file").agg(F.max(F.col("start") + F.col("n")).alias("n")).toPandas().sort_values("file")
    before = list(zip(ends["file"].tolist(), (ends["n"].cumsum() - ends["n"]).tolist()))
    base = spark.createDataFrame(before, "file int, before long")
    lost = F.raise_error(F.format_string("document at %d of file %d is not whole", "start", "file"))
    return whole.join(base, "file").select(
        "doc_id", (F.col("before") + F.col("start")).alias("start"),
        F.when(F.col("_n") == F.col("n_tokens"), F.col("n_tokens")).otherwise(lost.cast("long")).alias("n_tokens"), "ids_crc32",
    )
