"""Secret scans: fixed patterns, and character Markov models that find other random strings.

Two order-2 character models, one of random strings and one of ordinary identifiers and words, are
trained from labelled samples. Runs of key characters are cut where fixed patterns match. What is left,
if of 20 or more characters, is a secret as a whole if the log-likelihood ratio of the two models is at
least ``bits_per_char`` for each character on average; else the segments of 20 or more characters are
whose ratio exceeds that bound most, each widened to the separators around it.
The labelled samples are drawn from the corpus itself: what the fixed patterns match is random, and of
what they leave, one token of SAMPLE_RUN or more characters in SAMPLE_SHARE by hash is ordinary (at most
``max_samples`` of each, the smallest by CRC over all texts). So recall on strings like those that the
patterns match says little of the models; tests measure it on others. Runs under MIN_RUN characters are
never scored. Seeded random strings in the usual key alphabets complete the random class.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.textkernel import column_bytes, hash_words

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "markov")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KEY_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SEPARATORS = b"+/_=-"
MIN_RUN, MIN_HEX, SAMPLE_RUN = 20, 24, 8
SAMPLE_SHARE = 16  # one in so many ordinary tokens, by hash
MAX_SAMPLES = 20_000
BITS_PER_CHAR = 2.0
TRIM_BITS, TRIM_ROUNDS = -0.5, 5

_CODE = np.full(256, -1, np.int64)
_CODE[[ord(c) for c in KEY_CHARS]] = np.arange(len(KEY_CHARS))
_HEXA = np.zeros(256, bool)
_HEXA[[ord(c) for c in "0123456789abcdef"]] = True

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping for each kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


@dataclass
class MarkovPair:
    """Bits by which the random class is likelier, for each (two characters before, character)."""

    ratio: np.ndarray

    def score(self, token: bytes) -> float:
        """Mean log-likelihood ratio in bits for each character."""
        return float(self.ratios(token).mean())

    def ratios(self, token: bytes) -> np.ndarray:
        """Log-likelihood ratio in bits of each character."""
        codes = _CODE[np.frombuffer(token, np.uint8)]
        start = len(KEY_CHARS)  # stands for what lies before the token
        padded = np.concatenate(([start, start], codes))
        return self.ratio[padded[:-2], padded[1:-1], padded[2:]]

    def segments(self, token: bytes, bits: float) -> list[tuple[int, int]]:
        """Spans of ``token`` that are likely random, in order: all of it, or its best segments."""
        ratios = self.ratios(token)
        if ratios.mean() >= bits:
            return [] if token.isdigit() else [(0, len(token))]
        sums, found, todo = np.concatenate(([0.0], np.cumsum(ratios - bits))), [], [(0, len(token))]
        while todo:
            a, b = todo.pop()
            if b - a < MIN_RUN:
                continue
            part = sums[a : b + 1]
            low = np.minimum.accumulate(part[:-MIN_RUN])  # the least sum MIN_RUN or more characters before
            gain = part[MIN_RUN:] - low
            at = int(gain.argmax())
            if gain[at] < 0:
                continue
            start, end = a + int(part[: at + 1].argmin()), a + at + MIN_RUN
            while start > a and token[start - 1] not in SEPARATORS:
                start -= 1
            while end < b and (token[end] not in SEPARATORS or token[end] == ord("=")):
                end += 1
            if not token[start:end].isdigit():
                found.append((start, end))
            todo += [(a, start), (end, b)]
        return sorted(found)


def _counts(samples: list[bytes]) -> np.ndarray:
    n = len(KEY_CHARS)
    out = np.zeros((n + 1) * (n + 1) * n)
    for token in samples:
        padded = np.concatenate(([n, n], _CODE[np.frombuffer(token, np.uint8)]))
        np.add.at(out, (padded[:-2] * (n + 1) + padded[1:-1]) * n + padded[2:], 1)
    return out.reshape(n + 1, n + 1, n)


def _log_probability(samples: list[bytes], strength: float = 4.0) -> np.ndarray:
    """Order 2 shrunk to order 1, to order 0, to uniform, each with ``strength`` pseudo-counts."""
    two = _counts(samples)
    n = len(KEY_CHARS)
    below = np.full(n, 1 / n)
    for counts in (two.sum((0, 1)), two.sum(0), two):
        below = (counts + strength * below) / (counts.sum(-1, keepdims=True) + strength)
    return np.log2(below)


def train(random: list[bytes], ordinary: list[bytes]) -> MarkovPair:
    """Both models from labelled tokens over KEY_CHARS. Empty classes fall back to uniform."""
    return MarkovPair(_log_probability(random) - _log_probability(ordinary))


def seeded_random(n: int = 3000, seed: int = 5) -> list[bytes]:
    """Labelled samples of the random class: hex, base-62 and base-64 strings of 20 to 64 characters."""
    rng = np.random.Generator(np.random.PCG64(seed))
    alphabets = ("0123456789abcdef", KEY_CHARS[:62], KEY_CHARS[:64])
    return ["".join(rng.choice(list(alphabets[k % 3]), rng.integers(20, 65))).encode() for k in range(n)]


def _runs(data: np.ndarray, inside: np.ndarray, offs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, starts and ends (bytes of ``data``) of runs of ``inside`` with ``least`` bytes or more."""
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offs] = True
    cuts = np.flatnonzero(edge | (np.arange(len(edge)) == len(data)))
    if len(cuts) and cuts[0] != 0:
        cuts = np.concatenate(([0], cuts))
    starts, ends = cuts[:-1], cuts[1:]
    ok = (ends - starts >= least) & inside[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[ok], ends[ok]
    return np.searchsorted(offs, starts, side="right") - 1, starts, ends


def _pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of about a megabyte of whole texts each."""
    data, offs = column_bytes(column)
    row, n = 0, len(offs) - 1
    while row < n:
        last = row + 1
        while last < n and offs[last + 1] - offs[row] <= 1 << 20:
            last += 1
        yield row, data[offs[row] : offs[last]], offs[row : last + 1] - offs[row]
        row = last


def _suspects(column: pa.Array, run: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(row, byte spans of key runs) of the texts that a pattern or the models could match at all."""
    for first, data, offs in _pieces(column):
        if not len(data):
            continue
        rows, starts, ends = _runs(data, _CODE[data] >= 0, offs, run)
        found: dict[int, list[tuple[int, int]]] = {}
        for r, s, e in zip(rows.tolist(), starts.tolist(), ends.tolist()):
            found.setdefault(r, []).append((s - int(offs[r]), e - int(offs[r])))
        lower = data.tobytes().lower()
        for word in KEYWORDS:
            at = lower.find(word)
            while at >= 0:
                r = int(np.searchsorted(offs, at, side="right")) - 1
                found.setdefault(r, [])
                at = lower.find(word, int(offs[r + 1]))
        for r in sorted(found):
            yield first + r, found[r]


def all_spans(text: str, runs: list[tuple[int, int]], model: MarkovPair, bits: float) -> tuple[list[Span], list[Span]]:
    """Base spans, and base spans with the Markov spans that overlap none of them, in order."""
    base = base_spans(text)
    raw, extra = text.encode(), []
    byte, start = 0, 0
    for s, e in runs:  # in order, so characters are counted from run to run
        byte, start = s, start + len(raw[byte:s].decode())
        at, end = start, start + e - s
        for a, b in sorted((x[0], x[1]) for x in base if x[0] < end and x[1] > start) + [(end, end)]:
            if a - at >= MIN_RUN:
                token = raw[s + at - start : s + a - start]
                extra += [(at + x, at + y, "markov") for x, y in model.segments(token, bits)]
            at = max(at, b)
    return base, sorted(base + extra, key=lambda x: (x[0], KINDS.index(x[2])))


def labelled_samples(docs: DataFrame, max_samples: int = MAX_SAMPLES) -> DataFrame:
    """(token, random) samples of the whole corpus: at most ``max_samples`` distinct tokens a class,
    the smallest by CRC, so that every text can contribute and reruns agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            held: tuple[set, set] = (set(), set())
            covered: dict[int, list[tuple[int, int]]] = {}
            for row, _ in _suspects(texts, MIN_RUN):
                text = texts[row].as_py()
                for a, b, kind in base_spans(text):
                    value = ASSIGN.match(text, a)[2] if kind == "assign" else text[a:b]
                    held[1].add(re.sub(r"[^A-Za-z0-9+/_=-]", "", value).encode())
                    covered.setdefault(row, []).append((len(text[:a].encode()), len(text[:b].encode())))
            for first, data, offs in _pieces(texts):
                hashes, starts, ends = hash_words(data, offs[:-1], _CODE < 0)
                chosen = (ends - starts >= SAMPLE_RUN) & (hashes < np.uint64(2**64 // SAMPLE_SHARE))
                rows = np.searchsorted(offs, starts[chosen], side="right") - 1
                for r, s, e in zip(rows.tolist(), starts[chosen].tolist(), ends[chosen].tolist()):
                    at, to = s - int(offs[r]), e - int(offs[r])
                    if all(to <= a or at >= b for a, b in covered.get(first + r, ())):
                        held[0].add(data[s:e].tobytes())
            for label, tokens in enumerate(held):
                best = sorted((zlib.crc32(t), t) for t in tokens if t)[:max_samples]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t for _, t in best], pa.binary()), pa.array([k for k, _ in best], pa.int64()), pa.array([label == 1] * len(best), pa.bool_())],
                    ["token", "crc", "random"],
                )

    found = docs.select("text").mapInArrow(run, "token binary, crc long, random boolean").distinct()
    parts = [found.where(F.col("random") == label).orderBy("crc", "token").limit(max_samples) for label in (False, True)]
    return parts[0].unionByName(parts[1]).select("token", "random")


def train_trimmed(random: list[bytes], ordinary: list[bytes]) -> MarkovPair:
    """As ``train``, but tokens of the ordinary class that are not clearly likelier under it, such as keys that
    no pattern has labelled, are taken out of it. A token is judged by models that did not learn from it, each
    half of the class by the other; rounds go on until the class is stable."""
    halves = [[t for t in ordinary if zlib.crc32(t) // 7 % 2 == side] for side in (0, 1)]
    kept = halves
    for _ in range(TRIM_ROUNDS):
        models = [train(random, half) for half in kept]
        again = [[t for t in halves[side] if models[1 - side].score(t) < TRIM_BITS] for side in (0, 1)]
        if again == kept:
            break
        kept = again
    return train(random, sorted(kept[0] + kept[1]))


def fit(docs: DataFrame, max_samples: int = MAX_SAMPLES) -> MarkovPair:
    """Both models from the samples of the corpus."""
    rows = labelled_samples(docs, max_samples).toArrow().to_pydict()
    classes: tuple[list, list] = ([], [])
    for token, random in zip(rows["token"], rows["random"]):
        classes[random].append(bytes(token))
    return train_trimmed(sorted(classes[1]) + seeded_random(), sorted(classes[0]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, bits_per_char: float = BITS_PER_CHAR, model: MarkovPair | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov of every row (doc_id, text).

    A null or empty text has no spans; a very long one is scanned whole. Repeated rows give repeated
    results; rows with a null doc_id are scanned too; extra columns are ignored;
    an empty table gives an empty result. Positions are code points, the end exclusive.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean = (0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0)
        for batch in batches:
            texts, rows = batch.column(1), [clean] * batch.num_rows
            for row, runs in _suspects(texts, MIN_RUN):
                base, spans = all_spans(texts[row].as_py(), runs, shared.value, bits_per_char)
                counts = [sum(k == kind for _, _, k in spans) for kind in KINDS]
                rows[row] = (*counts[:3], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), counts[3])
            columns = list(zip(*rows)) if rows else [()] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def redact(docs: DataFrame, mask: str = "[SECRET]", bits_per_char: float = BITS_PER_CHAR) -> DataFrame:
    """Pipeline stage: every row stays, with each secret span of its text replaced by ``mask``.

    Overlapping spans are masked as one. n_chars follows the new text where the text changed. Null and
    empty texts stay as they are, repeated rows are masked alike, and all other columns pass through. An
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))
    names = docs.columns
    at = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changed: dict[int, str] = {}
            for row, runs in _suspects(batch.column(at), MIN_RUN):
                text = batch.column(at)[row].as_py()
                _, spans = all_spans(text, runs, shared.value, bits_per_char)
                out, done = [], 0
                for s, e, _ in spans:
                    if s >= done:
                        out += [text[done:s], mask]
                    done = max(done, e)
                if spans:
                    changed[row] = "".join([*out, text[done:]])
            columns = list(batch.columns)
            if changed:
                texts = columns[at].to_pylist()
                for row, text in changed.items():
                    texts[row] = text
                columns[at] = pa.array(texts, columns[at].type)
                if count is not None:
                    sizes = columns[count].to_pylist()
                    for row, text in changed.items():
                        sizes[row] = len(text)
                    columns[count] = pa.array(sizes, columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
