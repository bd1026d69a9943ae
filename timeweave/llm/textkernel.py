"""Vectorised word hashing over Arrow string columns.

One pass over the UTF-8 bytes of many documents gives a 64-bit hash for each word. The cost is a
few numpy operations a byte, whatever the number of words, and work is cut into pieces of about
PIECE bytes, so that temporary arrays stay small however long a document is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
# For comparison without punctuation: words are runs of ASCII letters, digits and all other bytes.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_INVERSE = np.uint64(pow(int(_ODD), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int, what: str) -> np.ndarray:
    have = _powers.get(what)
    if have is None or len(have) < n:
        base = _ODD if what == "up" else _INVERSE
        size = max(n, PIECE + 4096)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[what] = np.multiply.accumulate(steps)
    return have


def hash_words(data: np.ndarray, cuts: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, start and end bytes of the words in ``data``; no word crosses a position in ``cuts``.

    ``between`` marks the bytes that are in no word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~between[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = cuts[(cuts > 0) & (cuts < n)]
    begins[inner] = solid[inner]
    starts = np.flatnonzero(begins)
    ends_mask = solid.copy()
    ends_mask[:-1] &= ~solid[1:]
    ends_mask[inner - 1] = solid[inner - 1]
    ends = np.flatnonzero(ends_mask) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LOWER[data] * _power(n, "up")[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * _power(n, "down")[starts])
    return hashes, starts, ends


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def documents_words(
    column: pa.Array, between: np.ndarray = _SPACE
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, hashes, starts, ends) of each text in the column; starts and ends are bytes of the text."""
    data, offs = column_bytes(column)
    row, n = 0, len(offs) - 1
    while row < n:
        last = row + 1
        while last < n and offs[last + 1] - offs[row] <= PIECE:
            last += 1
        if offs[last] - offs[row] <= PIECE:
            base = offs[row]
            hashes, starts, ends = hash_words(data[base : offs[last]], offs[row:last] - base, between)
            edges = np.searchsorted(starts, offs[row : last + 1] - base)
            for k in range(last - row):
                a, b = edges[k], edges[k + 1]
                shift = offs[row + k] - base
                yield row + k, hashes[a:b], starts[a:b] - shift, ends[a:b] - shift
        else:  # one long text, in pieces that end at white space
            text, parts, at = data[offs[row] : offs[last]], [], 0
            while at < len(text):
                to = min(at + PIECE, len(text))
                if to < len(text):
                    back = np.flatnonzero(between[text[at:to]])
                    if len(back):
                        to = at + int(back[-1]) + 1
                    else:
                        ahead = np.flatnonzero(between[text[to:]])
                        to = to + int(ahead[0]) + 1 if len(ahead) else len(text)
                h, s, e = hash_words(text[at:to], np.zeros(0, np.int64), between)
                parts.append((h, s + at, e + at))
                at = to
            yield (row, *(np.concatenate(x) for x in zip(*parts)))
        row = last


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; a shorter text with words is one run."""
    if not len(words):
        return words
    if len(words) < width:
        width = len(words)
    with np.errstate(over="ignore"):
        out = np.full(len(words) - width + 1, np.uint64(width), np.uint64)
        for k in range(width):
            out = mix(out * _ODD + words[k : k + len(out)])
    return out
