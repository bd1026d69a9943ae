"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

1. Every n-gram of a test item is counted in the corpus (n-grams of the benchmark only, summed by
   Spark). A seed is each n-gram that the corpus holds and that is rare (in one text of RARE_SHARE at
   most, or RARE_LEAST times) or in at most FEW places of the benchmark, since no n-gram stands for the
   others: an edit breaks any of them. Phrases that are common in both give way, but for windows of
   ``spread`` neighbouring n-grams without a seed, where all that the corpus holds are seeds.
2. The texts are scanned for seeds. A hit places the item on the text; hits of one item on nearby
   diagonals are one window of the text, of the item's length with room for edits on both sides.
   Windows that lack too many of the item's words to reach the threshold are not aligned.
3. The window and the item are aligned (match +2, mismatch -1, gap -1 a word). The best local score
   over twice the item's length is the share of the item that the text holds; from ``threshold`` on
   the pair is a leak. Edited, shortened or padded copies lose a little for each edit; a copy in which
   no n-gram survives, as with an edit at every third word, is not found.

The benchmark goes to the tasks in blocks of at most ``block_words`` words, so what is broadcast is
bounded however large the benchmark is; every block meets all texts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import materialize
from timeweave.llm.textkernel import PUNCTUATION, documents_words, shingle_hashes

GRAM, SPREAD, THRESHOLD = 3, 4, 0.6
RARE_SHARE, RARE_LEAST, FEW = 1000, 64, 16
BLOCK_WORDS = 2_000_000
SCHEMA = "doc_id long, item_id long, score double, start_word int, end_word int, matches int"


def _next_row(before: np.ndarray, word: np.uint64, text: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """One row of scores; the gap along the text is a running maximum of score plus distance."""
    now = np.zeros(len(before), np.int64)
    now[1:] = np.maximum(np.maximum(before[:-1] + np.where(text == word, 2, -1), before[1:] - 1), 0)
    return np.maximum.accumulate(now + steps) - steps


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman over word hashes: best score, first and last word of the text's part, matches.

    Every k-th row of scores is kept, k being the root of the item's length; going back, the rows between
    two kept ones are computed again, so memory is 2 * k rows and not one for each word of the item."""
    n, every = len(text), max(1, int(len(item) ** 0.5))
    steps = np.arange(n + 1)
    row, marks = np.zeros(n + 1, np.int64), [np.zeros(n + 1, np.int32)]
    best, i, j = 0, 0, 0
    for k, word in enumerate(item, 1):
        row = _next_row(row, word, text, steps)
        if k % every == 0:
            marks.append(row.astype(np.int32))
        at = int(row.argmax())
        if row[at] > best:
            best, i, j = int(row[at]), k, at
    last, matches, held, low = j - 1, 0, [], 0
    while i and j:
        if not held or i <= low:
            low = (i - 1) // every * every
            held = [marks[low // every].astype(np.int64)]
            for k in range(low, i):
                held.append(_next_row(held[-1], item[k], text, steps))
        here, above = held[i - low], held[i - low - 1]
        if not here[j]:
            break
        same = text[j - 1] == item[i - 1]
        if here[j] == above[j - 1] + (2 if same else -1):
            matches += int(same)
            i, j = i - 1, j - 1
        elif here[j] == above[j] - 1:
            i -= 1
        else:
            j -= 1
    return best, int(j), last, matches


class Items:
    """A block of the benchmark: word hashes of each item and its n-grams."""

    def __init__(self, ids: list[int], texts: list[str], gram: int) -> None:
        self.gram = gram
        self.ids = ids
        self.words = [w for _, w, _, _ in documents_words(pa.array(texts, pa.string()), PUNCTUATION)]
        self.grams = [shingle_hashes(w, gram) for w in self.words]
        self.known = np.unique(np.concatenate([*self.grams, np.zeros(0, np.uint64)]))

    def seeds(self, frequency: dict[int | None, int], spread: int) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]]]:
        """Sorted seed hashes, and (item, position) of each. ``frequency`` has the number of texts under None."""
        bound = max(RARE_LEAST, frequency.get(None, 0) // RARE_SHARE)
        places = Counter(g for grams in self.grams for g in grams.view(np.int64).tolist())
        where: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, grams in enumerate(self.grams):
            order = grams.view(np.int64).tolist()
            held = [p for p, g in enumerate(order) if frequency.get(g)]
            chosen = {p for p in held if frequency[order[p]] <= bound or places[order[p]] <= FEW}
            bare: set[int] = set()
            for p in range(max(1, len(order) - spread + 1)):
                if chosen.isdisjoint(window := range(p, min(p + spread, len(order)))):
                    bare.update(window)
            for p in held:
                if p in chosen or p in bare:
                    where[order[p]].append((k, p))
        return np.array(sorted(where), np.int64), dict(where)


def _member(values: np.ndarray, known: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Positions of ``values`` that are in sorted ``known``; ``table`` is a bit filter by low bits."""
    maybe = np.flatnonzero(table[values & np.uint64(len(table) - 1)])
    if not len(maybe) or not len(known):
        return maybe[:0]
    at = np.minimum(np.searchsorted(known, values[maybe]), len(known) - 1)
    return maybe[known[at] == values[maybe]]


def _filter(known: np.ndarray) -> np.ndarray:
    size = 1 << max(10, int(16 * max(len(known), 1) - 1).bit_length())
    table = np.zeros(size, bool)
    table[known & np.uint64(size - 1)] = True
    return table


def _frequencies(docs: DataFrame, shared: Broadcast, gram: int) -> dict[int | None, int]:
    """Occurrences in the corpus of the block's n-grams, and the number of texts under None; at most one
    row for each reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        table, counts, n_texts = _filter(known), np.zeros(len(known), np.int64), 0
        for batch in batches:
            n_texts += batch.num_rows
            for _, words, _, _ in documents_words(batch.column(0), PUNCTUATION):
                grams = shingle_hashes(words, gram)
                hit = _member(grams, known, table)
                np.add.at(counts, np.searchsorted(known, grams[hit]), 1)
        some = np.flatnonzero(counts)
        grams, n = known[some].view(np.int64).tolist(), counts[some].tolist()
        yield pa.RecordBatch.from_arrays([pa.array([*grams, None], pa.int64()), pa.array([*n, n_texts], pa.int64())], ["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = rows.toArrow()
    return dict(zip(found["gram"].to_pylist(), found["n"].to_pylist()))


def _windows(hits: list[tuple[int, int]], item_words: int, text_words: int) -> list[tuple[int, int]]:
    """Text windows of the hits (item position, text position) of one item, merged where they overlap."""
    slack = max(8, item_words // 2)
    out: list[list[int]] = []
    for begin in sorted(t - p for p, t in hits):
        lo, hi = max(0, begin - slack), min(text_words, begin + item_words + slack)
        if out and lo <= out[-1][1] and hi - out[-1][0] <= 4 * (item_words + 2 * slack):
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out if b > a]


def _block_seeds(docs: DataFrame, items: Items, spread: int) -> tuple[Broadcast, Broadcast]:
    """The block's n-grams and, from their counts in the corpus, what the tasks need to find its items."""
    known = docs.sparkSession.sparkContext.broadcast(items.known)
    seeds, where = items.seeds(_frequencies(docs, known, items.gram), spread)
    return known, docs.sparkSession.sparkContext.broadcast((items.ids, items.words, seeds.view(np.uint64), where))


def _leaks_of_block(docs: DataFrame, shared: Broadcast, gram: int, threshold: float) -> DataFrame:
    names = ["doc_id", "item_id", "score", "start_word", "end_word", "matches"]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, item_words, unordered, places = shared.value
        known = np.sort(unordered)
        table = _filter(known)
        for batch in batches:
            found: list[tuple] = []
            doc_ids = batch.column(0)
            for row, words, _, _ in documents_words(batch.column(1), PUNCTUATION):
                grams = shingle_hashes(words, gram)
                hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
                for t in _member(grams, known, table).tolist():
                    for k, p in places[int(grams[t].view(np.int64))]:
                        hits[k].append((p, t))
                for k, own in hits.items():
                    size, best = len(item_words[k]), None
                    for lo, hi in _windows(own, size, len(words)):
                        if 2 * np.isin(item_words[k], words[lo:hi]).sum() < threshold * 2 * size:
                            continue
                        score, first, last, same = align(item_words[k], words[lo:hi])
                        if best is None or score > best[0]:
                            best = (score, lo + first, lo + last + 1, same)
                    if best is not None and best[0] >= threshold * 2 * size:
                        found.append((doc_ids[row].as_py(), ids[k], best[0] / (2 * size), *best[1:]))
            columns = list(zip(*found)) if found else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    gram: int = GRAM,
    spread: int = SPREAD,
    threshold: float = THRESHOLD,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word, matches) of each document that holds a test item.

    score is the aligned share of the item (0 to 1); start_word and end_word delimit the aligned words
    of the document, words being runs of letters and digits, A-Z
    lower-cased. Null, empty and blank texts hold nothing; very long ones are read in pieces; an
    item without words is held by nothing; an item shorter than ``gram`` words is one seed. Repeated
    rows are reported as often as they occur, repeated items once each. Extra columns are ignored. Empty
    tables give no rows.

    One block of the benchmark is on the driver at a time; its leaks are written before the next is read.
    """
    spark = docs.sparkSession
    done: list[DataFrame] = []
    ids: list[int] = []
    texts: list[str] = []
    size = 0

    def block_done() -> None:
        items = Items(ids, texts, gram)
        seeds, shared = _block_seeds(docs, items, spread)
        found = _leaks_of_block(docs, shared, gram, threshold)
        done.append(materialize(found, "leaks"))
        shared.unpersist()
        seeds.unpersist()

    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"].split())
        if size >= block_words:
            block_done()
            ids, texts, size = [], [], 0
    if ids:
        block_done()
    if not done:
        return spark.createDataFrame([], SCHEMA)
    return reduce(DataFrame.unionByName, done)


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline stage: documents that hold a test item go, the others stay unchanged.

    Rows that share a doc_id go together; a row with a null doc_id stays, as do null and empty texts and, if
    the benchmark is empty, all rows. All columns pass through, whatever their names."""
    found = leaks(docs, benchmark).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(found, docs["doc_id"].cast("long") == found["_leak"], "left_anti")
