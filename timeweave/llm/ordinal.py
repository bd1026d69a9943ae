"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's features are hashed: the presence of each word and of each pair of neighbouring marks, and
levels of a few whole-text statistics (shares of capitals, digits, marks and repeated words, word
length). One weight vector is shared by all
grades; a grade is above k with probability sigmoid(score - threshold k), and the thresholds are
ordered by construction. Expected grade and tail probabilities select documents.

Training uses at most ``max_train`` labelled rows, the smallest by hash of doc_id; every text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeweave.llm.textkernel import PUNCTUATION, column_bytes, documents_words

MAX_TRAIN = 12_000
BUCKETS = 1 << 18
LEVELS, STATISTICS, MARK_PAIRS = 16, 6, 4096
N_WEIGHTS = BUCKETS + STATISTICS * LEVELS + MARK_PAIRS
LEAST_ROWS, LEAST_Z = 3, 3.0
_UPPER = np.arange(65, 91)
_LETTER = np.r_[65:91, 97:123, 128:256]
_MARK = np.r_[33:48, 58:65, 91:97, 123:127]
_IS_MARK = np.isin(np.arange(256), _MARK)


def features(words: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Distinct feature ids of a text: words in the first BUCKETS ids, then statistics, then mark pairs."""
    own = np.unique((words % np.uint64(BUCKETS)).astype(np.int32))
    counts = np.bincount(data, minlength=256)
    n, letters = max(len(data), 1), max(counts[_LETTER].sum(), 1)
    shares = (
        counts[_UPPER].sum() / letters,
        counts[48:58].sum() / n,
        counts[_MARK].sum() / n,
        counts[ord("|")] * 20 / n,
        1 - len(own) / max(len(words), 1),
        min(letters / max(len(words), 1) / 16, 1),
    )
    levels = [BUCKETS + k * LEVELS + min(int(np.sqrt(x) * LEVELS), LEVELS - 1) for k, x in enumerate(shares)]
    marks = _IS_MARK[data]
    at = np.flatnonzero(marks[:-1] & marks[1:]) if len(data) > 1 else np.zeros(0, np.int64)
    pairs = np.unique((data[at].astype(np.int32) * 251 + data[at + 1]) % MARK_PAIRS) if len(at) else np.zeros(0, np.int32)
    return np.concatenate((own, np.array(levels, np.int32), (BUCKETS + STATISTICS * LEVELS + pairs).astype(np.int32)))


@dataclass
class Ordinal:
    """weights of the features; thresholds between neighbouring grades, ascending."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: float | np.ndarray) -> np.ndarray:
        """Probability that the grade is above each threshold; falls from left to right. Scores may be a column."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -500, 500)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(grades: np.ndarray, rows: list[np.ndarray], steps: int = 250, rate: float = 0.05, l2: float = 2e-4) -> Ordinal:
    """Maximum likelihood with an L2 penalty, full-batch Adam. ``rows`` hold the feature ids of each text.

    A feature has a weight if LEAST_ROWS rows hold it and their mean grade is LEAST_Z standard errors off
    the overall mean; the rest would only memorise. With fewer than two grades nothing is learned."""
    top = int(grades.max()) if len(grades) else 0
    if len(np.unique(grades)) < 2:
        return Ordinal(np.zeros(N_WEIGHTS, np.float32), np.arange(max(top, 1), dtype=float))
    ids = np.concatenate(rows)
    row_of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    held = np.bincount(ids, minlength=N_WEIGHTS)
    lead = np.bincount(ids, (grades - grades.mean())[row_of], N_WEIGHTS) / np.sqrt(np.maximum(held, 1)) / grades.std()
    often = np.flatnonzero((held >= LEAST_ROWS) & (np.abs(lead) >= LEAST_Z))
    place = np.full(N_WEIGHTS, -1)
    place[often] = np.arange(len(often))
    known = place[ids] >= 0
    col, row_of = place[ids[known]], row_of[known]
    share = np.array([(grades > k).mean() for k in range(top)]).clip(1e-3, 1 - 1e-3)
    first = np.sort(-np.log(share / (1 - share)))
    x = np.concatenate((np.zeros(len(often)), [first[0]], np.log(np.diff(first).clip(1e-2))))
    m, v = np.zeros_like(x), np.zeros_like(x)
    n, w = len(rows), len(often)
    for t in range(1, steps + 1):
        gaps = np.exp(x[w + 1 :])
        edges = np.concatenate(([-np.inf], x[w] + np.concatenate(([0.0], np.cumsum(gaps))), [np.inf]))
        score = np.bincount(row_of, x[:w][col], n)
        low, high = _sigmoid(edges[grades] - score), _sigmoid(edges[grades + 1] - score)
        p = np.maximum(high - low, 1e-12)
        d_low, d_high = low * (1 - low) / p, high * (1 - high) / p
        by_edge = np.bincount(grades, d_low, top + 2)[1:-1] - np.bincount(grades + 1, d_high, top + 2)[1:-1]
        tail = np.cumsum(by_edge[::-1])[::-1]
        grad = np.concatenate((np.bincount(col, (d_high - d_low)[row_of], w) / n + l2 * x[:w], [tail[0] / n], tail[1:] * gaps / n))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(N_WEIGHTS, np.float32)
    weights[often] = x[:w]
    return Ordinal(weights, x[w] + np.concatenate(([0.0], np.cumsum(np.exp(x[w + 1 :])))))


def train(docs: DataFrame, ratings: DataFrame, max_train: int = MAX_TRAIN) -> Ordinal:
    """A model of docs (doc_id, text) with ratings (doc_id, grade). The ratings are chosen before any text is
    read: the ``max_train`` smallest by hash of doc_id, so the table that is broadcast to the texts is
    bounded by that parameter. Rows with a null text, grade or doc_id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = column_bytes(batch.column(0))
            ids = [features(w, data[offs[k] : offs[k + 1]]) for k, w, _, _ in documents_words(batch.column(0), PUNCTUATION)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["grade", "ids"])

    rated = ratings.where("doc_id is not null and grade is not null").select("doc_id", F.col("grade").cast("int"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(max_train)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "grade")
    got = rows.mapInArrow(run, "grade int, ids array<int>").toArrow()
    lists = got["ids"].combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    flat, offs = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    order = sorted(range(len(lists)), key=lambda k: flat[offs[k] : offs[k + 1]].tobytes())  # as rows come in any order
    grades = got["grade"].to_numpy().astype(np.int64)
    return fit(grades[order], [flat[offs[k] : offs[k + 1]] for k in order])


def score(docs: DataFrame, model: Ordinal, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, expected_grade and tails (probability of more than each grade but the last)
    of every row of ``docs``. A null, empty or blank text is scored by its statistics alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("expected_grade", "double").add("tails", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(len(keep))
            data, offs = column_bytes(texts)
            scores = [m.weights[features(w, data[offs[k] : offs[k + 1]])].sum(dtype=np.float64) for k, w, _, _ in documents_words(texts, PUNCTUATION)]
            tails = m.tails(np.array(scores, float)[:, None])
            ends = pa.array(np.arange(len(scores) + 1) * tails.shape[1], pa.int32())
            expected = pa.array(tails.sum(1), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], expected, pa.ListArray.from_arrays(ends, pa.array(tails.ravel(), pa.float64()))], schema.names
            )

    return docs.select(*keep, "text").mapInArrow(run, schema)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 for toxic, 1 for poor, 2 for good; null marks give no grade."""
    grade = F.when(F.col("toxic") == 1, 0).when((F.col("toxic") == 0) & (F.col("quality") == 0), 1)
    grade = grade.when((F.col("toxic") == 0) & (F.col("quality") == 1), 2)
    return labels.select("doc_id", grade.alias("grade")).where("grade is not null")


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents whose ratings are not learned from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def select_quality(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, held_out, expected_grade, p_acceptable, p_good, kept of every row of ``docs``.

    p_acceptable is the probability of a grade above 0, p_good of one above 1; kept means that p_good is
    at least ``least``. Ratings of held-out documents are not used. Several ratings of a document each
    count. Without ratings every document has the same probabilities. Null and empty texts are scored by
    their statistics, very long ones whole; repeated rows and rows with a null doc_id are scored each; ties
    at ``least`` are kept. Extra columns are ignored; an empty table gives an empty result.
    """
    model = train(docs, graded(labels).where(~held_out(F.col("doc_id"))))
    marked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    out = score(marked, model, ["doc_id", "held_out"])
    p_good = F.coalesce(F.try_element_at("tails", F.lit(2)), F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "expected_grade", F.element_at("tails", 1).alias("p_acceptable"), p_good.alias("p_good"), (p_good >= least).alias("kept")
    )
