"""Language identification by prediction by partial matching (PPM) over bytes.

Training counts, for each language, every byte with the three bytes before it; Spark sums the counts.
The counts are then frozen as one context tree a language: a context of order 1 to 3 is a node if it
makes up ``context_share`` of the language's bytes, so the order varies with the evidence, and a node
keeps the whole counts of all bytes that follow it. In a node of n occurrences and d distinct next
bytes, a seen byte of count c has probability c / (n + d), and the escape d / (n + d) is spread over the
unseen bytes in proportion to the next shorter context (PPM method C with exclusion); below order 0 all
256 bytes are alike. Each node is thus an exact distribution, and a text's code length under a language
is the sum of its bytes' costs in bits.

The model's size is bounded by its parameters: a language has at most 3 / context_share nodes, each a row
of costs, and a lookup from the nodes of all languages to its own. Training reads all labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import discard, materialize
from timeweave.llm.textkernel import PIECE, column_bytes

ORDER = 3
CONTEXT_SHARE = 2e-5
SCORE_BYTES = 48
_MAYBE_LETTER = re.compile(r"[^\W\d_]")  # letters, and numbers that are no digits
LEAST_GAIN = 0.0


def has_letter(text: str | None) -> bool:
    """True if a character is of a Unicode letter category (Lu, Ll, Lt, Lm, Lo)."""
    return text is not None and any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text))


@dataclass
class Model:
    """Frozen statistics. symbol: byte to symbol id, 0 for bytes never seen; node: deepest node of a
    triple of symbols; row: for each language, its own row of a node, that of the deepest of the node's
    suffixes that the language has; cost: for each language, bits of (row, symbol); pooled: bits of each
    symbol by the letter frequencies of all languages together."""

    languages: list[str]
    symbol: np.ndarray
    node: np.ndarray
    row: list[np.ndarray]
    cost: list[np.ndarray]
    pooled: np.ndarray

    @property
    def width(self) -> int:
        return int(self.symbol.max()) + 1


def _padded(data: np.ndarray, begin: int, end: int, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts offs[begin:end+1] with three zeros before each, and a mask of the text bytes."""
    lengths = np.diff(offs[begin : end + 1])
    total = int(lengths.sum())
    text = np.repeat(np.arange(1, end - begin + 1) * ORDER, lengths) + np.arange(total)
    out = np.zeros(total + ORDER * (end - begin), np.uint8)
    out[text] = data[offs[begin] : offs[end]]
    mask = np.zeros(len(out), bool)
    mask[text] = True
    return out, mask


def pieces(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes with context, mask of bytes to code); a long text comes in pieces."""
    row, n = 0, len(offs) - 1
    while row < n:
        last = row + 1
        while last < n and offs[last + 1] - offs[row] <= PIECE:
            last += 1
        if offs[last] - offs[row] <= PIECE:
            yield (row, last, *_padded(data, row, last, offs))
        else:
            for at in range(int(offs[row]), int(offs[last]), PIECE):
                to = min(at + PIECE, int(offs[last]))
                before = data[max(at - ORDER, int(offs[row])) : at]
                out = np.concatenate((np.zeros(ORDER - len(before), np.uint8), before, data[at:to]))
                yield row, last, out, np.arange(len(out)) >= ORDER
        row = last


def gram_counts(labelled: DataFrame) -> DataFrame:
    """lang, gram (four bytes as a number, the last one predicted), n, over all rows of (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            grams, where = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
            return grams, np.bincount(where, np.concatenate([x[1] for x in parts])).astype(np.int64)

        for batch in batches:
            langs = np.asarray(batch.column(1).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                data, offs = column_bytes(batch.column(0).filter(pa.array(langs == lang)))
                for _, _, text, mask in pieces(data, offs):
                    wide = text.astype(np.uint32)
                    grams = wide[3:] | wide[2:-1] << np.uint32(8) | wide[1:-2] << np.uint32(16) | wide[:-3] << np.uint32(24)
                    held.setdefault(lang, []).append(np.unique(grams[mask[3:]], return_counts=True))
                    if len(held[lang]) >= 16:
                        held[lang] = [merged(held[lang])]
        for lang, parts in held.items():
            grams, counts = merged(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(counts, pa.int64())], ["lang", "gram", "n"]
            )

    counted = labelled.select("text", "lang").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def by_order(counts: DataFrame) -> DataFrame:
    """lang, order, gram, n: the counts of every order, each summed over all longer contexts."""
    masks = F.array(*(F.struct(F.lit(k).alias("order"), F.lit((1 << 8 * (k + 1)) - 1).cast("long").alias("mask")) for k in range(ORDER + 1)))
    rows = counts.select("lang", "n", "gram", F.explode(masks).alias("m"))
    rows = rows.select("lang", "m.order", F.col("gram").bitwiseAND(F.col("m.mask")).alias("gram"), "n")
    return rows.groupBy("lang", "order", "gram").agg(F.sum("n").alias("n"))


def tree_counts(counts: DataFrame, context_share: float) -> DataFrame:
    """The rows of ``by_order`` that the trees hold: all of order 0, and all of the contexts that make up
    ``context_share`` of their language's bytes (two at least), whole."""
    totals = counts.where("order = 0").groupBy("lang").agg(F.sum("n").alias("total"))
    context = F.shiftright("gram", 8)
    sized = counts.where("order > 0").groupBy("lang", "order", context.alias("context")).agg(F.sum("n").alias("size"))
    often = sized.join(totals, "lang").where(F.col("size") >= F.greatest(F.lit(2), context_share * F.col("total")))
    kept = counts.where("order > 0").withColumn("context", context).join(often.drop("size", "total"), ["lang", "order", "context"], "left_semi")
    return counts.where("order = 0").select("lang", "order", "gram", "n").union(kept.select("lang", "order", "gram", "n"))


def build_model(counts: pa.Table) -> Model:
    """The context trees of counts (lang, order, gram, n); each context given is a node."""
    lang_of = np.asarray(counts["lang"].to_pylist(), dtype=object)
    gram_of, n_of, order_of = counts["gram"].to_numpy().astype(np.int64), counts["n"].to_numpy(), counts["order"].to_numpy()
    languages = sorted(set(lang_of))
    seen = np.unique(gram_of & 255)
    symbol = np.zeros(256, np.int64)
    symbol[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    multiple = np.ones(width)
    multiple[0] = 256 - len(seen)  # bytes that symbol 0 stands for

    quads = np.stack([symbol[(gram_of >> s) & 255] for s in (24, 16, 8, 0)], 1)
    by_lang, own_contexts = {}, {}
    nodes: list[np.ndarray] = [np.zeros(1, np.int64), *[np.zeros(0, np.int64)] * ORDER]
    for lang in languages:
        for order in range(ORDER + 1):
            own = (lang_of == lang) & (order_of == order)
            context = _context(quads[own], order, width)
            by_lang[lang, order] = (context, quads[own, 3], n_of[own])
            own_contexts[lang, order] = np.unique(context) if order else nodes[0]
            nodes[order] = np.union1d(nodes[order], own_contexts[lang, order]).astype(np.int64)

    first = np.cumsum([0, *(len(x) for x in nodes)])  # node 0 is the empty context
    parent = np.zeros(int(first[-1]), np.int64)
    deepest = np.zeros(1, np.int64)
    for order in range(1, ORDER + 1):
        # the context's oldest symbol is the highest digit, so its parent is the rest
        deepest = np.tile(deepest, width)
        own = np.arange(first[order], first[order + 1])
        parent[own] = deepest[nodes[order]]
        deepest[nodes[order]] = own

    rows, cost = [], []
    for lang in languages:
        row, tables, size = np.zeros(len(parent), np.int32), [], 0
        for order in range(ORDER + 1):
            ids, at_node = own_contexts[lang, order], np.arange(first[order], first[order + 1])
            row[at_node] = row[parent[at_node]]
            if not len(ids):
                continue
            mine = first[order] + np.searchsorted(nodes[order], ids)
            below = np.full((1, width), 1 / 256) if order == 0 else np.concatenate(tables)[row[parent[mine]]]
            context, byte, n = by_lang[lang, order]
            here = np.bincount(np.searchsorted(ids, context) * width + byte, n, len(ids) * width).reshape(len(ids), width)
            tables.append(_mixed(here, below, multiple))
            row[mine] = size + np.arange(len(ids))
            size += len(ids)
        rows.append(row)
        cost.append(-np.log2(np.maximum(np.concatenate(tables), 1e-30)).astype(np.float32).reshape(-1))
    letters = np.bincount(quads[order_of == 0, 3], n_of[order_of == 0], width)[None]
    pooled = -np.log2(_mixed(letters, np.full((1, width), 1 / 256), multiple))[0].astype(np.float32)
    return Model(languages, symbol, deepest.astype(np.int32), rows, cost, pooled)


def _context(quads: np.ndarray, order: int, width: int) -> np.ndarray:
    out = np.zeros(len(quads), np.int64)
    for k in range(3 - order, 3):
        out = out * width + quads[:, k]
    return out


def _mixed(here: np.ndarray, below: np.ndarray, multiple: np.ndarray) -> np.ndarray:
    """Method C with exclusion: escape mass over the bytes unseen here, in proportion to ``below``."""
    n, seen = here.sum(1, keepdims=True), here > 0
    d = seen.sum(1, keepdims=True)
    left = (below * multiple * ~seen).sum(1, keepdims=True)
    known = np.where(n > 0, here / np.maximum(n + d, 1), 0)
    escape = np.where(n > 0, d / np.maximum(n + d, 1), 1.0)
    return np.where(seen, known, escape * below / np.maximum(left, 1e-30))


def code_lengths(model: Model, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each text (rows) under each language (columns), and by pooled letter frequencies."""
    n, width = len(offs) - 1, model.width
    bits, plain = np.zeros((n, len(model.languages))), np.zeros(n)
    for first, last, text, mask in pieces(data, offs):
        symbols = model.symbol[text]
        node = model.node[(symbols[:-3] * width + symbols[1:-2]) * width + symbols[2:-1]][mask[3:]]
        next_symbol = symbols[3:][mask[3:]]
        if not len(node):
            continue
        lengths = np.diff(offs[first : last + 1]) if last - first > 1 or len(node) == offs[last] - offs[first] else np.array([len(node)])
        full = np.flatnonzero(lengths)
        starts = np.concatenate(([0], np.cumsum(lengths[full])[:-1]))
        for k, table in enumerate(model.cost):
            at = model.row[k][node] * np.int64(width) + next_symbol
            bits[first + full, k] += np.add.reduceat(table[at].astype(np.float64), starts)
        plain[first + full] += np.add.reduceat(model.pooled[next_symbol].astype(np.float64), starts)
    return bits, plain


def train(labelled: DataFrame, context_share: float = CONTEXT_SHARE) -> Model:
    """A model of all rows of (text, lang) with neither null."""
    counts = materialize(by_order(gram_counts(labelled.where("text is not null and lang is not null"))), "grams")
    model = build_model(tree_counts(counts, context_share).toArrow())
    discard(counts)
    return model


def _judged(m: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and gain of each text; ``und``, 0 and 0 without a letter."""
    data, offs = column_bytes(texts)
    named, score, gain = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    letters = np.array([has_letter(t) for t in texts.to_pylist()], bool)
    if m.languages and letters.any():
        (bits, plain), sizes = code_lengths(m, data, offs), np.maximum(np.diff(offs), 1)
        best = bits.argmin(1)
        gain = np.where(letters, 1 - bits.min(1) / np.maximum(plain, 1e-9), 0)
        lead = (bits - bits.min(1, keepdims=True)) * (np.minimum(sizes, SCORE_BYTES) / sizes)[:, None]
        score = np.where(letters, 1 / np.exp2(-np.minimum(lead, 1000)).sum(1), 0)
        named = [m.languages[b] if ok else "und" for b, ok in zip(best, letters)]
    return named, score, gain


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, lang_pred, score and gain of every row of ``docs``; ``keep`` has none of these names.

    lang_pred is the language of least code length (the smaller name on a tie), ``und`` with score 0
    if the text is null, empty or has no letter, or if no language was learned. score is the posterior
    of the winner with equal priors and at most SCORE_BYTES bytes' worth of evidence. gain is the share
    of bits that the winner saves against pooled letter frequencies, which know no language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("gain", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named, score, gain = _judged(shared.value, batch.column(len(keep)))
            columns = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(named, pa.string()), pa.array(score), pa.array(gain)], schema.names)

    return docs.select(*keep, "text").mapInArrow(run, schema)


def held_out(doc_id) -> F.Column:
    """True for the fifth of the documents that training must not see; null ids are not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Train on the documents that are not held out and have a language, then predict all of them.

    Rows with a null doc_id are predicted but not learned from. Repeated rows count as often as they
    occur. Extra columns are ignored; an empty table gives an empty result.
    """
    training = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    model = train(training)
    marked = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return predict(marked, model, ["doc_id", "held_out"])


def reject_unknown(docs: DataFrame, least_gain: float = LEAST_GAIN) -> DataFrame:
    """Pipeline stage: documents without a recognisable language go, the others stay unchanged.

    Rejected are texts with no letter (null and empty ones included) and texts for which the best language
    saves less than ``least_gain`` of the bits that pooled letter frequencies need: random letters, and
    languages that were not learned. Where no row has a language to learn, all texts with letters stay.
    Repeated rows go or stay together; very long texts are coded whole; all columns pass through, whatever
    their names; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value.languages:
                named, _, gain = _judged(shared.value, batch.column(at))
                stays = (np.array(named, object) != "und") & (gain >= least_gain)
            else:
                stays = np.array([has_letter(t) for t in batch.column(at).to_pylist()], bool)
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
