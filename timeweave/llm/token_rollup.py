"""Token counts as delta-maintained rollups with idempotent batch commits.

A batch is a table of changes; each becomes signed rows that add to totals by source, language and
tokenizer version: an insert adds its count, a delete takes it away, a revision takes the old count
away and adds the new one. Signed rows are summed before the shuffle, so a batch is stored as one row a
group, in a folder named after the batch. A batch that is already committed is not counted again,
whatever is replayed; one that failed half-way leaves no success mark and is written anew. Totals are
the sum over the committed batches, and ``compact`` folds them into one whose ledger keeps the ids of all
that it holds, so a batch replayed after that is still known. Two writers must not commit one id at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.llm.common import delete_path, materialize, path_exists, word_count

GROUP = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
# Letters, single digits, and single other marks; the same classes in Java and RE2.
PIECES = r"\p{L}+|\p{N}|[^\p{L}\p{N}\x20\x09-\x0D]"


def words_v1(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return word_count(text)


def pieces_v2(text: Column) -> Column:
    """Words of letters, single digits and single marks."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(PIECES)).cast("long")


TOKENIZERS = {"words-v1": words_v1, "pieces-v2": pieces_v2}


def counted(docs: DataFrame, tokenizers: dict | None = None) -> DataFrame:
    """One row a document and tokenizer version: the document's columns without text, tokenizer, n_tokens."""
    versions = tokenizers or TOKENIZERS
    each = F.array(*(F.struct(F.lit(k).alias("tokenizer"), f(F.col("text")).alias("n_tokens")) for k, f in versions.items()))
    rest = [c for c in docs.columns if c not in ("text", "tokenizer", "n_tokens")]
    return docs.select(*rest, F.explode(each).alias("_t")).select(*rest, "_t.tokenizer", "_t.n_tokens")


def bpe_counted(docs: DataFrame, ranks_path: str, pattern: str, version: str) -> DataFrame:
    """As ``counted`` for one byte-pair vocabulary: a ranks file that the driver can read, a line an entry,
    which is sent to the tasks once (some 50,000 entries). A null text counts 0 tokens."""
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rest = [c for c in docs.columns if c not in ("text", "tokenizer", "n_tokens")]
    schema = docs.select(*rest).schema.add("tokenizer", "string").add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in shared.value.splitlines() if line.strip())}
        encoding = tiktoken.Encoding(version, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t.as_py())) if t.is_valid else 0 for t in batch.column(len(rest))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(rest)], pa.array([version] * len(sizes), pa.string()), pa.array(sizes, pa.int64())], schema.names
            )

    return docs.select(*rest, "text").mapInArrow(run, schema)


def deltas(changes: DataFrame) -> DataFrame:
    """Signed group totals of changes (op, source, lang, tokenizer, n_tokens[, old_source, old_lang, old_tokens]).

    op is insert, delete or revise; any other op is an error. A revision without old_source or old_lang
    columns stays in its group. A null count is 0. Groups that come to nothing are left out.
    """
    has = changes.columns
    old_group = [F.col(c) if c in has else F.col(c.removeprefix("old_")) for c in ("old_source", "old_lang")]
    old_tokens = F.col("old_tokens") if "old_tokens" in has else F.lit(0)

    def row(source: Column, lang: Column, sign: int, tokens: Column) -> Column:
        return F.struct(
            source.alias("source"), lang.alias("lang"), F.col("tokenizer").alias("tokenizer"),
            F.lit(sign).cast("long").alias("n_docs"), (sign * F.coalesce(tokens, F.lit(0))).cast("long").alias("n_tokens"),
        )

    plus = row(F.col("source"), F.col("lang"), 1, F.col("n_tokens"))
    signed = (
        F.when(F.col("op") == "insert", F.array(plus))
        .when(F.col("op") == "delete", F.array(row(F.col("source"), F.col("lang"), -1, F.col("n_tokens"))))
        .when(F.col("op") == "revise", F.array(row(*old_group, -1, old_tokens), plus))
        .otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))))
    )
    rows = changes.select(F.explode(signed).alias("d")).select("d.*")
    summed = rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return summed.where("n_docs != 0 or n_tokens != 0")


class Rollup:
    """Totals in a folder of committed batches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _batch(self, batch_id: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch_id):
            raise ValueError(f"batch id {batch_id!r}: letters, digits, dot, underscore and dash only")
        return f"{self.path}/batch={batch_id}"

    def committed(self, batch_id: str) -> bool:
        if path_exists(self.spark, f"{self._batch(batch_id)}/_SUCCESS"):
            return True
        ledger = self._ledger()
        return ledger is not None and not ledger.where(F.col("batch_id") == batch_id).isEmpty()

    def _ledger(self) -> DataFrame | None:
        """batch_id of every batch that is folded into the compacted one."""
        path = f"{self.path}/ledger"
        return self.spark.read.schema("batch_id string").parquet(path) if path_exists(self.spark, f"{path}/_SUCCESS") else None

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch; False, and no work, if a batch of that id is already in."""
        if self.committed(batch_id):
            return False
        deltas(changes).write.mode("overwrite").parquet(self._batch(batch_id))
        return True

    def _committed_names(self) -> list[str]:
        """Folders of committed batches; one without a success mark is none."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        store = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath() for s in store.listStatus(top)] if store.exists(top) else []
        names = sorted(p.getName() for p in found if p.getName().startswith("batch="))
        return [n for n in names if path_exists(self.spark, f"{self.path}/{n}/_SUCCESS")]

    def batches(self) -> DataFrame:
        """The deltas of every committed batch."""
        paths = [f"{self.path}/{n}" for n in self._committed_names()]
        if not paths:
            return self.spark.createDataFrame([], DELTA)
        return self.spark.read.schema(DELTA).parquet(*paths)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; groups without documents are gone."""
        summed = self.batches().groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where("n_docs != 0 or n_tokens != 0")

    def compact(self, into: str) -> None:
        """Write the totals as the first batch of a new folder, and before it the ledger of the ids it holds.

        A folder without the success mark of that batch is not complete and must be written again."""
        ids = [(n.removeprefix("batch="),) for n in self._committed_names()]
        known = self.spark.createDataFrame(ids, "batch_id string")
        ledger = self._ledger()
        if ledger is not None:
            known = known.unionByName(ledger)
        known.write.mode("errorifexists").parquet(f"{into.rstrip('/')}/ledger")
        self.totals().write.mode("errorifexists").parquet(f"{into.rstrip('/')}/batch=compacted")

    def drop(self) -> None:
        delete_path(self.spark, self.path)


def corpus_history(docs: DataFrame, rollup: Rollup) -> None:
    """Three batches of a corpus's life, the first one replayed: all documents arrive under every
    tokenizer version; table bars are cleaned from the texts, which revises the counts that change;
    of exact copies all but those of smallest doc_id are deleted, with their revised counts.

    A null text counts 0 tokens and is a copy of nothing; a row with a null doc_id is never deleted; rows
    equal in doc_id and text are all kept or all deleted. Very long texts are counted whole. Extra
    columns are ignored. An empty table commits empty batches.
    """
    bare = F.replace(F.col("text"), F.lit("|"), F.lit(""))
    each = F.array(
        *(
            F.struct(F.lit(k).alias("tokenizer"), f(F.col("text")).alias("old_tokens"), f(bare).alias("n_tokens"))
            for k, f in TOKENIZERS.items()
        )
    )
    state = docs.select("doc_id", "source", "lang", F.sha2("text", 256).alias("digest"), F.explode(each).alias("t"))
    state = materialize(state.select("doc_id", "source", "lang", "digest", "t.*"), "counts")
    arrive = state.select(F.lit("insert").alias("op"), "source", "lang", "tokenizer", F.col("old_tokens").alias("n_tokens"))
    for _ in range(2):  # the replay adds nothing
        rollup.commit("0001-arrive", arrive)
    revised = state.where("n_tokens != old_tokens")
    rollup.commit("0002-clean", revised.select(F.lit("revise").alias("op"), "source", "lang", "tokenizer", "n_tokens", "old_tokens"))
    copied = state.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copies = state.join(copied.where("first < last"), "digest").where("doc_id > first")
    rollup.commit("0003-copies", copies.select(F.lit("delete").alias("op"), "source", "lang", "tokenizer", "n_tokens"))
