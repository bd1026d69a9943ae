"""Incremental re-runs: results kept per video and step under a signature of all they depend on."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.functions.text import signature

STEPS = ("transcribe", "prefilter", "energy", "select", "build")
CACHE = "video_id long, step string, sig string, payload string"


def chain_signatures(params: DataFrame, steps: tuple[str, ...] = STEPS) -> DataFrame:
    """video_id, step, sig of (video_id, step, param): a step's signature covers its parameters and the
    signature of the step before, so a change carries on to all later steps."""
    wide = params.groupBy("video_id").pivot("step", list(steps)).agg(F.max("param"))
    before = F.lit("")
    columns = []
    for step in steps:
        before = signature(before, F.col(step))
        columns.append(F.struct(F.lit(step).alias("step"), before.alias("sig")))
    return wide.select("video_id", F.explode(F.array(*columns)).alias("s")).select("video_id", "s.*")


def words_fingerprint(words: F.Column) -> F.Column:
    """SHA-256 of words as JSON."""
    return F.sha2(F.to_json(words), 256)


def stale(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Wanted (video_id, step, sig) that the cache lacks under this signature: the work to do."""
    return wanted.join(cache.select("video_id", "step", "sig"), ["video_id", "step", "sig"], "left_anti")


def status(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """``wanted`` with state: fresh, stale (another signature is there) or missing."""
    held = cache.groupBy("video_id", "step").agg(F.collect_set("sig").alias("_sigs"))
    out = wanted.join(held, ["video_id", "step"], "left")
    state = F.when(F.col("_sigs").isNull(), "missing").when(F.array_contains("_sigs", F.col("sig")), "fresh").otherwise("stale")
    return out.withColumn("state", state).drop("_sigs")


def split_cached(items: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with a cached value (its columns attached) and rows without."""
    return items.join(cache, keys), items.join(cache.select(*keys), keys, "left_anti")


def raw_clips(wanted: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw replies kept by (video_id, sig), a signature of all parameters: the ``wanted`` rows with content, and
    those to ask for. A kept content that is blank or no JSON list or object is a miss."""
    usable = F.trim("content").rlike(r"^[\[{]") & F.try_parse_json("content").isNotNull()
    good = raw.where(usable).groupBy("video_id", "sig").agg(F.min("content").alias("content"))
    return split_cached(wanted, good, ["video_id", "sig"])


class StepCache:
    """The cache as batches of Parquet files and numbered manifests in a folder. The newest batch's row of a video
    and step counts.

    The manifest with the greatest number lists the live batches, oldest first, each with the steps cleared since.
    A change writes its batch to a folder of its own and then takes effect by one rename of a new manifest to the
    next number, which fails if another writer has taken it; the change is then made to that manifest instead. So
    a crash at any point leaves the state before or after it, writers do not lose each other's batches, and a
    reader keeps the files it has planned on until ``vacuum``. Rename must be atomic and not replace a file, as
    on HDFS and local disks.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._store = self._at(self.path).getFileSystem(self._conf)

    def rows(self) -> DataFrame:
        return self._rows(self._newest()[1])

    def _rows(self, live: list[dict]) -> DataFrame:
        if not live:
            return self.spark.createDataFrame([], CACHE)
        batches = [self._batch(b).withColumn("_batch", F.lit(i)) for i, b in enumerate(live)]
        own = reduce(DataFrame.unionAll, batches)
        newest = own.groupBy("video_id", "step").agg(F.max_by(F.struct("sig", "payload"), "_batch").alias("n"))
        return newest.select("video_id", "step", "n.sig", "n.payload")

    def put(self, results: DataFrame) -> None:
        """Add (video_id, step, sig, payload) as a new batch; nothing that is there is written again."""
        batch = self._write(results.select("video_id", "step", "sig", "payload"))
        self._change(lambda live: [*live, batch])

    def compact(self) -> None:
        """Write the newest rows as one batch in place of those read. What another writer put meanwhile stays
        behind it, and what was cleared meanwhile stays cleared."""
        read = self._newest()[1]
        batch = self._write(self._rows(read))
        names = {b["name"]: set(b["without"]) for b in read}

        def change(live: list[dict]) -> list[dict]:
            kept = [b for b in live if b["name"] in names]
            if len(kept) < len(names):  # another compaction, or clearing of all, came first: this one has no place
                return live
            cleared = set.union(set(), *(set(b["without"]) - names[b["name"]] for b in kept))
            return [batch | {"without": sorted(cleared)}, *(b for b in live if b["name"] not in names)]

        self._change(change)

    def clear(self, step: str | None = None) -> None:
        """Forget one step, or all."""
        self._change(lambda live: [] if step is None else [b | {"without": sorted({*b["without"], step})} for b in live])

    def vacuum(self, older_than_hours: float = 24.0) -> int:
        """Delete batches that the newest manifest does not list, and older manifests, if they are older than any
        reader or writer at work. Returns how many folders and files went."""
        number, live = self._newest()
        keep = {b["name"] for b in live} | {f"{number:012d}.json"}
        until = (time.time() - older_than_hours * 3600) * 1000
        old = [f.getPath() for part in ("batches", "manifests") for f in self._list(part) if f.getModificationTime() < until]
        return sum(self._store.delete(p, True) for p in old if p.getName() not in keep)

    def _at(self, path: str) -> object:
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _list(self, part: str) -> list:
        at = self._at(f"{self.path}/{part}")
        return list(self._store.listStatus(at)) if self._store.exists(at) else []

    def _newest(self) -> tuple[int, list[dict]]:
        """Number and live batches of the newest manifest; 0 and none if there is none."""
        numbers = [int(m[1]) for f in self._list("manifests") if (m := re.fullmatch(r"(\d+)\.json", f.getPath().getName()))]
        if not numbers:
            return 0, []
        file = self._store.open(self._at(f"{self.path}/manifests/{max(numbers):012d}.json"))
        try:
            return max(numbers), json.loads(bytes(file.readAllBytes()).decode())
        finally:
            file.close()

    def _batch(self, batch: dict) -> DataFrame:
        own = self.spark.read.schema(CACHE).parquet(f"{self.path}/batches/{batch['name']}")
        return own.where(~F.col("step").isin(*batch["without"])) if batch["without"] else own

    def _write(self, rows: DataFrame) -> dict:
        name = uuid.uuid4().hex
        rows.write.partitionBy("step").parquet(f"{self.path}/batches/{name}")
        return {"name": name, "without": []}

    def _change(self, change: Callable[[list[dict]], list[dict]]) -> None:
        """Make ``change`` to the newest manifest, again for as long as another writer is faster."""
        while True:
            number, live = self._newest()
            if self._commit(number + 1, change(live)):
                return

    def _commit(self, number: int, live: list[dict]) -> bool:
        """Whether manifest ``number`` is now this one; false if there is one already."""
        staged, final = self._at(f"{self.path}/manifests/{uuid.uuid4().hex}.tmp"), self._at(f"{self.path}/manifests/{number:012d}.json")
        file = self._store.create(staged)
        file.write(json.dumps(live).encode())
        file.close()
        never_over = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._store.getUri(), self._conf).rename(staged, final, never_over)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            self._store.delete(staged, False)
            return False
        return True


def merged_metadata(videos: DataFrame, cached: DataFrame, generated: DataFrame) -> DataFrame:
    """title and caption of each video: the user's, else cached, else generated."""
    c = cached.select("video_id", F.col("title").alias("_ct"), F.col("caption").alias("_cc"))
    g = generated.select("video_id", F.col("title").alias("_gt"), F.col("caption").alias("_gc"))
    out = videos.join(c, "video_id", "left").join(g, "video_id", "left")
    blank = lambda x: F.when(F.trim(x) != "", F.col(x))
    return out.withColumns(
        {"title": F.coalesce(blank("user_title"), blank("_ct"), "_gt"), "caption": F.coalesce(blank("user_caption"), blank("_cc"), "_gc")}
    ).drop("_ct", "_cc", "_gt", "_gc", "user_title", "user_caption")
