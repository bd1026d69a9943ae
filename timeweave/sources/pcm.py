"""Raw s16le mono recordings as a Spark data source: ranges of whole windows are read, parts are written in order.

Files are opened with ``pyarrow.fs`` on the executors, so a path is absolute or a URI of a store that it knows
(file, hdfs, s3, gs), reachable from all of them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

ENDING = ".s16le"
SAMPLE = 2


def _store(path: str) -> tuple[fs.FileSystem, str]:
    store, own = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return store, own.rstrip("/")


@dataclass
class Ranges(InputPartition):
    """Pieces of recordings for one task: (path in the store, video_id, first window, windows)."""

    pieces: list[tuple[str, str, int, int]]


def plan_ranges(files: list[tuple[str, int]], per_window: int, split_bytes: int) -> list[Ranges]:
    """Whole windows of ``files`` (path, bytes) cut into pieces of some ``split_bytes``; small ones share a task.
    A tail shorter than a window is in no piece."""
    window = per_window * SAMPLE
    most = max(1, split_bytes // window)
    out, room = [], 0
    for path, length in sorted(files):
        stem, first, left = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1]), 0, length // window
        while left:
            if not room:
                out.append(Ranges([]))
                room = most
            n = min(left, room)
            out[-1].pieces.append((path, stem, first, n))
            first, left, room = first + n, left - n, room - n
    return out


class PcmReader(DataSourceReader):
    """Plans ranges from the lengths of files and reads a range some windows at a time."""

    AT_ONCE = 1 << 22

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.per_window = int(options.get("per_window", 8000))
        self.split_bytes = int(options.get("split_bytes", 64 << 20))
        if self.per_window < 1:
            raise ValueError("per_window must be 1 or more")

    def partitions(self) -> list[Ranges]:
        store, own = _store(self.path)
        info = store.get_file_info(own)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(own, recursive=True))
        files = [(f.path, f.size) for f in found if f.is_file and f.path.endswith(ENDING)]
        return plan_ranges(files, self.per_window, self.split_bytes) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        window = self.per_window * SAMPLE
        step = max(1, self.AT_ONCE // window)
        for path, stem, first, n in partition.pieces:
            with store.open_input_file(path) as file:
                for at in range(first, first + n, step):
                    k = min(step, first + n - at)
                    samples = np.frombuffer(file.read_at(k * window, at * window), "<i2").reshape(k, self.per_window)
                    rms = np.sqrt(np.array([np.square(w.astype(np.float64)).mean() for w in samples]))
                    columns = [pa.array([stem] * k, pa.string()), pa.array(np.arange(at, at + k)), pa.array(rms)]
                    yield pa.RecordBatch.from_arrays(columns, ["video_id", "win_idx", "rms"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class PcmWriter(DataSourceArrowWriter):
    """Streams parts to a file a recording. A task writes under names of its own; the commit of the whole write
    gives files their names, so a lost or repeated task leaves none behind that a reader sees."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, own = _store(self.path)
        store.create_dir(own, recursive=True)
        files, name, out = [], None, None
        try:
            for batch in iterator:
                for video, content in zip(batch.column("video_id"), batch.column("content")):
                    if out is None or video.as_py() != name:
                        if out:
                            out.close()
                        name = video.as_py()
                        files.append((f"{own}/_{uuid.uuid4().hex}", f"{own}/{name}{ENDING}"))
                        out = store.open_output_stream(files[-1][0])
                    if content.is_valid:
                        out.write(content.as_buffer())
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.path)
        pairs = [pair for m in messages if m for pair in m.files]
        names = [final for _, final in pairs]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("parts of a recording must be together in one task")
        for own, final in pairs:
            store.move(own, final)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.path)
        for own, _ in (pair for m in messages if m for pair in m.files):
            store.delete_file(own)


class PcmSource(DataSource):
    """Format ``pcm_windows``: reads ``video_id, win_idx, rms``, writes ``video_id, content``."""

    @classmethod
    def name(cls) -> str:
        return "pcm_windows"

    def schema(self) -> str:
        return "video_id string, win_idx long, rms double"

    def reader(self, schema: StructType) -> PcmReader:
        return PcmReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> PcmWriter:
        return PcmWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(PcmSource)
