"""Arrow lists of structs as NumPy arrays and back, for rules that run over many lists at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def sizes_of(lists: pa.Array) -> np.ndarray:
    """The length of each list, 0 for null."""
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def starts_of(sizes: np.ndarray) -> np.ndarray:
    """Where lists of these sizes start when they stand one behind another, and where the last one ends."""
    return np.concatenate([[0], np.cumsum(sizes)])


def places(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, as many as ``sizes`` says, one run behind another."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def list_of(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts_of(sizes), pa.int32()), values)


def floats(values: np.ndarray, unknown: bool) -> pa.Array:
    """Numbers; NaN is null if there are ``unknown`` ones among those they were made of."""
    return pa.array(values, pa.float64(), from_pandas=unknown)


def joined(words: pa.Array, sizes: np.ndarray, between: str) -> pa.Array:
    """Runs of these sizes of words as one text each; null words are passed over, a text of one null is null."""
    if not words.null_count:
        return pc.binary_join(list_of(words, sizes), between)
    runs = list_of(words, sizes).to_pylist()
    return pa.array([None if run == [None] else between.join(w for w in run if w is not None) for run in runs], pa.string())


def by_batch(rule: Callable[..., pa.Array], kind: str, *columns: Column | str) -> Column:
    """What ``rule`` makes of Arrow arrays of the columns. It is not made again for a filter behind it."""

    def run(batches: Iterator) -> Iterator[pa.Array]:
        for batch in batches:
            yield rule(*batch) if isinstance(batch, tuple) else rule(batch)

    hints = {"batches": Iterator[tuple[pa.Array, ...]] if len(columns) > 1 else Iterator[pa.Array], "return": Iterator[pa.Array]}
    run.__annotations__ = hints
    return F.arrow_udf(run, kind).asNondeterministic()(*columns)


class Fields:
    """Fields of an Arrow array of structs by name as NumPy arrays, NaN for null; of the structs at ``at``, if given."""

    def __init__(self, of: pa.StructArray, at: np.ndarray | None = None) -> None:
        self.of, self.at = of, at

    def __getitem__(self, name: str) -> np.ndarray:
        values = self.of.field(name).to_numpy(zero_copy_only=False)
        return values if self.at is None else values[self.at]
