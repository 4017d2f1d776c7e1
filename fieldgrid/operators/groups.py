"""Whole groups in streams of Arrow batches: a task works on many small groups at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def gathered(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with the rows of a group side by side in one partition, for ``whole_groups``; the keys' columns come first."""
    return df.select(*keys, *(c for c in df.columns if c not in keys)).repartition(*keys).sortWithinPartitions(*keys)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut anew so that no group is parted, and where each group starts. Groups are runs of rows with the same first ``keys`` columns, without nulls."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(_starts(batch, keys)[-1])
        if held and not last and all(held[-1].column(k)[-1].equals(batch.column(k)[0]) for k in range(keys)):
            held.append(batch)
            continue
        whole = [*held, batch.slice(0, last)] if last else held
        if whole:
            yield _joined(whole, keys)
        held = [batch.slice(last)]
    if held:
        yield _joined(held, keys)


def _starts(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    new = np.ones(batch.num_rows, bool)
    new[1:] = False
    for k in range(keys):
        c = batch.column(k)
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _joined(batches: list[pa.RecordBatch], keys: int) -> tuple[pa.RecordBatch, np.ndarray]:
    batch = pa.concat_batches(batches)
    return batch, _starts(batch, keys)


def pairs_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, k): each i as often as ``sizes`` says, and k counting from 0 for each."""
    i = np.repeat(np.arange(len(sizes)), sizes)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def runs_within(work: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of consecutive items whose ``work`` adds up to ``most`` at most; an item beyond it is alone."""
    at, ends = 0, np.cumsum(work)
    while at < len(work):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield slice(at, stop)
        at = stop
