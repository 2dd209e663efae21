"""Runs of rows with equal keys in sorted partitions, for functions of mapInArrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where a row's keys differ from those of the row before; nulls are equal to each other."""
    change = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in keys:
        c = batch.column(batch.schema.get_field_index(k))
        a, b = c.slice(0, batch.num_rows - 1), c.slice(1)
        same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
        none = pc.and_(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
        change |= ~(same | none)
    return np.flatnonzero(change) + 1


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1) -> Iterator[pa.Table]:
    """Each maximal run of rows with equal ``keys`` as one table; what does not fit a batch is carried on. Runs of
    fewer than ``least`` rows may be left out."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            edge = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]).combine_chunks().to_batches()[0]
            if len(starts(edge, keys)):
                yield pa.Table.from_batches(held)
                held = []
        cuts = [0, *starts(batch, keys).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a < least and b < batch.num_rows and not held:
                continue
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)
