"""Groups of a sorted stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of a stream sorted by `key`: at each batch's end, all that are complete."""
    kept: list[pa.Table] = []
    for batch in batches:
        keys = batch.column(key).to_numpy()
        if not len(keys):
            continue
        table = pa.Table.from_batches([batch])
        same = kept and kept[-1].column(key)[-1].as_py() == keys[0]
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if cut or (kept and not same):
            done = [*kept, table.slice(0, cut)]
            yield pa.concat_tables(done).combine_chunks()
            kept = []
        kept.append(table.slice(cut))
    if kept:
        yield pa.concat_tables(kept).combine_chunks()


def group_bounds(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
