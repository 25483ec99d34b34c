"""Reading sorted Arrow batches group by group inside mapInArrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def by_key(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """A table for each run of equal values in that column; holds one group and one batch at most."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key)
        same = np.asarray(pc.equal(values[1:], values[:-1]).fill_null(False)) if batch.num_rows > 1 else np.zeros(0, bool)
        cuts = [0, *(np.nonzero(~same)[0] + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == 0 and held and held[-1].column(key)[0] != values[0]:
                yield pa.Table.from_batches(held)
                held = []
            elif a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
