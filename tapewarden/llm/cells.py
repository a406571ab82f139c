"""Groups of sorted Arrow batches, one bounded group at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The runs of equal ``keys`` of a partition that is sorted by them; a run may reach over several batches."""
    waiting: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        waiting = table if waiting is None else pa.concat_tables([waiting, table])
        columns = [waiting[k].to_numpy() for k in keys]
        turn = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        edges = [0, *turn.tolist()]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield waiting.slice(a, b - a)
        waiting = waiting.slice(edges[-1])
    if waiting is not None and len(waiting):
        yield waiting
