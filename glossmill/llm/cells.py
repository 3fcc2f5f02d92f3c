"""Counts of hashed keys in a table of fixed size, over all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W

_CHUNK_BITS = 15


def cell_counts(rows: DataFrame, cells: Callable[[pa.Array], np.ndarray], bits: int, n: int) -> np.ndarray:
    """How often ``cells`` of the texts of ``rows`` gives each of ``2**bits`` cells.

    Tasks count and pass on chunks of their counts (one that goes above 65,535 in a task stays there), which are
    summed; the driver gets 4 bytes a cell at any size of the input.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << bits, np.int64)
        for batch in W.small(batches):
            found += np.bincount(cells(batch.column("text")), minlength=len(found))
        chunks = np.minimum(found, 65_535).astype(np.uint16).reshape(-1, 1 << _CHUNK_BITS)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(len(chunks)), pa.int32()), "counts": pa.array([c.tobytes() for c in chunks], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                sums.setdefault(chunk, np.zeros(1 << _CHUNK_BITS, np.uint32))
                sums[chunk] += np.frombuffer(counts, np.uint16)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "counts": pa.array([c.tobytes() for c in sums.values()], pa.binary())})

    schema = "chunk int, counts binary"
    summed = rows.select("text").mapInArrow(tally, schema).repartition(min(n, 1 << bits - _CHUNK_BITS), "chunk").mapInArrow(add, schema)
    out = np.zeros((1 << bits - _CHUNK_BITS, 1 << _CHUNK_BITS), np.uint32)
    for r in summed.toLocalIterator():
        out[r.chunk] = np.frombuffer(r.counts, np.uint32)
    return out.ravel()
