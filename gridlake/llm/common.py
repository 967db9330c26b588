"""Helpers shared by the operators: Arrow batch loops, deterministic samples, hashed counts."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows handled at once inside a Python task, so that the Python copy of a batch stays small.
SLICE_ROWS = 512


def sliced(step: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator], Iterator]:
    """A mapInArrow function that applies ``step`` to slices of SLICE_ROWS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                out = step(batch.slice(k, SLICE_ROWS))
                if out.num_rows:
                    yield out

    return run


def batch_of(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    """A record batch from ``{name: (values, type)}``."""
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def hash_sample(df: DataFrame, key: str, rows: int, seed: int = 0) -> DataFrame:
    """At most ``rows`` rows with the smallest hash of ``key``: a bounded sample that is the same on
    every run and every partitioning.  Ties are broken by the key itself."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(rows)


def hashed_counts(df: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], buckets: int,
                  chunk: int = 16_384) -> np.ndarray:
    """Sum over all tasks of a count table with a fixed number of buckets.

    ``count`` turns a task's batches into an int64 array of ``buckets`` counts (bounded memory however
    large the task's input).  A task sends its table as chunks.  They are added in two steps, first per slice of
    tasks (as many slices as the tables' size asks for), then per chunk, so no task adds up what all tasks sent; only
    the summed table, ``8 * buckets`` bytes whatever the input, reaches the driver.
    """

    def partial(batches):
        total = count(batches)
        own = random.randrange(1 << 16)
        for k in range(0, buckets, chunk):
            part = total[k:k + chunk]
            if part.any():
                yield batch_of({"chunk": ([k], pa.int64()), "counts": ([part.astype("<i8").tobytes()], pa.binary()), "slice": ([own], pa.int32())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw, "<i8")
                sums[k] = sums[k] + part if k in sums else part.copy()
        for k, part in sums.items():
            yield batch_of({"chunk": ([k], pa.int64()), "counts": ([part.tobytes()], pa.binary())})

    schema = "chunk long, counts binary"
    n_chunks = -(-buckets // chunk)
    rows = (df.mapInArrow(partial, schema + ", slice int")
            .repartition("slice").mapInArrow(add, schema)
            .repartition(min(n_chunks, 64), "chunk")
            .mapInArrow(add, schema).collect())
    out = np.zeros(buckets, np.int64)
    for r in rows:
        part = np.frombuffer(bytes(r["counts"]), "<i8")
        out[r["chunk"]:r["chunk"] + len(part)] += part
    return out
