"""Helpers that several operators of this subpackage use: the shared folder, group streaming, components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from nodeloom.operators import structure
from nodeloom.storage import scratch, written  # noqa: F401


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Consecutive rows with equal leading n_keys columns, as (key, columns); the input is sorted by them.

    Only the group under way is held.
    """
    key, cols = None, None
    for batch in batches:
        data = [c.to_pylist() for c in batch.columns]
        n = batch.num_rows
        start = 0
        keys = list(zip(*data[:n_keys]))
        for i in range(n):
            if keys[i] != key:
                if cols is not None:
                    for c, d in zip(cols, data[n_keys:]):
                        c.extend(d[start:i])
                    yield key, cols
                key, cols, start = keys[i], [[] for _ in data[n_keys:]], i
        if cols is not None:
            for c, d in zip(cols, data[n_keys:]):
                c.extend(d[start:n])
    if cols is not None:
        yield key, cols


def give_back() -> None:
    """Memory that this worker no longer uses, back to the machine: the worker stays for the next task, and what the
    allocators keep would count for as long."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has it
    if trim:
        trim(0)


def trimmed(task):
    """task (batches -> batches), with give_back at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        give_back()

    return run


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of the undirected edges (a, b) as (node, component_id), the smallest id reachable."""
    return structure.components(edges, a, b).toDF("node", "component_id")
