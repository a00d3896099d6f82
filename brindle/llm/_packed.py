"""Exchanges of packed entries: what a task has to say to a bucket travels as one binary value.

An entry is a few whole numbers.  A task collects up to ``FLUSH`` entries,
sorts them by bucket and gives out one row per kind and bucket.  Numbers are
stored in as many bytes as their column needs, byte by byte (first bytes of all
entries, second bytes, ...), so that the exchange's compression finds what is
alike; columns that hardly change from entry to entry are stored as differences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm._shared import mix, record

#: Entries that a task holds before it gives them out.
FLUSH = 1 << 18
#: Bytes of text for one bucket, on average: this at least, or this part of an executor's memory.
BUCKET_BYTES, BUCKET_PART = 1 << 22, 400
#: Buckets at least, so that small tables are dealt out too.
LEAST = 32
#: What a row holds: questions to a name's bucket, answers to their owner's bucket, questions left open.
ASK, ANSWER, OPEN = 0, 1, 2
SPARK_ROWS = "kind byte, bucket int, n int, data binary"
ARROW_ROWS = pa.schema([("kind", pa.int8()), ("bucket", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])


@dataclass(frozen=True)
class Layout:
    """Bytes of each column; ``delta``: columns stored as differences."""

    widths: tuple[int, ...]
    delta: tuple[int, ...] = ()


def address(x: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each number."""
    return (mix(x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int32)


def bucket_count(bare: DataFrame, column: str = "text") -> int:
    """Buckets for a table's texts, so that one fits a worker's memory.

    Not one more, as a bucket's task sends up to one row to each other bucket.
    """
    size = bare.agg(F.sum(F.octet_length(column))).first()[0] or 0
    memory = bare.sparkSession.sparkContext._jsc.sc().executorMemory() << 20
    return max(LEAST, -(-size // max(BUCKET_BYTES, memory // BUCKET_PART)))


def pack(kind: int, bucket: np.ndarray, columns: list[np.ndarray], layout: Layout) -> pa.RecordBatch:
    """One row per bucket of whole-number columns."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    firsts = np.flatnonzero(np.diff(bucket, prepend=np.int32(-1)))
    edges = np.append(firsts, len(bucket))
    planes = []
    for i, (column, width) in enumerate(zip(columns, layout.widths, strict=True)):
        x = column[order].astype(np.int64, copy=False) if column.dtype != np.uint64 else column[order].view(np.int64)
        if i in layout.delta:
            d = np.diff(x, prepend=np.int64(0))
            d[firsts] = x[firsts]
            x = d
        planes.append(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :width])
    pairs = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    data = [b"".join([p[a:b].T.tobytes() for p in planes]) for a, b in pairs]
    return record(ARROW_ROWS, [np.full(len(pairs), kind, np.int8), bucket[firsts], np.diff(edges).astype(np.int32), pa.array(data, pa.binary())])


def unpack(rows: pa.Table, layout: Layout) -> list[np.ndarray]:
    """The columns of all entries in packed rows, as 64-bit numbers."""
    counts = rows.column("n").to_numpy()
    total = int(counts.sum())
    out = [np.zeros((total, 8), np.uint8) for _ in layout.widths]
    cells = [cell for chunk in rows.column("data").chunks for cell in chunk]
    at = 0
    for n, cell in zip(counts.tolist(), cells, strict=True):
        raw, done = np.frombuffer(cell.as_buffer(), np.uint8), 0
        for x, width in zip(out, layout.widths, strict=True):
            x[at : at + n, :width] = raw[done : done + n * width].reshape(width, n).T
            done += n * width
        at += n
    columns = [x.view(np.int64).ravel() for x in out]
    for i in layout.delta:
        at = 0
        for n in counts.tolist():
            np.cumsum(columns[i][at : at + n], out=columns[i][at : at + n])
            at += n
    return columns


def runs(*columns: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns begins a new group."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def several(names: list[np.ndarray], paired: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries by equal names: those repeated here; one of each name to ask with; whether that one is repeated already.

    An entry marked ``paired`` is known to be repeated: it needs no answer, but
    entries of its name are repeated by it.
    """
    order = np.lexsort(names[::-1]) if len(names) > 1 else np.argsort(names[0], kind="stable")
    new = runs(*[n[order] for n in names])
    group = np.cumsum(new) - 1
    many = np.bincount(group) > 1 if len(group) else np.zeros(0, bool)
    if paired is not None:
        np.logical_or.at(many, group, paired[order])
    settled = many[group]
    if paired is not None:
        settled = settled & ~paired[order]
    firsts = order[new]
    again = np.argsort(firsts, kind="stable")
    return np.sort(order[settled]), firsts[again], many[again]


class Buffer:
    """Entries of a task until there are enough to give out."""

    def __init__(self, give: Callable[[list[np.ndarray]], Iterator[pa.RecordBatch]]) -> None:
        self.give, self.held, self.size = give, [], 0

    def add(self, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(columns[0]):
            self.held.append(columns)
            self.size += len(columns[0])
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            columns = [np.concatenate(x) for x in zip(*self.held, strict=True)]
            self.held, self.size = [], 0
            yield from self.give(columns)


def as_table(batches: Iterator[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(list(batches), schema=ARROW_ROWS)


def meet(rows: DataFrame, decide: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Questions of a bucket decided together; all other rows pass."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() != ASK:
            return table
        return as_table(decide(table))

    return rows.groupBy("kind", "bucket").applyInArrow(run, SPARK_ROWS)
