"""Repeated token windows over a corpus: what the two substring deduplicators share.

A *rule* says which windows count as repeated and finds the places where
repeated windows can be (its ``candidates``, by its own method); here those
windows are compared by names of 128 bits and taken out.

All exchanges are of packed entries (:mod:`brindle.llm._packed`).  Before each
one a task settles what it can by itself and sends one entry per name, so a
name sends one entry per task, never one per document, and no group of copies
meets anywhere.  Texts are shuffled once, those with candidates once more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm._packed import ANSWER, ASK, OPEN, SPARK_ROWS, Buffer, Layout, address, bucket_count, meet, pack, runs, several, unpack
from brindle.llm._shared import as_bytes, chunks, cut, forget, mix, record, schemas, slim
from brindle.llm._windows import SEGMENT, ladder, segments, window_names

#: A row's id and a run of window starts in it: first start, windows, whether they are known to be repeated.
SPANS = Layout((8, 4, 4, 1), (0,))
#: The same for a document's key and its text's hash.
MARKS = Layout((8, 4, 4, 4, 1), (0,))
_WINDOWS = Layout((8, 8, 8, 4, 1), (2,))
_EARLIER = Layout((8, 8, 8, 8, 4), (2, 3))


class Rule(Protocol):
    """``window`` tokens (bytes, or words) that count as repeated."""

    words: bool
    window: int

    def candidates(self, bare: DataFrame, buckets: int) -> DataFrame:
        """``doc, copy, marks``: runs of windows of ``doc, copy, text`` that hold all repeated ones."""

    def exact(self, work: DataFrame, buckets: int) -> DataFrame:
        """``rid, spans``: the repeated windows among ``rid, doc, text, marks``."""


def largest_power(n: float) -> int:
    return 1 << max(0, int(n).bit_length() - 1)


def owner(doc: np.ndarray, copy: np.ndarray) -> np.ndarray:
    return mix(doc.astype(np.uint64)) ^ copy.astype(np.uint64)


def starts_of(spans: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All window starts of packed runs, with their marks."""
    first, n, flag = np.frombuffer(spans, "<i4").reshape(-1, 3).T.astype(np.int64)
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(flag, n) > 0


def gather(rows: DataFrame, layout: Layout, names: tuple[str, ...], column: str) -> DataFrame:
    """One row per owner (columns ``names``) with its runs in ``column``; consecutive windows become one run."""
    schema, arrow = schemas([], "".join(f"{n} long, " for n in names) + f"{column} binary")
    width = len(names)

    def run(table: pa.Table) -> pa.Table:
        cols = unpack(table, layout)
        *ids, start, n, flag = cols
        order = np.lexsort([start, flag, *ids[::-1]])
        *ids, start, n, flag = (c[order] for c in cols)
        new = runs(*ids, flag)
        new[1:] |= start[1:] != start[:-1] + n[:-1]
        first = np.flatnonzero(new)
        total = np.add.reduceat(n, first)
        whole = np.stack([start[first], total, flag[first]], axis=1).astype("<i4")
        begun = np.flatnonzero(runs(*[x[first] for x in ids]))
        edges = [*begun.tolist(), len(first)]
        data = [whole[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
        return pa.Table.from_batches([record(arrow, [*[x[first][begun] for x in ids], pa.array(data, pa.binary())])])

    assert width + 3 == len(layout.widths)
    return rows.groupBy("bucket").applyInArrow(run, schema)


# --- single windows --------------------------------------------------------


def exact_windows(work: DataFrame, words: bool, window: int, earlier: bool, buckets: int) -> DataFrame:
    """Packed answers: which of the windows in ``marks`` are repeated (``earlier``: start in a smaller document too)."""
    k = largest_power(window)

    def later(names: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
        order = np.lexsort([doc, *names[::-1]])
        new = runs(*[n[order] for n in names])
        out = np.zeros(len(doc), bool)
        out[order] = doc[order] > doc[order][new][np.cumsum(new) - 1]
        return out

    def give(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        a, b, doc, rid, at, paired = columns
        if earlier:
            gone = later([a, b], doc)
            yield pack(ASK, address(a[~gone], buckets), [x[~gone] for x in (a, b, doc, rid, at)], _EARLIER)
            gone = np.flatnonzero(gone)
        else:
            gone, ask, many = several([a, b], paired)
            yield pack(ASK, address(a[ask], buckets), [a[ask], b[ask], rid[ask], at[ask], many], _WINDOWS)
        yield from answer(rid[gone], at[gone])

    def answer(rid: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        one = np.ones(len(rid), np.int64)
        yield pack(ANSWER, address(rid, buckets), [rid, at, one, 0 * one], SPANS)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = Buffer(give)
        for batch in batches:
            for first, last in chunks(batch, "text"):
                part = batch.slice(first, last - first)
                rid, docs = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                marks = [starts_of(x.as_py()) for x in part.column(3)]
                for values, row, base, offsets in segments(part.column(2).to_pylist(), words, window, 2):
                    names = [window_names(ladder(v, (k,), lane)[0], k, window, lane) for lane, v in enumerate(values)]
                    where, who, flags, starts = [], [], [], []
                    for i, (r, b) in enumerate(zip(row.tolist(), base.tolist(), strict=True)):
                        begin, flag = marks[r]
                        mine = (begin >= b) & (begin < b + SEGMENT) & (begin <= b + offsets[i + 1] - offsets[i] - window)
                        where.append(begin[mine] - b + offsets[i])
                        starts.append(begin[mine])
                        flags.append(flag[mine])
                        who.append(np.full(len(starts[-1]), r))
                    at, r = np.concatenate(where), np.concatenate(who)
                    yield from buffer.add([names[0][at], names[1][at], docs[r], rid[r], np.concatenate(starts), np.concatenate(flags)])
        yield from buffer.flush()

    def decide(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if earlier:
            a, b, doc, rid, at = unpack(rows, _EARLIER)
            gone = np.flatnonzero(later([a, b], doc))
        else:
            a, b, rid, at, many = unpack(rows, _WINDOWS)
            gone, _, _ = several([a, b], many > 0)
        yield from answer(rid[gone], at[gone])

    return meet(work.select("rid", "doc", "text", "marks").mapInArrow(slim(ask), SPARK_ROWS), decide).filter(F.col("kind") == ANSWER)


# --- blocks of windows -----------------------------------------------------

_BLOCKS = Layout((8, 8, 8, 8, 4, 4, 1), (3,))
_GRAMS = Layout((8, 8, 4, 4, 1, 1), (1,))
_GRAM_ASK = 3


def exact_blocks(work: DataFrame, ask_blocks: Callable[[pa.RecordBatch], Iterator[list[np.ndarray]]], buckets: int) -> DataFrame:
    """Packed answers and open runs: all windows of an anchor at once.

    ``ask_blocks`` gives ``gram, name, name, rid, start, n``: the anchor's own
    name, the block's two names, and its windows.  Equal blocks are answered
    whole.  Where one gram has unlike blocks (only near the ends of repeated
    passages) one copy of each is left open, to be compared window by window.
    """

    def answer(kind: int, rid: np.ndarray, start: np.ndarray, n: np.ndarray, flag: np.ndarray) -> pa.RecordBatch:
        return pack(kind, address(rid, buckets), [rid, start, n, flag], SPANS)

    def give(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        gram, a, b, rid, start, n = columns
        gone, ask, many = several([a, b, gram])
        yield pack(ASK, address(a[ask], buckets), [x[ask] for x in (gram, a, b, rid, start, n)] + [many], _BLOCKS)
        yield answer(ANSWER, rid[gone], start[gone], n[gone], 0 * n[gone])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = Buffer(give)
        for batch in batches:
            for first, last in chunks(batch, "text"):
                for columns in ask_blocks(batch.slice(first, last - first)):
                    yield from buffer.add(columns)
        yield from buffer.flush()

    def by_block(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        gram, a, b, rid, start, n, paired = unpack(rows, _BLOCKS)
        gone, one, many = several([a, b, gram], paired > 0)
        yield answer(ANSWER, rid[gone], start[gone], n[gone], 0 * n[gone])
        # One copy of each block asks whether its gram has other blocks.
        gram, rid, start, n = gram[one], rid[one], start[one], n[one]
        unlike, ask, known = several([gram])
        yield answer(OPEN, rid[unlike], start[unlike], n[unlike], many[unlike])
        yield pack(_GRAM_ASK, address(gram[ask], buckets), [gram[ask], rid[ask], start[ask], n[ask], many[ask], known], _GRAMS)

    def by_gram(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() != _GRAM_ASK:
            return table
        gram, rid, start, n, many, known = unpack(table, _GRAMS)
        unlike, _, _ = several([gram], known > 0)
        return pa.Table.from_batches([answer(OPEN, rid[unlike], start[unlike], n[unlike], many[unlike])])

    rows = meet(work.select("rid", "doc", "text", "marks").mapInArrow(slim(ask), SPARK_ROWS), by_block)
    return rows.groupBy("kind", "bucket").applyInArrow(by_gram, SPARK_ROWS)


# --- whole jobs ------------------------------------------------------------


def covered(n: int, spans: bytes | None, window: int) -> np.ndarray | None:
    """Which of ``n`` tokens repeated windows cover; None for none."""
    if not spans:
        return None
    start, count, _ = np.frombuffer(spans, "<i4").reshape(-1, 3).T.astype(np.int64)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, start, 1)
    np.add.at(edges, start + count - 1 + window, -1)
    return np.cumsum(edges[:-1]) > 0


Finish = Callable[[bytes, list[bytes | None]], tuple]


def find_repeats(docs: DataFrame, rules: list[Rule], key: str, text: str, keep: tuple[str, ...], finish: Finish, result: str) -> DataFrame:
    """``finish(text, repeated windows by rule)`` of every row, as columns ``result`` (DDL).

    One row per input row: ``key``, the columns of ``keep`` and those of
    ``result``.  All rules are judged on the input.  Rows with one key and
    unlike texts are told apart by the text's hash.
    """
    spark = docs.sparkSession
    # A missing key comes after all others.
    doc = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit((1 << 63) - 1)).alias("doc")
    copy = F.xxhash64(as_bytes(f"`{text}`")).bitwiseAND(F.lit((1 << 31) - 1)).alias("copy")
    bare = docs.select(doc, copy, as_bytes(f"`{text}`").alias("text"))
    buckets = bucket_count(bare)
    marks = [cut(rule.candidates(bare, buckets), "marks") for rule in rules]
    carried = [F.col(f"`{key}`").alias("__key"), *[F.col(f"`{c}`").alias(f"__keep_{i}") for i, c in enumerate(keep)]]
    joined = docs.select(doc, copy, *carried, as_bytes(f"`{text}`").alias("text"))
    for i, found in enumerate(marks):
        joined = joined.join(found.withColumnRenamed("marks", f"marks_{i}"), ["doc", "copy"], "left")
    names = ["doc", "__key", *[f"__keep_{i}" for i in range(len(keep))]]
    fields = [joined.schema[c] for c in names]
    columns = [f"marks_{i}" for i in range(len(rules))]
    s1, a1 = schemas(fields, f"{result}, text binary, {', '.join(f'{c} binary' for c in columns)}")
    s2, a2 = schemas(fields, result)
    size = len(a2) - len(names)

    def settle(batches: Iterator[pa.RecordBatch], final: bool) -> Iterator[pa.RecordBatch]:
        """Results of rows without candidates (or, last, of the others); texts stay where work is left."""
        for batch in batches:
            for first, last in chunks(batch, "text"):
                *kept, texts = batch.slice(first, last - first).columns[: len(names) + 1]
                found = batch.slice(first, last - first).columns[len(names) + 1 :]
                rows = []
                for data, *spans in zip(texts, *found, strict=True):
                    data, spans = data.as_py(), [x.as_py() for x in spans]
                    if final or not any(spans):
                        rows.append((*finish(data, spans), None, *[None] * len(spans)))
                    else:
                        rows.append((*[None] * size, data, *spans))
                out = list(zip(*rows, strict=True))
                yield record(a2, [*kept, *out[:size]]) if final else record(a1, [*kept, *out])

    split = cut(joined.select(*names, "text", *columns).mapInArrow(slim(lambda it: settle(it, False)), s1).withColumn("rid", F.monotonically_increasing_id()), "texts")
    forget(*marks)
    work = split.filter("text is not null")
    changed = work.select("rid", *names, "text")
    spans = []
    for i, rule in enumerate(rules):
        some = work.filter(F.col(f"marks_{i}").isNotNull()).select("rid", "doc", "text", F.col(f"marks_{i}").alias("marks"))
        spans.append(cut(rule.exact(some, buckets), "spans"))
        changed = changed.join(spans[-1].withColumnRenamed("spans", f"spans_{i}"), "rid", "left")
    changed = changed.select(*names, "text", *[f"spans_{i}" for i in range(len(rules))]).mapInArrow(slim(lambda it: settle(it, True)), s2)
    out = split.filter("text is null").select(*s2.fieldNames()).unionByName(changed)
    return out.select(F.col("__key").alias(key), *[F.col(f"__keep_{i}").alias(c) for i, c in enumerate(keep)], *s2.fieldNames()[len(names) :])
