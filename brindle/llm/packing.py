"""Bulk-synchronous best-fit packing of tokenised documents into sequences of one length.

Pieces are taken class by class, longest first (each class goes down to half the
length of the one before).  In a round, the pieces of the class and the gaps of
open sequences that could hold one are range-sorted by size together.  Every
task sweeps its range downwards and gives each piece its successor, the smallest
gap that holds it; what a piece leaves of a gap is a gap again.  Pieces that find
none in their range conflict for the gaps left over in higher ranges: both are
ranked, a task's count of each is all that leaves it, and rank by rank the last
piece gets the nearest gap above.  Gaps are updated and rounds repeat while they
place enough; pieces that no gap holds then open sequences, again by best fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm._shared import as_bytes, chunks, cut, record, schemas, slim, table
from brindle.llm.word_bpe import WordIds

CAPACITY = 2048
#: Shorter pieces are one class.
SHORTEST = 64
#: Pieces and gaps that one task sweeps (on average).
SWEPT = 1 << 16
#: Pieces for which a task opens sequences at once.
OPENED = 1 << 16
#: What a round says: a piece placed; a gap updated; a gap left over; a piece left over.
PLACED, GAP, FREE, LEFT = range(4)

_MODELS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each worker process and vocabulary."""
    if path not in _MODELS:
        _MODELS[path] = WordIds(path)
    return _MODELS[path]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    model = word_ids(path)
    for batch in batches:
        for a, b in chunks(batch, "__bytes"):
            part = batch.slice(a, b - a)
            source, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(model.texts(part.column(1).to_pylist())):
                full = np.zeros(len(ids) + 1, "<u4")
                full[:-1] = ids
                for n, at in enumerate(range(0, len(full), capacity)):
                    data = full[at : at + capacity]
                    source.append(i)
                    piece.append(n)
                    start.append(at)
                    length.append(len(data))
                    crc.append(zlib.crc32(data.tobytes()))
            yield record(schema, [part.column(0).take(pa.array(source, pa.int32())), piece, start, length, crc])


class Gaps:
    """Open sequences by the room they have left; the successor of a length in one step."""

    def __init__(self, capacity: int) -> None:
        self.by_room: list[list] = [[] for _ in range(capacity + 1)]
        self.some = 0  # bit n: some sequence has room n

    def add(self, room: int, what: tuple) -> None:
        self.by_room[room].append(what)
        self.some |= 1 << room

    def take(self, length: int) -> tuple[int, tuple] | None:
        """The smallest room of at least ``length`` and a sequence that has it."""
        above = self.some >> length
        if not above:
            return None
        room = length + (above & -above).bit_length() - 1
        held = self.by_room[room]
        what = held.pop()
        if not held:
            self.some ^= 1 << room
        return room, what

    def all(self) -> Iterator[tuple[int, tuple]]:
        """Rooms in ascending order."""
        for room, held in enumerate(self.by_room):
            for what in held:
                yield room, what


_STATE = "kind byte, id long, size long, used long, seq long, part int, rank long"


def _sweep(batches: Iterator[pa.RecordBatch], capacity: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pieces and gaps of one range: placed pieces, updated gaps, what is left over and its rank."""
    rows = [x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    if not rows:
        return
    part = TaskContext.get().partitionId()
    gaps, out, left = Gaps(capacity), [], 0
    for is_gap, i, size, used in rows:
        if is_gap:
            gaps.add(size, (i, used, True))
    for size, i in sorted(((size, i) for is_gap, i, size, _ in rows if not is_gap), reverse=True):
        found = gaps.take(size)
        if found is None:
            out.append((LEFT, i, size, 0, 0, part, left))
            left += 1
            continue
        room, (seq, used, _) = found
        out.append((PLACED, i, size, used, seq, part, 0))
        if room > size:
            gaps.add(room - size, (seq, used + size, False))
    free = 0
    for room, (seq, used, untouched) in gaps.all():
        # Only gaps that nothing was put into are sure to hold what lower ranges have left.
        out.append((FREE if untouched else GAP, seq, room, used, 0, part, free if untouched else 0))
        free += untouched
    yield record(schema, list(zip(*out, strict=True)))


def rank_matches(free: dict[int, int], left: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """Intervals of ranks that match: (task of pieces, first rank, task of gaps, first rank, count).

    ``free`` and ``left`` count each task's gaps and pieces left over; tasks are
    numbered from the largest sizes down.  A task's pieces take the nearest gaps above.
    """
    stack: list[list[int]] = []
    out = []
    for part in sorted({*free, *left}):
        rank, need = 0, left.get(part, 0)
        while need and stack:
            above, first, n = stack[-1]
            k = min(need, n)
            out.append((part, rank, above, first, k))
            rank, need = rank + k, need - k
            stack[-1][1:] = first + k, n - k
            if k == n:
                stack.pop()
        if free.get(part):
            stack.append([part, 0, free[part]])
    return out


def _numbered(intervals: list[tuple[int, int, int]], schema: pa.Schema):
    """Adds to each row the number of the match that its task and rank are part of (-1: none)."""
    part, first, n = np.array(sorted(intervals), np.int64).reshape(-1, 3).T
    place = np.array([p << 40 | f for p, f in zip(part.tolist(), first.tolist(), strict=True)], np.int64)

    def run(batches: Iterator[pa.RecordBatch], base: np.ndarray) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (5, 6))
            i = np.searchsorted(place, p << 40 | rank, "right") - 1
            ok = (i >= 0) & (part[i] == p) & (rank < first[i] + n[i])
            yield record(schema, [*batch.columns, np.where(ok, base[i] + rank - first[i], -1)])

    return run


def _open(batches: Iterator[pa.RecordBatch], turn: int, capacity: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pieces that open sequences, by best fit among those that ``OPENED`` pieces of this task open together."""
    base, opened = turn << 50 | TaskContext.get().partitionId() << 30, 0
    ids, sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def worked(ids: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        nonlocal opened
        order = np.lexsort((-ids, -sizes))
        gaps, out = Gaps(capacity), []
        for size, i in zip(sizes[order].tolist(), ids[order].tolist(), strict=True):
            found = gaps.take(size)
            if found is None:
                found = capacity, (base + opened, 0)
                opened += 1
            room, (seq, used) = found
            out.append((PLACED, i, size, used, seq, 0, 0))
            if room > size:
                gaps.add(room - size, (seq, used + size))
        out += [(GAP, seq, room, used, 0, 0, 0) for room, (seq, used) in gaps.all()]
        return record(schema, list(zip(*out, strict=True)))

    for batch in batches:
        ids = np.concatenate([ids, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)])
        sizes = np.concatenate([sizes, batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)])
        while len(ids) >= OPENED:
            yield worked(ids[:OPENED], sizes[:OPENED])
            ids, sizes = ids[OPENED:], sizes[OPENED:]
    if len(ids):
        yield worked(ids, sizes)


def best_fit(pieces: DataFrame, capacity: int) -> DataFrame:
    """``id, seq, used`` for ``id, length``: the sequence of each piece and what that holds before it."""
    spark = pieces.sparkSession
    state, arrow = schemas([], _STATE)
    by_class = {r["c"]: r["n"] for r in pieces.groupBy(_class_of(F.col("length"), capacity).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a dozen classes
    placed: list[DataFrame] = []
    gaps: DataFrame | None = None
    turn, n_gaps = 0, 0
    for c in sorted(by_class, reverse=True):
        todo = pieces.filter(_class_of(F.col("length"), capacity) == c).select("id", F.col("length").alias("size"))
        low, left = (c // 2 + 1 if c > SHORTEST else 1), by_class[c]
        while left:
            turn += 1
            if gaps is not None and n_gaps:
                items = todo.select(F.lit(False).alias("gap"), "id", "size", F.lit(0).cast("long").alias("used")).unionByName(gaps.filter(F.col("size") >= low).select(F.lit(True).alias("gap"), "id", "size", "used"))
                tasks = max(1, -(-(left + n_gaps) // SWEPT))
                ranged = items.repartitionByRange(tasks, F.desc("size"), F.desc("gap"), F.xxhash64("id")) if tasks > 1 else items.repartition(1)
                swept = cut(ranged.mapInArrow(lambda it: _sweep(it, capacity, arrow), state), "swept")
                counts = {(r["kind"], r["part"]): r["n"] for r in swept.groupBy("kind", "part").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows a task
                of = lambda kind: {p: n for (k, p), n in counts.items() if k == kind}  # noqa: B023, E731
                matches = rank_matches(of(FREE), of(LEFT))
                if matches:
                    swept = _resolve(swept, matches, state, arrow)
                found = sum(of(PLACED).values()) + sum(x[-1] for x in matches)
                placed.append(swept.filter(F.col("kind") == PLACED).select("id", "seq", "used"))
                rest = gaps.filter(F.col("size") < low)
                gaps = rest.unionByName(swept.filter((F.col("kind") == GAP) | (F.col("kind") == FREE)).select("id", "size", "used"))
                todo = swept.filter(F.col("kind") == LEFT).select("id", "size")
                left -= found
                if found and left and tasks > 1:
                    continue  # until a round places nothing; one task has placed all that fits
            if left:
                opened = cut(todo.select(F.lit(LEFT).cast("byte").alias("kind"), "id", "size").mapInArrow(lambda it, turn=turn: _open(it, turn, capacity, arrow), state), "opened")
                placed.append(opened.filter(F.col("kind") == PLACED).select("id", "seq", "used"))
                new = opened.filter(F.col("kind") == GAP).select("id", "size", "used")
                gaps = new if gaps is None else gaps.unionByName(new)
                left = 0
        n_gaps = gaps.filter(F.col("size") >= 1).count() if gaps is not None else 0
    out = spark.createDataFrame([], "id long, seq long, used long")
    for one in placed:
        out = out.unionByName(one)
    return out


def _class_of(length: Column, capacity: int) -> Column:
    """The top of a length's class: the capacity, halved while it still holds the length, down to ``SHORTEST``."""
    tops = [capacity]
    while tops[-1] // 2 >= SHORTEST:
        tops.append(tops[-1] // 2)
    return F.least(*[F.when(length <= top, F.lit(top)).otherwise(F.lit(capacity)) for top in tops], F.lit(capacity))


def _resolve(swept: DataFrame, matches: list[tuple[int, int, int, int, int]], state, arrow: pa.Schema) -> DataFrame:
    """Pieces and gaps that matched by rank, put together."""
    s1, a1 = schemas([], f"{_STATE}, match long")
    base = np.concatenate([[0], np.cumsum([x[-1] for x in matches])])

    def numbered(kind: int, part: int, first: int) -> DataFrame:
        own = sorted((x[part], x[first], x[4], int(b)) for x, b in zip(matches, base, strict=False))
        run = _numbered([x[:3] for x in own], a1)
        begin = np.array([x[3] for x in own])
        return swept.filter(F.col("kind") == kind).mapInArrow(lambda it: run(it, begin), s1)

    left, free = numbered(LEFT, 0, 1), numbered(FREE, 2, 3)
    both = left.filter("match >= 0").select("match", F.col("id").alias("piece"), F.col("size").alias("length")).join(free.filter("match >= 0").select("match", F.col("id").alias("seq"), "size", "used"), "match")
    zero = [F.lit(0).cast("int").alias("part"), F.lit(0).cast("long").alias("rank")]
    put = both.select(F.lit(PLACED).cast("byte").alias("kind"), F.col("piece").alias("id"), F.col("length").alias("size"), "used", "seq", *zero)
    kept = both.filter("size > length").select(F.lit(GAP).cast("byte").alias("kind"), F.col("seq").alias("id"), (F.col("size") - F.col("length")).alias("size"), (F.col("used") + F.col("length")).alias("used"), F.lit(0).cast("long").alias("seq"), *zero)
    rest = left.filter("match < 0").drop("match").unionByName(free.filter("match < 0").drop("match"))
    return cut(swept.filter(F.col("kind") <= GAP).unionByName(rest).unionByName(put).unionByName(kept), "resolved")


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pack every document's ids, closed by id 0, into sequences of ``capacity``.

    One row per piece: ``key``, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id``, ``offset``.  Only documents over
    ``capacity`` are cut.  A null or empty text is the one id 0; a null key is
    kept; repeated rows are packed each for itself; an empty table gives an
    empty one; other columns are ignored.

    The driver gets counts only: of the classes, and four for each task of a round.
    """
    source = docs.select(F.col(f"`{key}`").alias("__key"), as_bytes(f"`{text}`").alias("__bytes"))
    schema, arrow = schemas(source.schema.fields[:1], "piece int, start long, length long, ids_crc32 long")
    pieces = cut(source.mapInArrow(slim(lambda it: _pieces(it, vocabulary, capacity, arrow)), schema).withColumn("id", F.monotonically_increasing_id()), "pieces")
    places = best_fit(pieces.select("id", "length"), capacity)
    out = pieces.join(places, "id").select(F.col("__key").alias(key), "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), F.col("used").alias("offset"))
    return out


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_vocabulary())


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
ORACLE: dict[str, str] = {}
