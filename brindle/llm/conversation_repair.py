"""Conversation structure repair: the cheapest edits that make turns alternate.

Roles must begin with ``(s?(ua)+)?``.  That has four states (nothing yet, after
the system turn, after a user turn, after an assistant turn), and the edits of
one turn, with a run of insertions before it, are one macro edit.  The macros'
codes (D, ID, IK, IR, K, R) are free of prefixes and ordered as in ASCII, so of
two audits over the same turns the one with the smaller code at the first
difference is the smaller string.  A layer of the dynamic program (one turn) thus
keeps per state its cost, the rank of its audit among the layer's, and a byte
with the parent state and the code; audits are spelt out afterwards.  Longer runs
before a turn only cost more: two insertions lead back to the same state or to
one that a single turn reaches as well.

Costs and ranks of a stretch of turns from each state to each state are again
such a macro.  Turns are range-sorted, so a conversation of any length is dealt
over tasks in segments; segments' macros are put together by task, tasks' macros
by conversation, and each segment is then told where it begins and ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from brindle.llm._shared import cut, record, schemas, slim, table

SPACES = " \t\n\v\f\r"
#: Edits of one turn, in ASCII order, and their costs.
CODES = ("D", "ID", "IK", "IR", "K", "R")
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
NEXT_ROLE = ("user", "user", "assistant", "user")
AFTER = (2, 2, 3, 2)
#: Insertions that end a conversation in each state.
TAIL = np.array([0, 2, 1, 0])
LEGAL = {"su", "ua", "au"}
_INF = 1 << 50
#: Turns and text bytes of a segment (a longer turn is one alone).
SEGMENT_ROWS, SEGMENT_BYTES = 1_024, 1 << 16


def _moves() -> np.ndarray:
    """cost * 32 + code from state to state; by initial (s u a, other) * 2 + truncated, and 8 for turns that must go."""
    out = np.full((9, 4, 4), _INF * 32, np.int64)
    for kind in range(9):
        initial, extra = "sua-"[kind // 2] if kind < 8 else "-", TRUNCATED * (kind % 2)
        for state in range(4):
            for code, name in enumerate(CODES):
                at, cost = (AFTER[state], INSERT) if name[0] == "I" else (state, 0)
                if name[-1] == "D":
                    to, cost = at, cost + DELETE
                elif kind == 8:
                    continue
                elif name[-1] == "R":
                    to, cost = AFTER[at], cost + REROLE + extra
                elif initial == "s" and at == 0:
                    to, cost = 1, cost + extra
                elif initial == NEXT_ROLE[at][0]:
                    to, cost = AFTER[at], cost + extra
                else:
                    continue
                out[kind, state, to] = min(out[kind, state, to], cost * 32 + code)
    return out


MOVES = _moves()


class Walk:
    """The dynamic program over many chains side by side, layer by layer.

    A chain is a sequence of indices into ``moves`` (macros of cost * 32 + order);
    ``starts`` are the states it may begin in.  ``cost`` and ``rank`` are by
    chain, start and state.
    """

    def __init__(self, moves: np.ndarray, chains: list[np.ndarray], starts: np.ndarray, trail: bool = True):
        n, lengths = len(chains), np.array([len(c) for c in chains], np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        self.base = np.concatenate([[0], np.cumsum(lengths)])
        self.active = [int((lengths > i).sum()) for i in range(int(lengths.max(initial=0)))]
        flat = np.concatenate(chains) if n else np.zeros(0, np.int64)
        self.cost = np.full((n, starts.shape[1], 4), _INF, np.int64)
        np.put_along_axis(self.cost, starts[:, :, None], 0, 2)
        self.rank = np.zeros_like(self.cost)
        self.trail: list[np.ndarray] = []
        for layer, count in enumerate(self.active):
            at = self.order[:count]
            key = (self.cost[at] * 4 + self.rank[at])[..., None] * 8 + moves[flat[self.base[at] + layer]][:, None]
            parent = key.argmin(2)
            best = np.take_along_axis(key, parent[:, :, None], 2)[:, :, 0]
            self.cost[at] = np.minimum(best >> 5, _INF)
            low = np.where(best >> 5 >= _INF, 31, best & 31)  # the parent's rank, then the code
            self.rank[at] = (low[..., None, :] < low[..., None]).sum(-1)
            if trail:
                self.trail.append((parent * 8 + (best & 7)).astype(np.uint8)[:, 0])

    def ends(self) -> np.ndarray:
        """The state in which each chain ends best, with the insertions that it then takes."""
        return ((self.cost[:, 0] + INSERT * TAIL) * 4 + self.rank[:, 0]).argmin(1)

    def back(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State before each step and its order number, chain after chain."""
        state = ends.astype(np.int64).copy()
        before, code = np.empty(self.base[-1], np.int64), np.empty(self.base[-1], np.int64)
        for layer in range(len(self.active) - 1, -1, -1):
            at = self.order[: self.active[layer]]
            step = self.trail[layer][np.arange(len(at)), state[at]]
            place = self.base[at] + layer
            state[at] = step >> 3
            before[place], code[place] = state[at], step & 7
        return before, code

    def macros(self) -> np.ndarray:
        """Each chain as one macro, for chains walked from all four states."""
        return self.cost * 32 + self.rank


ALL = np.arange(4)


def kinds_of(roles: list[str], texts: list[str], again: set[int] | None) -> tuple[np.ndarray, list[int]]:
    """Each turn's row of MOVES, and the numbers of blank, duplicate and truncated turns.

    ``again``: places of turns seen earlier; None to look in these turns alone.
    """
    kinds, counts, seen = np.empty(len(roles), np.int64), [0, 0, 0], set()
    for i, (role, text) in enumerate(zip(roles, texts, strict=True)):
        body = text.strip(SPACES)
        if again is None:
            repeated = (role, text) in seen
            seen.add((role, text))
        else:
            repeated = i in again
        if not body or repeated:
            counts[bool(body)] += 1
            kinds[i] = 8
        else:
            cut_off = body[-1] not in ".!?"
            counts[2] += cut_off
            kinds[i] = 2 * ({"s": 0, "u": 1, "a": 2}.get(role[:1], 3)) + cut_off
    return kinds, counts


def edited(roles: list[str], texts: list[str], before: np.ndarray, codes: np.ndarray, tail: int) -> list[tuple[str, str]]:
    """The turns that the edits leave; a tail of one or two insertions ends the conversation."""
    out = []
    for role, text, state, code in zip(roles, texts, before.tolist(), codes.tolist(), strict=True):
        name = CODES[code]
        if name[0] == "I":
            out.append((NEXT_ROLE[state], ""))
            state = AFTER[state]
        if name[-1] == "K":
            out.append((role, text))
        elif name[-1] == "R":
            out.append((NEXT_ROLE[state], text))
    return out + [("user", ""), ("assistant", "")][2 - tail :]


class Report:
    """What is returned of a conversation, gathered from its segments in order."""

    def __init__(self):
        self.first = self.last = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.initial: str | None = None
        self.audit: list[str] = []
        self.digest, self.empty = hashlib.sha256(), True

    def add(self, turns: list, initials: list[str], counts: list[int], cost: int, audit: str, lines: list[tuple[str, str]]) -> None:
        known = [t for t in turns if t is not None]
        if known:  # in order
            self.distinct += len(set(known)) - (self.last == known[0])
            self.first, self.last = (known[0] if self.first is None else self.first), known[-1]
        self.blank, self.duplicate, self.truncated = (a + b for a, b in zip((self.blank, self.duplicate, self.truncated), counts, strict=True))
        if initials:
            line = initials if self.initial is None else [self.initial, *initials]
            self.illegal += sum(a + b not in LEGAL for a, b in zip(line, line[1:], strict=False))
            self.initial = initials[-1]
        self.cost += cost
        self.audit.append(audit)
        if lines:
            self.digest.update(b"\n" * (not self.empty) + "\n".join(f"{r}:{t}" for r, t in lines).encode())
            self.empty = False

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURN = "array<struct<role: string, text: string>>"


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows damaged by ``crc32(conv:turn) % 20``; ``dropped`` marks those that fault 0 drops.

    0 drops, 1 empties the text, 2 takes out ``.!?``, 3 repeats the row, 4 sets
    the role to user.  Nulls of role and text, and in the hashed key, are one space.
    """
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    fault = (F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20).alias("fault")
    rows = turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), blank(role).alias("role"), blank(text).alias("text"), fault)
    said = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), (F.col("fault") == 0).alias("dropped"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.select(F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), F.col("text").alias(text), "dropped")


def _segments(batches: Iterator[pa.RecordBatch], schema: pa.Schema, most: int, size: int) -> Iterator[pa.RecordBatch]:
    """Sorted turns as segments.  ``whole`` marks conversations that lie in one segment and within the task."""
    part, number, held = TaskContext.get().partitionId(), 0, None
    first, broken, run = True, False, 0

    def pieces(lengths: np.ndarray, start: int, stop: int) -> list[int]:
        """Starts of the segments of a conversation."""
        out, rows, total = [start], 0, 0
        if stop - start <= most and int(lengths[start:stop].sum()) <= size:
            return out
        for i in range(start, stop):
            if rows and (rows >= most or total + int(lengths[i]) > size):
                out.append(i)
                rows = total = 0
            rows, total = rows + 1, total + int(lengths[i])
        return out

    def emit(rows: pa.Table, spans: list[tuple[int, bool, int]], stop: int) -> pa.RecordBatch:
        nonlocal number
        starts = np.array([s for s, _, _ in spans])
        keep = ~rows["dropped"].to_numpy()[:stop]
        upto = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
        offsets = pa.array(np.append(upto[starts], upto[stop]), pa.int32())
        kept = rows.slice(0, stop).filter(pa.array(keep))
        lists = [pa.ListArray.from_arrays(offsets, kept[c].combine_chunks()) for c in ("turn", "role", "text")]
        n = len(spans)
        number += n
        return record(schema, [rows["conv"].take(pa.array(starts)).combine_chunks(), [part] * n, [r for _, _, r in spans], range(number - n, number), [w for _, w, _ in spans], *lists])

    def worked(rows: pa.Table, over: bool) -> Iterator[pa.RecordBatch]:
        """Segments of all that is complete; the rest is held."""
        nonlocal held, first, broken, run
        rows = rows.combine_chunks()
        ends = pc.run_end_encode(rows["conv"].combine_chunks()).run_ends.to_numpy()
        lengths = pc.fill_null(pc.binary_length(rows["text"]), 0).to_numpy()
        spans: list[tuple[int, bool, int]] = []
        start = 0
        for stop in ends.tolist():
            last = stop == rows.num_rows
            starts = pieces(lengths, start, stop)
            if not broken:
                run = number + len(spans)
            alone = len(starts) == 1 and not (first or broken or last)
            if last and not over:
                spans += [(s, False, run) for s in starts[:-1]]
                broken = broken or len(starts) > 1
                start = starts[-1]
                break
            spans += [(s, alone, run) for s in starts]
            first = broken = False
            start = stop
        if spans:
            yield emit(rows, spans, start)
        held = rows.slice(start) if start < rows.num_rows else None

    for batch in batches:
        if batch.num_rows:
            now = pa.Table.from_batches([batch])
            yield from worked(now if held is None else pa.concat_tables([held, now]), False)
    if held is not None:
        yield from worked(held, True)


def _lists(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def _again(batch: pa.RecordBatch) -> list[set[int] | None]:
    """Places of duplicates by segment: as found across segments, or None where the segment is whole."""
    if "again" not in batch.schema.names:
        return [None] * batch.num_rows
    return [set(x or ()) for x in _lists(batch, "again")[0]]


def _solved(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str], list[int], int, str, list[tuple[str, str]]]]:
    """What each segment of a batch adds to its conversation's report; whole ones choose their own end."""
    turns, roles, texts = _lists(batch, "turn", "role", "text")
    found = [kinds_of(r, t, a) for r, t, a in zip(roles, texts, _again(batch), strict=True)]
    n = batch.num_rows
    loose = "start" in batch.schema.names
    start, end, tail = (np.array(x, np.int64) for x in _lists(batch, "start", "end", "tail")) if loose else (np.zeros(n, np.int64), None, None)
    walk = Walk(MOVES, [k for k, _ in found], start[:, None])
    if not loose:
        end = walk.ends()
        tail = TAIL[end]
    before, codes = walk.back(end)
    cost = walk.cost[np.arange(n), 0, end] + INSERT * tail
    for i in range(n):
        at = slice(walk.base[i], walk.base[i + 1])
        audit = "".join([CODES[c] for c in codes[at].tolist()]) + "I" * int(tail[i])
        yield turns[i], [r[:1] for r in roles[i]], found[i][1], int(cost[i]), audit, edited(roles[i], texts[i], before[at], codes[at], int(tail[i]))


def _report(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row for each whole conversation."""
    for batch in batches:
        rows = []
        for solved in _solved(batch):
            report = Report()
            report.add(*solved)
            rows.append(report.row())
        yield record(schema, [batch.column(0), *(zip(*rows, strict=True) if rows else [[]] * 8)])


def _pieces(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What each segment adds, to be gathered in order."""
    for batch in batches:
        rows = [(turns, initials, counts, cost, audit, [{"role": r, "text": t} for r, t in lines]) for turns, initials, counts, cost, audit, lines in _solved(batch)]
        yield record(schema, [*(batch.column(batch.schema.get_field_index(c)) for c in ("conv", "part", "seg")), *(zip(*rows, strict=True) if rows else [[]] * 6)])


def _gathered(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Reports of conversations whose pieces come in order; one conversation is open at a time."""
    report, conv = None, None
    for batch in batches:
        keys, rows = [], []
        ids = batch.column(0).to_pylist()
        for i, key in enumerate(ids):
            if report is not None and key != conv:
                keys.append(conv)
                rows.append(report.row())
                report = None
            report, conv = report or Report(), key
            *rest, lines = (batch.column(c)[i].as_py() for c in range(3, 9))
            report.add(*rest, [(x["role"], x["text"]) for x in lines])
        yield record(schema, [keys, *(zip(*rows, strict=True) if rows else [[]] * 8)])
    if report is not None:
        yield record(schema, [[conv], *([x] for x in report.row())])


def _macros(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Each segment as one macro of 16 numbers."""
    for batch in batches:
        roles, texts = _lists(batch, "role", "text")
        chains = [kinds_of(r, t, a)[0] for r, t, a in zip(roles, texts, _again(batch), strict=True)]
        macros = Walk(MOVES, chains, np.tile(ALL, (batch.num_rows, 1)), trail=False).macros()
        yield record(schema, [*(batch.column(batch.schema.get_field_index(c)) for c in ("conv", "part", "run", "seg")), list(macros.reshape(-1, 16))])


def _stacked(rows: pd.DataFrame, order: str) -> tuple[pd.DataFrame, np.ndarray]:
    rows = rows.sort_values(order)
    return rows, np.stack(rows["macro"].to_list()).reshape(-1, 4, 4)


def _by_task(rows: pd.DataFrame) -> pd.DataFrame:
    """The segments of a conversation in one task as one macro."""
    rows, macros = _stacked(rows, "seg")
    whole = Walk(macros, [np.arange(len(macros))], ALL[None], trail=False).macros()
    return rows.head(1)[["conv", "part", "run"]].assign(macro=[whole.ravel().tolist()])


def _by_conversation(rows: pd.DataFrame) -> pd.DataFrame:
    """Where each task's stretch of a conversation begins and ends; the last one has the tail."""
    rows, macros = _stacked(rows, "part")
    walk = Walk(macros, [np.arange(len(macros))], np.zeros((1, 1), np.int64))
    return _told(rows, walk, walk.ends())


def _told(rows: pd.DataFrame, walk: Walk, end: np.ndarray) -> pd.DataFrame:
    start = walk.back(end)[0]
    tail = np.zeros(len(rows), np.int64)
    tail[-1] = TAIL[end[0]]
    return rows.drop(columns="macro").assign(start=start, end=np.append(start[1:], end), tail=tail)


def _by_segment(rows: pd.DataFrame) -> pd.DataFrame:
    """Where each segment begins and ends, as its task's stretch does."""
    rows, macros = _stacked(rows, "seg")
    walk = Walk(macros, [np.arange(len(macros))], rows[["start"]].to_numpy()[:1])
    tail = int(rows["tail"].iloc[0])
    out = _told(rows.drop(columns=["start", "end", "tail"]), walk, rows["end"].to_numpy()[:1])
    out["tail"] = [0] * (len(out) - 1) + [tail]
    return out[["part", "seg", "start", "end", "tail"]]


def segments(turns: DataFrame, conv: str, turn: str, role: str, text: str, dropped: str | None, most: int, size: int) -> DataFrame:
    """Turns in order as rows ``conv, part, run, seg, whole, turn[], role[], text[]``; written to the shared folder.

    The order is by conversation, turn (nulls first), role and the text's MD5.
    Ranges may part a conversation, even rows that are equal.
    """
    clean = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    gone: Column = F.lit(False) if dropped is None else F.coalesce(F.col(f"`{dropped}`"), F.lit(False))
    rows = turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), clean(role).alias("role"), clean(text).alias("text"), gone.alias("dropped"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("name", F.md5(F.col("text").cast("binary")))
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "name", "row")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", "dropped")
    schema, arrow = schemas(rows.schema.fields[:1], "part int, run long, seg long, whole boolean, turn array<bigint>, role array<string>, text array<string>")
    return cut(rows.mapInArrow(slim(lambda it: _segments(it, arrow, most, size)), schema), "segments")


def placed(loose: DataFrame) -> DataFrame:
    """Segments of parted conversations with ``again``, ``start``, ``end`` and ``tail``.

    Duplicates are found by the first place of each role and text of a
    conversation; then macros go up by task and by conversation, and states come down.
    """
    turns = loose.select("conv", "part", "seg", F.posexplode(F.arrays_zip("role", "text")).alias("at", "said"))
    names = turns.select("conv", "part", "seg", "at", F.col("said.role").alias("role"), F.md5(F.col("said.text").cast("binary")).alias("name"))
    key = F.struct(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("name").alias("n")).alias("key")  # a null conversation is one, too
    names = cut(names.select(F.xxhash64(key).alias("hash"), key, F.struct("part", "seg", "at").alias("place")), "names")
    firsts = names.groupBy("hash", "key").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash", F.col("key").alias("k"), "first")
    later = names.join(firsts, "hash").filter(F.col("key").eqNullSafe(F.col("k")) & (F.col("place") > F.col("first")))
    again = later.groupBy("place.part", "place.seg").agg(F.collect_list("place.at").alias("again"))
    rows = cut(loose.join(again, ["part", "seg"], "left"), "loose")

    conv = rows.schema["conv"]
    schema, arrow = schemas([conv], "part int, run long, seg long, macro array<bigint>")
    macros = cut(rows.mapInArrow(slim(lambda it: _macros(it, arrow)), schema), "macros")
    plain = schemas([conv], "part int, run long, macro array<bigint>")[0]
    tasks = macros.groupBy("part", "run").applyInPandas(_by_task, plain)
    states = tasks.groupBy("conv").applyInPandas(_by_conversation, schemas([conv], "part int, run long, start long, end long, tail long")[0])
    told = macros.join(states.drop("conv"), ["part", "run"]).groupBy("part", "run").applyInPandas(_by_segment, "part int, seg long, start long, end long, tail long")
    return cut(rows.join(told, ["part", "seg"]), "placed")


def repair_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", dropped: str | None = None, most: int = SEGMENT_ROWS, size: int = SEGMENT_BYTES) -> DataFrame:
    """One row per conversation: its faults, the cheapest edits (``audit``), their cost and the digest of what they leave.

    Rows marked ``dropped`` are no turns, but their conversation is returned.
    A null conversation is one, null roles and texts are one space, null turns
    come first; a role without a first character fits nowhere.  Equal rows are
    turns each (all but one of them duplicates).  No rows give no rows; other
    columns are ignored.  A segment has at most ``most`` turns and ``size`` bytes.

    A digest is one sequence by definition: the pieces of a parted conversation
    are read in order by one task, one Arrow batch at a time; only its audit is held.
    """
    rows = segments(turns, conv, turn, role, text, dropped, most, size)
    schema, arrow = schemas([rows.schema["conv"]], REPORT)
    whole = rows.filter("whole").mapInArrow(slim(lambda it: _report(it, arrow)), schema)
    loose = rows.filter("NOT whole")
    if not loose.isEmpty():
        inner, inner_arrow = schemas([*loose.schema.fields[:2], loose.schema["seg"]], f"turn array<bigint>, initials array<string>, counts array<bigint>, cost long, audit string, lines {TURN}")
        pieces = placed(loose).mapInArrow(slim(lambda it: _pieces(it, inner_arrow)), inner)
        pieces = pieces.repartition("conv").sortWithinPartitions("conv", "part", "seg")
        whole = whole.unionByName(pieces.mapInArrow(slim(lambda it: _gathered(it, arrow)), schema))
    return whole.withColumnRenamed("conv", conv)


def repaired_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", dropped: str | None = None, most: int = SEGMENT_ROWS, size: int = SEGMENT_BYTES) -> DataFrame:
    """The repaired conversations: one row per turn, in the order of ``part, seg, at``; see :func:`repair_conversations`."""
    rows = segments(turns, conv, turn, role, text, dropped, most, size)
    schema, arrow = schemas([*rows.schema.fields[:2], rows.schema["seg"]], f"turn array<bigint>, initials array<string>, counts array<bigint>, cost long, audit string, lines {TURN}")
    solved = rows.filter("whole").mapInArrow(slim(lambda it: _pieces(it, arrow)), schema)
    loose = rows.filter("NOT whole")
    if not loose.isEmpty():
        solved = solved.unionByName(placed(loose).mapInArrow(slim(lambda it: _pieces(it, arrow)), schema))
    return solved.select(F.col("conv").alias(conv), "part", "seg", F.posexplode("lines").alias("at", "line")).select(conv, "part", "seg", "at", F.col("line.role").alias(role), F.col("line.text").alias(text))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damage(table(spark, sf_dir, "conversations")), dropped="dropped")


#: The same program with audits kept as strings; crc32 by its table, which is made by its rule.
ORACLE_OP11 = r"""
WITH RECURSIVE poly AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hashed AS (SELECT src.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT)),
    lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) % 20 AS fault FROM src, poly),
damaged AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed WHERE fault <> 0),
ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (SELECT c, turn, role, text, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS earlier
  FROM damaged d JOIN ids ON d.conv_id IS NOT DISTINCT FROM ids.conv_id
  WINDOW w AS (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text), copy)),
trimmed AS (SELECT *, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
  row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again FROM placed),
rows AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM trimmed),
faults AS (SELECT c, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (earlier IS NOT NULL AND earlier || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
  coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, max(i) AS n FROM rows GROUP BY c),
states AS (SELECT * FROM (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')) AS s(st, nxt, want)),
runs AS (SELECT st, st AS at, 0 AS cost, '' AS audit, '' AS added FROM states
  UNION ALL SELECT st, nxt, 3, 'I', chr(10) || want || ':' FROM states),
dp AS (SELECT c, 0::BIGINT AS i, 0 AS st, 0 AS cost, '' AS audit, '' AS body FROM ids
  UNION ALL
  SELECT c, i, st, cost, audit, body FROM (
    SELECT dp.c, dp.i + 1 AS i, e.edit, CASE WHEN edit = 'D' THEN runs.at WHEN edit = 'K' AND left(r.role, 1) = 's' THEN 1 ELSE s.nxt END AS st,
      dp.cost + runs.cost + CASE edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS cost,
      dp.audit || runs.audit || edit AS audit,
      dp.body || runs.added || CASE edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || r.role || ':' || r.text ELSE chr(10) || s.want || ':' || r.text END AS body
    FROM dp JOIN rows r ON r.c = dp.c AND r.i = dp.i + 1 JOIN runs ON runs.st = dp.st JOIN states s ON s.st = runs.at, (VALUES ('D'), ('K'), ('R')) AS e(edit)
    WHERE edit = 'D' OR fault NOT IN ('blank', 'duplicate') AND (edit = 'R' OR left(r.role, 1) = left(s.want, 1) OR left(r.role, 1) = 's' AND runs.at = 0))
  QUALIFY row_number() OVER (PARTITION BY c, st ORDER BY cost, audit) = 1),
tails AS (SELECT * FROM (VALUES (0, 0, '', ''), (3, 0, '', ''), (2, 3, 'I', chr(10) || 'assistant:'), (1, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')) AS t(st, cost, audit, added)),
done AS (SELECT dp.c, dp.cost + tails.cost AS cost, dp.audit || tails.audit AS audit, dp.body || tails.added AS body
  FROM dp LEFT JOIN faults USING (c) JOIN tails USING (st) WHERE i = coalesce(n, 0)
  QUALIFY row_number() OVER (PARTITION BY dp.c ORDER BY dp.cost + tails.cost, dp.audit || tails.audit) = 1)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost::BIGINT AS cost, audit, sha256(substr(body, 2)) AS repaired_sha256
FROM ids JOIN done USING (c) LEFT JOIN faults USING (c)
"""

QUERIES = {"op11_conversation_repair": op11_conversation_repair}
ORACLE = {"op11_conversation_repair": ORACLE_OP11}
