"""SentencePiece encoding and decoding by suffix-array matching.

For a BPE piece model.  A text is cut into units (spaces and the word after
them); a worker remembers the ids of the units it has seen.  New units of a
batch are concatenated and indexed by a suffix array; every piece is
binary-searched for its range of occurrences; the occurrences are edges, sorted
by where they end, and relaxed from left to right: an edge extends the
encoding that ends where it begins if its piece and the last piece there keep
apart, i.e. merging the two strings would never join across their border.  For
each place exactly one edge does, so the relaxed path is the model's encoding.
(In runs of 15 and more spaces that test can leave no path; such a unit is merged
by the definition instead.)
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from brindle.llm._shared import as_bytes, chunks, record, schemas, slim, table

REMEMBERED = 800_000
#: Bytes of new units that are indexed at once.
INDEXED = 1 << 19
_MARK = "▁".encode()
_UNITS = re.compile(rb"\n| *[^ \n]+| +")
NEVER = np.int32(2**30)


def _chars(data: bytes) -> list[bytes]:
    return [c.encode() for c in data.decode()]


@dataclass
class PieceModel:
    """Tables of a BPE piece model; the mark of a word's beginning is a space here."""

    pieces: list[bytes]  # by id, spaces for marks; bytes of byte pieces
    usable: np.ndarray  # ids that encoding may produce, but for byte pieces
    byte_ids: list[int]
    rank: dict[bytes, tuple[float, int]]  # piece: (score, id)
    order: np.ndarray  # by id: place in the merge order; -1 for single characters
    left: np.ndarray  # by id: the two pieces whose merge makes it
    right: np.ndarray
    table: np.ndarray = field(repr=False)  # open-addressed (left, right) -> order of their merge
    values: np.ndarray = field(repr=False)
    probes: int = 1
    apart: dict[int, frozenset[int]] = field(default_factory=dict)  # byte: bytes it never follows within a piece

    def merge(self, data: bytes) -> list[bytes]:
        """Pieces of a unit by the definition: the best pair first, the leftmost of equals."""
        parts: list[bytes | None] = list(_chars(data))
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, bytes, bytes]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts):
                found = self.rank.get(parts[i] + parts[j])
                if found is not None:
                    heapq.heappush(heap, (-found[0], i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] is not a or j >= len(parts) or parts[j] is not b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]


def _slot(a: np.ndarray, b: np.ndarray, mask: int) -> np.ndarray:
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((x >> np.uint64(29)) & np.uint64(mask)).astype(np.int64)


@lru_cache(maxsize=2)
def load_model(path: str) -> PieceModel:
    """Read a model file (the library parses it) and build the tables."""
    proto = model_pb2.ModelProto()
    proto.ParseFromString(SentencePieceProcessor(model_file=path).serialized_model_proto())
    spec = proto.normalizer_spec
    if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not proto.trainer_spec.byte_fallback:
        raise ValueError("a BPE model with byte fallback and the identity normaliser is needed")
    pieces, byte_ids, rank = [], [0] * 256, {}
    for i, p in enumerate(proto.pieces):
        if p.type == 6:
            byte_ids[int(p.piece[3:5], 16)] = i
            pieces.append(bytes([int(p.piece[3:5], 16)]))
        elif p.type == 1:
            text = p.piece.replace("▁", " ").encode()
            pieces.append(text)
            rank[text] = (p.score, i)
            if b" " in text.lstrip(b" "):
                raise ValueError("a piece goes over a word's beginning")
        else:
            pieces.append(b"")
    n = len(pieces)
    left, right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    place = {i: at for at, (_, i) in enumerate(sorted((-s, i) for s, i in rank.values()))}
    order = np.full(n, -1, np.int32)
    model = PieceModel(pieces, np.zeros(0, np.int64), byte_ids, rank, order, left, right, np.zeros(0), np.zeros(0))
    usable, pairs = [], {}
    for text, (_, i) in list(rank.items()):
        units = _chars(text)
        if len(units) == 1:
            usable.append(i)
            continue
        order[i] = place[i]
        ends = np.cumsum([len(c) for c in units])[:-1].tolist()
        for at in ends:
            if text[:at] in rank and text[at:] in rank:
                pairs[rank[text[:at]][1], rank[text[at:]][1]] = place[i]
        best = rank.pop(text)
        parts = model.merge(text)
        rank[text] = best
        if len(parts) == 2:
            left[i], right[i] = rank[parts[0]][1], rank[parts[1]][1]
            usable.append(i)
    size = 1 << (3 * len(pairs)).bit_length()
    model.table, model.values = np.full(size, -1, np.int64), np.zeros(size, np.int32)
    for (a, b), v in pairs.items():
        at = int(_slot(np.array([a]), np.array([b]), size - 1)[0])
        tries = 1
        while model.table[at] >= 0:
            at, tries = (at + 1) & (size - 1), tries + 1
        model.table[at], model.values[at] = a << 32 | b, v
        model.probes = max(model.probes, tries)
    model.usable = np.array(sorted(usable))
    joined = {(x, y) for text in rank for x, y in zip(text, text[1:], strict=False)}
    model.apart = {p: frozenset(b for b in range(256) if (b, p) not in joined) for p in b".,"}
    return model


class Encoder(dict):
    """Ids of units as little-endian 16-bit bytes."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        if len(model.pieces) >= 0xFFFF:
            raise ValueError("ids over 65534 do not fit")
        self.unknown = len(model.pieces)
        pad = lambda x: np.append(x, -1).astype(np.int32)  # noqa: E731  the unknown character is a leaf
        self.order, self.left, self.right = pad(model.order), pad(model.left), pad(model.right)
        use = sorted((model.pieces[i], i) for i in model.usable)
        self.names, self.ids = [n for n, _ in use], np.array([i for _, i in use])
        self.sizes = np.array([len(n) for n in self.names])
        eight = lambda n, fill: int.from_bytes(n[:8].ljust(8, fill), "big")
        self.low = np.array([eight(n, b"\0") for n in self.names], np.uint64)
        self.high = np.array([eight(n, b"\xff") for n in self.names], np.uint64)
        self.single = {n for n in self.names if len(n.decode()) == 1}

    # Whether pieces a, b stay apart: undo both sides' merges from the last one back; at no
    # time may the two pieces at the border merge before either is merged on its own side.
    def keeps_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        rows = np.arange(len(a))
        a, b = a.copy(), b.copy()
        ra, rb = np.full(len(a), NEVER), np.full(len(a), NEVER)
        table, values, mask = self.model.table, self.model.values, len(self.model.table) - 1
        while len(rows):
            key = a.astype(np.int64) << 32 | b
            at = _slot(a, b, mask)
            merged = np.full(len(rows), NEVER)
            open_ = np.arange(len(rows))
            for _ in range(self.model.probes):
                here = table[at[open_]]
                hit = here == key[open_]
                merged[open_[hit]] = values[at[open_[hit]]]
                open_ = open_[~hit & (here >= 0)]
                if not len(open_):
                    break
                at[open_] = (at[open_] + 1) & mask
            bad = (merged < ra) & (merged <= rb) & (merged < NEVER)
            ok[rows[bad]] = False
            oa, ob = self.order[a], self.order[b]
            go = ~bad & ((oa >= 0) | (ob >= 0))
            rows, a, b, ra, rb, oa, ob = (x[go] for x in (rows, a, b, ra, rb, oa, ob))
            first = oa > ob
            ra, rb = np.where(first, oa, ra), np.where(first, rb, ob)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    def _plain(self, unit: bytes) -> bytes:
        out: list[int] = []
        for part in self.model.merge(unit):
            found = self.model.rank.get(part)
            out += [found[1]] if found is not None else [self.model.byte_ids[x] for x in part]
        return np.array(out, "<u2").tobytes()

    def learn(self, units: set[bytes]) -> None:
        """Encode units not seen yet."""
        missing = [u for u in units if u not in self]
        if len(self) + len(missing) > REMEMBERED:
            self.clear()
            missing = list(units)
        heads, todo, size = [], {}, 0
        for unit in missing:
            if unit[-1] in self.model.apart and len(unit) > 1 and unit[-2] != 32 and unit[-2] in self.model.apart[unit[-1]]:
                heads.append(unit)
                unit = unit[:-1]
            if unit in self:
                continue
            if unit not in todo:
                todo[unit] = None
                size += len(unit) + 1
                if size > INDEXED:
                    self._match(list(todo))
                    todo, size = {}, 0
        if todo:
            self._match(list(todo))
        for unit in heads:
            tail = unit[-1:]
            if tail not in self:
                self[tail] = self._plain(tail)
            self[unit] = self[unit[:-1]] + self[tail]

    def _edges(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places and pieces (places in the sorted list) of all occurrences, by suffix array."""
        raw = np.frombuffer(text + b"\xff" * 16, np.uint8)
        n = len(text)
        key = np.zeros(n + 8, np.uint64)
        for j in range(8):
            key = (key << np.uint64(8)) | raw[j : j + n + 8]
        suffixes = np.lexsort((key[8 : 8 + n], key[:n]))
        first, second = key[:n][suffixes], key[8 : 8 + n][suffixes]
        low = np.searchsorted(first, self.low, "left")
        high = np.searchsorted(first, self.high, "right")
        for p in np.flatnonzero((self.sizes > 8) & (high > low)).tolist():
            rest = self.names[p][8:16]
            a, b = low[p], high[p]
            low[p] = a + np.searchsorted(second[a:b], np.uint64(int.from_bytes(rest.ljust(8, b"\0"), "big")), "left")
            high[p] = a + np.searchsorted(second[a:b], np.uint64(int.from_bytes(rest.ljust(8, b"\xff"), "big")), "right")
        count = high - low
        piece = np.repeat(np.arange(len(count)), count)
        at = suffixes[np.repeat(low - np.cumsum(count) + count, count) + np.arange(len(piece))]
        long = np.flatnonzero(self.sizes[piece] > 16)
        wrong = [i for i in long.tolist() if not text.startswith(self.names[piece[i]], at[i])]
        return np.delete(at, wrong), np.delete(piece, wrong)

    def _match(self, units: list[bytes]) -> None:
        text = b"\xff".join(units) + b"\xff"
        sizes = np.array([len(u) for u in units])
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        owner = np.repeat(starts, sizes + 1)
        at, piece = self._edges(text)
        ids, size = self.ids[piece], self.sizes[piece]
        # Characters that are no piece: an edge of their own.
        raw = np.frombuffer(text, np.uint8)
        covered = np.zeros(len(text) + 1, bool)
        one = (raw < 0x80) | (raw >= 0xC0)
        width = np.where(raw < 0x80, 1, np.where(raw < 0xE0, 2, np.where(raw < 0xF0, 3, 4)))
        whole = size == width[at]
        covered[at[whole]] = True
        lone = np.flatnonzero(one & ~covered[:-1] & (raw != 0xFF))
        at, ids, size = np.concatenate([at, lone]), np.concatenate([ids, np.full(len(lone), self.unknown)]), np.concatenate([size, width[lone]])
        end = at + size
        step = end - owner[at]
        order = np.argsort(step.astype(np.uint16) if len(step) and step.max() < 1 << 16 else step, kind="stable")  # few bits sort faster
        at, ids, end, step = at[order], ids[order].astype(np.int32), end[order], step[order]
        last = np.full(len(text) + 1, -1, np.int32)
        came = np.zeros(len(text) + 1, np.int64)
        bounds = np.searchsorted(step, np.arange(int(step[-1]) + 2)).tolist()
        begins = np.zeros(len(text) + 1, bool)
        begins[starts] = True
        for a, b in zip(bounds, bounds[1:], strict=False):
            if a == b:
                continue
            s, e, t = at[a:b], end[a:b], ids[a:b]
            before = last[s]
            good = begins[s]
            test = np.flatnonzero(~good & (before >= 0))
            good[test[self.keeps_apart(before[test], t[test])]] = True
            last[e[good]] = t[good]
            came[e[good]] = s[good]
        ends = starts + sizes
        live = np.arange(len(units))
        here = ends.copy()
        failed = last[ends] < 0
        who, what, where = [], [], []
        live = live[~failed]
        here = here[live]
        while len(live):
            who.append(live)
            what.append(last[here])
            where.append(here)
            here = came[here]
            more = here > starts[live]
            live, here = live[more], here[more]
        who, what, where = np.concatenate(who), np.concatenate(what), np.concatenate(where)
        order = np.lexsort((where, who))
        who, what = who[order], what[order]
        odd = set(np.unique(who[what == self.unknown]).tolist()) | set(np.flatnonzero(failed).tolist())
        data = what.astype("<u2").tobytes()
        cuts = (2 * np.searchsorted(who, np.arange(len(units) + 1))).tolist()
        for i, unit in enumerate(units):
            if i not in odd:
                self[unit] = data[cuts[i] : cuts[i + 1]]
            elif failed[i]:
                self[unit] = self._plain(unit)
            else:
                a, out = 0, []
                for t in what[cuts[i] // 2 : cuts[i + 1] // 2].tolist():
                    if t == self.unknown:
                        n = int(width[starts[i] + a])
                        out += [self.model.byte_ids[x] for x in unit[a : a + n]]
                        a += n
                    else:
                        out.append(t)
                        a += len(self.model.pieces[t])
                self[unit] = np.array(out, "<u2").tobytes()

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts; an empty text has none."""
        split = [_UNITS.findall(b" " + (t.replace(_MARK, b" ") if _MARK in t else t)) if t else [] for t in texts]
        self.learn(set().union(*split))
        get = self.__getitem__
        return [np.frombuffer(b"".join(map(get, units)), "<u2") for units in split]


def decode(model: PieceModel, ids: np.ndarray) -> bytes:
    """Text of ids, without the space that encoding put first."""
    return b"".join(map(model.pieces.__getitem__, ids.tolist()))[1:]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and model."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(load_model(path))
    return _ENCODERS[path]


def _encode(batches: Iterator[pa.RecordBatch], path: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    model = encoder(path)
    for batch in batches:
        for first, last in chunks(batch, "text", 4 << 20):
            part = batch.slice(first, last - first)
            texts = part.column(part.num_columns - 1).to_pylist()
            got = model.encode(texts)
            whole = [decode(model.model, ids) == (t.replace(_MARK, b" ") if _MARK in t else t) for ids, t in zip(got, texts, strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
            flat = pa.array(np.concatenate(got).astype(np.int32) if got else np.zeros(0, np.int32))
            yield record(schema, [*part.columns[:-1], np.diff(offsets), pa.ListArray.from_arrays(pa.array(offsets), flat), whole])


def encode_pieces(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Piece ids of every whole text; map-only, one row per input row.

    Columns: ``key``, ``n_ids``, ``ids``, ``round_trip`` (decoding the ids
    gives the text; the mark U+2581 itself decodes as a space).

    Null and empty texts have no ids; null keys are kept; repeated rows give
    repeated results; an empty table gives an empty one; other columns are
    ignored.  ``model`` is a path that every worker can open.
    """
    source = docs.select(F.col(f"`{key}`").alias("__key"), as_bytes(f"`{text}`").alias("text"))
    schema, arrow = schemas(source.schema.fields[:1], "n_ids int, ids array<int>, round_trip boolean")
    return source.mapInArrow(slim(lambda it: _encode(it, model, arrow)), schema).withColumnRenamed("__key", key)


def _decode(batches: Iterator[pa.RecordBatch], path: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    model = load_model(path)
    for batch in batches:
        texts = [decode(model, np.asarray([] if ids is None else ids, np.int64)).decode("utf-8", "replace") for ids in batch.column(batch.num_columns - 1).to_pylist()]
        yield record(schema, [*batch.columns[:-1], texts])


def decode_pieces(encoded: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``text`` of id arrays; a null or empty array is an empty text."""
    source = encoded.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{ids}`").alias("ids"))
    schema, arrow = schemas(source.schema.fields[:1], "text string")
    return source.mapInArrow(slim(lambda it: _decode(it, model, arrow)), schema).withColumnRenamed("__key", key)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), default_model())


QUERIES = {"op5_sentencepiece": op5_sentencepiece}
ORACLE: dict[str, str] = {}
