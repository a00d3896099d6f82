"""Secret scans with one combined deterministic automaton.

Every rule is a byte pattern ``lead`` followed by a run of at least ``least``
bytes of one class.  All rules are compiled together: Thompson fragments,
subset construction over byte classes with one component per rule (a rule's
matches are leftmost and do not overlap, whatever the others do), then
minimisation by partition refinement into one transition array.  The scan is a
single pass over the bytes; a state whose entry ends a passing match is an
event, anything else costs one table step per byte.  The automaton is compiled
once on the driver and shipped as arrays.  Only where an event says that a match
ended is the text looked at again, to find where that match began.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm._shared import as_bytes, record, schemas, slim, table

WORD = "A-Za-z0-9"


@dataclass(frozen=True)
class Rule:
    """``lead`` (a byte regex) then ``run`` (a class) repeated; see :func:`compile_rules`.

    A match is the lead and the longest run after it; it passes if the run has
    ``least`` bytes or more.
    """

    kind: str
    lead: str
    run: str
    least: int


#: The base kinds in their listed order, then what this scan adds.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 12),
    Rule("access", "AKIA", "[A-Z0-9]", 14),
    Rule("hex", "", "[0-9a-f]", 16),
)
EXTRA = (
    Rule("hosted", "gh[pousr]_", f"[{WORD}]", 20),
    Rule("chat", "xox[abprs]-", f"[{WORD}-]", 10),
    Rule("pem", "-----BEGIN ", "[A-Z ]", 11),
)
RULES = BASE + EXTRA


# --- patterns to fragments ------------------------------------------------


def _class(text: str) -> frozenset[int]:
    return frozenset(b for b in range(256) if re.match(text.encode("latin-1"), bytes([b]), re.DOTALL))


class _Nfa:
    """Thompson fragments over byte sets."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.step: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.eps.append([])
        self.step.append([])
        return len(self.eps) - 1

    def parse(self, text: str) -> tuple[int, int]:
        """Fragment of a pattern: literals, escapes, classes, groups, ``|``, ``?``, ``*`` and ``+``."""
        self.text, self.at = text, 0
        out = self._either()
        if self.at != len(text):
            raise ValueError(f"unbalanced pattern: {text}")
        return out

    def _peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def _either(self) -> tuple[int, int]:
        parts = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            parts.append(self._sequence())
        if len(parts) == 1:
            return parts[0]
        first, last = self.state(), self.state()
        for a, b in parts:
            self.eps[first].append(a)
            self.eps[b].append(last)
        return first, last

    def _sequence(self) -> tuple[int, int]:
        first = last = self.state()
        while self._peek() not in ("", "|", ")"):
            a, b = self._repeated()
            self.eps[last].append(a)
            last = b
        return first, last

    def _repeated(self) -> tuple[int, int]:
        a, b = self._atom()
        if (mark := self._peek()) and mark in "?*+":
            self.at += 1
            first, last = self.state(), self.state()
            self.eps[first].append(a)
            self.eps[b].append(last)
            if mark in "?*":
                self.eps[first].append(last)
            if mark in "*+":
                self.eps[b].append(a)
            return first, last
        return a, b

    def _atom(self) -> tuple[int, int]:
        if self._peek() == "(":
            self.at += 1
            out = self._either()
            if self._peek() != ")":
                raise ValueError(f"unbalanced pattern: {self.text}")
            self.at += 1
            return out
        unit = re.compile(r"\[(?:[^\]\\]|\\.)+\]|\\x[0-9a-fA-F]{2}|\\.|[^\\]", re.DOTALL).match(self.text, self.at)
        self.at = unit.end()
        a, b = self.state(), self.state()
        self.step[a].append((_class(unit[0]), b))
        return a, b

    def closure(self, states: frozenset[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for nxt in self.eps[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)

    def move(self, states: frozenset[int], byte: int) -> frozenset[int]:
        return self.closure(frozenset(to for s in states for chars, to in self.step[s] if byte in chars))


class _Component:
    """One rule's search: ``(threads, run length)`` where a run length over 0 means a match is growing.

    Threads are sets of lead states in order of their start, so that the
    leftmost lead to complete wins; once a run has begun no other lead does.
    """

    def __init__(self, rule: Rule) -> None:
        self.rule, self.nfa = rule, _Nfa()
        first, self.last = self.nfa.parse(rule.lead)
        self.first = self.nfa.closure(frozenset([first]))
        self.run = _class(rule.run)
        self.sets = [chars for step in self.nfa.step for chars, _ in step] + [self.run]
        self.start: tuple = ((), 0)

    def step(self, state: tuple, byte: int) -> tuple[tuple, bool]:
        """The next state, and whether a passing match ended before this byte."""
        threads, length = state
        if length:
            if byte in self.run:
                return ((), min(length + 1, self.rule.least)), False
            ended = length >= self.rule.least
            threads = ()
        else:
            ended = False
        out: list[frozenset[int]] = []
        seen: set[int] = set()
        for group in (*threads, self.first):
            if self.last in group and byte in self.run:
                if out:
                    raise ValueError(f"rule {self.rule.kind}: a later lead completes within an earlier one")
                return ((), 1), ended
            if moved := self.nfa.move(group, byte) - seen:
                seen |= moved
                out.append(frozenset(moved))
        return (tuple(out), 0), ended


@dataclass(frozen=True)
class Automaton:
    """``move[state, class]`` is a state, or ``-1 - event``; ``events`` has (rules ended, state)."""

    classes: np.ndarray
    move: np.ndarray
    events: tuple[tuple[tuple[int, ...], int], ...]
    rules: tuple[Rule, ...]


@lru_cache(maxsize=4)
def compile_rules(rules: tuple[Rule, ...] = RULES) -> Automaton:
    """Subset construction over all rules at once, then minimisation."""
    parts = [_Component(rule) for rule in rules]
    signature: dict[tuple, int] = {}
    classes = np.zeros(256, np.int32)
    chosen: list[int] = []
    for byte in range(256):
        mark = tuple(byte in s for p in parts for s in p.sets)
        if mark not in signature:
            signature[mark] = len(chosen)
            chosen.append(byte)
        classes[byte] = signature[mark]
    memo: list[dict] = [{} for _ in parts]

    def stepped(i: int, state: tuple, c: int) -> tuple[tuple, bool]:
        key = (state, c)
        if key not in memo[i]:
            memo[i][key] = parts[i].step(state, chosen[c])
        return memo[i][key]

    start = tuple(p.start for p in parts)
    number, order = {start: 0}, [start]
    rows: list[list[int]] = []
    events: dict[tuple, int] = {}
    listed: list[tuple[tuple[int, ...], int]] = []
    at = 0
    while at < len(order):
        state, row = order[at], []
        at += 1
        for c in range(len(chosen)):
            moved = [stepped(i, s, c) for i, s in enumerate(state)]
            to = tuple(m[0] for m in moved)
            if to not in number:
                number[to] = len(order)
                order.append(to)
            ended = tuple(i for i, m in enumerate(moved) if m[1])
            if ended:
                key = (ended, number[to])
                if key not in events:
                    events[key] = len(listed)
                    listed.append(key)
                row.append(-1 - events[key])
            else:
                row.append(number[to])
        rows.append(row)
    move = np.array(rows, np.int64)
    # Partition refinement: states are one if all steps lead to one block with the same matches ended.
    ended_sets = {ended: i + 1 for i, ended in enumerate(dict.fromkeys(e for e, _ in listed))}
    target = np.where(move >= 0, move, np.array([to for _, to in listed] or [0])[np.maximum(-1 - move, 0)])
    output = np.where(move >= 0, 0, np.array([ended_sets[e] for e, _ in listed] or [0])[np.maximum(-1 - move, 0)])
    # What is still open when the text ends differs by state: it belongs to the output too.
    final = np.array([hash(tuple(s[1] >= p.rule.least for s, p in zip(state, parts, strict=True))) for state in order], np.int64)
    block, count = np.unique(final, return_inverse=True)[1], 0
    while True:
        key = np.concatenate([block[:, None], block[target], output], axis=1)
        block = np.unique(key, axis=0, return_inverse=True)[1].ravel()
        if block.max() + 1 == count:
            break
        count = int(block.max()) + 1
    keep = np.unique(block, return_index=True)[1]
    relabel = block.copy()
    if relabel[0] != 0:  # the start is state 0
        a = relabel[0]
        relabel = np.where(block == a, 0, np.where(block == 0, a, block))
        keep = keep.copy()
        keep[[0, a]] = keep[[a, 0]]
    small: dict[tuple, int] = {}
    out = np.empty((count, len(chosen)), np.int64)
    for s, old in enumerate(keep):
        for c in range(len(chosen)):
            v = int(move[old, c])
            if v >= 0:
                out[s, c] = relabel[v]
            else:
                ended, to = listed[-1 - v]
                out[s, c] = -1 - small.setdefault((ended, int(relabel[to])), len(small))
    return Automaton(classes, out.astype(np.int32), tuple(small), tuple(rules))


_SCANNERS: dict[tuple[Rule, ...], tuple] = {}


def _scanner(machine: Automaton) -> tuple:
    """Transition rows as lists that hold each other: a step is one subscription.

    One is kept for each worker process and set of rules.
    """
    rules = machine.rules
    if rules in _SCANNERS:
        return _SCANNERS[rules]
    rows: list[list] = [[] for _ in range(len(machine.move))]
    for row, values in zip(rows, machine.move, strict=True):
        row.extend(rows[v] if v >= 0 else int(-1 - v) for v in values[machine.classes].tolist())
    events = [(ended, rows[to]) for ended, to in machine.events]
    starts = [re.compile(b"(?:" + rule.lead.encode("latin-1") + b")" + rule.run.encode("latin-1") + b"+", re.DOTALL) for rule in rules]
    return _SCANNERS.setdefault(rules, (rows[0], events, starts))


def _began(pattern: re.Pattern, data: bytes, end: int, floor: int) -> int:
    """Start of the match of a rule that ends at ``end``: the first from ``floor`` on that reaches it.

    ``floor`` is the end of the rule's last passing match; failing matches in
    between are stepped over in order, as the scan did.
    """
    at = floor
    while True:
        found = pattern.search(data, at)
        if found is None:
            raise AssertionError("an event without a match")
        if found.end() == end:
            return found.start()
        at = found.end()


def find_spans(data: bytes, machine: Automaton) -> list[list[tuple[int, int]]]:
    """Byte spans of the passing matches of each rule in one document."""
    state, events, starts = _scanner(machine)
    found: list[list[tuple[int, int]]] = [[] for _ in machine.rules]
    steps = iter(data + b"\n")  # the end of a text ends a run
    size = len(data) + 1
    while True:
        try:
            for byte in steps:
                state = state[byte]
        except TypeError:  # the last step led to an event, a number
            at = size - steps.__length_hint__() - 2
        else:
            at = size - 1
        if isinstance(state, list):
            return found
        ended, row = events[state]
        for i in ended:
            begun = _began(starts[i], data, at, found[i][-1][1] if found[i] else 0)
            found[i].append((begun, at))
        if at == size - 1:
            return found
        state = row[data[at + 1]] if at + 1 < len(data) else row[10]


def _digest(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch], machine: Automaton, schema: pa.Schema, redact: bool) -> Iterator[pa.RecordBatch]:
    base, rules = len(BASE), machine.rules
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        rows = []
        for scalar in texts:
            data = scalar.as_py()
            found = find_spans(data, machine)
            spans = sorted((a, k, b) for k, each in enumerate(found) for a, b in each)
            if spans and not data.isascii():  # code points before a byte position
                heads = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
                shown = [(int(heads[a]), k, int(heads[b])) for a, k, b in spans]
            else:
                shown = spans
            first = _digest([s for s in shown if s[1] < base], rules)
            if redact:
                parts, at = [], 0
                for a, k, b in spans:
                    if b > at:
                        parts += [data[at : max(a, at)], f"[{rules[k].kind}]".encode() if a >= at else b""]
                        at = b
                clean = b"".join([*parts, data[at:]]).decode("utf-8", "replace")
            rows.append((*(len(found[k]) for k in range(base)), hashlib.sha256(first.encode()).hexdigest(), _digest(shown, rules), *([clean] if redact else [])))
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(len(schema) - batch.num_columns + 1)]
        yield record(schema, [*batch.columns[:-1], *columns])


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), rules: tuple[Rule, ...] = RULES, redact: bool = False) -> DataFrame:
    """Spans of secrets in every whole text; map-only, one row per input row.

    Columns: ``key``, those of ``keep``, ``n_assign``, ``n_access``, ``n_hex``,
    ``base_sha256`` (digest of the base spans), ``spans`` (all spans as
    kind:start:end in code points, by start then kind) and, with ``redact``,
    ``clean``: the text with each span replaced by its kind in brackets.

    ``rules`` begins with :data:`BASE`.  A null or empty text has no spans and
    the digest of nothing; a null key is kept; repeated rows give repeated
    results; an empty table gives an empty one; other columns are ignored.
    """
    carried = [key, *keep]
    source = docs.select(*[F.col(f"`{c}`").alias(c) for c in carried], as_bytes(f"`{text}`").alias("__bytes"))
    fields = [source.schema[c] for c in carried]
    out = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + (", clean string" if redact else "")
    schema, arrow = schemas(fields, out)
    machine = compile_rules(tuple(rules))
    return source.mapInArrow(slim(lambda it: _scan(it, machine, arrow, redact)), schema)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same spans by regular expressions: a match begins after all matches and gaps before it."""
    parts, spans = [], []
    for i, rule in enumerate(RULES):
        whole = f"({rule.lead})({rule.run}+)".replace("'", "''")
        group = 3 if rule.kind == "assign" else 2
        parts.append(f"r{i} AS (SELECT rid, regexp_extract_all(text, '{whole}') AS m, regexp_extract_all(text, '{whole}', {group}) AS g, string_split_regex(text, '{whole}') AS gaps FROM d),")
        parts.append(f"u{i} AS (SELECT rid, unnest(m) AS m, unnest(g) AS g, unnest(gaps[1:len(m)]) AS gap, generate_subscripts(m, 1) AS j FROM r{i}),")
        parts.append(f"s{i} AS (SELECT rid, m, g, sum(length(gap) + length(m)) OVER (PARTITION BY rid ORDER BY j) AS b FROM u{i}),")
        spans.append(f"SELECT rid, {i} AS k, '{rule.kind}' AS kind, b - length(m) AS a, b FROM s{i} WHERE length(g) >= {rule.least}")
    every = "\nUNION ALL ".join(spans)
    listed = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k)"
    base = len(BASE)
    counts = ", ".join(f"count(*) FILTER (k = {i}) AS n_{rule.kind}" for i, rule in enumerate(BASE))
    shown = ", ".join(f"coalesce(n_{rule.kind}, 0)::BIGINT AS n_{rule.kind}" for rule in BASE)
    steps = "\n".join(parts)
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
{steps}
e AS ({every}),
a AS (SELECT rid, {counts}, {listed} FILTER (k < {base}) AS base, {listed} AS spans FROM e GROUP BY rid)
SELECT doc_id, {shown}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)"""


QUERIES = {"op6_secret_scan": op6_secret_scan}
ORACLE = {"op6_secret_scan": _oracle()}
