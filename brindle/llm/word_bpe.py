"""Ids of a word-end BPE vocabulary for many texts at once.

White space never joins words in this kind of tokenizer, so a text's ids are
those of its words in turn.  A worker keeps the ids of words it has seen in flat
arrays: a word of up to 16 bytes is looked up by its bytes, two numbers, for all
words of a chunk in a few vector steps.  New plain words (Latin letters, digits,
ASCII punctuation) are cut into the tokenizer's units, whose letters are merged
by the tokenizer's own merge table, all units of a batch side by side; any other
word is given to the library.
"""

from __future__ import annotations

import json
import re

import numpy as np
from tokenizers import Tokenizer

from brindle.llm._windows import join, word_edges, word_keys, word_parts

#: Words a worker remembers; past it the memory starts anew.
REMEMBERED = 1 << 19
#: Plain words: Latin letters whose lower case is one of them too (from U+0180 on some have theirs elsewhere), digits
#: and ASCII punctuation but for the apostrophe, which has a rule of its own.
_UNITS = re.compile(r"[A-Za-zÀ-ÖØ-öø-įı-ſ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
_PLAIN = re.compile(rf"(?:{_UNITS.pattern})+")
_NEVER = np.int64(1) << 62


class _Table:
    """Pairs of symbols and the order and outcome of their merge, open-addressed."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]) -> None:
        size = 1 << (4 * len(pairs)).bit_length()
        self.mask = np.uint64(size - 1)
        self.keys = np.full(size, -1, np.int64)
        self.rank, self.made = np.zeros(size, np.int64), np.zeros(size, np.int64)
        ab = np.array(list(pairs), np.int64).reshape(-1, 2)
        key = ab[:, 0] << 20 | ab[:, 1]
        values = np.array(list(pairs.values()), np.int64).reshape(-1, 2)
        todo, at = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = self.keys[at] < 0
            self.keys[at[free]] = key[todo[free]]
            mine = self.keys[at] == key[todo]
            self.rank[at[mine]], self.made[at[mine]] = values[todo[mine]].T
            todo, at = todo[~mine], (at[~mine] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x >> np.uint64(32)) & self.mask).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or never) and outcome of each pair."""
        key = a << 20 | b
        at = self._slot(key)
        rank, made = np.full(len(key), _NEVER), np.zeros(len(key), np.int64)
        open_ = np.arange(len(key))
        while len(open_):
            have = self.keys[at]
            hit = have == key[open_]
            rank[open_[hit]], made[open_[hit]] = self.rank[at[hit]], self.made[at[hit]]
            go = ~hit & (have >= 0)
            open_, at = open_[go], (at[go] + 1) & int(self.mask)
        return rank, made


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)


def _byte_kinds() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of each byte; bytes of accented Latin-1 letters are seen to in :func:`_kinds`."""
    kind, lower = np.full(256, _ODD, np.int8), np.arange(256, dtype=np.uint8)
    kind[33:127] = _SIGN
    kind[39] = _ODD
    kind[32] = _SPACE
    kind[48:58] = _DIGIT
    kind[65:91] = kind[97:123] = _LETTER
    lower[65:91] += 32
    return kind, lower


_KIND, _LOWER = _byte_kinds()


def _kinds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kinds and lower case of UTF-8 bytes: U+00C0 to U+00FF are the bytes C3 80 to C3 BF, capitals first."""
    kind, lower = _KIND[raw], _LOWER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    if len(lead):
        after = raw[lead + 1]
        sign = (after == 0x97) | (after == 0xB7)  # multiplication and division
        kind[lead] = kind[lead + 1] = np.where(sign, _ODD, _LETTER)
        lower[lead + 1] = np.where((after < 0x9F) & ~sign, after + 0x20, after)
    return kind, lower


class _Store:
    """Ids of strings of up to 16 bytes, found by their bytes; entry 0 is the id that closes a document."""

    def __init__(self) -> None:
        self.slots = np.full(4 * REMEMBERED, -1, np.int32)
        self.low, self.high = (np.zeros(REMEMBERED + 1, np.uint64) for _ in range(2))
        self.length, self.first, self.size = (np.zeros(REMEMBERED + 1, np.int32) for _ in range(3))
        self.ids = np.zeros(4 * REMEMBERED, np.uint16)
        self.count = self.filled = 1
        self.size[0] = 1

    def room(self, n: int) -> bool:
        return self.count + n <= REMEMBERED

    def _slot(self, name: np.ndarray) -> np.ndarray:
        return (name & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, name: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        at, found = self._slot(name), np.full(len(low), -1, np.int64)
        open_ = np.arange(len(low))
        while len(open_):
            entry = self.slots[at]
            some = entry >= 0
            same = some & (self.low[entry] == low[open_]) & (self.high[entry] == high[open_]) & (self.length[entry] == n[open_])
            found[open_[same]] = entry[same]
            go = some & ~same
            open_, at = open_[go], (at[go] + 1) & (len(self.slots) - 1)
        return found

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """New entries for id strings that follow each other in ``ids``."""
        entry = np.arange(self.count, self.count + len(sizes))
        self.first[entry], self.size[entry] = self.filled + np.cumsum(sizes) - sizes, sizes
        while self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.count, self.filled = self.count + len(sizes), self.filled + len(ids)
        return entry

    def index(self, name: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray, entry: np.ndarray) -> None:
        self.low[entry], self.high[entry], self.length[entry] = low, high, n
        at = self._slot(name)
        while len(entry):
            free = self.slots[at] < 0
            self.slots[at[free]] = entry[free]
            lost = self.slots[at] != entry
            entry, at = entry[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def read(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of entries in turn, and how many each has."""
        first, size = self.first[entry], self.size[entry].astype(np.int64)
        return self.ids[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())], size


def _names(low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
    return join(join(low, high), n.astype(np.uint64))


def _firsts(name: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One place of each different string."""
    order = np.argsort(name, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in (name, low, high, n)])
    return np.sort(order[new])


class WordIds:
    """Ids of texts by a vocabulary file of the library."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        if max(self.tokenizer.get_vocab(with_added_tokens=True).values()) > 0xFFFF:
            raise ValueError("ids over 65535 do not fit")
        letters = _byte_letters()
        self.inner = np.array([vocabulary[x] for x in letters], np.int64)
        self.last = np.array([vocabulary[x + end] for x in letters], np.int64)
        self.table = _Table({(vocabulary[a], vocabulary[b]): (i, vocabulary[a + b]) for i, (a, b) in enumerate(model["merges"])})
        self.clear()

    def clear(self) -> None:
        self.words, self.units = _Store(), _Store()
        self.long: dict[bytes, int] = {}

    def merge(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units that follow each other in ``raw``, in turn, and how many each has.

        By the definition: the pair of lowest rank first, the leftmost of equals.
        """
        symbols = self.inner[raw]
        ends = np.cumsum(size) - 1
        symbols[ends] = self.last[raw[ends]]
        owner = np.repeat(np.arange(len(size)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, made = self._pairs(symbols, owner, np.arange(len(symbols)))
        while len(symbols):
            new = np.ones(len(owner), bool)
            new[1:] = owner[1:] != owner[:-1]
            begin = np.flatnonzero(new)
            key = np.where(rank == _NEVER, _NEVER, (rank << 31) | np.arange(len(rank)))
            best = np.minimum.reduceat(key, begin)
            ended = np.repeat(best == _NEVER, np.diff(np.append(begin, len(owner))))
            done.append((owner[ended], symbols[ended]))
            at = best[best != _NEVER] & ((1 << 31) - 1)
            symbols[at] = made[at]
            stay = ~ended
            stay[at + 1] = False
            # Only pairs on both sides of a new symbol change.
            place = np.cumsum(stay) - 1
            symbols, owner, rank, made = symbols[stay], owner[stay], rank[stay], made[stay]
            here = place[at]
            touched = np.concatenate([here, np.maximum(here - 1, 0)])
            if len(symbols):
                rank[touched], made[touched] = self._pairs(symbols, owner, touched)
        owners = np.concatenate([x for x, _ in done])
        order = np.argsort(owners, kind="stable")
        return np.concatenate([x for _, x in done])[order].astype(np.uint16), np.bincount(owners, minlength=len(size))

    def _pairs(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = np.minimum(at + 1, len(symbols) - 1)
        rank, made = self.table.of(symbols[at], symbols[after])
        rank[(after == at) | (owner[after] != owner[at])] = _NEVER
        return rank, made

    def _odd(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words of any kind: units of plain ones together, others by the library."""
        out: list[np.ndarray | None] = []
        units: list[bytes] = []
        counts: list[int] = []
        for word in words:
            text = word.decode()
            if _PLAIN.fullmatch(text) and "<|" not in text and len(word) <= 64:
                mine = [u.encode() for u in _UNITS.findall(text.lower())]
                units += mine
                counts.append(len(mine))
                out.append(None)
            else:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16))
        if units:
            ids, size = self.merge(np.frombuffer(b"".join(units), np.uint8), np.array([len(u) for u in units]))
            ends = np.cumsum(size)[np.cumsum(counts) - 1]
            plain = iter(np.split(ids, ends[:-1]))
            out = [next(plain) if x is None else x for x in out]
        return out

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words of up to 16 bytes in turn, and how many each has."""
        raw = np.frombuffer(b" ".join(words), np.uint8)
        kind, lower = _kinds(raw)
        word = np.cumsum(raw == 32)
        odd = np.zeros(len(words), bool)
        odd[word[kind == _ODD]] = True
        odd[word[:-1][(raw[:-1] == 60) & (raw[1:] == 124)]] = True  # may begin a special token's name
        kind[odd[word]] = _SPACE
        new = np.ones(len(raw), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        edges = np.flatnonzero(new)
        ends = np.append(edges[1:], len(raw))
        some = kind[edges] != _SPACE
        edges, ends = edges[some], ends[some]
        low, high, n = word_keys(lower, edges, ends)
        name = _names(low, high, n)
        entry = self.units.find(name, low, high, n)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            if not self.units.room(len(missing)):
                self.units = _Store()
                missing = np.arange(len(entry))
            first = missing[_firsts(name[missing], low[missing], high[missing], n[missing])]
            sizes = n[first]
            spread = np.repeat(edges[first] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            made = self.units.add(*self.merge(lower[spread], sizes))
            self.units.index(name[first], low[first], high[first], n[first], made)
            entry[missing] = self.units.find(name[missing], low[missing], high[missing], n[missing])
        ids, size = self.units.read(entry)
        sizes = np.bincount(word[edges], weights=size, minlength=len(words)).astype(np.int64)
        if odd.any():
            places = np.flatnonzero(odd).tolist()
            own = dict(zip(places, self._odd([words[i] for i in places]), strict=True))
            parts = np.split(ids, np.cumsum(sizes)[np.flatnonzero(odd)])
            ids = np.concatenate([x for part, i in zip(parts, own, strict=False) for x in (part, own[i])] + [parts[-1]])
            sizes[list(own)] = [len(x) for x in own.values()]
        return ids, sizes

    def _entries(self, data: bytes, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        low, high, n = word_keys(raw, starts, ends)
        name = _names(low, high, n)
        short = n <= 16
        entry = np.full(len(n), -1, np.int64)
        entry[short] = self.words.find(name[short], low[short], high[short], n[short])
        long = {i: data[starts[i] : ends[i]] for i in np.flatnonzero(~short).tolist()}
        missing = np.flatnonzero(short & (entry < 0))
        first = missing[_firsts(name[missing], low[missing], high[missing], n[missing])]
        others = [w for w in dict.fromkeys(long.values()) if w not in self.long]
        if not self.words.room(len(first) + len(others)):
            if self.words.count == 1:
                raise ValueError("a part of a text has too many different words")
            self.clear()
            return self._entries(data, raw, starts, ends)
        if len(first):
            new = self.words.add(*self._encode([data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]))
            self.words.index(name[first], low[first], high[first], n[first], new)
            entry[missing] = self.words.find(name[missing], low[missing], high[missing], n[missing])
        if others:
            ids = self._odd(others)
            self.long.update(zip(others, self.words.add(np.concatenate(ids), np.array([len(x) for x in ids])).tolist(), strict=True))
        for i, w in long.items():
            entry[i] = self.long[w]
        return entry

    def part(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of up to some MB of text: where they begin, their ids in turn, and how many each has."""
        raw = np.frombuffer(data, np.uint8)
        starts, ends = word_edges(raw)
        entries = self._entries(data, raw, starts, ends)  # may put a new memory in the old one's place
        return starts, *self.words.read(entries)

    def texts(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = []
        group: list[bytes] = []

        def flush() -> None:
            nonlocal group
            if group:
                starts, ids, size = self.part(b" ".join(group))
                words = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in group])[:-1])
                out.extend(np.split(ids, np.concatenate([[0], np.cumsum(size)])[words]))
            group = []

        held = 0
        for data in texts:
            if len(data) > 1 << 20:
                flush()
                out.append(np.concatenate([self.part(x)[1] for x in word_parts(data)]))
                held = 0
                continue
            group.append(data)
            held += len(data)
            if held > 1 << 20:
                flush()
                held = 0
        flush()
        return out
