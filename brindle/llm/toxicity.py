"""Toxicity by noisy-channel deobfuscation and a linear model over restored words.

A character model of order four, backing off to shorter ones, is counted over
the whole corpus; digits are a symbol of it.  What may be disguised becomes a
lattice: a look-alike sign stands for a letter, for itself
or for nothing, a drawn-out letter is kept or dropped, and the space between
single letters is kept or dropped, so that the decoder says where words end.
Viterbi decoding under the character model restores the text; plain words have one
path only and stay as they are.  A logistic model over restored words and word
beginnings gives the score.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm._shared import as_bytes, chunks, cut, forget, held_out, record, schemas, slim, table

#: Labelled rows of each label that the fit uses at most (those with the smallest hashes of their ids).
SAMPLE = 4_000
#: Evidence for label 1 that a feature must give in the sample, in nats.
EVIDENCE = 8.0
CUT_AT = 0.7
REMEMBERED = 150_000
#: What a sign may stand for (fixed values).
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou"}
#: Letters of other alphabets that look like Latin ones (fixed values); read so in words that also hold Latin letters.
ALIKE = str.maketrans({"а": "a", "в": "b", "е": "e", "и": "u", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "п": "n", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w"})
#: Full-width forms of the printable ASCII characters, read so anywhere.
WIDE = {0xFEE0 + c: c for c in range(33, 127)}
#: Channel costs: reading a sign as a letter, keeping a digit (one of ten that the model has as one symbol), dropping a sign, dropping a drawn-out letter.
READ, KEEP, DROP, SHORTEN = 1.0, 2.3, 3.0, 0.3
#: At a word's ends: dropping a mark of punctuation, a sign of a run of three or more.
MARK, RUN = 0.2, 0.05
#: Between single letters: dropping the space, keeping it.
CLOSE, SPACE = 0.0, 0.0
#: Symbols of the character model: all else, letters, other alphabets, digits.
_N, OTHER, DIGIT = 29, 27, 28
#: Characters that the model looks at, the next one included.
ORDER = 4
#: Weight of the shorter model, in occurrences of a context.
BACK_OFF = 5.0
_MARKS = frozenset("!|(*+¡")
_CHAR = rb"(?:[!-~]|[\xc2-\xf4][\x80-\xbf]+)"
#: Single characters with white space between them, three at least.
_SPACED = re.compile(rb"(?<!\S)" + _CHAR + rb"(?:[ \t]+" + _CHAR + rb"){2,}(?!\S)")
#: Single characters with one separator between them.
_INNER = re.compile(r"^[^\W_](?:[._*-][^\W_])+[._*-][^\W_]$")
_CORE = re.compile(r"^([^\w]*)([^\W\d_]{2,})([^\w]*)$")
#: A number, with signs around it.
_NUMBER = re.compile(r"^[^\w]*(\d+)[^\w]*$")
_DRAWN = re.compile(r"([^\W\d_])\1\1")


def _codes() -> np.ndarray:
    out = np.zeros(256, np.int32)
    for b in range(26):
        out[97 + b] = out[65 + b] = b + 1
    out[48:58] = DIGIT
    out[128:] = OTHER
    return out


_CODES = _codes()


def latin(word: str) -> str:
    """A lower-case word with look-alikes of other alphabets as Latin letters; words of one such alphabet stay."""
    if word.isascii():
        return word
    word = word.translate(WIDE).lower()
    return word.translate(ALIKE) if any("a" <= c <= "z" for c in word) else word


def _code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else DIGIT if "0" <= c <= "9" else OTHER if ord(c) > 127 else 0


def grams(data: bytes) -> np.ndarray:
    """Every run of ``ORDER`` symbols of a text, as a number of base ``_N``; its borders are spaces."""
    c = np.frombuffer(data, np.uint8)
    c = _CODES[c[(c & 0xC0) != 0x80]]  # one symbol a character
    c = np.concatenate([np.zeros(ORDER - 1, np.int32), c, np.zeros(1, np.int32)])
    n = len(c) - ORDER + 1
    runs = np.zeros(n, np.int32)
    for i in range(ORDER):
        runs = runs * _N + c[i : i + n]
    return runs


def _count(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_N**ORDER, np.int64)
    for batch in batches:
        for first, last in chunks(batch, batch.schema.names[0]):
            texts = batch.column(0).slice(first, last - first).to_pylist()
            total += np.bincount(np.concatenate([grams(x) for x in texts]), minlength=len(total))
    seen = np.flatnonzero(total)
    yield record(schema, [seen, total[seen]])


class Channel:
    """Restores disguised words under a character model."""

    def __init__(self, counts: np.ndarray) -> None:
        grid = counts.reshape((_N,) * ORDER).astype(float)
        back = np.full(_N, 1 / _N)
        for seen in range(ORDER):  # models of 0 to ORDER - 1 known characters
            of = grid.sum(axis=tuple(range(ORDER - 1 - seen)))
            back = (of + BACK_OFF * back) / (of.sum(axis=-1, keepdims=True) + BACK_OFF)
        #: Cost of a symbol behind ``ORDER - 1`` others, all as digits of one number of base ``_N``.
        self.cost = array("d", -np.log(back).ravel())
        self.parts: dict[tuple[str, str, str], str] = {}

    def arcs(self, text: str, spaced: bool = False) -> list[list[tuple[str, float]]]:
        """What each character may stand for, with the channel's cost; "" drops it, " " ends a word.

        ``spaced``: white space and separators between single characters may be dropped.
        """
        out = []
        first = next((i for i, c in enumerate(text) if c.isalnum()), len(text))
        last = next((i for i in range(len(text) - 1, -1, -1) if text[i].isalnum()), -1)
        for i, c in enumerate(text):
            before, after = text[i - 1 : i], text[i + 1 : i + 2]
            if c.isalpha():
                drawn = before == c and (text[i - 2 : i - 1] == c or after == c)
                out.append([(c, 0.0), ("", SHORTEN)] if drawn else [(c, 0.0)])
            elif spaced and (c in " \t._-" or c == "*" and 0 < i < len(text) - 1 and i % 2):
                out.append([("", CLOSE), (" ", SPACE)])
            elif c in SIGNS:
                run = before == c and (after == c or text[i - 2 : i - 1] == c) or after == c and text[i + 2 : i + 3] == c
                edge = not first <= i <= last
                drop = RUN if edge and run else MARK if edge and c in _MARKS else DROP
                out.append([(x, READ) for x in SIGNS[c]] + [(c, KEEP) if c.isdigit() else ("", drop)])
            elif c.isdigit():
                out.append([(c, KEEP)])
            else:
                out.append([("", 0.0)])
        return out

    def decode(self, arcs: list[list[tuple[str, float]]], known: str = "", then: str = " ") -> str:
        """The cheapest path between the letters ``known`` and the text ``then``: Viterbi over the last restored characters."""
        context, base = 0, _N ** (ORDER - 1)
        for c in known:
            context = (context * _N + _code(c)) % base
        best: dict[int, tuple[float, tuple]] = {context: (0.0, ())}
        for options in [*arcs, *[[(c, 0.0)] for c in then]]:
            new: dict[int, tuple[float, tuple]] = {}
            for context, (cost, text) in best.items():
                for c, price in options:
                    if c:
                        run = context * _N + _code(c)
                        state, value, to = run % base, cost + price + self.cost[run], (text, c)
                    else:
                        state, value, to = context, cost + price, text
                    if state not in new or value < new[state][0]:
                        new[state] = (value, to)
            best = new
        _, _, text = min((cost, i, text) for i, (cost, text) in enumerate(best.values()))
        letters: list[str] = []
        while text:
            text, c = text
            letters.append(c)
        return "".join(reversed(letters))[: len(letters) - len(then)]

    def part(self, signs: str, before: str, then: str) -> str:
        """Signs between known letters; ``ORDER - 1`` letters are all that the model sees of a side."""
        if not signs:
            return ""
        key = signs, before, then
        if key not in self.parts:
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            whole = self.arcs(("xx" if before else "") + signs + ("xx" if then.strip() else ""))
            start = 2 if before else 0
            self.parts[key] = self.decode(whole[start : start + len(signs)], before, then)
        return self.parts[key]

    def clear(self, word: str) -> str:
        """A lower-case word as it was meant, words with spaces between; a plain word comes back unchanged, a number without the signs around it."""
        word = latin(word)
        if word.isalpha() and not _DRAWN.search(word):
            return word
        if number := _NUMBER.match(word):
            return number[1]
        core = _CORE.match(word)
        if core and not _DRAWN.search(core[2]):
            head, letters, tail = core.groups()
            sides = self.part(head, "", letters[: ORDER - 1]), self.part(tail, (" " + letters)[1 - ORDER :], " ")
            return sides[0] + letters + sides[1]
        return " ".join(self.decode(self.arcs(word, bool(_INNER.match(word)))).split())

    def join(self, spaced: str) -> str:
        """Single characters with white space between them, as words."""
        return " ".join(self.decode(self.arcs(latin(" ".join(spaced.split())), True)).split())


def words_of(data: bytes, channel: Channel, memory: dict[bytes, str]) -> set[str]:
    """Distinct restored words of a whole text."""
    data = data.decode().lower().encode()
    out: set[str] = set()
    for word in set(data.split()):
        clear = memory.get(word)
        if clear is None:
            if len(memory) >= REMEMBERED:
                memory.clear()
            clear = memory[word] = channel.clear(word.decode())
        out.update(clear.split())
    for found in _SPACED.findall(data):
        out.update(channel.join(found.decode()).split())
    return out


def features_of(word: str) -> list[int]:
    """Hashes of a word and its beginnings."""
    return [xxhash.xxh32_intdigest(x) - (1 << 31) for x in (word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) >= n))]


def _extract(batches: Iterator[pa.RecordBatch], channel: Channel, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    memory: dict[bytes, str] = {}
    for batch in batches:
        rows, digests = [], []
        for scalar in batch.column(1):
            data = scalar.as_py()
            rows.append(sorted({f for w in words_of(data, channel, memory) for f in features_of(w)}))
            digests.append(xxhash.xxh3_64_intdigest(data) - (1 << 63))
        yield record(schema, [batch.column(0), digests, rows])


def fit(rows: list[tuple[int, list[int]]], n: int, ridge: float = 3e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model over ``n`` binary features; labels weigh the same in sum."""
    y = np.array([r[0] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return np.zeros(n), -5.0 if not len(y) or y[0] == 0 else 5.0
    used = np.concatenate([np.zeros(0, np.int64), *[np.asarray(r[1], np.int64) for r in rows]])
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, b = np.zeros(n), 0.0
    mw, mb, step = np.zeros(n), 0.0, 2.0
    for _ in range(400):  # accelerated gradient
        ahead = w + 0.9 * mw
        z = np.bincount(row, ahead[used], len(rows)) + b + 0.9 * mb
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        mw = 0.9 * mw - step * (np.bincount(used, g[row], n) + ridge * w)
        mb = 0.9 * mb - step * float(g.sum())
        w, b = w + mw, b + mb
    return w, float(b)


def _score(batches: Iterator[pa.RecordBatch], channel: Channel, places: dict[int, float], bias: float, cut_at: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    memory: dict[bytes, tuple[int, ...]] = {}

    def known(clear: str) -> tuple[int, ...]:
        return tuple(f for word in clear.split() for f in features_of(word) if f in places)

    for batch in batches:
        *carried, texts = batch.columns
        scores = []
        for scalar in texts:
            data = scalar.as_py().decode().lower().encode()
            hits: set[int] = set()
            for word in set(data.split()):
                found = memory.get(word)
                if found is None:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    found = memory[word] = known(channel.clear(word.decode()))
                if found:
                    hits.update(found)
            for spaced in _SPACED.findall(data):
                hits.update(known(channel.join(spaced.decode())))
            z = bias + sum(places[f] for f in sorted(hits))
            scores.append(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))
        predicted = [int(s >= cut_at) for s in scores]
        yield record(schema, [*carried, scores, predicted])


def toxicity_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", keep: tuple[str, ...] = (), parts: int = 3, part: int = 1, sample: int = SAMPLE, cut_at: float = CUT_AT) -> DataFrame:
    """Toxicity of every whole text; one row per input row, columns in ``keep`` carried.

    Columns: ``key``, ``held_out`` (crc32 of the key as text modulo ``parts``
    is ``part``), ``score`` (0 to 1), ``predicted`` (score >= ``cut_at``).

    The character model is counted over all texts.  The fit uses at most
    ``sample`` labelled rows of each label that are not held out, and all their
    features that give evidence for label 1.  Null and
    empty texts score by the bias alone; null keys are scored and never train;
    repeated rows give repeated results; rows without a label are left out of
    the fit; with one label only, that label's constant score is given; an
    empty table gives an empty one.
    """
    text_bytes = as_bytes(f"`{text}`").alias("text")
    s1, a1 = schemas([], "gram int, n long")
    counts = np.zeros(_N**ORDER)
    for r in docs.select(text_bytes).mapInArrow(slim(lambda it: _count(it, a1)), s1).groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r["gram"]] = r["n"]
    channel = Channel(counts)

    known = labels.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).filter(~held_out(F.col("id"), parts, part) & F.col("id").isNotNull())
    of = lambda y: known.filter(F.col("y") == y).dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(sample)
    # At most 2 * sample ids: a size that does not grow with the input.
    chosen = F.broadcast(of(1).union(of(0)))
    s2, a2 = schemas([], "y int, digest long, used array<int>")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), text_bytes).join(chosen, "id").select("y", "text")
    drawn = cut(rows.mapInArrow(slim(lambda it: _extract(it, channel, a2)), s2), "drawn")
    once = drawn.dropDuplicates(["digest", "y"])
    size = {r["y"]: r["n"] for r in once.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = max(size.get(1, 0), 1), max(size.get(0, 0), 1)
    per = once.select("y", F.explode("used").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    gain = F.col("a") * F.log((F.col("a") + 0.1) / pos / ((F.col("b") + 1.0) / neg))
    top = [r["f"] for r in per.filter((F.col("a") >= 2) & (F.col("a") * neg > 2 * F.col("b") * pos) & (gain >= EVIDENCE)).orderBy("f").select("f").collect()]
    place = {f: i for i, f in enumerate(top)}
    s3, a3 = schemas([], "y int, used array<int>")

    def project(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield record(a3, [batch.column(0), [[place[f] for f in used if f in place] for used in batch.column(1).to_pylist()]])

    vectors = [(r["y"], r["used"]) for r in once.select("y", "used").mapInArrow(project, s3).orderBy("y", F.xxhash64("used")).collect()]
    weights, bias = fit(vectors, len(top))
    forget(drawn)
    places = {f: float(w) for f, w in zip(top, weights, strict=True) if w}
    carried = [F.col(f"`{key}`").alias("__key"), held_out(F.col(f"`{key}`"), parts, part).alias("held_out"), *[F.col(f"`{c}`").alias(f"__keep_{i}") for i, c in enumerate(keep)]]
    source = docs.select(*carried, text_bytes)
    out, arrow = schemas(source.schema.fields[:-1], "score double, predicted int")
    scored = source.mapInArrow(slim(lambda it: _score(it, channel, places, bias, cut_at, arrow)), out)
    return scored.select(F.col("__key").alias(key), "held_out", "score", "predicted", *[F.col(f"__keep_{i}").alias(c) for i, c in enumerate(keep)])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE: dict[str, str] = {}
