"""Suffix-array dedup: depth-limited most-significant-digit passes over suffixes.

The suffixes that are sorted are those at anchors: every window of ``window``
tokens has one, at the same place in equal windows (the smallest name of
``gram`` tokens in it), so a repeated window has suffixes that agree from its
anchor on.  They are ordered only through ``gram`` tokens, digit by digit: the
first digit deals suffixes to buckets; within a bucket each pass sorts what is
left by the next digit within equal groups and drops suffixes that are alone.
What is together after the last digit can begin a repeated window; there the
rest of the depth, on both sides of the anchor, is one more digit: first for all
windows of an anchor at once (a block), then, where blocks differ, window by
window.  What is equal through all digits is exactly the repeated windows.
A digit is the name of a string of tokens; the last digits have 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm._packed import ANSWER, ASK, OPEN, SPARK_ROWS, Buffer, Layout, address, meet, pack, runs, several, unpack
from brindle.llm._shared import chunks, cut, slim, table
from brindle.llm._windows import anchors, join, ladder, segments, window_names, word_edges
from brindle.llm.repeats import MARKS, SPANS, covered, exact_blocks, exact_windows, find_repeats, gather, largest_power, owner, starts_of

WINDOW = 400
#: Words of the shortest repeated passage that is counted beside the bytes: over 50.
PASSAGE = 51
#: Digits of the passes before texts are looked at again.
DIGITS = 4
#: Digits that only select candidates have 48 bits.
_SHORT = np.uint64((1 << 48) - 1)


def radix_groups(digits: list[np.ndarray], paired: np.ndarray) -> np.ndarray:
    """Suffixes that agree with another one in all digits, in order; most significant digit first.

    Each pass sorts what is left within its groups by one digit and drops groups
    of one.  A suffix marked ``paired`` stands for several.
    """
    left = np.arange(len(paired))
    group = np.zeros(len(paired), np.int64)
    for digit in digits:
        order = np.lexsort((digit[left], group))
        left, group = left[order], group[order]
        new = runs(group, digit[left])
        group = np.cumsum(new) - 1
        together = np.bincount(group, minlength=1) > 1
        np.logical_or.at(together, group, paired[left])
        stay = together[group]
        left, group = left[stay], group[stay]
    return left


@dataclass(frozen=True)
class RadixRule:
    """Windows of ``window`` tokens (bytes, or words) that also start anywhere else."""

    window: int
    words: bool = False

    @property
    def gram(self) -> int:
        return largest_power(max(1, 3 * self.window // 4))

    def candidates(self, bare: DataFrame, buckets: int) -> DataFrame:
        window, k = self.window, self.gram
        size = max(1, k // DIGITS)
        m = k // size
        asked, found = Layout((*(6,) * m, 8, 4, 4, 1), (m,)), Layout((8, 4, 4, 4, 1), (0,))
        assert found == MARKS

        def answer(doc: np.ndarray, copy: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
            return pack(ANSWER, address(owner(doc, copy), buckets), [doc, copy, at, np.ones_like(at), np.zeros_like(at)], MARKS)

        def give(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            *digits, doc, copy, at = columns
            equal, ask, many = several(digits)
            yield pack(ASK, address(digits[0][ask], buckets), [x[ask] for x in columns] + [many], asked)
            yield answer(doc[equal], copy[equal], at[equal])

        def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            buffer = Buffer(give)
            for batch in batches:
                for a, b in chunks(batch, "text"):
                    doc, copy = (batch.column(i).slice(a, b - a).to_numpy(zero_copy_only=False) for i in (0, 1))
                    for values, row, base, offsets in segments(batch.column(2).slice(a, b - a).to_pylist(), self.words, window, 1):
                        short, grams = ladder(values[0], (size, k))
                        part, place, _, _ = anchors(grams, offsets, window, k)
                        digits = [short[place + j * size] & _SHORT for j in range(m)]
                        yield from buffer.add([*digits, doc[row[part]], copy[row[part]], place - offsets[part] + base[part]])
            yield from buffer.flush()

        def passes(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            *digits, doc, copy, at, many = unpack(rows, asked)
            left = radix_groups(digits, many > 0)
            left = left[many[left] == 0]
            yield answer(doc[left], copy[left], at[left])

        rows = meet(bare.mapInArrow(slim(suffixes), SPARK_ROWS), passes).filter(F.col("kind") == ANSWER)
        return gather(rows, MARKS, ("doc", "copy"), "marks")

    def exact(self, work: DataFrame, buckets: int) -> DataFrame:
        window, k = self.window, self.gram

        def blocks(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
            rid = batch.column(0).to_numpy(zero_copy_only=False)
            alive = [starts_of(x.as_py())[0] for x in batch.column(3)]
            for values, row, base, offsets in segments(batch.column(2).to_pylist(), self.words, window, 2):
                grams = [ladder(v, (k,), lane)[0] for lane, v in enumerate(values)]
                part, place, first, last = anchors(grams[0], offsets, window, k)
                at = place - offsets[part] + base[part]
                # Places and marks of all rows as single numbers.
                mine = np.concatenate([x + (r << 40) for r, x in enumerate(alive)])
                keep = np.isin(at + (row[part] << 40), mine)
                part, place, first, last = part[keep], place[keep], first[keep], last[keep]
                n = last - first + 1
                names = []
                for lane, g in enumerate(grams):
                    whole = window_names(g, k, window, lane)
                    names.append(join(join(whole[first], whole[last], lane), n.astype(np.uint64), lane))
                yield [grams[0][place], *names, rid[row[part]], first - offsets[part] + base[part], n]

        rows = cut(exact_blocks(work, blocks, buckets), "blocks")
        todo = gather(rows.filter(F.col("kind") == OPEN), SPANS, ("rid",), "marks")
        open_ = work.select("rid", "doc", "text").join(todo, "rid")
        singles = exact_windows(open_, self.words, window, False, buckets)
        return gather(rows.filter(F.col("kind") == ANSWER).unionByName(singles), SPANS, ("rid",), "spans")


def byte_runs(data: bytes, gone: np.ndarray | None, words: bool) -> np.ndarray:
    """Which bytes go: a covered byte; with a run of covered words the white space between and after them."""
    if gone is None:
        return np.zeros(len(data), bool)
    if not words:
        return gone
    raw = np.frombuffer(data, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    begin = ~space
    begin[1:] &= space[:-1]
    # A word and the white space after it share a number.
    number = np.cumsum(begin)
    return np.concatenate([[False], gone])[number]


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), window: int = WINDOW, passage: int = PASSAGE, with_text: bool = False, cut_passages: bool = False) -> DataFrame:
    """Remove each byte covered by a ``window``-byte string that also starts elsewhere.

    One row per input row: ``key``, ``keep`` columns, ``n_bytes``,
    ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256``,
    ``n_passage_words`` (words in runs of ``passage`` words or more that also
    stand elsewhere, whatever their bytes) and, ``with_text``, ``kept``: the
    remaining text without characters cut in two.  With ``cut_passages`` the
    words of ``n_passage_words`` go as well.  The text is its UTF-8 bytes;
    strings never cross documents; the same document counts as elsewhere;
    overlaps count; strings are judged on the input.

    Null and empty texts have no bytes and keep nothing; texts under ``window``
    bytes stay whole; repeated rows are elsewhere for each other, whatever their
    key; null keys are kept; an empty table gives an empty one; other columns
    are ignored.
    """

    def finish(data: bytes, spans: list[bytes | None]) -> tuple:
        gone = byte_runs(data, covered(len(data), spans[0], window), False)
        passed = 0
        if spans[1]:
            long = covered(len(word_edges(np.frombuffer(data, np.uint8))[0]), spans[1], passage)
            passed = int(long.sum())
            if cut_passages:
                gone = gone | byte_runs(data, long, True)
        n = int(gone.sum())
        left = np.frombuffer(data, np.uint8)[~gone].tobytes() if n else data
        spans_ = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        return len(data), n, spans_, hashlib.sha256(left).hexdigest(), passed, left.decode("utf-8", "ignore") if with_text else None

    rules = [RadixRule(window), RadixRule(passage, words=True)]
    out = find_repeats(docs, rules, key, text, keep, finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, kept string")
    return out if with_text or "kept" in keep else out.drop("kept")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


#: All windows by their hashes; bytes are pairs of hexadecimal digits.
ORACLE_OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT rid, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d WHERE length(h) >= 800),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY k) AS n FROM (SELECT rid, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM s)) WHERE n > 1),
m AS (SELECT rid, min(i) AS a, max(i) + 400 AS b FROM (SELECT rid, i, sum(CASE WHEN i > p + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS g FROM (SELECT rid, i, lag(i, 1, i) OVER (PARTITION BY rid ORDER BY i) AS p FROM r)) GROUP BY rid, g),
k AS (SELECT rid, string_agg(substr(h, 2 * pb + 1, 2 * (a - pb)), '' ORDER BY a) AS kept, max(b) AS last, sum(b - a) AS n_removed, count(*) AS n_spans
  FROM (SELECT rid, a, b, lag(b, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS pb FROM m) JOIN d USING (rid) GROUP BY rid),
t AS (SELECT rid, words, unnest(range(1, len(words) - 49)) AS i FROM d WHERE len(words) >= 51),
q AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY k) AS n FROM (SELECT rid, i, md5(array_to_string(words[i:i + 50], ' ')) AS k FROM t)) WHERE n > 1),
c AS (SELECT rid, sum(least(51, coalesce(nx - i, 51))) AS n_passage_words FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM q) GROUP BY rid)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256, coalesce(n_passage_words, 0)::BIGINT AS n_passage_words
FROM d LEFT JOIN k USING (rid) LEFT JOIN c USING (rid)
"""

QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLE = {"op4_suffix_dedup": ORACLE_OP4}
