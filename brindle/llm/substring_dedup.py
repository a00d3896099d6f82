"""Substring dedup by level-wise doubling over word windows.

Level by level, windows of ``first``, twice, four times, ... as many words are
counted over the corpus.  A window found alone ends there; two neighbours that
are both repeated are extended to one window of twice the length (the last
level: to ``window`` words, by two that overlap), until no candidates survive.
The windows that reach the full length are compared by 128-bit names with the
documents they start in.

Levels under ``first`` words are left out: nearly every word and pair of words
of prose occurs twice, so they would cost an exchange each and end nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm._packed import ANSWER, ASK, SPARK_ROWS, Buffer, Layout, address, as_table, meet, pack, runs, several, unpack
from brindle.llm._shared import chunks, cut, schemas, slim, table
from brindle.llm._windows import join, ladder, segments, word_parts
from brindle.llm.repeats import MARKS, SPANS, covered, exact_windows, find_repeats, gather, largest_power, owner

WINDOW = 13
#: Words of the first level.
FIRST = 4
#: Names that only select candidates have 48 bits.
_SHORT = np.uint64((1 << 48) - 1)
_ASKED = Layout((6, 8, 4, 4, 1), (1,))
_FOUND = Layout((6, 8, 4, 4), (1,))


def level_sizes(window: int, first: int) -> list[int]:
    """Lengths of the levels that are counted: powers of two from ``first`` on, below ``window``."""
    first = min(largest_power(first), largest_power(max(1, window - 1)))
    sizes = [first]
    while 2 * sizes[-1] < window:
        sizes.append(2 * sizes[-1])
    return sizes


@dataclass(frozen=True)
class LevelRule:
    """Word windows that also start in a document with a smaller key."""

    window: int = WINDOW
    first: int = FIRST
    words: bool = True

    def candidates(self, bare: DataFrame, buckets: int) -> DataFrame:
        window, sizes = self.window, level_sizes(self.window, self.first)

        def give(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            name, doc, copy, at = columns
            found, ask, many = several([name])
            yield pack(ASK, address(name[ask], buckets), [x[ask] for x in columns] + [many], _ASKED)
            yield pack(ANSWER, address(owner(doc[found], copy[found]), buckets), [x[found] for x in columns], _FOUND)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The first level's windows."""
            buffer = Buffer(give)
            for batch in batches:
                for a, b in chunks(batch, "text"):
                    doc, copy = (batch.column(i).slice(a, b - a).to_numpy(zero_copy_only=False) for i in (0, 1))
                    for values, row, base, offsets in segments(batch.column(2).slice(a, b - a).to_pylist(), True, window, 1):
                        name = ladder(values[0], (sizes[0],))[0] & _SHORT
                        place = np.arange(len(name))
                        part = np.searchsorted(offsets, place, "right") - 1
                        ok = place + sizes[0] <= offsets[part + 1]
                        place, part = place[ok], part[ok]
                        yield from buffer.add([name[ok], doc[row[part]], copy[row[part]], place - offsets[part] + base[part]])
            yield from buffer.flush()

        def decide(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            name, doc, copy, at, many = unpack(rows, _ASKED)
            found, _, _ = several([name], many > 0)
            doc, copy = doc[found], copy[found]
            yield pack(ANSWER, address(owner(doc, copy), buckets), [name[found], doc, copy, at[found]], _FOUND)

        def extended(rows: pa.Table, step: int) -> list[np.ndarray]:
            """Windows made of two survivors ``step`` apart in one text."""
            columns = unpack(rows, _FOUND)
            name, doc, copy, at = columns
            order = np.lexsort((name, at, copy, doc))
            name, doc, copy, at = (c[order] for c in columns)
            new = runs(doc, copy, at, name)  # parts of one text overlap
            name, doc, copy, at = name[new].view(np.uint64), doc[new], copy[new], at[new]
            place = ((np.cumsum(runs(doc, copy)) - 1) << 32) | at
            low, high = np.searchsorted(place, place + step), np.searchsorted(place, place + step, "right")
            left = np.repeat(np.arange(len(place)), high - low)
            right = np.repeat(low - np.cumsum(high - low) + high - low, high - low) + np.arange(len(left))
            return [join(name[left], name[right]) & _SHORT, doc[left], copy[left], at[left]]

        def longer_by(step: int):
            return lambda rows: as_table(give(extended(rows, step)))

        def whole(step: int):
            def run(rows: pa.Table) -> pa.Table:
                _, doc, copy, at = extended(rows, step)
                return as_table([pack(ANSWER, address(owner(doc, copy), buckets), [doc, copy, at, np.ones_like(at), np.zeros_like(at)], MARKS)])

            return run

        rows = bare.mapInArrow(slim(count), SPARK_ROWS)
        for size, longer in zip(sizes, [*sizes[1:], window], strict=True):
            survivors = cut(meet(rows, decide).filter(F.col("kind") == ANSWER), "level")
            if not survivors.limit(1).count():
                return bare.sparkSession.createDataFrame([], schemas([], "doc long, copy long, marks binary")[0])
            extend = whole if size == sizes[-1] else longer_by
            rows = survivors.groupBy("bucket").applyInArrow(extend(longer - size), SPARK_ROWS)
        return gather(rows, MARKS, ("doc", "copy"), "marks")

    def exact(self, work: DataFrame, buckets: int) -> DataFrame:
        return gather(exact_windows(work, True, self.window, True, buckets), SPANS, ("rid",), "spans")


def _finish(data: bytes, spans: bytes | None, window: int, with_text: bool) -> tuple:
    """Words, words that go, the hash of those that stay and, ``with_text``, those themselves."""
    parts = [part.split() for part in word_parts(data)]
    n = sum(map(len, parts))
    gone = covered(n, spans, window)
    digest, kept, at = hashlib.sha256(), [], 0
    for part in parts:
        left = part if gone is None else list(compress(part, (~gone[at : at + len(part)]).tolist()))
        at += len(part)
        if left:
            piece = (b" " if kept else b"") + b" ".join(left)
            digest.update(piece)
            kept.append(piece if with_text else b"")
    return n, 0 if gone is None else int(gone.sum()), digest.hexdigest(), b"".join(kept).decode("utf-8", "ignore") if with_text else None


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), window: int = WINDOW, with_text: bool = False, first: int = FIRST) -> DataFrame:
    """Remove each word covered by a ``window``-word sequence that also starts in a document with a smaller key.

    One row per input row: ``key``, ``keep`` columns, ``n_words``,
    ``n_removed``, ``kept_sha256`` (kept words joined by one space) and,
    ``with_text``, ``kept``.  Words are runs of non-white-space bytes,
    unchanged; windows are judged on the input.

    Null and empty texts have no words; texts under ``window`` words stay
    whole; rows with one key never remove from each other; a null key is larger
    than any other; an empty table gives an empty one; other columns are ignored.
    """
    out = find_repeats(docs, [LevelRule(window, first)], key, text, keep, lambda data, spans: _finish(data, spans[0], window, with_text), "n_words long, n_removed long, kept_sha256 string, kept string")
    return out if with_text else out.drop("kept") if "kept" not in keep else out


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


#: A 13-word window is removed if its words also start in a document with a smaller id.
ORACLE_OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT rid, doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d WHERE len(words) >= 13),
h AS (SELECT rid, doc_id, i, array_to_string(words[i:i + 12], ' ') AS win FROM w),
r AS (SELECT rid, i FROM (SELECT rid, i, doc_id, min(doc_id) OVER (PARTITION BY win) AS first FROM h) WHERE doc_id > first),
gone AS (SELECT DISTINCT rid, i + o AS i FROM r, (SELECT unnest(range(0, 13)) AS o)),
u AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
k AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n_kept FROM u ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""

QUERIES = {"op7_substring_dedup": op7_substring_dedup}
ORACLE = {"op7_substring_dedup": ORACLE_OP7}
