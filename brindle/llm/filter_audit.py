"""Filter interaction audit: what each of five filters removes in every order of applying them.

Four filters look at one text (A few words, B few distinct words, C capitals,
D symbols); E fails a text that is identical to one of a smaller id.  Identical
texts are found by partition refinement: classes are split by length in bytes,
then by the hash of one block of the text after another (blocks grow, so the
passes are the logarithm of the longest text), and rows alone in their class are
dropped; full texts of what is left are compared, and every id but the smallest
of a text fails.  A row is then a mask of five bits, and all orders follow from
the number of rows of each mask in each part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm._shared import cut, forget, table

FILTERS = "ABCDE"
SPACES = r"[\x20\x09-\x0D]+"
CAPITALS = "[A-Z]+"
#: Bytes of a text's first block; each further one is GROWTH times as long.
BLOCK, GROWTH = 256, 4
ORDERS = list(permutations(FILTERS))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def masks(text: Column, words: Column) -> Column:
    """Bits 0 to 3: whether a text (not null) of these words fails A, B, C, D."""
    n, chars = F.size(words).cast("long"), F.length(text).cast("long")  # a hundred times a long text is more than an int
    failing = (
        n < 100,
        100 * F.size(F.array_distinct(words)).cast("long") < 80 * n,
        100 * (chars - F.length(F.regexp_replace(text, CAPITALS, ""))) > 10 * chars,
        text.rlike(r"[#$%&*|]"),
    )
    return reduce(lambda a, b: a + b, [F.when(x, 1 << i).otherwise(0) for i, x in enumerate(failing)])


def block_hashes(text: Column, block: int = BLOCK) -> Column:
    """Hashes of the consecutive blocks of a text: ``block`` bytes, then GROWTH times as many, and so on.

    A block of bytes is a copy of its own place; one of code points would count
    through the whole text for its length and up to its start, once a block.
    """
    ends = []  # a text has under 2^31 bytes
    start, size = 0, block
    while start < 1 << 31:
        ends.append((start, min(size, (1 << 31) - 1)))
        start, size = start + size, size * GROWTH
    spans = F.array(*[F.struct(F.lit(a).cast("long").alias("at"), F.lit(n).cast("int").alias("n")) for a, n in ends])
    return F.transform(F.filter(spans, lambda s: s["at"] < F.octet_length(text)), lambda s: F.xxhash64(F.substring(text.cast("binary"), (s["at"] + 1).cast("int"), s["n"])))


def refined(slim: DataFrame) -> DataFrame:
    """Class (``cls``) of each row of ``id, bytes, blocks`` that is together with another to the last block.

    One pass a block: a class is split by the block's hash and rows alone in
    theirs are dropped; a row without further blocks is done.  Classes are 64-bit
    names, so different texts may share one; full texts are compared afterwards.
    """

    def shared(rows: DataFrame, step: str) -> DataFrame:
        many = rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cls")
        return cut(rows.join(many, "cls", "left_semi"), step)

    left = shared(slim.select("id", "blocks", F.xxhash64("bytes").alias("cls")), "lengths")
    done, k, used = [], 0, [left]
    while True:
        done.append(left.filter(F.size("blocks") <= k).select("id", "cls"))
        left = left.filter(F.size("blocks") > k)
        if left.isEmpty():
            break
        left = shared(left.withColumn("cls", F.xxhash64("cls", F.element_at("blocks", k + 1))), f"block{k}")
        used.append(left)
        k += 1
    out = cut(reduce(DataFrame.union, done), "classes")
    forget(*used)
    return out


def class_of(text: Column, block: int = BLOCK) -> Column:
    """The class that a text has after its last pass."""
    return F.aggregate(block_hashes(text, block), F.xxhash64(F.octet_length(text)), lambda cls, h: F.xxhash64(cls, h))


def measured(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """``id, part, text`` of each row; a null text is empty, a null part the empty string."""
    return docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


def smallest_ids(texts: DataFrame, slim: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The smallest id of each text that several rows of ``slim`` may hold.

    First ``cls, lead`` of classes of one text, then ``cls, text, lead`` of the
    texts of classes that hold several (64-bit names that met by chance).  The
    texts of shared classes are grouped as they are, after each task has put its
    own copies together.
    """
    classes = cut(refined(slim).select("cls").distinct(), "shared")
    whole = texts.withColumn("cls", class_of(F.col("text"), block)).join(classes, "cls", "left_semi")
    whole = cut(whole.groupBy("cls", "text").agg(F.min("id").alias("lead")), "whole")
    forget(classes)
    n = whole.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("lead").alias("lead"))
    mixed = n.filter("n > 1").select("cls")
    return cut(n.filter("n = 1").select("cls", "lead"), "leads"), cut(whole.join(mixed, "cls", "left_semi"), "mixed")


def row_masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", block: int = BLOCK) -> DataFrame:
    """``id, part, mask, good, toxic`` of each row of ``docs``; bits of the mask are the failed filters, A the lowest.

    A null text is empty, a null part the empty string.  A null id is neither
    smaller than another nor has smaller ones.  Repeated rows count each, and
    rows of one id and text are no smaller copies of each other.  An id that
    ``labels`` holds twice has a mark if either row has it.  Other columns are ignored.
    """
    texts = measured(docs, key, text, part)
    own = masks(F.col("text"), F.col("words")).alias("own")
    worded = texts.withColumn("words", words_of(F.col("text")))  # a column of its own, as it is used several times
    slim = worded.select("id", "part", own, F.octet_length("text").alias("bytes"), block_hashes(F.col("text"), block).alias("blocks"))
    slim = cut(slim.withColumn("cls", F.aggregate("blocks", F.xxhash64("bytes"), lambda cls, h: F.xxhash64(cls, h))), "audit")
    leads, mixed = smallest_ids(texts, slim, block)
    rows = slim.select("id", "part", "own", "cls")
    if mixed.isEmpty():
        rows = rows.join(leads, "cls", "left")
    else:
        some = mixed.select("cls").distinct()
        told = worded.select("id", "part", own, class_of(F.col("text"), block).alias("cls"), "text").join(some, "cls", "left_semi")
        rows = rows.join(some, "cls", "left_anti").join(leads, "cls", "left").unionByName(told.join(mixed, ["cls", "text"]).drop("text"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    mask = F.col("own") + F.when(F.col("id") > F.col("lead"), 1 << 4).otherwise(0)
    out = rows.select("id", "part", mask.alias("mask")).join(marks, "id", "left")
    return out.select("id", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def steps_of(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """The 600 steps of all orders from 32 numbers of rows, good and toxic ones by mask."""
    mask = np.arange(32)
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    own = np.array([bit[f] for order in ORDERS for f in order])
    before = np.array([sum(bit[x] for x in order[:i]) for order in ORDERS for i in range(5)])
    fails, gone = (mask & own[:, None]) != 0, (mask & before[:, None]) != 0
    bits = np.array([max(1, int(m).bit_count()) for m in mask])
    return {
        "filter_order": np.repeat(["".join(order) for order in ORDERS], 5),
        "step": np.tile(np.arange(1, 6), len(ORDERS)),
        "kept": (~fails & ~gone) @ n,
        "removed": (fails & ~gone) @ n,
        "redundant": (fails & gone) @ n,
        "unique_fails": (mask == own[:, None]) @ n,
        "good_lost": (fails & ~gone) @ good,
        "toxic_lost": (fails & ~gone) @ toxic,
        "shapley": (fails * (len(ORDERS) // bits)) @ n,  # a row that fails k filters is removed by each in 120 / k orders
    }


STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def interactions(rows: DataFrame) -> DataFrame:
    """Counts of every part, order and step from ``part, mask, good, toxic``; no rows give no parts.

    What leaves the aggregate are 96 numbers of each part.
    """
    small = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    parts = small.groupBy("part").agg(*[F.array(*[F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for m in range(32)]).alias(c) for c in ("n", "good", "toxic")])

    def steps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                yield pd.DataFrame({"part": row.part} | steps_of(*(np.array(x, np.int64) for x in (row.n, row.good, row.toxic))))

    return parts.mapInPandas(steps, STEPS)


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", block: int = BLOCK) -> DataFrame:
    """What each filter removes at each step of each order, by part; see :func:`row_masks` and :func:`interactions`.

    ``shapley`` is the filter's removals summed over all orders: a row that fails
    ``k`` filters is removed by each of them in 120 / k orders.
    """
    return interactions(row_masks(docs, labels, key, text, part, block))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Each step counted over the documents themselves; orders by joins of the five letters.
ORACLE_OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
first AS (SELECT text, min(doc_id) AS lead FROM d GROUP BY text),
mark AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(words) < 100 THEN 'A' ELSE '' END ||
  CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END ||
  CASE WHEN 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 10 * length(w.text) THEN 'C' ELSE '' END ||
  CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 'D' ELSE '' END ||
  CASE WHEN w.doc_id > lead THEN 'E' ELSE '' END AS fails
  FROM w JOIN first USING (text) LEFT JOIN mark USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT g.*, s.*, contains(fails, own) AS fail_own, length(translate(fails, before, '')) < length(fails) AS gone FROM g, s),
t AS (SELECT part, filter_order, step, own,
  sum(CASE WHEN NOT gone AND NOT fail_own THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN fail_own AND NOT gone THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN fail_own AND gone THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN fail_own AND NOT gone THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN fail_own AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM t
"""

QUERIES = {"op12_filter_audit": op12_filter_audit}
ORACLE = {"op12_filter_audit": ORACLE_OP12}
