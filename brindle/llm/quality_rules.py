"""Quality rules: whole-text counts and cross-document line frequency.

Normalised lines (lower case, words joined by one space) are hashed; a line
that occurs in more than ``max_docs`` documents of one host is boilerplate and
its words are removed; a document that keeps less than ``min_kept`` of its
word characters is depleted and rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm._shared import as_bytes, cut, record, schemas, slim, table

#: Characters that count as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"
MIN_WORDS = 50


def _n_chars(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode())


def text_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one text."""
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated, triples = 0, list(zip(words, words[1:], words[2:], strict=False))
    if len(set(triples)) < len(triples):
        often, upto = Counter(triples), 0
        for i, triple in enumerate(triples):
            if often[triple] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    return len(words), _n_chars(data.translate(None, SPACE)), len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated


def line_sizes(data: bytes) -> dict[int, int]:
    """Word characters by hash of the normalised line; lines without a word are left out."""
    out: dict[int, int] = {}
    for line in data.split(b"\n"):
        if words := line.split():
            normal = b" ".join(words).decode().lower()
            h = xxhash.xxh3_64_intdigest(normal) - (1 << 63)
            out[h] = out.get(h, 0) + _n_chars(b"".join(words))
    return out


def _measure(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, hashes, sizes = [], [], []
        for scalar in batch.column(batch.num_columns - 1):
            data = scalar.as_py()
            counts.append(text_counts(data))
            lines = line_sizes(data)
            hashes.append(list(lines))
            sizes.append(list(lines.values()))
        yield record(schema, [*batch.columns[:-1], *(zip(*counts, strict=True) if counts else [[]] * 5), hashes, sizes])


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = 25, min_kept: float = 0.3, min_words: int = MIN_WORDS) -> DataFrame:
    """Counts of every whole text and whether the document is kept; one row per input row.

    Columns: ``key``, ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, ``base_failed`` (under ``min_words``
    words, or over half the words in repeated 3-word windows), ``kept``,
    ``common_chars`` (word characters in lines found in more than ``max_docs``
    documents of the host).

    Null texts are empty and fail; a null host is a host of its own; a null key
    counts as a document of its own; rows of one key are one document in the line
    statistics; other columns are ignored.  Line statistics cover all rows; the list of common lines is
    joined (Spark broadcasts it only below its size threshold).
    """
    source = docs.select(F.col(f"`{key}`").alias("__key"), F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("\u0000")).alias("__host"), as_bytes(f"`{text}`").alias("__bytes"))
    schema, arrow = schemas(source.schema.fields[:2], "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, __hash array<long>, __size array<long>")
    measured = cut(source.mapInArrow(slim(lambda it: _measure(it, arrow)), schema).withColumn("__row", F.monotonically_increasing_id()), "quality")
    # Rows of one key are one document; a row without a key is one by itself.
    doc = F.coalesce(F.concat(F.lit("k"), F.col("__key").cast("string")), F.concat(F.lit("r"), F.col("__row").cast("string"))).alias("__doc")
    lines = measured.select("__row", doc, "__host", F.explode(F.arrays_zip("__hash", "__size")).alias("line")).select("__row", "__doc", "__host", "line.__hash", "line.__size")
    common = lines.groupBy("__host", "__hash", "__doc").agg(F.lit(1).alias("one")).groupBy("__host", "__hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_docs).drop("n")
    lost = lines.join(common, ["__host", "__hash"]).groupBy("__row").agg(F.sum("__size").alias("common_chars"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("word_chars") - F.col("common_chars")
    return (
        measured.drop("__hash", "__size", "__host")
        .join(lost, "__row", "left")
        .withColumn("common_chars", F.coalesce("common_chars", F.lit(0)))
        .select(F.col("__key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (left >= min_kept * F.col("word_chars"))).alias("kept"), "common_chars")
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


#: The same counts in DuckDB; lines are compared as texts instead of hashes.
ORACLE_OP10 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
wi AS (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3),
tri AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS t FROM wi),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS n FROM tri) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM rep, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT rid, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM ln),
lv AS (SELECT rid, line, lower(array_to_string(words, ' ')) AS norm, length(array_to_string(words, '')) AS size FROM lw WHERE len(words) > 0),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lv GROUP BY rid),
per AS (SELECT v.rid, coalesce(d.source, chr(0)) AS host, norm, sum(size) AS size FROM lv v JOIN d USING (rid) GROUP BY ALL),
common AS (SELECT host, norm FROM per JOIN d USING (rid) GROUP BY ALL HAVING count(DISTINCT coalesce('k' || doc_id, 'r' || rid)) > 25),
lost AS (SELECT rid, sum(size) AS common_chars FROM per JOIN common USING (host, norm) GROUP BY rid),
s AS (SELECT rid, doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d JOIN w USING (rid)),
a AS (SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(common_chars, 0)::BIGINT AS common_chars
  FROM s LEFT JOIN dup USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN lost USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars - common_chars >= 0.3 * word_chars AS kept, common_chars FROM f
"""

QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLE = {"op10_quality_rules": ORACLE_OP10}
