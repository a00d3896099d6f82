"""A BM25 index that is built once, appended to and searched many times.

Documents are dealt to strips (runs of documents as they are read).  The postings
of a term in a strip are cut into blocks of at most ``BLOCK``; a block holds its
documents, their term frequencies and lengths and, for its maximum, the least
length for each term frequency: with them the largest contribution of the block
is exact for any mean length, however much is appended later.  Blocks lie in
folders by segment (one append) and bucket of the term.

A search reads the maxima of the asked terms' buckets, scores the most promising
strips of each query, and takes the k-th best score as the bar: a block whose
maximum, with the other terms' maxima in its strip, stays under the bar is never
read.  Results are those of scoring everything.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from brindle.operators.search import B, K1, STOPWORDS, TOP_K, documents_lengths, query_terms, total
from brindle.sources.shared import written

#: Documents of a strip, postings of a block, folders that terms are dealt to.
STRIP, BLOCK, BUCKETS = 1_024, 128, 64
#: Strips a query scores first for each result it wants.
FIRST_STRIPS = 1.0
#: Bounds that differ by less are equal: their sums depend on the order of terms.
SLACK = 1e-9


def _blocks(batches: Iterator[pa.RecordBatch], schema: pa.Schema, strip: int, block: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the documents' terms, strip by strip."""
    part, number, held = TaskContext.get().partitionId() << 32, 0, None

    def of(docs: pa.RecordBatch) -> pa.RecordBatch:
        lengths = docs.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = docs.column(1).flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pairs, tf = np.unique(code * docs.num_rows + np.repeat(np.arange(docs.num_rows), lengths), return_counts=True)
        term, doc = pairs // docs.num_rows, pairs % docs.num_rows
        begins = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(begins, len(term)))
        place = np.arange(len(term)) - np.repeat(begins, sizes)
        heads = np.flatnonzero(place % block == 0)
        ends = np.append(heads[1:], len(term))
        # The least length of each term frequency of a block.
        own = np.repeat(np.arange(len(heads)), ends - heads)
        order = np.lexsort((lengths[doc], tf, own))
        a, b = own[order], tf[order]
        least = order[np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))] if len(order) else order
        peaks = pa.ListArray.from_arrays(pa.array(np.searchsorted(own[least], np.arange(len(heads) + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(tf[least].astype(np.int32)), pa.array(lengths[doc[least]].astype(np.int32))], ["tf", "length"]))
        spans = pa.array(np.append(heads, len(term)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(spans, x) for x in (docs.column(0).take(pa.array(doc)), pa.array(tf.astype(np.int32)), pa.array(lengths[doc].astype(np.int32)))]
        return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(term[heads])), pa.array(np.full(len(heads), part + number)), pa.array((place[heads] // block).astype(np.int32)), pa.array((ends - heads).astype(np.int32)), peaks.cast(schema.field("peaks").type), *(x.cast(schema.field(n).type) for n, x in zip(("documents", "tfs", "lengths"), lists, strict=True))], schema=schema)

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        while held.num_rows >= strip:
            yield of(held.slice(0, strip).combine_chunks().to_batches()[0])
            number, held = number + 1, held.slice(strip)
    if held is not None and held.num_rows:
        yield of(held.combine_chunks().to_batches()[0])


@dataclass(frozen=True)
class _Folder:
    """A folder of a Hadoop file system."""

    at: JavaObject
    files: JavaObject

    def exists(self) -> bool:
        return self.files.exists(self.at)

    def delete(self, deep: bool) -> None:
        self.files.delete(self.at, deep)


@dataclass(frozen=True)
class Index:
    """An index in a folder of any file system that Spark reads and writes."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS
    stopwords: tuple[str, ...] = STOPWORDS

    def segments(self) -> DataFrame:
        """One row per finished append: its number, documents and sum of lengths."""
        return self.spark.read.parquet(f"{self.path}/segments")

    def _folder(self, name: str) -> _Folder:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return _Folder(at, at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()))

    def _next(self) -> int:
        if not self._folder("segments").exists():
            return 0
        last = self.segments().agg(F.max("segment")).first()[0]
        return 0 if last is None else last + 1

    def append(self, docs: DataFrame, key: str, text: str, strip: int = STRIP, block: int = BLOCK) -> Index:
        """Index more documents; their ids have to be new.

        A segment counts once its row in ``segments`` is written, last of all: an
        append that fails leaves nothing that a search reads, and the next one
        writes over it.  Appends are made one at a time.
        """
        segment = self._next()
        lengths = documents_lengths(docs, key, text, self.stopwords)
        lengths.select("document_id", "length").write.mode("overwrite").parquet(f"{self.path}/documents/segment={segment}")
        ids = lengths.schema["document_id"].dataType.simpleString()
        schema = StructType.fromDDL(f"term string, strip bigint, block int, n int, peaks array<struct<tf: int, length: int>>, documents array<{ids}>, tfs array<int>, lengths array<int>")
        arrow = to_arrow_schema(schema)
        blocks = lengths.select("document_id", "terms", "length").mapInArrow(lambda it: _blocks(it, arrow, strip, block), schema)
        # A bucket is dealt to several tasks, so that a term of most documents is no task's alone; a range partitioning would make the blocks twice.
        spread = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        blocks = blocks.withColumn("bucket", (F.crc32(F.col("term").cast("binary")) % self.buckets).cast("int"))
        blocks = blocks.repartition("bucket", F.pmod(F.xxhash64("term", "strip"), F.lit(spread))).sortWithinPartitions("bucket", "term", "strip", "block")
        blocks.write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/postings/segment={segment}")
        stored = self.spark.read.parquet(f"{self.path}/documents/segment={segment}")
        stored.agg(F.lit(segment).alias("segment"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).coalesce(1).write.mode("append").parquet(f"{self.path}/segments")
        return self

    def postings(self, terms: Iterable[str]) -> DataFrame:
        """Blocks of some terms, from the folders of their buckets in finished segments alone."""
        wanted = sorted(set(terms))
        buckets = sorted({zlib.crc32(t.encode()) % self.buckets for t in wanted})
        done = [r["segment"] for r in self.segments().filter("n > 0").select("segment").collect()]  # one number an append
        rows = self.spark.read.option("basePath", f"{self.path}/postings").parquet(*[f"{self.path}/postings/segment={s}" for s in done])
        return rows.filter(F.col("bucket").isin(buckets) & F.col("term").isin(wanted))

    def search(self, queries: DataFrame, k: int = TOP_K, k1: float = K1, b: float = B) -> DataFrame:
        """The ``k`` best documents of each query: ``query_id``, ``rank``, ``document_id``, ``score``.

        Ties go to the smaller id; where fewer than ``k`` documents match, the
        first others follow with score 0.
        """
        totals = self.segments().agg(F.sum("n").alias("n"), F.sum("length").alias("length")).first()
        documents = self.spark.read.parquet(*[f"{self.path}/documents/segment={r['segment']}" for r in self.segments().select("segment").collect()])
        if not totals["n"]:
            return self.spark.createDataFrame([], StructType([queries.schema["query_id"], StructField("rank", IntegerType()), documents.schema["document_id"], StructField("score", DoubleType())]))
        mean = max(totals["length"] / totals["n"], 1.0)
        asked = written(query_terms(queries, self.stopwords).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")), "asked")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id"))
        terms = [r["term"] for r in asked.select("term").distinct().collect()]  # the queries' words
        best = self._best(asked, terms, totals["n"], mean, k, k1, b, rank).select("query_id", "document_id", "score")
        best = written(best, "best")
        few = queries.select("query_id").distinct().join(best.groupBy("query_id").agg(F.count(F.lit(1)).alias("found")), "query_id", "left").filter(F.coalesce("found", F.lit(0)) < k).select("query_id")
        # Documents without a hit only fill lists: the first 2 k by id are enough.
        fill = [r[0] for r in documents.select("document_id").orderBy("document_id").limit(2 * k).collect()]
        others = F.array(*[F.lit(x) for x in fill]).cast(f"array<{documents.schema['document_id'].dataType.simpleString()}>")
        zero = few.select("query_id", F.explode(others).alias("document_id"), F.lit(0.0).alias("score")).join(best.select("query_id", "document_id"), ["query_id", "document_id"], "left_anti")
        return best.unionByName(zero).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "document_id", "score")

    def _best(self, asked: DataFrame, terms: list[str], n: int, mean: float, k: int, k1: float, b: float, rank: Column) -> DataFrame:
        """Documents with a hit, the ``k`` best of each query."""
        gain = lambda tf, length: tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * length / mean))
        rows = self.postings(terms)
        at = ["segment", "strip"]
        heads = written(rows.select("term", *at, "block", "n", F.array_max(F.transform("peaks", lambda p: gain(p["tf"], p["length"]))).alias("peak")), "heads")
        df = heads.groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = written(asked.join(df, "term").select("query_id", "term", (F.col("times") * idf).alias("weight")), "weights")
        bounds = heads.join(weights, "term").select("query_id", "term", *at, "block", (F.col("weight") * F.col("peak")).alias("bound"))
        peaks = bounds.groupBy("query_id", *at, "term").agg(F.max("bound").alias("most"))
        strips = written(peaks.groupBy("query_id", *at).agg(F.sum("most").alias("most")), "strips")

        def scored(chosen: DataFrame) -> DataFrame:
            """Scores from some blocks: of each document over all its blocks among them."""
            hits = rows.join(chosen, ["term", *at, "block"]).select("query_id", "weight", F.explode(F.arrays_zip("documents", "tfs", "lengths")).alias("p"))
            part = F.col("weight") * gain(F.col("p.tfs"), F.col("p.lengths"))
            return hits.groupBy("query_id", F.col("p.documents").alias("document_id")).agg(total(part).alias("score"))

        order = Window.partitionBy("query_id").orderBy(F.desc("most"), *at)
        first = strips.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max(1, int(FIRST_STRIPS * k))).select("query_id", *at)
        tried = heads.join(weights, "term").join(first, ["query_id", *at]).select("query_id", "term", *at, "block", "weight")
        top = written(scored(tried).withColumn("rank", rank).filter(F.col("rank") <= k), "top")
        bar = top.filter(F.col("rank") == k).select("query_id", (F.col("score") * (1 - SLACK)).alias("bar"))
        live = strips.join(bar, "query_id", "left").filter(F.col("most") >= F.coalesce("bar", F.lit(0.0))).join(first, ["query_id", *at], "left_anti")
        rest = bounds.join(live, ["query_id", *at]).join(peaks, ["query_id", *at, "term"]).withColumn("reach", F.col("bound") + live["most"] - peaks["most"])
        rest = rest.filter(F.col("reach") >= F.coalesce("bar", F.lit(0.0)) * (1 - SLACK)).select("query_id", "term", *at, "block").join(weights, ["query_id", "term"])
        both = top.select("query_id", "document_id", "score").unionByName(scored(rest))
        return both.withColumn("rank", rank).filter(F.col("rank") <= k)


def build_index(docs: DataFrame, key: str, text: str, path: str, buckets: int = BUCKETS, stopwords: Iterable[str] = STOPWORDS, strip: int = STRIP, block: int = BLOCK, overwrite: bool = False) -> Index:
    """An index of ``docs`` in a new folder, or in place of the one there."""
    index = Index(docs.sparkSession, path.rstrip("/"), buckets, tuple(stopwords))
    if index._next():
        if not overwrite:
            raise FileExistsError(f"{path} holds an index already; append to it or overwrite it")
        index._folder("").delete(True)
    return index.append(docs, key, text, strip, block)
