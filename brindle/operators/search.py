"""BM25 keyword search: postings, statistics, top results of many queries in one plan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from brindle.functions.columns import tokens

K1, B, TOP_K = 1.5, 0.75, 10
#: Spanish words that are not indexed (fixed values).
STOPWORDS = ("a", "al", "con", "de", "del", "e", "el", "en", "la", "las", "los", "o", "para", "por", "que", "un", "una", "y")


def documents_lengths(docs: DataFrame, key: str, text: str, stopwords: Iterable[str] = STOPWORDS) -> DataFrame:
    """``key``, ``terms`` (array) and ``length`` of each document; one without tokens has length 0."""
    return docs.select(F.col(key).alias("document_id"), tokens(F.col(text), stopwords).alias("terms")).withColumn("length", F.size("terms"))


def term_frequencies(lengths: DataFrame) -> DataFrame:
    """``document_id``, ``term``, ``tf``, ``length``."""
    return lengths.select("document_id", "length", F.explode("terms").alias("term")).groupBy("document_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def inverse_frequencies(postings: DataFrame, n_documents: int) -> DataFrame:
    """``term``, ``df``, ``idf`` = ln(1 + (N - df + 0.5) / (df + 0.5))."""
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.log(1 + (F.lit(n_documents) - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def query_terms(queries: DataFrame, stopwords: Iterable[str] = STOPWORDS) -> DataFrame:
    """One row per token of a query: a term asked for twice counts twice."""
    return queries.select("query_id", F.explode(tokens(F.col("query"), stopwords)).alias("term"))


def total(part: Column) -> Column:
    """Sum of the parts of a score, the same in any order of its rows.

    Sums of doubles differ in the last digit by the order in which a shuffle brings
    three parts or more; documents of equal parts would then not tie.
    """
    return F.sum(part.cast("decimal(38, 28)")).cast("double")


def bm25_search(docs: DataFrame, queries: DataFrame, key: str, text: str, k: int = TOP_K, k1: float = K1, b: float = B, stopwords: Iterable[str] = STOPWORDS) -> DataFrame:
    """The ``k`` best documents of each query: ``query_id``, ``rank``, ``document_id``, ``score``.

    Only postings of asked terms are shuffled.  Ties go to the smaller id;
    where fewer than ``k`` documents match, the first others follow with score 0.
    """
    lengths = documents_lengths(docs, key, text, stopwords)
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg")).first()
    if not stats["n"]:
        return lengths.sparkSession.createDataFrame([], StructType([queries.schema["query_id"], StructField("rank", IntegerType()), lengths.schema["document_id"], StructField("score", DoubleType())]))
    asked = query_terms(queries, stopwords).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    wanted = [r["term"] for r in asked.select("term").distinct().collect()]  # the queries' words
    hits = lengths.select("document_id", "length", F.explode(F.filter("terms", lambda t: t.isin(wanted) if wanted else F.lit(False))).alias("term"))
    postings = hits.groupBy("document_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))
    idf = inverse_frequencies(postings, stats["n"])
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("length") / F.lit(max(stats["avg"], 1.0)))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
    scored = postings.join(idf, "term").join(asked, "term").groupBy("query_id", "document_id").agg(total(part).alias("score"))
    # Documents without a hit can only fill a query's list: its first k by id are enough.
    fill = lengths.select("document_id").orderBy("document_id").limit(2 * k + 1)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id"))
    best = scored.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")
    zero = queries.select("query_id").distinct().crossJoin(fill).select("query_id", "document_id", F.lit(0.0).alias("score")).join(best.select("query_id", "document_id"), ["query_id", "document_id"], "left_anti")
    both = best.select("query_id", "document_id", "score").union(zero)
    return both.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "document_id", "score")
