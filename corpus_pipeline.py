"""Corpus pipeline: toxicity, near-duplicates, repeated passages, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before kept; all but the last return the columns of ``documents``.

In every stage a null text is an empty one, a null doc_id is kept, texts of any
length are worked on whole, rows repeated whole give repeated results (but for
near-duplicates, where one of them stays), an empty table gives an empty one,
and further columns of any name are carried (packing leaves them out).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm._shared import cut, table
from brindle.llm.minhash_dedup import near_duplicates
from brindle.llm.packing import default_vocabulary, pack
from brindle.llm.secrets import scan_secrets
from brindle.llm.suffix_dedup import suffix_dedup
from brindle.llm.toxicity import toxicity_scores


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The columns that stages read or write; all others are carried.
OWN = ("doc_id", "text", "n_chars")


def _carrying(stage: Stage) -> Stage:
    """The stage with all other columns under names that cannot clash with its own."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inner = {c: c if c in OWN else f"__carried_{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()]), sf_dir)
        return out.select(*[F.col(n).alias(c) for c, n in inner.items()])

    return run


@_carrying
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that score as toxic."""
    rest = tuple(c for c in docs.columns if c != "doc_id")
    return toxicity_scores(docs, table(spark, sf_dir, "labels"), keep=rest).filter("predicted = 0").select(*docs.columns)


@_carrying
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates (the smallest doc_id)."""
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    rows = near_duplicates(docs).groupBy(F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).alias("key")).agg(F.count_if("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    rows = cut(rows.filter("kept > 0"), "kept")
    out = docs.withColumn("__key", key).join(rows.filter("kept = n").select(F.col("key").alias("__key")), "__key", "left_semi")
    if rows.filter("kept < n").limit(1).count():  # rows that are repeated whole: one of them stays
        out = out.union(docs.withColumn("__key", key).join(rows.filter("kept < n").select(F.col("key").alias("__key")), "__key", "left_semi").dropDuplicates(["__key"]))
    return out.drop("__key")


@_carrying
def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated passages of 400 bytes or of over 50 words out of the texts.

    Every copy of a passage goes, the first too: what is left holds none.
    Characters cut in two go with it.
    """
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = suffix_dedup(docs, keep=rest, with_text=True, cut_passages=True)
    return _rewritten(out.withColumn("text", F.col("kept")), docs)


@_carrying
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put each secret's kind in brackets in its place."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = scan_secrets(docs, keep=rest, redact=True)
    return _rewritten(out.withColumn("text", F.col("clean")), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return pack(docs, default_vocabulary())


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("suffix_array", suffix_array), ("secrets", secrets), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def _rewritten(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with ``n_chars`` counted anew."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)

