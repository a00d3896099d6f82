"""Retrieval quality of ranked lists with binary relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Per query: total_relevant, precision, recall, mrr, ndcg at ``k``.

    ``ranked`` has ``query_id, rank, document_id``; ``relevant`` has
    ``query_id, document_id``.  Precision divides by ``k`` even for shorter
    lists; recall by the relevant documents, 1 at least; the ideal gain is of
    min(relevant, k) documents, and without any the nDCG is 0.
    """
    wanted = relevant.select("query_id", "document_id").distinct()
    total = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_relevant"))
    flagged = ranked.filter(F.col("rank") <= k).join(wanted.withColumn("hit", F.lit(1)), ["query_id", "document_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    per = flagged.groupBy("query_id").agg(
        F.sum("hit").alias("hits"),
        F.coalesce(F.try_divide(F.lit(1.0), F.min(F.when(F.col("hit") == 1, F.col("rank")))), F.lit(0.0)).alias("mrr"),
        F.sum(F.col("hit") / F.log2(F.col("rank") + 1)).alias("gain"),
    )
    joined = per.join(total, "query_id", "left").withColumn("total_relevant", F.coalesce("total_relevant", F.lit(0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("total_relevant"), F.lit(k)).cast("int"), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return joined.select("query_id", "total_relevant", (F.col("hits") / k).alias("precision"), (F.col("hits") / F.greatest("total_relevant", F.lit(1))).alias("recall"), "mrr", F.when(F.col("total_relevant") > 0, F.col("gain") / ideal).otherwise(0.0).alias("ndcg"))


def mean_metrics(per_query: DataFrame) -> DataFrame:
    return per_query.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "mrr", "ndcg")])


def sample_results(ranked: DataFrame, relevant: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` results of each query with their relevance."""
    flag = relevant.select("query_id", "document_id").distinct().withColumn("is_relevant", F.lit(True))
    return ranked.filter(F.col("rank") <= n).join(flag, ["query_id", "document_id"], "left").withColumn("is_relevant", F.coalesce("is_relevant", F.lit(False)))
