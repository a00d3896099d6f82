"""Choice of a clustering by weighted ranks of its quality metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weight of each metric's rank and whether larger is better (fixed values).
WEIGHTS = {"silhouette": (0.50, True), "davies_bouldin": (0.25, False), "calinski_harabasz": (0.20, True), "balance": (0.05, False)}
MIN_SHARE = 0.05


def rank_models(metrics: DataFrame) -> DataFrame:
    """Ranks (smallest of ties, missing values unranked) over all rows, and their weighted sum.

    ``balance`` is the largest cluster over the smallest.  ``viable`` rows have a smallest cluster of at least 5 % of the samples.
    """
    out = metrics.withColumn("balance", F.try_divide(F.col("max_cluster_size").cast("double"), F.col("min_cluster_size")))
    for name, (_, larger) in WEIGHTS.items():
        x = F.when(~F.isnan(name), F.col(name))
        order = x.desc_nulls_last() if larger else x.asc_nulls_last()
        # The grid of models is a handful of rows: one window over them all.
        out = out.withColumn(f"{name}_rank", F.when(x.isNotNull(), F.rank().over(Window.orderBy(order))))
    combined = sum((F.lit(w) * F.col(f"{name}_rank") for name, (w, _) in WEIGHTS.items()), F.lit(0.0))
    viable = F.coalesce(F.try_divide(F.col("min_cluster_size"), F.nullif(F.col("n_samples"), F.lit(0))) >= MIN_SHARE, F.lit(False))
    return out.withColumn("combined_rank", combined).withColumn("viable", viable)


def choose_model(metrics: DataFrame) -> DataFrame:
    """The best row among viable ones, or among all if none is viable."""
    ranked = rank_models(metrics)
    some = ranked.withColumn("some", F.max("viable").over(Window.partitionBy()))
    return some.filter(F.col("viable") | ~F.col("some")).drop("some", "viable").orderBy(F.col("combined_rank").asc_nulls_last(), "silhouette_rank", "k", "representation").limit(1)
