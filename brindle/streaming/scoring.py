"""Scoring of arriving rows with a frozen scaler and frozen centres (an extension; batch results are the same)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.operators.features import Scaler
from brindle.operators.kmeans import assign


def score_rows(df: DataFrame, scaler: Scaler, centres: np.ndarray) -> DataFrame:
    """Cluster, distance and membership of each row; works on streams and tables alike (map-only)."""
    scaled = scaler.apply(df.withColumns({f"__raw_{c}": F.col(f"`{c}`") for c in scaler.columns}))
    made = scaled.withColumn("x", F.array(*[F.col(f"`{c}`") for c in scaler.columns])).drop(*scaler.columns)
    raw = made.select(*[F.col(f"__raw_{c}").alias(c) if c in scaler.columns else F.col(f"`{c}`") for c in df.columns], "x")
    return assign(raw, centres).drop("x")


def score_stream(stream: DataFrame, scaler: Scaler, centres: np.ndarray, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append scored rows to a Parquet table, exactly once; ``once`` takes what is there and ends."""
    writer = score_rows(stream, scaler, centres).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
