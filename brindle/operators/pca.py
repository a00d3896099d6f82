"""Principal components of standardised columns from one pass of orthogonal factors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Components:
    """Loadings by row, signs fixed so that each one's largest loading is positive."""

    columns: tuple[str, ...]
    loadings: np.ndarray
    variances: np.ndarray
    means: np.ndarray

    def explained(self, spark: SparkSession) -> DataFrame:
        """component, explained variance, its ratio, and the running sum of ratios."""
        total = float(self.variances.sum()) or 1.0
        rows = [(i + 1, f"PC{i + 1}", float(v), float(v) / total) for i, v in enumerate(self.variances)]
        df = spark.createDataFrame(rows, "position int, component string, explained_variance double, explained_ratio double")
        upto = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("cumulative_ratio", F.sum("explained_ratio").over(upto))

    def needed(self, share: float) -> int:
        """Components until the running ratio reaches ``share``; all if it never does."""
        total = float(self.variances.sum()) or 1.0
        reached = np.flatnonzero(np.cumsum(self.variances) / total >= share)
        return int(reached[0]) + 1 if len(reached) else len(self.variances)

    def recommended(self, share: float = 0.90, high: float = 0.95) -> int:
        """``share`` if that is at most 60 % of the columns (3 at least), else ``high``."""
        n = self.needed(share)
        return n if n <= max(3, math.ceil(0.6 * len(self.columns))) else self.needed(high)

    def scores(self, df: DataFrame, n: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
        """Projected rows, ``keep`` columns first; map-only, inside code generation."""
        out = []
        for i, loading in enumerate(self.loadings[: n or len(self.loadings)]):
            terms = [(F.col(f"`{c}`") - F.lit(float(m))) * F.lit(float(w)) for c, m, w in zip(self.columns, self.means, loading, strict=True)]
            out.append(sum(terms[1:], terms[0]).alias(f"PC{i + 1}"))
        return df.select(*[F.col(f"`{k}`") for k in keep], *out)

    def top_loadings(self, spark: SparkSession, n: int = 5) -> DataFrame:
        """The ``n`` largest loadings by absolute value of each component, as text too."""
        rows = [(i + 1, f"PC{i + 1}", c, float(w)) for i, loading in enumerate(self.loadings) for c, w in zip(self.columns, loading, strict=True)]
        df = spark.createDataFrame(rows, "position int, component string, variable string, loading double")
        rank = F.row_number().over(Window.partitionBy("position").orderBy(F.abs("loading").desc(), "variable"))
        return df.withColumn("rank", rank).filter(F.col("rank") <= n).withColumn("text", F.format_string("%s (%+.2f)", "variable", "loading"))


def covariance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sample covariances of all pairs (each once) in one pass, long form."""
    pairs = list(combinations_with_replacement(columns, 2))
    row = df.agg(*[F.covar_samp(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")).alias(str(i)) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("variable_a"), F.lit(b).alias("variable_b"), F.col(str(i)).alias("covariance")) for i, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")


#: Rows factored at once, and factors that a task of each level of the tree puts together at most (a share of all tasks).
ROWS, LEVELS = 4_096, (1_024, 32, 1)


def _factor(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.concatenate([r, rows]), mode="r")


def triangle(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray]:
    """Rows, and the triangular factor of the rows with a 1 before them: a tall matrix by a tree of small factors.

    Each task factors its rows piece by piece; what meets in the exchanges are
    (p + 1) x (p + 1) triangles.  Rows with a null are left out.
    """
    p = len(columns) + 1
    rows = df.select(F.array(F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in columns]).alias("x")).filter(~F.exists("x", lambda v: v.isNull()))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, r = 0, np.zeros((0, p))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            n += len(x)
            for start in range(0, len(x), ROWS):
                r = _factor(r, x[start : start + ROWS])
        yield pa.RecordBatch.from_pydict({"node": pa.array([TaskContext.get().partitionId()], pa.int64()), "n": pa.array([n], pa.int64()), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    def joined(parts: pd.DataFrame) -> pd.DataFrame:
        r = np.zeros((0, p))
        for part in parts.sort_values("node")["r"]:
            r = _factor(r, np.array(part).reshape(-1, p))
        return pd.DataFrame({"node": [parts["node"].min()], "n": [parts["n"].sum()], "r": [r.ravel().tolist()]})

    schema = "node long, n long, r array<double>"
    tree = rows.mapInArrow(leaves, schema)
    for level in LEVELS:
        tree = tree.groupBy(F.pmod("node", F.lit(level))).applyInPandas(joined, schema)
    top = tree.first()
    r = np.zeros((p, p))
    if top is not None:
        got = np.array(top["r"], float).reshape(-1, p)
        r[: len(got)] = got
    return (top["n"] if top is not None else 0), r


def fit_pca(df: DataFrame, columns: Sequence[str]) -> Components:
    """Singular vectors of the centred rows, from their triangular factor; the driver gets p * p numbers.

    Nothing is squared, so that a component as small as 1e-12 of the largest one
    keeps its digits, which a covariance matrix has lost.
    """
    n, r = triangle(df, columns)
    means = r[0, 1:] / r[0, 0] if n else np.zeros(len(columns))
    _, sizes, loadings = np.linalg.svd(r[1:, 1:])  # below the row of ones is the factor of the centred rows
    size = np.abs(loadings)
    largest = (size >= size.max(axis=1, keepdims=True) - 1e-9).argmax(axis=1)  # the first of equals
    loadings = loadings * np.sign(loadings[np.arange(len(loadings)), largest])[:, None]
    return Components(tuple(columns), loadings, sizes**2 / max(n - 1, 1), means)
