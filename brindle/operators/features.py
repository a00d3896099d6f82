"""Feature selection table and standardising with mean imputation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.columns import number, unpivot
from brindle.operators.profile import correlations


def feature_matrix(df: DataFrame, decisions: dict[str, tuple[str, str]]) -> DataFrame:
    """Decision and reason per variable with variance (n-1), missing rate and largest absolute correlation."""
    names = list(decisions)
    row = df.agg(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(names) for x in (F.var_samp(number(c)).alias(f"{i}_variance"), F.count(number(c)).alias(f"{i}_present"))])
    row = row.withColumns({f"{i}_missing_rate": F.try_divide(F.col("n") - F.col(f"{i}_present"), F.col("n")) for i in range(len(names))})
    row = row.withColumns({f"{i}_{f}": F.lit(decisions[c][j]) for i, c in enumerate(names) for j, f in enumerate(("decision", "reason"))})
    stats = unpivot(row, names, "variable", ["decision", "reason", "variance", "missing_rate"])
    pairs = correlations(df, names)
    both = pairs.select(F.col("variable_a").alias("variable"), "correlation").union(pairs.select("variable_b", "correlation"))
    return stats.join(both.groupBy("variable").agg(F.max(F.abs("correlation")).alias("max_abs_correlation")), "variable", "left")


def selected(decisions: dict[str, tuple[str, str]]) -> list[str]:
    """Included variables in their order."""
    return [c for c, (decision, _) in decisions.items() if decision == "include"]


@dataclass(frozen=True)
class Scaler:
    """Means and deviations by which columns are imputed and scaled."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]

    def params(self, spark) -> DataFrame:
        return spark.createDataFrame(list(zip(self.columns, self.means, self.stds, strict=True)), "feature string, mean double, std double")

    def apply(self, df: DataFrame) -> DataFrame:
        """Impute by the mean and scale, in place of the columns; map-only."""
        return df.withColumns({c: (F.coalesce(number(c), F.lit(m)) - F.lit(m)) / F.lit(s) for c, m, s in zip(self.columns, self.means, self.stds, strict=True)})


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> Scaler:
    """One pass: mean of present values; deviation (n) of the imputed column, 0 counts as 1.

    Imputed rows add nothing to the squares, so the deviation is that of the
    present values shrunk by their share.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        x = number(c)
        aggs += [F.avg(x).alias(f"m{i}"), (F.var_pop(x) * F.count(x)).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    means = tuple(float(row[f"m{i}"] or 0.0) for i in range(len(columns)))
    stds = tuple((max(float(row[f"s{i}"] or 0.0), 0.0) / row["n"]) ** 0.5 or 1.0 if row["n"] else 1.0 for i in range(len(columns)))
    return Scaler(tuple(columns), means, stds)
