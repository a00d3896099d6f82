"""Data-quality rules: a list of counts over one scan, plus a key check."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.columns import number
from brindle.operators.profile import duplicate_rows


@dataclass(frozen=True)
class Check:
    """A rule: rows where ``failing`` holds break it (a null counts as unbroken)."""

    name: str
    failing: Column
    severity: str = "alta"
    detail: str = ""


def within(column: str, low: float = 0, high: float = 100) -> Check:
    x = number(column)
    return Check(f"range_{low:g}_{high:g}_{column}", (x < low) | (x > high), detail=f"{column}: {low:g} to {high:g}")


def non_negative(column: str) -> Check:
    return Check(f"non_negative_{column}", number(column) < 0, detail=f"{column}: not negative")


def not_above(name: str, small: str, large: str, severity: str = "alta") -> Check:
    return Check(name, number(small) > number(large), severity, f"{small} <= {large}")


def ratio_matches(name: str, part: str, whole: str, percent: str, tolerance: float = 0.75) -> Check:
    """``part / whole * 100`` within ``tolerance`` of ``percent``."""
    return Check(name, F.abs(F.try_divide(number(part), number(whole)) * 100 - number(percent)) > tolerance, detail=f"{percent} = {part} / {whole}")


def run_checks(df: DataFrame, checks: Sequence[Check], key: Sequence[str] = (), required: Sequence[str] = (), null_allowed: Sequence[str] | None = None, key_name: str = "unique_key") -> DataFrame:
    """One row per check: check, passed, failing_rows, severity, detail.

    Key and required-column checks come first, then the rules in order, then,
    with ``null_allowed``, null cells outside those columns.  All rules share
    one scan; the key check has one exchange on the key.
    """
    spark = df.sparkSession
    rows: list[tuple[str, int, str, str]] = []
    if key:
        rows.append((key_name, int(duplicate_rows(df, key).first()[0]), "alta", " + ".join(key)))
    if required:
        missing = sorted(set(required) - set(df.columns))
        rows.append(("required_columns", len(missing), "alta", ", ".join(missing)))
    aggs = [F.count_if(c.failing).alias(str(i)) for i, c in enumerate(checks)]
    if null_allowed is not None:
        types = dict(df.dtypes)
        value = lambda c: number(c) if types[c] in ("double", "float") else F.col(f"`{c}`")
        aggs.append(sum((F.count_if(value(c).isNull()) for c in df.columns if c not in set(null_allowed)), F.lit(0)).alias("nulls"))
    found = df.agg(*aggs).first() if aggs else ()
    rows += [(c.name, int(found[i]), c.severity, c.detail) for i, c in enumerate(checks)]
    if null_allowed is not None:
        rows.append(("controlled_missing_values", int(found[len(checks)]), "media", "nulls outside " + ", ".join(sorted(null_allowed))))
    return spark.createDataFrame([(i, n, bad == 0, bad, s, d) for i, (n, bad, s, d) in enumerate(rows)], "position int, check string, passed boolean, failing_rows long, severity string, detail string").orderBy("position").drop("position")
