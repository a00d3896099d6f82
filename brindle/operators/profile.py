"""Descriptive statistics of tables, each from one pass or one exchange."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.columns import number, pearson, round_even, unpivot

#: Ranks of approximate quantiles are right to one part in so many.
RANK_ACCURACY = 10_000
#: Bins that a stretch of values is cut into, and rows of a bin whose values are fetched.
BINS, FETCHED = 4_096, 4_096


def column_quality(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: type, nulls (NaN counts as null), share of nulls, distinct values without nulls.

    One scan and one exchange at any number of columns: a row gives a pair of
    column and value each, and a task sends each of its pairs once.
    """
    names = list(columns or df.columns)
    types = dict(df.dtypes)
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _as_text(c, types[c]).alias("v")) for i, c in enumerate(names)])).alias("p")
    values = df.select(pairs).groupBy("p.i", "p.v").agg(F.count(F.lit(1)).alias("n"))
    counted = values.groupBy("i").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("null_count"), F.count("v").alias("unique_count"))
    frame = df.sparkSession.createDataFrame([(i, c, types[c]) for i, c in enumerate(names)], "i int, variable string, dtype string")
    out = frame.join(F.broadcast(counted), "i", "left")  # a row for each column
    nulls = F.coalesce("null_count", F.lit(0))
    return out.select("variable", "dtype", nulls.alias("null_count"), F.try_divide(nulls, F.col("n")).alias("null_rate"), F.coalesce("unique_count", F.lit(0)).alias("unique_count"))


def _as_text(column: str, kind: str) -> Column:
    """A text that is the same for equal values only; null for nulls and NaN."""
    x = F.col(f"`{column}`")
    if kind == "double":
        return (number(column) + F.lit(0.0)).cast("string")  # -0.0 is 0.0
    if kind == "float":
        return F.when(~F.isnan(x), x + F.lit(0.0).cast("float")).cast("string")
    if kind == "binary":
        return F.hex(x)
    return F.when(x.isNotNull(), F.to_json(F.struct(x))) if kind.startswith(("array", "struct", "map")) else x.cast("string")


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation, at any number of rows and distinct values.

    The values of a rank are selected by ranges: a first pass gives stretches that
    are about to hold the ranks (approximate quantiles); the next one counts the
    rows of each of their bins and of all between, with the bin's least and
    largest value; then only the bins that hold a rank are cut further.  Once
    they are small their values are fetched.  A rank outside its stretch is in a
    bin like any other.  Tasks keep counts, never values; the driver gets at most
    ``BINS`` rows a stretch.
    """
    x = [number(c) for c in columns]
    asked = sorted({min(max(q + d / RANK_ACCURACY, 0.0), 1.0) for q in shares for d in (-2, 2)})
    first = df.agg(*[F.count(x[i]).alias(f"n{i}") for i in range(len(x))], *[F.percentile_approx(x[i], asked, RANK_ACCURACY).alias(f"q{i}") for i in range(len(x))]).first()
    size = [first[f"n{i}"] for i in range(len(x))]
    value: dict[tuple[int, int], float] = {}
    wanted = {i: sorted({f(q * (n - 1)) for q in shares for f in (math.floor, math.ceil)}) for i, n in enumerate(size) if n}
    near = {i: dict(zip(asked, first[f"q{i}"], strict=True)) for i in wanted}
    spans = {i: _apart([(near[i][min(max(q - 2 / RANK_ACCURACY, 0.0), 1.0)], near[i][min(max(q + 2 / RANK_ACCURACY, 0.0), 1.0)]) for q in shares]) for i in wanted}
    before: dict[tuple[int, int], int] = {}  # rows under a stretch, by column and slot; at first all rows are in slots
    whole, fetch = True, False
    while wanted:
        counted = _binned(df, x, spans, whole, fetch)
        again: dict[int, list[tuple[float, float]]] = {}
        start: dict[tuple[int, float], int] = {}
        most = 0
        for i, ranks in wanted.items():
            upto, slot, left = 0, None, []
            rows = counted[i]
            for at, n, low, high in rows:
                if not whole and at != slot:
                    upto = before[i, at]
                slot = at
                for rank in ranks:
                    if upto <= rank < upto + n:
                        if low == high:
                            value[i, rank] = low
                        else:
                            again.setdefault(i, []).append((low, high))
                            start[i, low] = upto
                            left.append(rank)
                            most = max(most, n)
                upto += n
            wanted[i] = left
        wanted = {i: ranks for i, ranks in wanted.items() if ranks}
        spans = {i: sorted(set(again[i])) for i in wanted}
        before = {(i, 2 * j + 1): start[i, low] for i in spans for j, (low, _) in enumerate(spans[i])}
        whole, fetch = False, most <= FETCHED
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        out[c] = [None] * len(shares)
        for j, q in enumerate(shares if size[i] else ()):
            at = q * (size[i] - 1)
            low, high = value[i, math.floor(at)], value[i, math.ceil(at)]
            out[c][j] = low if low == high else low + (high - low) * (at - math.floor(at))
    return out


def _apart(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Stretches in order; those that meet are one."""
    out: list[tuple[float, float]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _binned(df: DataFrame, x: Sequence[Column], spans: dict[int, list[tuple[float, float]]], whole: bool, fetch: bool) -> dict[int, list[tuple[int, int, float, float]]]:
    """Slot, rows, least and largest value of each bin of each column, in order of values.

    Stretches have odd slots; with ``whole`` what lies between is one bin each, in
    even slots.  With ``fetch`` a bin is a value.
    """
    cells = []
    for i, some in spans.items():
        slot, bin_ = F.when(F.lit(False), 0), F.lit(0.0)
        for j, (low, high) in enumerate(some):
            a, z = F.lit(float(low)), F.lit(float(high))
            slot = slot.when(x[i] < a, F.lit(2 * j) if whole else None).when(x[i] <= z, 2 * j + 1)
            inside = F.floor(F.try_divide(x[i] / 2 - a / 2, z / 2 - a / 2) * BINS).cast("double")
            inside = F.when(x[i] == a, 0.0).when(x[i] == z, float(BINS)).otherwise(F.least(F.greatest(F.coalesce(F.when(~F.isnan(inside), inside), F.lit(0.0)), F.lit(0.0)), F.lit(BINS - 1.0)) if math.isfinite(high - low) else F.lit(1.0))
            bin_ = F.when((x[i] >= a) & (x[i] <= z), x[i] if fetch else inside).otherwise(bin_)
        slot = slot.otherwise(F.lit(2 * len(some)) if whole else None)
        slot = F.when(x[i].isNotNull(), slot)
        cells.append(F.when(slot.isNotNull(), F.struct(F.lit(i).alias("i"), slot.alias("slot"), bin_.alias("bin"), x[i].alias("v"))))
    values = df.select(F.explode(F.array(*cells)).alias("r")).filter("r IS NOT NULL").select("r.*")
    rows = values.groupBy("i", "slot", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
    out: dict[int, list[tuple[int, int, float, float]]] = {i: [] for i in spans}
    for r in sorted(rows, key=lambda r: (r["i"], r["low"])):
        out[r["i"]].append((r["slot"], r["n"], r["low"], r["high"]))
    return out


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std (n-1), min, exact quartiles with linear interpolation, max."""
    aggs = []
    for i, c in enumerate(columns):
        x = number(c)
        aggs += [F.count(x).alias(f"{i}_count"), F.avg(x).alias(f"{i}_mean"), F.stddev_samp(x).alias(f"{i}_std"), F.min(x).alias(f"{i}_min"), F.max(x).alias(f"{i}_max")]
    quartiles = quantiles(df, columns, (0.25, 0.5, 0.75))
    row = df.agg(*aggs).withColumns({f"{i}_q{p}": F.lit(quartiles[c][j]).cast("double") for i, c in enumerate(columns) for j, p in enumerate((25, 50, 75))})
    return unpivot(row, columns, "variable", ["count", "mean", "std", "min", "q25", "q50", "q75", "max"])


def iqr_outliers(df: DataFrame, columns: Sequence[str], reach: float = 1.5) -> DataFrame:
    """Values strictly outside ``[q1 - reach * iqr, q3 + reach * iqr]``; rates are of all rows.

    Quartiles come first, so that the counting pass has constants in its filter
    and no join.
    """
    quartiles = quantiles(df, columns, (0.25, 0.75))
    aggs, bounds = [], []
    for i, c in enumerate(columns):
        q1, q3 = quartiles[c]
        low, high = (None, None) if q1 is None else (q1 - reach * (q3 - q1), q3 + reach * (q3 - q1))
        bounds.append((q1, q3, None if q1 is None else q3 - q1, low, high))
        x = number(c)
        aggs.append(F.count_if((x < F.lit(low).cast("double")) | (x > F.lit(high).cast("double"))).alias(f"{i}_outlier_count"))
    row = df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    extra = {}
    for i, b in enumerate(bounds):
        extra |= {f"{i}_{name}": F.lit(v).cast("double") for name, v in zip(("q1", "q3", "iqr", "lower_bound", "upper_bound"), b, strict=True)}
        extra[f"{i}_outlier_rate"] = F.try_divide(F.col(f"{i}_outlier_count"), F.col("n"))
    return unpivot(row.withColumns(extra), columns, "variable", ["q1", "q3", "iqr", "lower_bound", "upper_bound", "outlier_count", "outlier_rate"])


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair once, over rows where both are present; one pass."""
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "variable_a string, variable_b string, correlation double")
    row = df.agg(*[pearson(number(a), number(b)).alias(str(i)) for i, (a, b) in enumerate(pairs)])
    structs = [F.struct(F.lit(a).alias("variable_a"), F.lit(b).alias("variable_b"), F.col(str(i)).alias("correlation")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both triangles and the diagonal in long form."""
    pairs = correlations(df, columns)
    same = df.agg(*[F.when(F.var_samp(number(c)) > 0, 1.0).alias(str(i)) for i, c in enumerate(columns)])
    diagonal = same.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable_a"), F.lit(c).alias("variable_b"), F.col(str(i)).alias("correlation")) for i, c in enumerate(columns)])).alias("r")).select("r.*")
    return pairs.union(pairs.select("variable_b", "variable_a", "correlation")).union(diagonal)


def strong_correlations(pairs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Pairs with an absolute correlation of ``threshold`` or more, strongest first; may be empty."""
    return pairs.filter(F.abs("correlation") >= threshold).orderBy(F.abs("correlation").desc(), "variable_a", "variable_b")


def group_means(df: DataFrame, key: str, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """Rows and rounded means per key, by key; rows without the key are left out."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[round_even(F.avg(number(c)), digits).alias(c) for c in columns]).orderBy(key)


def group_means_many(df: DataFrame, keys: Sequence[str], columns: Sequence[str], digits: int = 2) -> DataFrame:
    """Means by each of several keys in one scan (grouping sets): ``grouping``, ``key``, means."""
    sets = [[F.col(k)] for k in keys]
    out = df.groupingSets(sets, *[F.col(k) for k in keys]).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), *[F.avg(number(c)).alias(f"m{i}") for i, c in enumerate(columns)])
    full = (1 << len(keys)) - 1
    which, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, k in enumerate(keys):
        here = F.col("g") == (full & ~(1 << (len(keys) - 1 - i)))
        which, value = F.when(here, k).otherwise(which), F.when(here, F.col(k).cast("string")).otherwise(value)
    return out.select(which.alias("grouping"), value.alias("key"), "n", *[round_even(F.col(f"m{i}"), digits).alias(c) for i, c in enumerate(columns)]).filter(F.col("key").isNotNull())


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts of non-null values, most frequent first, ties by value."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Counts in equal-width bins between min and max; the last bin is closed, empty bins are there.

    With a single value the bins span half a unit on either side of it.
    """
    x = number(column)
    low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    if low == high:
        low, high = low - 0.5, high + 0.5
    edges = [low + (high - low) * i / bins for i in range(bins)] + [high]
    place = F.lit(0)
    for i in range(1, bins):
        place = F.when(x >= edges[i], i).otherwise(place)
    counted = df.filter(x.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.createDataFrame([(i, float(edges[i]), float(edges[i + 1])) for i in range(bins)], "bin int, low double, high double")
    return frame.join(counted, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n")).orderBy("bin")


def duplicate_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """How many rows repeat a key beyond its first row (nulls are equal); one row."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def dataset_summary(df: DataFrame, label: str, distinct: dict[str, str], means: dict[str, str]) -> DataFrame:
    """One row: label, records, columns, null cells, distinct counts and means under given names."""
    types = dict(df.dtypes)
    value = lambda c: number(c) if types[c] in ("double", "float") else F.col(f"`{c}`")
    nulls = sum((F.count_if(value(c).isNull()) for c in df.columns), F.lit(0))
    return df.agg(F.lit(label).alias("dataset"), F.count(F.lit(1)).alias("records"), F.lit(len(df.columns)).alias("columns"), nulls.alias("null_cells"), *[F.countDistinct(value(c)).alias(n) for n, c in distinct.items()], *[F.avg(number(c)).alias(n) for n, c in means.items()])
