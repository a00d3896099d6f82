"""Column functions: rounding, guards, buckets, text."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

#: Letters with marks and what they fold to (fixed values: Latin letters that decompose into a letter and a mark).
MARKED = "áàâäãåāăąéèêëēėęěíìîïīįóòôöõōőúùûüūůűýÿñńňçćčďťšśžźżřŕľĺğ"
FOLDED = "aaaaaaaaaeeeeeeeeiiiiiiooooooouuuuuuuyynnncccdtsszzzrrllg"
#: Namespace of names that are DNS names (fixed by the UUID standard).
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def nan_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Turn NaN into NULL in floating columns: from here on a missing value is NULL only."""
    wanted = set(df.columns if columns is None else columns)
    floating = {f.name for f in df.schema if isinstance(f.dataType, FloatType | DoubleType)} & wanted
    return df.select(*[F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) if c in floating else F.col(f"`{c}`") for c in df.columns])


def number(column: str) -> Column:
    """A numeric column as double with NaN as NULL."""
    x = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(x), x)


def round_even(x: Column, digits: int = 2) -> Column:
    """Round half to even on the binary value, as array libraries do."""
    return F.rint(x * F.lit(10.0**digits)) / F.lit(10.0**digits)


def pearson(a: Column, b: Column) -> Column:
    """Correlation over rows where both are present; NULL where either is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(x, lit(low)), lit(high))


def bucket(x: Column, thresholds: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the first threshold that ``x`` lies below, else the last label (a missing value too)."""
    out = F.lit(labels[-1])
    for limit, label in reversed(list(zip(thresholds, labels, strict=False))):
        out = F.when(x < limit, label).otherwise(out)
    return out


def zero_bucket(x: Column, limit: float, none: str, some: str, many: str) -> Column:
    """``none`` at 0, ``some`` below ``limit``, else ``many``."""
    return F.when(x == 0, none).when(x < limit, some).otherwise(many)


def first_match(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """Label of the first rule that holds."""
    out = F.lit(default)
    for condition, label in reversed(list(rules)):
        out = F.when(condition, label).otherwise(out)
    return out


def period_order(period: Column) -> Column:
    """Position in time of ``YYYY-T``: two terms a year."""
    parts = F.split(period, "-")
    return parts[0].cast("int") * 2 + F.when(parts[1].cast("int") == 1, 1).otherwise(2)


def fold(text: Column) -> Column:
    """Lower case without marks, for the letters in :data:`MARKED`; combining marks are dropped."""
    return F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[̀-ͯ]", ""), MARKED, FOLDED)


def tokens(text: Column, stopwords: Iterable[str] = ()) -> Column:
    """Folded alphanumeric tokens of two letters or more that are no stopwords, in order."""
    found = F.regexp_extract_all(fold(text), F.lit("[a-z0-9]+"), F.lit(0))
    stop = sorted(stopwords)
    keep = F.filter(found, lambda t: F.length(t) > 1)
    return F.filter(keep, lambda t: ~t.isin(stop)) if stop else keep


def uuid5(name: Column, namespace: str = DNS_NAMESPACE) -> Column:
    """Name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def unpivot(row: DataFrame, names: Sequence[str], label: str, fields: Sequence[str]) -> DataFrame:
    """One row per name from a single wide row with columns ``<name position>_<field>``."""
    structs = [F.struct(F.lit(n).alias(label), *[F.col(f"{i}_{f}").alias(f) for f in fields]) for i, n in enumerate(names)]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")
