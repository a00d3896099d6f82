"""What clusters look like: means, distinctive variables, profile labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.columns import first_match, number


def profile_label(attendance: Column, grade: Column, lag: Column, failed: Column) -> Column:
    """Suggested profile of a cluster; the first rule that holds (fixed values)."""
    rules = [
        ((attendance < 60) & (grade >= 80), "Atipico / buen promedio con baja asistencia"),
        ((grade >= 88) & (lag <= 0.5) & (failed <= 0.5), "Alto desempeno / avance estable"),
        ((grade < 62) | (lag >= 4), "Critico / rezago alto"),
        ((grade < 76) | (failed >= 2), "Riesgo academico moderado"),
    ]
    return first_match(rules, "Regular / seguimiento preventivo")


def differences(df: DataFrame, columns: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Long form: cluster, variable, cluster mean less overall mean, in raw units; one exchange of k rows."""
    per = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("records"), *[F.avg(number(c)).alias(f"m{i}") for i, c in enumerate(columns)])
    whole = df.agg(*[F.avg(number(c)).alias(f"g{i}") for i, c in enumerate(columns)]).first()
    structs = [F.struct(F.lit(c).alias("variable"), F.col(f"m{i}").alias("mean"), (F.col(f"m{i}") - F.lit(whole[i]).cast("double")).alias("difference")) for i, c in enumerate(columns)]
    return per.select(cluster, "records", F.explode(F.array(*structs)).alias("r")).select(cluster, "records", "r.*")


def top_differences(df: DataFrame, columns: Sequence[str], n: int = 5, cluster: str = "cluster") -> DataFrame:
    """The ``n`` largest differences of each cluster, ties by name, joined as ``name (+0.00)``."""
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.abs("difference").desc_nulls_last(), "variable"))
    top = differences(df, columns, cluster).withColumn("rank", rank).filter(F.col("rank") <= n)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "variable", "difference"))), lambda r: F.format_string("%s (%+.2f)", r["variable"], r["difference"]))
    return top.groupBy(cluster).agg(F.max("records").alias("records"), F.array_join(listed, ", ").alias("distinctive"))


def describe_clusters(df: DataFrame, columns: Sequence[str], means: dict[str, str], label: Column | None = None, n: int = 5, cluster: str = "cluster") -> DataFrame:
    """Size, named means, distinctive variables and a label over the means, by cluster."""
    per = df.groupBy(cluster).agg(*[F.avg(number(c)).alias(name) for name, c in means.items()])
    out = top_differences(df, columns, n, cluster).join(per, cluster)
    out = out.select(cluster, "records", *means, "distinctive", *([label.alias("profile")] if label is not None else []))
    return out.orderBy(cluster)
