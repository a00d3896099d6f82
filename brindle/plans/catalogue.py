"""All queries of the library with the DuckDB SQL that gives the same rows.

Doubles are rounded on both sides, as sums depend on the order of rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import columns as fn
from brindle.operators import features, ir_eval, kmeans, metrics, pca, profile, profiles, search, search_index, selection, validate
from brindle.operators.synth import NAME, students_of
from brindle.plans.students import METRICS_SCHEMA, evaluate_grid
from brindle.plans.students import QUERIES as STUDENT_QUERIES
from brindle.plans.students import relevance, search_documents, validate_students
from brindle.sources import tables
from brindle.sources.shared import shared_folder

LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
#: Words that occur in the documents, one query with a word twice, one with an unknown word.
SEARCHES = (("q1", "ention edtion license"), ("q2", "inging queque inging"), ("q3", "Licénse apache zzzunknown"))


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _round(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def _holes(df: DataFrame) -> DataFrame:
    """Line items with nulls in two columns, by rule."""
    return df.withColumn("l_quantity", F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity"))).withColumn("l_tax", F.when(F.col("l_suppkey") % 5 != 0, F.col("l_tax")))


HOLES = "(SELECT * REPLACE (CASE WHEN l_partkey % 7 <> 0 THEN l_quantity END AS l_quantity, CASE WHEN l_suppkey % 5 <> 0 THEN l_tax END AS l_tax) FROM lineitem)"


def _union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


# --- profile ---------------------------------------------------------------

QUALITY = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
KINDS = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


def column_quality(spark, d):
    return _round(profile.column_quality(_t(spark, d, "customer")), {"null_rate": 6})


def describe_numeric(spark, d):
    return _round(profile.describe(_holes(_t(spark, d, "lineitem")), LINE), {c: 4 for c in ("mean", "std", "min", "q25", "q50", "q75", "max")})


def iqr_outliers(spark, d):
    df = _t(spark, d, "orders").select("o_totalprice").withColumn("o_square", F.col("o_totalprice") * F.col("o_totalprice") / 1e6)
    return _round(profile.iqr_outliers(df, ("o_totalprice", "o_square")), {c: 3 for c in ("q1", "q3", "iqr", "lower_bound", "upper_bound")} | {"outlier_rate": 6})


def correlation_long(spark, d):
    return _round(profile.correlations(_holes(_t(spark, d, "lineitem")), LINE), {"correlation": 6})


def strong_correlations(spark, d):
    df = _t(spark, d, "lineitem").withColumn("l_net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return _round(profile.strong_correlations(profile.correlations(df, (*LINE, "l_net")), 0.5), {"correlation": 6})


def group_means_returnflag(spark, d):
    return profile.group_means(_t(spark, d, "lineitem"), "l_returnflag", ("l_quantity", "l_discount"))


def group_means_event(spark, d):
    return profile.group_means(_t(spark, d, "events"), "event_type", ("value",))


def group_means_sets(spark, d):
    return profile.group_means_many(_t(spark, d, "lineitem"), ("l_returnflag", "l_linestatus"), ("l_quantity", "l_tax"))


def value_counts(spark, d):
    return profile.value_counts(_t(spark, d, "events"), "event_type")


def histogram_10(spark, d):
    return _round(profile.histogram(_t(spark, d, "orders"), "o_totalprice"), {"low": 4, "high": 4})


def duplicate_keys(spark, d):
    return profile.duplicate_rows(_t(spark, d, "lineitem"), ("l_orderkey", "l_linenumber"))


def _slices(df: DataFrame) -> list[tuple[str, DataFrame]]:
    return [("before", df.filter("o_orderdate < timestamp'1996-01-01'")), ("after", df.filter("o_orderdate >= timestamp'1996-01-01'"))]


def dataset_comparison(spark, d):
    parts = [profile.dataset_summary(x, n, {"statuses": "o_orderstatus", "priorities": "o_orderpriority"}, {"avg_price": "o_totalprice"}) for n, x in _slices(_t(spark, d, "orders"))]
    return _round(parts[0].unionByName(parts[1]), {"avg_price": 4})


# --- features, components --------------------------------------------------

DECIDED = {"l_quantity": ("include", "size"), "l_extendedprice": ("exclude", "follows size"), "l_discount": ("include", "terms"), "l_tax": ("include", "terms")}


def feature_matrix(spark, d):
    return _round(features.feature_matrix(_holes(_t(spark, d, "lineitem")), DECIDED), {"variance": 2, "missing_rate": 6, "max_abs_correlation": 6})


def scaler_params(spark, d):
    return _round(features.fit_scaler(_holes(_t(spark, d, "lineitem")), LINE).params(spark), {"mean": 5, "std": 5})


def zscores(spark, d):
    df = _holes(_t(spark, d, "lineitem"))
    cols = ("l_quantity", "l_tax")
    scaled = features.fit_scaler(df, cols).apply(df)
    return scaled.groupBy("l_returnflag", "l_linestatus").agg(*[F.round(F.sum(c), 4).alias(f"sum_{c}") for c in cols], *[F.round(F.max(c), 6).alias(f"max_{c}") for c in cols])


def pca_covariance(spark, d):
    return _round(pca.covariance(_t(spark, d, "lineitem"), ("l_quantity", "l_discount", "l_tax")), {"covariance": 6})


def pca_explained(spark, d):
    df = _t(spark, d, "lineitem")
    scaled = features.fit_scaler(df, LINE).apply(df.select(*LINE))
    return _round(pca.fit_pca(scaled, LINE).explained(spark), {"explained_variance": 6, "explained_ratio": 6, "cumulative_ratio": 6})


def pca_scores(spark, d):
    df = _t(spark, d, "lineitem")
    scaled = features.fit_scaler(df, LINE).apply(df.select("l_orderkey", "l_linenumber", *LINE))
    return _round(pca.fit_pca(scaled, LINE).scores(scaled, 2, ("l_orderkey", "l_linenumber")), {"PC1": 6, "PC2": 6})


PAIR = ("l_quantity", "l_extendedprice")


def _pair(spark, d) -> tuple[DataFrame, pca.Components]:
    df = _t(spark, d, "lineitem")
    scaled = features.fit_scaler(df, PAIR).apply(df.select("l_orderkey", "l_linenumber", *PAIR))
    return scaled, pca.fit_pca(scaled, PAIR)


def pca_pair_explained(spark, d):
    """Two columns, whose components are known in closed form."""
    return _round(_pair(spark, d)[1].explained(spark), {"explained_variance": 9, "explained_ratio": 9, "cumulative_ratio": 9})


def pca_pair_scores(spark, d):
    scaled, fitted = _pair(spark, d)
    return _round(fitted.scores(scaled, 2, ("l_orderkey", "l_linenumber")), {"PC1": 6, "PC2": 6})


def pca_pair_needed(spark, d):
    fitted = _pair(spark, d)[1]
    return spark.createDataFrame([(share, fitted.needed(share)) for share in (0.5, 0.9, 0.95, 0.99, 1.5)], "share double, components int")


def pca_collinear(spark, d):
    """Columns that follow from each other: what holds for any components, and the variance that is left between two that are nearly equal."""
    df = _t(spark, d, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1000).alias("price"), "l_discount", "l_tax", (F.col("l_quantity") + F.col("l_tax") * 1e-6).alias("nearly"))
    df = df.withColumn("both", F.col("price") - F.col("l_discount"))
    fitted = pca.fit_pca(df, df.columns)
    scores = fitted.scores(df, keep=df.columns)
    names = [f"PC{i + 1}" for i in range(len(df.columns))]
    back = [F.lit(float(m)) + sum((F.col(n) * F.lit(float(w)) for n, w in zip(names, fitted.loadings[:, j], strict=True)), F.lit(0.0)) for j, m in enumerate(fitted.means)]
    off = F.greatest(*[F.max(F.abs(F.col(c) - b)) for c, b in zip(df.columns, back, strict=True)])
    row = scores.agg(off.alias("off"), *[F.var_samp(n).alias(n) for n in names]).first()
    pair = pca.fit_pca(df, ("l_quantity", "nearly")).variances
    found = {
        "trace": float(fitted.variances.sum()),
        "variance_of_scores": float(sum(row[n] for n in names)),
        "orthogonality": float(np.abs(fitted.loadings @ fitted.loadings.T - np.eye(len(names))).max()),
        "reconstruction": float(row["off"]),
        "null_directions": float((fitted.variances < 1e-20 * fitted.variances.sum()).sum()),
        "left_between_nearly_equal": float(pair[1] * 1e12 * 1e2),
    }
    return _round(spark.createDataFrame(list(found.items()), "name string, value double"), {"value": 5})


def dataset_nulls(spark, d):
    df = _holes(_t(spark, d, "lineitem")).select("l_partkey", "l_returnflag", *LINE)
    return _round(profile.dataset_summary(df, "holes", {"flags": "l_returnflag"}, {"avg_quantity": "l_quantity"}), {"avg_quantity": 6})


# --- rules of students on rows made from orders -----------------------------


def _student_rows(spark, d) -> DataFrame:
    """Rows with the students' columns, some of which break each rule."""
    o, c = F.col("o_orderkey").cast("int"), F.col("o_custkey").cast("int")
    programs = ("Ingenieria en Desarrollo de Software", "Ingenieria Biomedica", "Ingenieria en Energia", "Ingenieria Agroindustrial")
    return _t(spark, d, "orders").select(
        (o % 4999).cast("string").alias("id_estudiante"),
        F.concat((c % 6 + 2020).cast("string"), F.lit("-1")).alias("id_periodo"),
        F.element_at(F.array(*[F.lit(p) for p in programs]), c % 4 + 1).alias("programa"),
        (c % 5 + 2020).alias("cohorte"),
        ((o * 7 % 1100) / 10.0).alias("promedio_general"),
        F.when(o % 9 != 0, (o * 3 % 1000) / 10.0).alias("promedio_periodo"),
        ((o * 13 % 1050) / 10.0).alias("porcentaje_asistencia"),
        (o % 250 * 100 / 270.0 + c % 3).alias("porcentaje_avance"),
        (o % 250).alias("creditos_acumulados"),
        F.lit(270).alias("creditos_totales_plan"),
        (c % 50).alias("creditos_inscritos_periodo"),
        (o % 52).alias("creditos_aprobados_periodo"),
        (o % 8).alias("materias_en_curso_periodo"),
        (o % 5).alias("materias_reprobadas_acumuladas"),
        (o % 5).alias("materias_reprobadas"),
        (c % 4).alias("recursamientos"),
        (c % 7 - 1).alias("rezago_materias"),
        F.when(F.col("o_orderstatus") == "F", "Baja Temporal").when(F.col("o_orderstatus") == "O", "Regular").otherwise("Irregular").alias("estatus_academico"),
    )


def student_rules(spark, d):
    return validate_students(_student_rows(spark, d)).select("check", "passed", "failing_rows", "severity")


def rules_passed(spark, d):
    return student_rules(spark, d).agg(F.count(F.lit(1)).alias("checks"), F.count_if("passed").alias("passed"))


def _labelled(spark, d) -> DataFrame:
    label = profiles.profile_label(F.col("porcentaje_asistencia"), F.col("promedio_general"), F.col("rezago_materias"), F.col("materias_reprobadas_acumuladas"))
    return _student_rows(spark, d).withColumn("perfil_sugerido", label)


def profile_labels(spark, d):
    return _labelled(spark, d).groupBy("perfil_sugerido").agg(F.count(F.lit(1)).alias("n"))


def relevant_rows(spark, d):
    rows = _labelled(spark, d)
    return rows.agg(*[F.count_if(relevance(q)).alias(q) for q, _ in STUDENT_QUERIES])


def student_documents(spark, d):
    """Left joins on a composite key and to a tiny dimension; searchable text by row."""
    rows = _student_rows(spark, d).dropDuplicates(["id_estudiante", "id_periodo"]).withColumns({"promedio_general": F.lit(91.5), "porcentaje_asistencia": F.lit(59.0), "rezago_materias": F.lit(2), "materias_reprobadas": F.lit(0), "num_tutorias": F.lit(1), "num_incidencias": F.lit(0), "programa": F.lit("p"), "cohorte": F.lit(2020), "estatus_academico": F.lit("Regular")})
    rows = rows.select("id_estudiante", "id_periodo", "promedio_general", "porcentaje_asistencia", "rezago_materias", "materias_reprobadas", "num_tutorias", "num_incidencias", "programa", "cohorte", "estatus_academico")
    given = rows.filter(F.col("id_estudiante").cast("int") % 3 != 0).select("id_estudiante", "id_periodo", (F.col("id_estudiante").cast("int") % 4).alias("cluster"))
    summary = spark.createDataFrame([(0, "Critico / rezago alto"), (1, "Regular / seguimiento preventivo"), (2, "x")], "cluster int, profile string")
    return search_documents(rows, given, summary).select("document_id", "search_text")


# --- validation, joins, buckets --------------------------------------------


def validation_rules(spark, d):
    df = _t(spark, d, "lineitem")
    checks = [validate.within("l_quantity", 0, 45), validate.within("l_discount", 0, 100), validate.non_negative("l_tax"), validate.not_above("tax_below_discount", "l_tax", "l_discount", "media"), validate.Check("late_open", (F.col("l_linestatus") == "O") & (F.col("l_quantity") > 49))]
    return validate.run_checks(df, checks, ("l_orderkey", "l_linenumber"), ("l_orderkey", "l_missing"), ("l_tax",)).drop("detail")


def left_join_enrich(spark, d):
    o, c, n = (_t(spark, d, t) for t in ("orders", "customer", "nation"))
    n = n.filter("n_regionkey < 3").select("n_nationkey", "n_name")  # some customers find no nation
    out = o.join(c, o["o_custkey"] == c["c_custkey"], "left").join(n, F.col("c_nationkey") == n["n_nationkey"], "left")
    return out.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def bucketize_document(spark, d):
    c = _t(spark, d, "customer")
    return c.select(
        F.concat_ws("::", F.col("c_custkey").cast("string"), "c_mktsegment").alias("document_id"),
        fn.bucket(F.col("c_acctbal"), (0, 5000), ("low", "middle", "high")).alias("balance"),
        fn.zero_bucket(F.col("c_nationkey"), 3, "none", "some", "many").alias("nation"),
        fn.first_match([(F.col("c_acctbal") >= 9000, "top"), (F.col("c_acctbal") < 0, "debt"), (F.col("c_acctbal") >= 5000, "good")], "plain").alias("label"),
        (1 / (1 + F.abs("c_acctbal"))).cast("double").alias("m"),
    ).withColumn("m", F.round("m", 9))


# --- search ----------------------------------------------------------------


def _docs(spark, d) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", "text")


def term_statistics(spark, d):
    lengths = search.documents_lengths(_docs(spark, d), "doc_id", "text")
    tf = search.term_frequencies(lengths)
    n = lengths.count()
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    return df.withColumn("idf", F.round(F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6))


def document_lengths(spark, d):
    return search.documents_lengths(_docs(spark, d), "doc_id", "text").select("document_id", "length")


def _queries(spark) -> DataFrame:
    return spark.createDataFrame(list(SEARCHES), "query_id string, query string")


def bm25_topk(spark, d):
    return _round(search.bm25_search(_docs(spark, d), _queries(spark), "doc_id", "text"), {"score": 6})


def index_bm25(spark, d):
    """An index of some documents, appended to with the others, then searched."""
    docs = _docs(spark, d)
    index = search_index.build_index(docs.filter("doc_id % 3 <> 0"), "doc_id", "text", shared_folder(spark, "index"))
    index.append(docs.filter("doc_id % 3 = 0"), "doc_id", "text")
    return _round(index.search(_queries(spark)), {"score": 6})


def ir_metrics(spark, d):
    ranked = search.bm25_search(_docs(spark, d), _queries(spark), "doc_id", "text")
    good = _t(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("document_id"))
    relevant = good.select(F.explode(F.array(*[F.lit(q) for q, _ in SEARCHES])).alias("query_id"), "document_id")
    return _round(ir_eval.evaluate(ranked, relevant), {c: 6 for c in ("precision", "recall", "mrr", "ndcg")})


# --- clusters --------------------------------------------------------------


def _points(spark, d) -> DataFrame:
    e = _t(spark, d, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"), F.col("label").alias("cluster"))


def _first(points: DataFrame, k: int) -> np.ndarray:
    return np.array([r["x"] for r in points.orderBy("vec_id").limit(k).select("x").collect()])


def kmeans_assign(spark, d):
    points = _points(spark, d).drop("cluster")
    return _round(kmeans.assign(points, _first(points, 3)).drop("x"), {"distance_to_centroid": 6, "membership_score": 6})


def kmeans_steps(spark, d):
    points = _points(spark, d).drop("cluster")
    model = kmeans.lloyd(points.select("x"), _first(points, 3), 5, 0.0)
    return kmeans.assign(points, model.centres).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("distance_to_centroid") * F.col("distance_to_centroid")), 5).alias("inertia"))


def kmeans_restarts(spark, d):
    points = _points(spark, d).select("x")
    model = kmeans.fit_kmeans(points, 3)
    return spark.createDataFrame([(i, int(n), model.inertia) for i, n in enumerate(model.sizes)], "cluster int, n long, inertia double")


def kmeans_groups(spark, d):
    """Restarts over all points of three groups far apart, whose best clustering is known."""
    o, c = F.col("o_orderkey").cast("int"), F.col("o_custkey").cast("int")
    points = _t(spark, d, "orders").select(F.array((o % 3 * 100 + c % 5).cast("double"), (c % 5).cast("double")).alias("x"))
    model = kmeans.fit_kmeans(points, 3, n_init=4)
    rows = [(int(n), float(m[0]), float(m[1]), model.inertia) for n, m in zip(model.sizes, model.centres, strict=True)]
    return _round(spark.createDataFrame(rows, "n long, x double, y double, inertia double"), {"x": 6, "y": 6, "inertia": 3})


def ir_means(spark, d):
    return _round(ir_eval.mean_metrics(ir_metrics(spark, d)), {c: 5 for c in ("precision", "recall", "mrr", "ndcg")})


def cluster_quality(spark, d):
    p = _points(spark, d)
    row = (metrics.inertia(p), metrics.silhouette(p), metrics.calinski_harabasz(p), metrics.davies_bouldin(p))
    return _round(spark.createDataFrame([row], "inertia double, silhouette double, calinski_harabasz double, davies_bouldin double"), {"inertia": 5, "silhouette": 8, "calinski_harabasz": 7, "davies_bouldin": 7})


def cluster_sizes(spark, d):
    return metrics.cluster_sizes(_points(spark, d)).agg(F.min("n").alias("smallest"), F.max("n").alias("largest"), F.count(F.lit(1)).alias("clusters"))


def cluster_profile(spark, d):
    return profiles.top_differences(_t(spark, d, "lineitem").withColumn("cluster", F.col("l_returnflag")), LINE[:1] + LINE[2:], 2)


#: Places on a line, by representation: groups of groups, so that the best clustering of each k is clear (fixed values).
PLACES = {"plain": (0, 1, 10, 12, 100, 104, 1000, 1008, 1100), "folded": (0, 2, 30, 31, 300, 310, 312, 2000, 2030)}


def _grid(spark, d) -> DataFrame:
    """The reference's grid (k of 2 to 8, 20 restarts, 300 steps) over two representations of orders."""
    rows = []
    for name, places in PLACES.items():
        at = F.element_at(F.array(*[F.lit(float(v)) for v in places]), (F.col("o_orderkey") % len(places) + 1).cast("int"))
        rows += evaluate_grid(_t(spark, d, "orders").select(F.array(at).alias("x")), name)[0]
    return spark.createDataFrame(rows, METRICS_SCHEMA)


GRID_DIGITS = {"inertia": 3, "silhouette": 9, "calinski_harabasz": 0, "davies_bouldin": 9}


def kmeans_grid(spark, d):
    return _round(_grid(spark, d).drop("iterations"), GRID_DIGITS)


def embedding_grid(spark, d):
    """The same grid over the embeddings."""
    points = _points(spark, d).select("x")
    return _round(spark.createDataFrame(evaluate_grid(points, "embeddings")[0], METRICS_SCHEMA).drop("iterations"), GRID_DIGITS)


def model_ranks(spark, d):
    ranked = selection.rank_models(_grid(spark, d))
    return _round(ranked.select("representation", "k", *[F.col(f"{m}_rank").cast("long").alias(f"{m}_rank") for m in selection.WEIGHTS], "combined_rank", "viable"), {"combined_rank": 6})


def model_choice(spark, d):
    return _round(selection.choose_model(_grid(spark, d)).select("representation", "k", "combined_rank"), {"combined_rank": 6})


def uuid5_ids(spark, d):
    return _t(spark, d, "customer").select("c_custkey", fn.uuid5(F.concat(F.lit(NAME), F.col("c_custkey").cast("string"))).alias("uuid"))


def half_even(spark, d):
    return _t(spark, d, "part").select("p_partkey", fn.round_even(F.col("p_retailprice") / 8, 2).alias("r"))


def _synthetic(spark, d) -> DataFrame:
    """A student for each customer."""
    return students_of(_t(spark, d, "customer").select(F.col("c_custkey").alias("index")))


def synth_students(spark, d):
    return _synthetic(spark, d)


def synth_validation(spark, d):
    made = _synthetic(spark, d)
    return validate_students(made).select("check", "passed", "failing_rows", "severity").withColumn("records", F.lit(made.count()))


# --- files -----------------------------------------------------------------

CSV_SCHEMA = "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string, l_tax double"


def csv_bad_records(spark, d):
    """Line items as CSV in the shared folder, some lines spoilt by rule, read back: sums of what is good, and of what was set aside."""
    n, o = F.col("l_linenumber"), F.col("l_orderkey")
    quantity = F.when((o % 97 == 0) & (n == 1), "ten").otherwise(F.col("l_quantity").cast("string"))
    line = F.concat_ws(",", o.cast("string"), n.cast("string"), quantity, "l_returnflag", F.col("l_tax").cast("string"))
    line = F.when((o % 101 == 0) & (n == 2), F.concat(line, F.lit(",more"))).when((o % 103 == 0) & (n == 3), F.concat_ws(",", o.cast("string"), n.cast("string"))).otherwise(line)
    folder = shared_folder(spark, "lines")
    _t(spark, d, "lineitem").select(line.alias("value")).write.text(folder)
    read = tables.read_csv_checked(spark, folder, CSV_SCHEMA, ("l_orderkey", "l_tax"), header=False)
    good = read.good.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.sum("l_orderkey").alias("keys")).select(F.lit("good").alias("part"), "l_returnflag", "n", "quantity", "keys")
    key = F.element_at(F.split("line", ","), 1).cast("long")
    bad = read.bad.groupBy(F.size(F.split("line", ",")).cast("string").alias("l_returnflag")).agg(F.count(F.lit(1)).alias("n"), F.lit(0.0).alias("quantity"), F.sum(key).alias("keys")).select(F.lit("bad").alias("part"), "l_returnflag", "n", "quantity", "keys")
    counts = read.report.agg(F.lit("report").alias("part"), F.lit("all").alias("l_returnflag"), F.sum("lines").alias("n"), F.lit(0.0).alias("quantity"), F.sum("bad").alias("keys"))
    return good.unionByName(bad).unionByName(counts)


# --- oracle ----------------------------------------------------------------

_TOKENS = "list_filter(regexp_extract_all(strip_accents(lower({})), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({}))"
_STOP = ", ".join(f"'{w}'" for w in search.STOPWORDS)
_VALUES = ", ".join(f"('{i}', '{q}')" for i, q in SEARCHES)
_BM25 = f"""
qt AS (SELECT query_id, unnest({_TOKENS.format("query", _STOP)}) AS term FROM (VALUES {_VALUES}) v(query_id, query)),
dl AS (SELECT doc_id, {_TOKENS.format("coalesce(text, '')", _STOP)} AS terms FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM dl) GROUP BY ALL),
st AS (SELECT count(*) AS n, greatest(avg(len(terms)), 1) AS avgdl FROM dl),
idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st GROUP BY term, n),
sc AS (SELECT query_id, tf.doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(terms) / avgdl))) AS score
  FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl ON dl.doc_id = tf.doc_id, st GROUP BY ALL),
al AS (SELECT query_id, doc_id, coalesce(score, 0) AS score FROM (SELECT DISTINCT query_id FROM (VALUES {_VALUES}) v(query_id, query)) CROSS JOIN (SELECT doc_id FROM dl) LEFT JOIN sc USING (query_id, doc_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM al)"""


def _describe_sql() -> str:
    return _union(f"SELECT '{c}' AS variable, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max FROM {HOLES}" for c in LINE)


def _iqr_sql() -> str:
    src = "(SELECT o_totalprice, o_totalprice * o_totalprice / 1e6 AS o_square FROM orders)"
    one = "SELECT '{c}' AS variable, round(any_value(q1), 3) AS q1, round(any_value(q3), 3) AS q3, round(any_value(q3 - q1), 3) AS iqr, round(any_value(q1 - 1.5 * (q3 - q1)), 3) AS lower_bound, round(any_value(q3 + 1.5 * (q3 - q1)), 3) AS upper_bound, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outlier_count, round(count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count(*), 6) AS outlier_rate FROM {src}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {src})"
    return _union(one.format(c=c, src=src) for c in ("o_totalprice", "o_square"))


def _corr_sql(source: str, columns) -> str:
    return _union(f"SELECT '{a}' AS variable_a, '{b}' AS variable_b, round(corr({a}, {b}), 6) AS correlation FROM {source}" for a, b in combinations(columns, 2))


def _feature_sql() -> str:
    pairs = f"({_corr_sql(HOLES, LINE)})"
    return _union(f"SELECT '{c}' AS variable, '{x}' AS decision, '{y}' AS reason, round(var_samp({c}), 2) AS variance, round((count(*) - count({c})) / count(*), 6) AS missing_rate, (SELECT max(abs(correlation)) FROM {pairs} WHERE variable_a = '{c}' OR variable_b = '{c}') AS max_abs_correlation FROM {HOLES}" for c, (x, y) in DECIDED.items())


def _scaler_sql(c: str) -> str:
    return f"(SELECT avg({c}) AS m, stddev_pop(coalesce({c}, (SELECT avg({c}) FROM {HOLES}))) AS s FROM {HOLES})"


def _kmeans_sql(steps: int) -> str:
    ctes = ["p AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)", "c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cluster, x FROM (SELECT * FROM p ORDER BY vec_id LIMIT 3))"]
    for i in range(steps + 1):
        ctes.append(f"a{i} AS (SELECT vec_id, any_value(p.x) AS x, min_by(cluster, (list_distance(p.x, c.x), cluster)) AS cluster, min(list_distance(p.x, c.x)) AS d FROM p, c{i} c GROUP BY vec_id)")
        if i < steps:
            ctes.append(f"c{i + 1} AS (SELECT cluster, list(m ORDER BY j) AS x FROM (SELECT cluster, j, avg(v) AS m FROM (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM a{i}) GROUP BY ALL) GROUP BY cluster)")
    return "WITH " + ",\n".join(ctes)


_QUALITY_SQL = """
WITH p AS (SELECT vec_id, label AS c, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
m AS (SELECT c, list(v ORDER BY j) AS m, any_value(n) AS n FROM (SELECT c, j, avg(v) AS v, count(*) AS n FROM (SELECT c, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM p) GROUP BY c, j) GROUP BY c),
g AS (SELECT list(v ORDER BY j) AS g FROM (SELECT j, avg(v) AS v FROM (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS j FROM p) GROUP BY j)),
w AS (SELECT c, sum(list_distance(x, m) ** 2) AS w, avg(list_distance(x, m)) AS s, any_value(m) AS m, any_value(n) AS n FROM p JOIN m USING (c) GROUP BY c),
ch AS (SELECT (sum(n * list_distance(m, g) ** 2) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))) AS ch, sum(w) AS inertia FROM w, g),
db AS (SELECT avg(r) AS db FROM (SELECT a.c, max((a.s + b.s) / list_distance(a.m, b.m)) AS r FROM w a JOIN w b ON a.c <> b.c GROUP BY a.c)),
d AS (SELECT a.vec_id AS i, a.c AS ci, b.c AS cj, sum(list_distance(a.x, b.x)) AS s, count(*) AS n FROM p a, p b GROUP BY ALL),
ab AS (SELECT i, max(CASE WHEN ci = cj THEN CASE WHEN n > 1 THEN s / (n - 1) ELSE 0 END END) AS a, min(CASE WHEN ci <> cj THEN s / n END) AS b FROM d GROUP BY i)
SELECT round(inertia, 5) AS inertia, round((SELECT avg((b - a) / greatest(a, b)) FROM ab), 8) AS silhouette, round(ch, 7) AS calinski_harabasz, round(db, 7) AS davies_bouldin FROM ch, db
"""

#: All clusterings of the places into runs of neighbours; of each k the one with the least inertia is the best there is.
_GRID_CTE = "WITH pl AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', {i}, {float(v)}::DOUBLE)" for r, places in PLACES.items() for i, v in enumerate(places)) + """) p(representation, i, v)),
w AS (SELECT representation, i, v, n FROM pl JOIN (SELECT o_orderkey % 9 AS i, count(*) AS n FROM orders GROUP BY 1) USING (i)),
c AS (SELECT w.*, mask, bit_count(mask) + 1 AS k, bit_count(mask & ((1 << i) - 1)) AS c FROM w, (SELECT unnest(range(256))::INT AS mask)),
g AS (SELECT representation, mask, k, c, sum(n) AS size, sum(n * v) / sum(n) AS m FROM c GROUP BY ALL),
cg AS (SELECT c.*, size, m FROM c JOIN g USING (representation, mask, k, c)),
inner_ AS (SELECT representation, mask, k, sum(n * (v - m) ** 2) AS inertia FROM cg GROUP BY ALL),
best AS (SELECT representation, k, arg_min(mask, inertia) AS mask, min(inertia) AS inertia FROM inner_ WHERE k BETWEEN 2 AND 8 GROUP BY ALL),
p AS (SELECT cg.* FROM cg JOIN best USING (representation, k, mask)),
dist AS (SELECT a.representation, a.k, a.i, any_value(a.n) AS n, a.c = b.c AS same, any_value(a.size) AS own, sum(b.n * abs(a.v - b.v)) / any_value(b.size) AS mean, sum(b.n * abs(a.v - b.v)) AS total
  FROM p a JOIN p b ON a.representation = b.representation AND a.k = b.k GROUP BY a.representation, a.k, a.i, a.c, b.c),
ab AS (SELECT representation, k, i, any_value(n) AS n, max(CASE WHEN same THEN CASE WHEN own > 1 THEN total / (own - 1) ELSE 0 END END) AS a, min(CASE WHEN NOT same THEN mean END) AS b FROM dist GROUP BY ALL),
sil AS (SELECT representation, k, sum(n * (b - a) / greatest(a, b)) / sum(n) AS silhouette FROM ab GROUP BY ALL),
tot AS (SELECT representation, sum(n) AS n, sum(n * v) / sum(n) AS m FROM w GROUP BY 1),
cl AS (SELECT representation, k, c, any_value(size) AS size, any_value(m) AS m, sum(n * abs(v - m)) / any_value(size) AS s FROM p GROUP BY ALL),
ch AS (SELECT cl.representation, cl.k, sum(cl.size * (cl.m - tot.m) ** 2) / (cl.k - 1) AS between_, min(cl.size) AS smallest, max(cl.size) AS largest, any_value(tot.n) AS n FROM cl JOIN tot ON cl.representation = tot.representation GROUP BY cl.representation, cl.k),
db AS (SELECT representation, k, avg(r) AS db FROM (SELECT a.representation, a.k, a.c, max((a.s + b.s) / abs(a.m - b.m)) AS r FROM cl a JOIN cl b ON a.representation = b.representation AND a.k = b.k AND a.c <> b.c GROUP BY ALL) GROUP BY ALL),
grid AS (SELECT representation, k, inertia, silhouette, between_ / (inertia / (n - k)) AS calinski_harabasz, db AS davies_bouldin, smallest AS min_cluster_size, largest AS max_cluster_size, n AS n_samples
  FROM best JOIN sil USING (representation, k) JOIN ch USING (representation, k) JOIN db USING (representation, k))"""
_RANKS_SQL = """SELECT representation, k, min_cluster_size / n_samples >= 0.05 AS viable, rank() OVER (ORDER BY silhouette DESC) AS silhouette_rank, rank() OVER (ORDER BY davies_bouldin) AS davies_bouldin_rank,
rank() OVER (ORDER BY calinski_harabasz DESC) AS calinski_harabasz_rank, rank() OVER (ORDER BY max_cluster_size::DOUBLE / min_cluster_size) AS balance_rank FROM grid"""
_COMBINED = "round((0.5 * silhouette_rank + 0.25 * davies_bouldin_rank + 0.2 * calinski_harabasz_rank + 0.05 * balance_rank)::DOUBLE, 6)"


def _uuid_sql() -> str:
    h = f"sha1(unhex('{fn.DNS_NAMESPACE}') || encode('{NAME}' || c_custkey))"
    return f"SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', ('0x' || substr(h, 17, 1))::INT + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM (SELECT c_custkey, {h} AS h FROM customer)"


_CSV_SQL = """WITH l AS (SELECT *, CASE WHEN l_orderkey % 101 = 0 AND l_linenumber = 2 THEN '6' WHEN l_orderkey % 103 = 0 AND l_linenumber = 3 THEN '2' WHEN l_orderkey % 97 = 0 AND l_linenumber = 1 THEN '5' END AS fields FROM lineitem)
SELECT 'good' AS part, l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity, sum(l_orderkey)::BIGINT AS keys FROM l WHERE fields IS NULL GROUP BY 2
UNION ALL SELECT 'bad', fields, count(*), 0.0, sum(l_orderkey)::BIGINT FROM l WHERE fields IS NOT NULL GROUP BY 2
UNION ALL SELECT 'report', 'all', count(*), 0.0, count(fields) FROM l"""
#: Between q and q + e t the smaller variance is the determinant over the larger one.
_COLLINEAR_SQL = """WITH v AS (SELECT var_samp(l_quantity) AS q, var_samp(l_extendedprice / 1000) AS p, var_samp(l_discount) AS d, var_samp(l_tax) AS t, var_samp(l_extendedprice / 1000 - l_discount) AS b, covar_samp(l_quantity, l_tax) AS qt FROM lineitem),
s AS (SELECT *, q + 2e-6 * qt + 1e-12 * t AS nearly FROM v)
SELECT 'trace' AS name, round(q + p + d + t + nearly + b, 5) AS value FROM s UNION ALL SELECT 'variance_of_scores', round(q + p + d + t + nearly + b, 5) FROM s
UNION ALL SELECT 'orthogonality', 0.0 FROM s UNION ALL SELECT 'reconstruction', 0.0 FROM s UNION ALL SELECT 'null_directions', 2.0 FROM s
UNION ALL SELECT 'left_between_nearly_equal', round(1e2 * (q * t - qt * qt) / (q + nearly), 5) FROM s"""


def _histogram_sql() -> str:
    return """WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), b AS (SELECT i::INT AS bin, lo + (hi - lo) * i / 10 AS low, CASE WHEN i = 9 THEN hi ELSE lo + (hi - lo) * (i + 1) / 10 END AS high FROM range(10) r(i), s)
SELECT bin, round(low, 4) AS low, round(high, 4) AS high, count(o_totalprice) AS n FROM b LEFT JOIN orders ON o_totalprice >= low AND (o_totalprice < high OR bin = 9) GROUP BY ALL"""


def _validation_sql() -> str:
    bad = {
        "unique_key": ("count(*) - count(DISTINCT (l_orderkey, l_linenumber))", "alta"),
        "required_columns": ("count(*) FILTER (l_linenumber IS NULL) + 1", "alta"),
        "range_0_45_l_quantity": ("count(*) FILTER (l_quantity < 0 OR l_quantity > 45)", "alta"),
        "range_0_100_l_discount": ("count(*) FILTER (l_discount < 0 OR l_discount > 100)", "alta"),
        "non_negative_l_tax": ("count(*) FILTER (l_tax < 0)", "alta"),
        "tax_below_discount": ("count(*) FILTER (l_tax > l_discount)", "media"),
        "late_open": ("count(*) FILTER (l_linestatus = 'O' AND l_quantity > 49)", "alta"),
        "controlled_missing_values": ("count(*) FILTER (l_orderkey IS NULL)", "media"),
    }
    return _union(f"SELECT '{n}' AS \"check\", {x} = 0 AS passed, ({x})::BIGINT AS failing_rows, '{s}' AS severity FROM lineitem" for n, (x, s) in bad.items())


_Z = "(SELECT l_orderkey, l_linenumber, (l_quantity - q.m) / q.s AS a, (l_extendedprice - e.m) / e.s AS b FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem) q, (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem) e)"
#: Of two standardised columns the components are their sum and difference over the root of 2 (the difference first if they
#: correlate negatively), the variances 1 + |r| and 1 - |r|.
_PAIR_SQL = "(SELECT abs(corr(l_quantity, l_extendedprice)) AS r, count(*) / (count(*) - 1) AS f FROM lineitem)"

STUDENT_SQL = """(SELECT (o_orderkey % 4999)::VARCHAR AS id_estudiante, (o_custkey % 6 + 2020) || '-1' AS id_periodo, (['Ingenieria en Desarrollo de Software', 'Ingenieria Biomedica', 'Ingenieria en Energia', 'Ingenieria Agroindustrial'])[o_custkey % 4 + 1] AS programa,
(o_orderkey * 7 % 1100) / 10.0::DOUBLE AS pg, CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey * 3 % 1000) / 10.0::DOUBLE END AS pp, (o_orderkey * 13 % 1050) / 10.0::DOUBLE AS att, o_orderkey % 250 * 100 / 270.0::DOUBLE + o_custkey % 3 AS adv, o_orderkey % 250 AS acc,
o_custkey % 50 AS ins, o_orderkey % 52 AS apr, o_orderkey % 8 AS cur, o_orderkey % 5 AS rep, o_custkey % 4 AS rec, o_custkey % 7 - 1 AS lag, o_orderstatus AS st FROM orders)"""
_LABEL = "CASE WHEN att < 60 AND pg >= 80 THEN 'Atipico / buen promedio con baja asistencia' WHEN pg >= 88 AND lag <= 0.5 AND rep <= 0.5 THEN 'Alto desempeno / avance estable' WHEN pg < 62 OR lag >= 4 THEN 'Critico / rezago alto' WHEN pg < 76 OR rep >= 2 THEN 'Riesgo academico moderado' ELSE 'Regular / seguimiento preventivo' END"


def _student_rules_sql() -> str:
    bad = {
        "unique_student_period": ("count(*) - count(DISTINCT (id_estudiante, id_periodo))", "alta"),
        "required_columns": ("count(*) * 0", "alta"),
        **{f"range_0_100_{n}": (f"count(*) FILTER ({x} < 0 OR {x} > 100)", "alta") for n, x in (("promedio_general", "pg"), ("promedio_periodo", "pp"), ("porcentaje_asistencia", "att"), ("porcentaje_avance", "adv"))},
        **{f"non_negative_{n}": (f"count(*) FILTER ({x} < 0)", "alta") for n, x in (("materias_en_curso_periodo", "cur"), ("materias_reprobadas_acumuladas", "rep"), ("materias_reprobadas", "rep"), ("recursamientos", "rec"), ("rezago_materias", "lag"))},
        "period_credits_consistency": ("count(*) FILTER (apr > ins)", "alta"),
        "progress_matches_credits": ("count(*) FILTER (abs(acc / 270.0::DOUBLE * 100 - adv) > 0.75)", "alta"),
        "baja_temporal_without_active_load": ("count(*) FILTER (st = 'F' AND cur > 0)", "alta"),
        "recursamientos_not_greater_than_failed_accumulated": ("count(*) FILTER (rec > rep)", "alta"),
        "lag_not_below_failed_minus_retake": ("count(*) FILTER (lag < greatest(rep - rec, 0))", "media"),
        "controlled_missing_values": ("count(*) * 0", "media"),
    }
    return _union(f"SELECT '{n}' AS \"check\", {x} = 0 AS passed, ({x})::BIGINT AS failing_rows, '{s}' AS severity FROM {STUDENT_SQL}" for n, (x, s) in bad.items())


#: Who is relevant, by the rules over rows.
_RELEVANT = {
    "critical_lag": "label LIKE 'Critico%' OR lag >= 4 AND pg < 60", "atypical_attendance": "label LIKE 'Atipico%' OR pg >= 85 AND att < 60", "moderate_risk": "label = 'Riesgo academico moderado'", "regular_preventive": "label LIKE 'Regular%'",
    "software_lag": "programa LIKE '%Software' AND lag >= 3", "biomedical_low_attendance": "programa LIKE '%Biomedica' AND att < 60", "energy_low_average": "programa LIKE '%Energia' AND pg < 60 AND rep >= 3", "agro_high_performance": "programa LIKE '%Agroindustrial' AND pg >= 80 AND att >= 80",
}


def _documents_sql() -> str:
    who = "coalesce(CASE cluster WHEN 0 THEN 'Critico / rezago alto' WHEN 1 THEN 'Regular / seguimiento preventivo' WHEN 2 THEN 'x' END, 'sin perfil')"
    return f"""SELECT e || '::' || p AS document_id, 'estudiante ' || e || ' periodo ' || p || ' programa p cohorte 2020 estatus Regular cluster ' || coalesce(cluster::VARCHAR, 'nan') || ' perfil ' || {who} || ' ' || {who}
|| ' promedio alto asistencia baja rezago moderado sin reprobadas con tutorias seguimiento academico sin incidencias baja asistencia ausentismo asistencias atipico atipicos buen promedio baja asistencia' || CASE WHEN cluster = 1 THEN ' regular seguimiento preventivo estable' ELSE '' END AS search_text
FROM (SELECT e, p, CASE WHEN e::INT % 3 <> 0 THEN e::INT % 4 END AS cluster FROM (SELECT DISTINCT id_estudiante AS e, id_periodo AS p FROM {STUDENT_SQL}))"""


def _even(x: str) -> str:
    return f"round_even({x} * 100, 0) / 100"


ORACLE: dict[str, str] = {
    "column_quality": _union(f"SELECT '{c}' AS variable, '{KINDS[c]}' AS dtype, count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*), 6) AS null_rate, count(DISTINCT {c}) AS unique_count FROM customer" for c in QUALITY),
    "describe_numeric": _describe_sql(),
    "iqr_outliers": _iqr_sql(),
    "correlation_long": _corr_sql(HOLES, LINE),
    "strong_correlations": f"SELECT * FROM ({_corr_sql('(SELECT *, l_extendedprice * (1 - l_discount) AS l_net FROM lineitem)', (*LINE, 'l_net'))}) WHERE abs(correlation) >= 0.5",
    "group_means_returnflag": f"SELECT l_returnflag, count(*) AS n, {_even('avg(l_quantity)')} AS l_quantity, {_even('avg(l_discount)')} AS l_discount FROM lineitem GROUP BY 1",
    "group_means_event": f"SELECT event_type, count(*) AS n, {_even('avg(value)')} AS value FROM events GROUP BY 1",
    "group_means_sets": _union(f"SELECT '{k}' AS grouping, {k} AS key, count(*) AS n, {_even('avg(l_quantity)')} AS l_quantity, {_even('avg(l_tax)')} AS l_tax FROM lineitem GROUP BY {k}" for k in ("l_returnflag", "l_linestatus")),
    "value_counts": "SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1",
    "histogram_10": _histogram_sql(),
    "duplicate_keys": "SELECT sum(n - 1)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)",
    "dataset_comparison": _union(f"SELECT '{n}' AS dataset, count(*) AS records, 6 AS columns, 0::BIGINT AS null_cells, count(DISTINCT o_orderstatus) AS statuses, count(DISTINCT o_orderpriority) AS priorities, round(avg(o_totalprice), 4) AS avg_price FROM orders WHERE o_orderdate {op} TIMESTAMP '1996-01-01'" for n, op in (("before", "<"), ("after", ">="))),
    "feature_matrix": _feature_sql(),
    "scaler_params": _union(f"SELECT '{c}' AS feature, round(m, 5) AS mean, round(s, 5) AS std FROM {_scaler_sql(c)}" for c in LINE),
    "zscores": f"SELECT l_returnflag, l_linestatus, round(sum((coalesce(l_quantity, q.m) - q.m) / q.s), 4) AS sum_l_quantity, round(sum((coalesce(l_tax, t.m) - t.m) / t.s), 4) AS sum_l_tax, round(max((coalesce(l_quantity, q.m) - q.m) / q.s), 6) AS max_l_quantity, round(max((coalesce(l_tax, t.m) - t.m) / t.s), 6) AS max_l_tax FROM {HOLES}, {_scaler_sql('l_quantity')} q, {_scaler_sql('l_tax')} t GROUP BY 1, 2",
    "pca_covariance": _union(f"SELECT '{a}' AS variable_a, '{b}' AS variable_b, round(covar_samp({a}, {b}), 6) AS covariance FROM lineitem" for a, b in (("l_quantity", "l_quantity"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_discount"), ("l_discount", "l_tax"), ("l_tax", "l_tax"))),
    "pca_pair_explained": f"SELECT 1 AS position, 'PC1' AS component, round((1 + r) * f, 9) AS explained_variance, round((1 + r) / 2, 9) AS explained_ratio, round((1 + r) / 2, 9) AS cumulative_ratio FROM {_PAIR_SQL} UNION ALL SELECT 2, 'PC2', round((1 - r) * f, 9), round((1 - r) / 2, 9), 1.0::DOUBLE FROM {_PAIR_SQL}",
    "pca_pair_scores": f"SELECT l_orderkey, l_linenumber, round((a + s * b) / sqrt(2), 6) AS PC1, round((a - s * b) / sqrt(2), 6) AS PC2 FROM {_Z}, (SELECT CASE WHEN corr(l_quantity, l_extendedprice) < 0 THEN -1 ELSE 1 END AS s FROM lineitem)",
    "pca_pair_needed": f"SELECT share::DOUBLE AS share, CASE WHEN (1 + r) / 2 >= share THEN 1 ELSE 2 END AS components FROM {_PAIR_SQL}, (SELECT unnest([0.5, 0.9, 0.95, 0.99, 1.5]) AS share)",
    "dataset_nulls": f"SELECT 'holes' AS dataset, count(*) AS records, 6 AS columns, (6 * count(*) - count(l_partkey) - count(l_returnflag) - count(l_quantity) - count(l_extendedprice) - count(l_discount) - count(l_tax))::BIGINT AS null_cells, count(DISTINCT l_returnflag) AS flags, round(avg(l_quantity), 6) AS avg_quantity FROM {HOLES}",
    "student_rules": _student_rules_sql(),
    "rules_passed": f"SELECT count(*) AS checks, count(*) FILTER (passed) AS passed FROM ({_student_rules_sql()})",
    "profile_labels": f"SELECT {_LABEL} AS perfil_sugerido, count(*) AS n FROM {STUDENT_SQL} GROUP BY 1",
    "relevant_rows": f"SELECT {', '.join(f'count(*) FILTER ({x}) AS {q}' for q, x in _RELEVANT.items())} FROM (SELECT *, {_LABEL} AS label FROM {STUDENT_SQL})",
    "student_documents": _documents_sql(),
    "kmeans_groups": """WITH p AS (SELECT o_orderkey % 3 AS g, (o_orderkey % 3 * 100 + o_custkey % 5)::DOUBLE AS x, (o_custkey % 5)::DOUBLE AS y FROM orders), m AS (SELECT g, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM p GROUP BY g)
SELECT n, round(mx, 6) AS x, round(my, 6) AS y, (SELECT round(sum((x - mx) ** 2 + (y - my) ** 2), 3) FROM p JOIN m USING (g)) AS inertia FROM m""",
    "validation_rules": _validation_sql(),
    "left_join_enrich": "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey GROUP BY 1",
    "bucketize_document": "SELECT c_custkey || '::' || c_mktsegment AS document_id, CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal < 5000 THEN 'middle' ELSE 'high' END AS balance, CASE WHEN c_nationkey = 0 THEN 'none' WHEN c_nationkey < 3 THEN 'some' ELSE 'many' END AS nation, CASE WHEN c_acctbal >= 9000 THEN 'top' WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal >= 5000 THEN 'good' ELSE 'plain' END AS label, round(1 / (1 + abs(c_acctbal)), 9) AS m FROM customer",
    "term_statistics": f"WITH {_BM25} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, round(any_value(idf), 6) AS idf FROM tf JOIN idf USING (term) GROUP BY term",
    "document_lengths": f"WITH {_BM25} SELECT doc_id AS document_id, len(terms)::INT AS length FROM dl",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, rank::INT AS rank, doc_id AS document_id, round(score, 6) AS score FROM rk WHERE rank <= 10",
    "ir_metrics": f"""WITH {_BM25},
t AS (SELECT count(*) AS n FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)),
f AS (SELECT query_id, rank, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 1 ELSE 0 END AS hit FROM rk WHERE rank <= 10)
SELECT query_id, any_value(n) AS total_relevant, round(sum(hit) / 10, 6) AS precision, round(sum(hit) / greatest(any_value(n), 1), 6) AS recall, round(coalesce(1 / min(CASE WHEN hit = 1 THEN rank END), 0), 6) AS mrr,
round(sum(hit / log2(rank + 1)) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) r(i)), 6) AS ndcg FROM f, t GROUP BY query_id""",
    "kmeans_assign": f"{_kmeans_sql(0)} SELECT vec_id, cluster::INT AS cluster, round(d, 6) AS distance_to_centroid, round(1 / (1 + d), 6) AS membership_score FROM a0",
    "kmeans_steps": f"{_kmeans_sql(5)} SELECT cluster::INT AS cluster, count(*) AS n, round(sum(d * d), 5) AS inertia FROM a5 GROUP BY cluster",
    "cluster_quality": _QUALITY_SQL,
    "cluster_sizes": "SELECT min(n) AS smallest, max(n) AS largest, count(*) AS clusters FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)",
    "cluster_profile": _union(["WITH g AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem), c AS (SELECT l_returnflag AS cluster, count(*) AS records, avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem GROUP BY 1), u AS (SELECT cluster, records, 'l_quantity' AS v, c.q - g.q AS x FROM c, g UNION ALL SELECT cluster, records, 'l_discount', c.d - g.d FROM c, g UNION ALL SELECT cluster, records, 'l_tax', c.t - g.t FROM c, g), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY abs(x) DESC, v) AS rk FROM u) SELECT cluster, any_value(records) AS records, string_agg(printf('%s (%+.2f)', v, x), ', ' ORDER BY rk) AS distinctive FROM r WHERE rk <= 2 GROUP BY cluster"]),
    "kmeans_grid": f"{_GRID_CTE} SELECT representation, k::INT AS k, round(inertia, 3) AS inertia, round(silhouette, 9) AS silhouette, round(calinski_harabasz, 0) AS calinski_harabasz, round(davies_bouldin, 9) AS davies_bouldin, min_cluster_size::INT AS min_cluster_size, max_cluster_size::INT AS max_cluster_size, n_samples::BIGINT AS n_samples FROM grid",
    "csv_bad_records": _CSV_SQL,
    "pca_collinear": _COLLINEAR_SQL,
    "model_ranks": f"{_GRID_CTE} SELECT representation, k::INT AS k, silhouette_rank, davies_bouldin_rank, calinski_harabasz_rank, balance_rank, {_COMBINED} AS combined_rank, viable FROM ({_RANKS_SQL})",
    "model_choice": f"{_GRID_CTE} SELECT representation, k::INT AS k, {_COMBINED} AS combined_rank FROM ({_RANKS_SQL}) WHERE viable ORDER BY combined_rank, silhouette_rank, k, representation LIMIT 1",
    "uuid5_ids": _uuid_sql(),
    "half_even": "SELECT p_partkey, round_even(p_retailprice / 8 * 100, 0) / 100 AS r FROM part",
}

ORACLE["index_bm25"] = ORACLE["bm25_topk"]
ORACLE["ir_means"] = f"SELECT round(avg(precision), 5) AS precision, round(avg(recall), 5) AS recall, round(avg(mrr), 5) AS mrr, round(avg(ndcg), 5) AS ndcg FROM ({ORACLE['ir_metrics']})"
#: The generator keeps every rule: its 28 checks by severity (fixed values).
_COUNTS = "materias_aprobadas materias_reprobadas materias_en_curso retardos faltas num_tutorias num_asesorias num_incidencias num_permisos recursamientos rezago_materias periodos_cursados periodos_sin_inscripcion materias_reprobadas_periodo materias_reprobadas_acumuladas materias_en_curso_periodo"
_PERCENTS = "promedio_general promedio_periodo porcentaje_asistencia porcentaje_avance"
_HIGH = ["unique_student_period", "required_columns", *[f"range_0_100_{c}" for c in _PERCENTS.split()], *[f"non_negative_{c}" for c in _COUNTS.split()], "period_credits_consistency", "progress_matches_credits", "baja_temporal_without_active_load", "recursamientos_not_greater_than_failed_accumulated"]
_MEDIUM = ["lag_not_below_failed_minus_retake", "controlled_missing_values"]
ORACLE["synth_validation"] = "SELECT unnest([" + ", ".join(f"'{n}'" for n in _HIGH) + "]) AS \"check\", true AS passed, 0::BIGINT AS failing_rows, 'alta' AS severity, (SELECT count(*) FROM customer) AS records UNION ALL SELECT unnest([" + ", ".join(f"'{n}'" for n in _MEDIUM) + "]), true, 0, 'media', (SELECT count(*) FROM customer)"

_ALL = (
    pca_pair_explained, pca_pair_scores, pca_pair_needed, dataset_nulls, student_rules, rules_passed, profile_labels, relevant_rows, student_documents, kmeans_groups, ir_means,
    column_quality, describe_numeric, iqr_outliers, correlation_long, strong_correlations, group_means_returnflag, group_means_event, group_means_sets, value_counts, histogram_10, duplicate_keys, dataset_comparison, feature_matrix, scaler_params, zscores, pca_covariance, pca_explained, pca_scores, validation_rules, left_join_enrich, bucketize_document,
    term_statistics, document_lengths, bm25_topk, index_bm25, ir_metrics, kmeans_assign, kmeans_steps, kmeans_restarts, cluster_quality, cluster_sizes, cluster_profile, kmeans_grid, embedding_grid, pca_collinear, csv_bad_records, model_ranks, model_choice, uuid5_ids, half_even, synth_students, synth_validation,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
