"""The student table: its columns, rules and queries, and the four workflows over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.columns import bucket, fold, zero_bucket
from brindle.operators import features, ir_eval, kmeans, metrics, pca, profile, search, search_index, selection, validate
from brindle.operators.profiles import describe_clusters, profile_label

from brindle.sources import report, tables

KEY = ("id_estudiante", "id_periodo")
METADATA = ("id_estudiante", "id_periodo", "programa", "cohorte", "estatus_academico")
#: All columns in order (fixed values).
COLUMNS = (
    "id_estudiante", "id_periodo", "programa", "cohorte", "promedio_general", "promedio_periodo", "materias_aprobadas", "materias_reprobadas", "materias_en_curso", "creditos_acumulados", "porcentaje_avance", "porcentaje_asistencia", "faltas", "retardos", "num_tutorias", "num_asesorias", "num_incidencias", "num_permisos", "recursamientos", "rezago_materias", "estatus_academico",
    "creditos_inscritos_periodo", "creditos_aprobados_periodo", "creditos_totales_plan", "periodos_cursados", "periodos_sin_inscripcion", "materias_reprobadas_periodo", "materias_reprobadas_acumuladas", "materias_en_curso_periodo", "tendencia_promedio", "varianza_calificaciones", "tutorias_abiertas", "tutorias_cerradas", "compromisos_pendientes", "compromisos_cumplidos", "permisos_aprobados", "permisos_rechazados", "bandera_dato_incompleto",
)
NUMERIC = tuple(c for c in COLUMNS if c not in METADATA)
#: Numeric columns that are left out of the features (fixed values), with the reason; all others are features.
EXCLUDED = {
    "materias_aprobadas": "credits and progress say it better",
    "materias_reprobadas": "alias of the accumulated count",
    "materias_en_curso": "alias of the load of the term",
    "creditos_acumulados": "credits of the term and progress say it better",
    "faltas": "mirror of attendance",
    "num_tutorias": "sum of open and closed tutoring",
    "num_permisos": "sum of approved and rejected leave",
    "creditos_totales_plan": "constant of the program",
}
DECISIONS = {c: ("exclude", EXCLUDED[c]) if c in EXCLUDED else ("include", "feature") for c in NUMERIC}
FEATURES = tuple(features.selected(DECISIONS))
MEANS = {"promedio_general": "promedio_general", "porcentaje_asistencia": "porcentaje_asistencia", "rezago_materias": "rezago_materias", "materias_reprobadas_acumuladas": "materias_reprobadas_acumuladas"}
GROUP_METRICS = ("promedio_general", "porcentaje_asistencia", "rezago_materias", "materias_reprobadas_acumuladas")
#: Variables that the second version added: what they say, in words of our own, and what kind they are.
DICTIONARY = (
    ("creditos_inscritos_periodo", "Creditos que el estudiante inscribe en el termino.", "periodo"),
    ("creditos_aprobados_periodo", "De los inscritos, los que aprueba en el termino.", "periodo"),
    ("creditos_totales_plan", "Creditos que pide el programa completo.", "plan"),
    ("periodos_cursados", "Terminos que van de la cohorte al periodo de la fila.", "trayectoria"),
    ("periodos_sin_inscripcion", "Terminos intermedios en que no hubo inscripcion.", "trayectoria"),
    ("materias_reprobadas_periodo", "Cuantas materias no pasa en el termino.", "periodo"),
    ("materias_reprobadas_acumuladas", "Cuantas materias no ha pasado hasta la fecha.", "historico"),
    ("materias_en_curso_periodo", "Cuantas materias lleva en el termino.", "periodo"),
    ("tendencia_promedio", "Diferencia entre el promedio del termino y el de toda la carrera.", "derivada"),
    ("varianza_calificaciones", "Dispersion de las notas entre materias.", "derivada"),
    ("tutorias_abiertas", "Tutorias que siguen sin cerrar.", "operativa"),
    ("tutorias_cerradas", "Tutorias concluidas.", "operativa"),
    ("compromisos_pendientes", "Acuerdos de tutoria aun por cumplir.", "operativa"),
    ("compromisos_cumplidos", "Acuerdos de tutoria ya cumplidos.", "operativa"),
    ("permisos_aprobados", "Solicitudes de ausencia concedidas.", "operativa"),
    ("permisos_rechazados", "Solicitudes de ausencia negadas.", "operativa"),
    ("bandera_dato_incompleto", "Vale 1 donde falta un dato que no aplica.", "calidad"),
)
#: Evaluation queries: id, text (fixed values).
QUERIES = (
    ("critical_lag", "estudiantes criticos con rezago alto"),
    ("atypical_attendance", "buen promedio baja asistencia atipico"),
    ("moderate_risk", "riesgo academico moderado"),
    ("regular_preventive", "alumnos regulares seguimiento preventivo"),
    ("software_lag", "desarrollo de software rezago alto"),
    ("biomedical_low_attendance", "biomedica baja asistencia"),
    ("energy_low_average", "energia promedio bajo reprobadas"),
    ("agro_high_performance", "agroindustrial asistencia alta promedio alto"),
)


def student_checks(columns: list[str], version: str = "v2") -> list[validate.Check]:
    """The rules that the present columns allow, in table order where they are per column."""
    have = set(columns)
    out = [validate.within(c) for c in ("promedio_general", "promedio_periodo", "porcentaje_asistencia", "porcentaje_avance") if c in have]
    others = {"faltas", "retardos", "recursamientos", "rezago_materias", "periodos_cursados", "periodos_sin_inscripcion"}
    out += [validate.non_negative(c) for c in columns if c.startswith(("num_", "materias_")) or c in others]
    if {"creditos_aprobados_periodo", "creditos_inscritos_periodo"} <= have:
        out.append(validate.not_above("period_credits_consistency", "creditos_aprobados_periodo", "creditos_inscritos_periodo"))
    if {"creditos_acumulados", "creditos_totales_plan", "porcentaje_avance"} <= have:
        out.append(validate.ratio_matches("progress_matches_credits", "creditos_acumulados", "creditos_totales_plan", "porcentaje_avance"))
    load = next((c for c in ("materias_en_curso_periodo", "materias_en_curso") if c in have), None)
    if load and "estatus_academico" in have:
        out.append(validate.Check("baja_temporal_without_active_load", (F.col("estatus_academico") == "Baja Temporal") & (F.col(load) > 0)))
    failed = next((c for c in ("materias_reprobadas_acumuladas", "materias_reprobadas") if c in have), None)
    if failed and "recursamientos" in have:
        suffix = "_accumulated" if failed.endswith("acumuladas") else ""
        out.append(validate.not_above(f"recursamientos_not_greater_than_failed{suffix}", "recursamientos", failed))
        if "rezago_materias" in have:
            least = F.greatest(F.col(failed) - F.col("recursamientos"), F.lit(0))
            out.append(validate.Check("lag_not_below_failed_minus_retake", F.col("rezago_materias") < least, "media"))
    return out


def validate_students(df: DataFrame, version: str = "v2") -> DataFrame:
    allowed = ("promedio_periodo", "tendencia_promedio") if version == "v2" else None
    required = ("id_estudiante", "id_periodo", "programa", "cohorte", "promedio_general", "porcentaje_asistencia", "estatus_academico")
    return validate.run_checks(df, student_checks(df.columns, version), KEY, required, allowed, "unique_student_period")


def summarise(df: DataFrame, label: str) -> DataFrame:
    return profile.dataset_summary(df, label, {"programs": "programa", "periods": "id_periodo", "cohorts": "cohorte"}, {"avg_grade": "promedio_general", "avg_attendance": "porcentaje_asistencia", "avg_lag": "rezago_materias"})


def document_text() -> Column:
    """Searchable text of a student row with its cluster and profile (fixed wording)."""
    grade, attendance, lag = F.col("promedio_general"), F.col("porcentaje_asistencia"), F.col("rezago_materias")
    named = lambda word, value: F.concat(F.lit(word + " "), F.coalesce(value.cast("string"), F.lit("nan")))
    who = F.coalesce(F.col("perfil_sugerido"), F.lit("sin perfil"))
    parts = [
        named("estudiante", F.col("id_estudiante")), named("periodo", F.col("id_periodo")), named("programa", F.col("programa")), named("cohorte", F.col("cohorte")), named("estatus", F.col("estatus_academico")), named("cluster", F.col("cluster")),
        F.concat(F.lit("perfil "), who, F.lit(" "), who),
        bucket(grade, (60, 80), ("promedio bajo", "promedio medio", "promedio alto")),
        bucket(attendance, (60, 80), ("asistencia baja", "asistencia media", "asistencia alta")),
        zero_bucket(lag, 3, "sin rezago", "rezago moderado", "rezago alto"),
        zero_bucket(F.col("materias_reprobadas"), 3, "sin reprobadas", "reprobadas moderadas", "reprobadas altas"),
        F.when(F.col("num_tutorias") == 0, "sin tutorias").otherwise("con tutorias seguimiento academico"),
        F.when(F.col("num_incidencias") == 0, "sin incidencias").otherwise("con incidencias"),
        F.when(grade < 60, "critico criticos riesgo bajo promedio reprobacion"),
        F.when(attendance < 60, "baja asistencia ausentismo asistencias"),
        F.when(lag >= 3, "rezago rezagos alto atraso academico"),
        F.when((grade < 60) & (lag >= 4), "estudiantes criticos con rezago alto"),
        F.when((grade >= 85) & (attendance < 60), "atipico atipicos buen promedio baja asistencia"),
        F.when(fold(who).contains("regular"), "regular seguimiento preventivo estable"),
    ]
    return F.concat_ws(" ", *parts)


def relevance(query_id: str) -> Column:
    """Which student rows answer an evaluation query (fixed rules); ValueError for another id."""
    who, program = fold(F.col("perfil_sugerido")), fold(F.col("programa"))
    grade, attendance, lag = F.col("promedio_general"), F.col("porcentaje_asistencia"), F.col("rezago_materias")
    rules = {
        "critical_lag": who.contains("critico") | ((lag >= 4) & (grade < 60)),
        "atypical_attendance": who.contains("atipico") | ((grade >= 85) & (attendance < 60)),
        "moderate_risk": who.contains("riesgo academico moderado"),
        "regular_preventive": who.contains("regular"),
        "software_lag": program.contains("desarrollo de software") & (lag >= 3),
        "biomedical_low_attendance": program.contains("biomedica") & (attendance < 60),
        "energy_low_average": program.contains("energia") & (grade < 60) & (F.col("materias_reprobadas") >= 3),
        "agro_high_performance": program.contains("agroindustrial") & (grade >= 80) & (attendance >= 80),
    }
    if query_id not in rules:
        raise ValueError(f"unknown query: {query_id}")
    return F.coalesce(rules[query_id], F.lit(False))


def search_documents(df: DataFrame, assignments: DataFrame, summary: DataFrame) -> DataFrame:
    """Student rows left-joined with cluster and profile, with id and text to search."""
    joined = df.join(assignments.select(*KEY, "cluster"), list(KEY), "left").join(F.broadcast(summary.select("cluster", F.col("profile").alias("perfil_sugerido"))), "cluster", "left")
    return joined.withColumn("document_id", F.concat_ws("::", *KEY)).withColumn("search_text", document_text())


@dataclass(frozen=True)
class Analysis:
    scaler: features.Scaler
    components: pca.Components
    scaled: DataFrame
    scores: dict[str, DataFrame]


def run_analysis(df: DataFrame, out: str) -> Analysis:
    """Profile, selection, scaling and components; tables, drawings and reports under ``out``."""
    spark = df.sparkSession
    tables.require(df, COLUMNS)
    pairs = profile.correlations(df, NUMERIC).cache()
    frames = {
        "quality_summary": profile.column_quality(df), "descriptive_statistics": profile.describe(df, NUMERIC), "correlation_matrix": profile.correlation_matrix(df, NUMERIC), "strong_correlations": profile.strong_correlations(pairs), "outlier_summary": profile.iqr_outliers(df, NUMERIC),
        "group_by_program": profile.group_means(df, "programa", GROUP_METRICS), "group_by_cohort": profile.group_means(df, "cohorte", GROUP_METRICS), "group_by_period": profile.group_means(df, "id_periodo", GROUP_METRICS), "status_counts": profile.value_counts(df, "estatus_academico"),
        "feature_selection_matrix": features.feature_matrix(df, DECISIONS),
    }
    scaler = features.fit_scaler(df, FEATURES)
    scaled = scaler.apply(df.select(*METADATA, *FEATURES))
    components = pca.fit_pca(scaled, FEATURES)
    n90, n95 = components.needed(0.90), components.needed(0.95)
    scores = {"pca_90": components.scores(scaled, n90, METADATA), "pca_95": components.scores(scaled, n95, METADATA), "pca": components.scores(scaled, None, METADATA)}
    frames |= {"scaler_params": scaler.params(spark), "pca_explained_variance": components.explained(spark), "top_loadings": components.top_loadings(spark), "selected_features": df.select(*METADATA, *FEATURES), "scaled_features": scaled, **{f"scores_{k}": v for k, v in scores.items()}}
    for name, frame in frames.items():
        tables.write_results(frame, f"{out}/{name}")
    for c in ("promedio_general", "porcentaje_asistencia"):
        tables.write_text(f"{out}/figures/{c}.svg", report.histogram_svg(profile.histogram(df, c), c))
    tables.write_text(f"{out}/figures/correlations.svg", report.heatmap_svg(frames["correlation_matrix"], NUMERIC, "correlations"))
    strong, rows = frames["strong_correlations"].count(), df.count()
    said = f"{rows} rows; {len(NUMERIC)} numeric columns, {len(FEATURES)} of them features ({', '.join(sorted(EXCLUDED))} are left out). {strong} pairs correlate strongly. {n90} components keep 90 % of the variance, {n95} keep 95 %; recommended: {components.recommended()}."
    text = ["# Exploratory report", f"\n{said}"] + [f"\n## {name}\n\n{report.markdown_table(frames[name])}" for name in ("quality_summary", "outlier_summary", "strong_correlations", "group_by_program", "status_counts", "feature_selection_matrix", "pca_explained_variance")]
    tables.write_text(f"{out}/analysis.md", "\n".join(text))
    tables.write_json(f"{out}/pca_metadata.json", {"features": list(FEATURES), "components_90": n90, "components_95": n95, "recommended": components.recommended()})
    pairs.unpersist()
    return Analysis(scaler, components, scaled, scores)


def evaluate_grid(points: DataFrame, representation: str, ks=kmeans.K_RANGE, n_init: int = kmeans.N_INIT, exact: bool = True) -> tuple[list[tuple], dict[int, kmeans.Clustering]]:
    """One row of metrics per k, and the clusterings.

    All k share the passes of the fit and of the metrics, over different points with
    their numbers of rows.  The exact silhouette
    is quadratic; without ``exact`` it is the one by distances to the means.
    """
    ks = list(ks)
    with kmeans.kept(kmeans.weighted(points)) as crowds:
        models = kmeans.fit_grid(crowds, ks, n_init, weight="n")
        labelled = crowds
        for k in ks:
            labelled = kmeans.assign(labelled, models[k].centres).withColumnRenamed("cluster", f"k{k}").drop("distance_to_centroid", "membership_score")
        with kmeans.kept(labelled) as labelled:
            names = [f"k{k}" for k in ks]
            found = metrics.summaries(labelled, names, weight="n")
            near = metrics.silhouettes(labelled, names, weight="n") if exact else [metrics.centroid_silhouette(labelled, cluster=c, weight="n") for c in names]
    n = int(found[0].n.sum())
    rows = [(representation, k, models[k].inertia, s, one.calinski_harabasz, one.davies_bouldin, int(one.n.min()), int(one.n.max()), n, models[k].iterations) for k, one, s in zip(ks, found, near, strict=True)]
    return rows, models


METRICS_SCHEMA = "representation string, k int, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double, min_cluster_size int, max_cluster_size int, n_samples long, iterations int"


def run_clustering(df: DataFrame, analysis: Analysis, out: str, ks=kmeans.K_RANGE, n_init: int = kmeans.N_INIT, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """Grid over k and representation, choice, assignment, profiles; returns (assignments, summary)."""
    spark = df.sparkSession
    reps = {"scaled_features": analysis.scaled, "pca_90": analysis.scores["pca_90"]}
    rows, models, points = [], {}, {}
    for name, frame in reps.items():
        columns = [c for c in frame.columns if c not in METADATA]
        points[name] = kmeans.vectors(frame, columns, METADATA).cache()
        found, models[name] = evaluate_grid(points[name], name, ks, n_init, exact)
        rows += found
    table = spark.createDataFrame(rows, METRICS_SCHEMA)
    best = selection.choose_model(table).first()
    model = models[best["representation"]][best["k"]]
    assignments = kmeans.assign(points[best["representation"]], model.centres).drop("x").cache()
    joined = assignments.select(*KEY, "cluster").join(df, list(KEY), "left")
    label = profile_label(F.col("porcentaje_asistencia"), F.col("promedio_general"), F.col("rezago_materias"), F.col("materias_reprobadas_acumuladas"))
    summary = describe_clusters(joined, FEATURES, MEANS, label).cache()
    centres = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.centres)], "cluster int, centre array<double>")
    for name, frame in {"k_selection_metrics": table, "model_ranks": selection.rank_models(table), "cluster_assignments": assignments, "kmeans_centroids": centres, "cluster_summary": summary}.items():
        tables.write_results(frame, f"{out}/{name}")
    for metric in ("inertia", "silhouette", "calinski_harabasz", "davies_bouldin"):
        place = {"inertia": 2, "silhouette": 3, "calinski_harabasz": 4, "davies_bouldin": 5}[metric]
        tables.write_text(f"{out}/figures/{metric}.svg", report.line_svg([(r[1], r[place]) for r in rows if r[0] == best["representation"]], metric))
    flat = analysis.scores["pca_90"].join(assignments.select(*KEY, "cluster"), list(KEY))
    tables.write_text(f"{out}/figures/clusters.svg", report.scatter_svg(flat, "PC1", "PC2", "cluster", "clusters"))
    tables.write_json(f"{out}/kmeans_metadata.json", {"representation": best["representation"], "k": best["k"], "inertia": best["inertia"], "silhouette": best["silhouette"], "combined_rank": best["combined_rank"]})
    said = f"Chosen: {best['representation']} with {best['k']} clusters, combined rank {best['combined_rank']:.4g}, silhouette {best['silhouette']:.4g}, inertia {best['inertia']:.6g}. Ranks weigh silhouette, Davies-Bouldin, Calinski-Harabasz and balance; models with a cluster under 5 % of the rows are not chosen."
    tables.write_text(f"{out}/clustering.md", f"# Clustering report\n\n{said}\n\n{report.markdown_table(table, digits=5)}\n\n## Clusters\n\n{report.markdown_table(summary, digits=5)}")
    return assignments, summary


def run_search(df: DataFrame, assignments: DataFrame, summary: DataFrame, out: str, k: int = search.TOP_K) -> DataFrame:
    """Index, search all evaluation queries in one plan, evaluate; returns metrics per query."""
    spark = df.sparkSession
    docs = search_documents(df, assignments, summary).cache()
    queries = spark.createDataFrame(list(QUERIES), "query_id string, query string")
    index = search_index.build_index(docs, "document_id", "search_text", f"{out}/index", buckets=8, overwrite=True)
    ranked = index.search(queries, k).cache()
    flags = F.explode(F.array(*[F.when(relevance(q), F.lit(q)) for q, _ in QUERIES])).alias("query_id")
    relevant = docs.select("document_id", flags).filter("query_id IS NOT NULL")
    per = ir_eval.evaluate(ranked, relevant, k).join(queries, "query_id").cache()
    shown = ir_eval.sample_results(ranked, relevant).join(docs.select("document_id", "programa", "perfil_sugerido", *GROUP_METRICS[:3]), "document_id", "left")
    tables.write_results(per, f"{out}/search_metrics")
    tables.write_results(shown, f"{out}/search_results_sample")
    order = per.orderBy("ndcg", "query_id").select("query_id", "ndcg", "total_relevant").collect()  # one row a query
    said = f"{docs.count()} documents, {len(QUERIES)} queries, the first {k} results of each judged by rules over the rows. Hardest: {order[0]['query_id']} (nDCG {order[0]['ndcg']:.4g}, {order[0]['total_relevant']} relevant); easiest: {order[-1]['query_id']} (nDCG {order[-1]['ndcg']:.4g}). Recall is bounded by {k} results for queries with more relevant rows."
    tables.write_text(f"{out}/search.md", f"# Search report\n\n{said}\n\n{report.markdown_table(ir_eval.mean_metrics(per), digits=5)}\n\n{report.markdown_table(per.orderBy('query_id'), digits=5)}")
    return per


def run_dataset(spark: SparkSession, out: str, n: int = 1000, seed: int = 42, before: DataFrame | None = None) -> DataFrame:
    """Generate, validate and compare with an earlier version if there is one; returns the table."""
    from brindle.operators.synth import students

    df = students(spark, n, seed).cache()
    tables.write_results(df, f"{out}/students")
    tables.write_results(validate_students(df), f"{out}/dataset_validation")
    words = spark.createDataFrame(list(DICTIONARY), "variable string, descripcion string, semantica string")
    tables.write_results(words, f"{out}/data_dictionary")
    tables.write_text(f"{out}/data_dictionary.md", f"# Diccionario de variables\n\n{report.markdown_table(words, 40)}")
    summary = summarise(df, "v2")
    if before is not None:
        tables.write_results(validate_students(before, "v1"), f"{out}/dataset_validation_before")
        summary = summarise(before, "v1").unionByName(summary)
    tables.write_results(summary, f"{out}/dataset_comparison")
    text = f"# Dataset\n\n{report.markdown_table(summary)}\n\n## Checks\n\n{report.markdown_table(validate_students(df), 40)}"
    tables.write_text(f"{out}/dataset.md", text)
    return df


def search_inputs(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, assignments and summary as the earlier workflows left them under ``out``; FileNotFoundError without them."""
    paths = [f"{out}/dataset/students", f"{out}/clustering/cluster_assignments", f"{out}/clustering/cluster_summary"]
    tables.need(spark, *paths)
    return tuple(spark.read.parquet(p) for p in paths)


def run_all(spark: SparkSession, out: str, n: int = 1000, seed: int = 42, n_init: int = kmeans.N_INIT) -> DataFrame:
    """The four workflows one after the other."""
    df = run_dataset(spark, f"{out}/dataset", n, seed)
    analysis = run_analysis(df, f"{out}/analysis")
    run_clustering(df, analysis, f"{out}/clustering", n_init=n_init)
    return run_search(*search_inputs(spark, out), f"{out}/search")
