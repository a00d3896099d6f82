"""Edge cases and brute force for the analytics operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import columns as fn
from brindle.operators import features, ir_eval, kmeans, metrics, pca, profile, profiles, search, selection, validate
from brindle.operators.synth import students
from brindle.plans import students as plan
from brindle.sources import report, tables


def one(df, *exprs):
    return df.select(*exprs).first()


def test_rounding_and_buckets(spark):
    df = spark.createDataFrame([(0.125,), (1.005,), (2.675,), (None,)], "x double")
    assert [r[0] for r in df.select(fn.round_even(F.col("x"))).collect()] == [0.12, 1.0, 2.67 if round(2.675 * 100) == 267 else 2.68, None]
    b = spark.createDataFrame([(59.9,), (60.0,), (79.9,), (80.0,), (None,)], "x double")
    assert [r[0] for r in b.select(fn.bucket(F.col("x"), (60, 80), ("a", "b", "c"))).collect()] == ["a", "b", "b", "c", "c"]
    z = spark.createDataFrame([(0.0,), (2.99,), (3.0,)], "x double")
    assert [r[0] for r in z.select(fn.zero_bucket(F.col("x"), 3, "n", "s", "m")).collect()] == ["n", "s", "m"]
    assert one(spark.range(1), fn.period_order(F.lit("2024-2")))[0] == 2024 * 2 + 2


def test_text(spark):
    row = one(spark.range(1), fn.tokens(F.lit("Energía del NIÑO a x straße 42"), search.STOPWORDS), fn.fold(F.lit("É")), fn.uuid5(F.lit("python.org")))
    assert row[0] == ["energia", "nino", "stra", "42"] or row[0] == ["energia", "nino", "stra", "e", "42"]
    assert row[1] == "e" and row[2] == "886313e1-3b8a-5372-9b90-0c9aee199e5d"


def test_profile_edges(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (2.0, float("nan"), 5.0), (4.0, 1.0, 5.0), (8.0, 3.0, 5.0)], "a double, b double, c double")
    q = {r["variable"]: r for r in profile.column_quality(df).collect()}
    assert q["b"]["null_count"] == 2 and q["b"]["unique_count"] == 2 and q["a"]["null_rate"] == 0
    d = {r["variable"]: r for r in profile.describe(df, ("a", "b", "c")).collect()}
    assert d["a"]["q25"] == 1.75 and d["b"]["count"] == 2 and d["c"]["std"] == 0
    c = {(r[0], r[1]): r[2] for r in profile.correlations(df, ("a", "b", "c")).collect()}
    assert c["a", "b"] == pytest.approx(1.0) and c["a", "c"] is None
    assert profile.strong_correlations(profile.correlations(df, ("a", "c"))).count() == 0
    empty = df.filter("a < 0")
    assert profile.iqr_outliers(empty, ("a",)).first()["outlier_count"] == 0
    assert profile.histogram(empty, "a").count() == 0
    h = spark.createDataFrame([(1.0,), (2.0,), (2.8,), (10.0,)], "x double")
    assert [r["n"] for r in profile.histogram(h, "x").collect()] == [1, 1, 1, 0, 0, 0, 0, 0, 0, 1]
    assert sum(r["n"] for r in profile.histogram(h.filter("x = 1"), "x").collect()) == 1


def test_value_counts_ties_and_groups(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), (None, 3.0)], "k string, v double")
    assert [r["k"] for r in profile.value_counts(df, "k").collect()] == ["a", "b"]
    assert [tuple(r) for r in profile.group_means(df, "k", ("v",)).collect()] == [("a", 1, 2.0), ("b", 1, 1.0)]


def test_scaler_and_pca(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1]])
    rows = [tuple(None if (i + j) % 11 == 0 else float(v) for j, v in enumerate(r)) + (7.0,) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    scaler = features.fit_scaler(df, ("a", "b", "c", "k"))
    raw = np.array([[np.nan if v is None else v for v in r] for r in rows])
    mean = np.nanmean(raw, axis=0)
    full = np.where(np.isnan(raw), mean, raw)
    std = full.std(axis=0)
    std[std == 0] = 1
    assert np.allclose(scaler.means, mean) and np.allclose(scaler.stds, std)
    scaled = scaler.apply(df)
    z = (full - mean) / std
    assert np.allclose(np.array(scaled.collect(), float), z)
    model = pca.fit_pca(scaled, ("a", "b", "c", "k"))
    s = np.linalg.svd(z, full_matrices=False)[1]
    assert np.allclose(model.variances, s**2 / (len(z) - 1))
    assert np.allclose(model.loadings @ model.loadings.T, np.eye(4))
    got = np.array(model.scores(scaled).collect(), float)
    assert np.allclose((got**2).sum(axis=0), s**2)
    assert model.explained(spark).agg(F.sum("explained_ratio")).first()[0] == pytest.approx(1.0)
    assert model.needed(2.0) == 4 and model.recommended() in (1, 2, 3, 4)
    assert model.top_loadings(spark, 2).count() == 8


def test_kmeans_and_metrics(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.3, (25, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    points = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(x)], "id long, x array<double>")
    model = kmeans.fit_kmeans(points.select("x"), 3, n_init=2)
    assert sorted(model.sizes.tolist()) == [25, 25, 25]
    labelled = kmeans.assign(points, model.centres)
    y = np.array([r["cluster"] for r in labelled.orderBy("id").collect()])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(len(x)):
        a = d[i, y == y[i]].sum() / ((y == y[i]).sum() - 1)
        b = min(d[i, y == c].mean() for c in set(y) - {y[i]})
        s.append((b - a) / max(a, b))
    assert metrics.silhouette(labelled) == pytest.approx(np.mean(s))
    assert metrics.inertia(labelled) == pytest.approx(model.inertia)
    assert metrics.calinski_harabasz(labelled) > 100 and 0 < metrics.davies_bouldin(labelled) < 1
    assert abs(metrics.centroid_silhouette(labelled) - np.mean(s)) < 0.2
    far = kmeans.lloyd(points.select("x"), np.array([[0.0, 0], [100, 100], [200, 200]]), 50)
    assert (far.sizes > 0).all()


def test_metric_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, "x array<double>, cluster int")
    single = make([([0.0], 0), ([0.1], 0), ([9.0], 3)])
    values = {round(r["silhouette"], 3) for r in metrics.silhouette_samples(single).filter("cluster = 3").collect()}
    assert values == {1.0}
    assert math.isnan(metrics.silhouette(make([([0.0], 1), ([1.0], 1)])))
    same = make([([0.0], 0), ([1.0], 0), ([0.0], 1), ([1.0], 1)])
    assert metrics.davies_bouldin(same) == math.inf
    assert metrics.calinski_harabasz(make([([0.0], 0), ([0.0], 0), ([1.0], 1), ([1.0], 1)])) == math.inf
    assert math.isnan(metrics.calinski_harabasz(make([([0.0], 0), ([1.0], 0)])))


def test_selection_falls_back(spark):
    rows = [("a", 2, 1.0, 0.5, 10.0, 1.0, 1, 99, 100), ("b", 3, 2.0, 0.1, 5.0, 2.0, 2, 98, 100)]
    df = spark.createDataFrame(rows, "representation string, k int, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double, min_cluster_size int, max_cluster_size int, n_samples long")
    assert selection.choose_model(df).first()["representation"] == "a"


def test_labels_take_the_first_rule(spark):
    df = spark.createDataFrame([(50.0, 95.0, 0.0, 0.0), (80.0, 90.0, 0.5, 0.5), (80.0, 61.0, 0.0, 0.0), (80.0, 75.0, 1.0, 0.0), (80.0, 80.0, 1.0, 0.0)], "a double, g double, l double, f double")
    got = [r[0] for r in df.select(profiles.profile_label(F.col("a"), F.col("g"), F.col("l"), F.col("f"))).collect()]
    assert [g.split()[0] for g in got] == ["Atipico", "Alto", "Critico", "Riesgo", "Regular"]


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "casa roja"), (2, "casa casa azul"), (3, ""), (4, None), (5, "perro")], "id long, t string")
    queries = spark.createDataFrame([("q", "casa"), ("qq", "casa casa"), ("none", "xyz")], "query_id string, query string")
    rows = search.bm25_search(docs, queries, "id", "t", 4).collect()
    by = {(r["query_id"], r["rank"]): (r["document_id"], r["score"]) for r in rows}
    n, avg = 5, (2 + 3 + 0 + 0 + 1) / 5
    idf = math.log(1 + (n - 2 + 0.5) / 2.5)
    score = lambda tf, dl: idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert by["q", 1] == (2, pytest.approx(score(2, 3))) and by["q", 2] == (1, pytest.approx(score(1, 2)))
    assert by["qq", 1][1] == pytest.approx(2 * score(2, 3))
    assert [by["q", 3][0], by["q", 4][0]] == [3, 4] and [by["none", i][0] for i in (1, 2, 3, 4)] == [1, 2, 3, 4]
    assert search.bm25_search(docs.limit(0), queries, "id", "t").count() == 0


def test_ir_metrics(spark):
    ranked = spark.createDataFrame([("a", 1, 10), ("a", 2, 11), ("b", 1, 20), ("b", 2, 21), ("c", 1, 30)], "query_id string, rank int, document_id long")
    relevant = spark.createDataFrame([("a", 10), ("b", 21), ("b", 99)], "query_id string, document_id long")
    got = {r["query_id"]: r for r in ir_eval.evaluate(ranked, relevant, 2).collect()}
    assert got["a"]["mrr"] == 1 and got["b"]["mrr"] == 0.5 and got["c"]["mrr"] == 0
    assert got["a"]["ndcg"] == 1 and got["c"]["ndcg"] == 0 and got["b"]["recall"] == 0.5 and got["a"]["precision"] == 0.5
    assert got["b"]["ndcg"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))


def test_students_follow_the_rules(spark):
    df = students(spark, 2000)
    assert df.columns == list(plan.COLUMNS)
    checks = plan.validate_students(df).collect()
    assert len(checks) == 28 and all(r["passed"] for r in checks)
    again = students(spark, 2000, partitions=7)
    assert df.exceptAll(again).count() == 0
    share = {r[0]: r[1] / 2000 for r in profile.value_counts(df, "estatus_academico").collect()}
    assert 0.75 < share["Regular"] < 0.93 and 0.03 < share["Baja Temporal"] < 0.15
    mean = df.agg(F.avg("promedio_general"), F.avg("porcentaje_asistencia")).first()
    assert abs(mean[0] - 76) < 4 and abs(mean[1] - 63) < 8


def test_checks_fail_where_they_should(spark):
    df = spark.createDataFrame([(1, 120.0, None), (1, -1.0, 3.0)], "k long, v double, w double")
    got = {r["check"]: r for r in validate.run_checks(df, [validate.within("v"), validate.non_negative("v")], ("k",), ("k", "zz"), ("v",)).collect()}
    assert got["unique_key"]["failing_rows"] == 1 and got["required_columns"]["detail"] == "zz"
    assert got["range_0_100_v"]["failing_rows"] == 2 and got["non_negative_v"]["failing_rows"] == 1 and got["controlled_missing_values"]["failing_rows"] == 1


def test_sources_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), "a|b"), (2, 2.5, None)], "i long, x double, s string")
    tables.write_table(df, str(tmp_path / "t"))
    back = tables.read_table(spark, str(tmp_path / "t"))
    assert back.filter("x IS NULL").count() == 1
    with pytest.raises(ValueError, match="missing"):
        tables.read_table(spark, str(tmp_path / "t"), required=["zz"])
    assert tables.read_matrix(spark, str(tmp_path / "t"), ("i",))[1] == ["x"]
    tables.write_table(df.select("i", "s"), str(tmp_path / "c"), "csv")
    assert tables.read_csv(spark, str(tmp_path / "c"), "i long, s string").count() == 2
    text = report.markdown_table(df.orderBy("i"))
    assert "a/b" in text and report.markdown_table(df.limit(0)) == "_Sin datos._"
    assert "<svg" in report.histogram_svg(profile.histogram(df, "x"), "x") and report.correlation_color(5.0) == report.correlation_color(1.0)
    assert "<svg" in report.line_svg([(2, 1.0), (3, 1.0)], "flat")


def test_workflows(spark, tmp_path):
    df = plan.run_dataset(spark, str(tmp_path / "d"), 200)
    analysis = plan.run_analysis(df, str(tmp_path / "a"))
    assignments, summary = plan.run_clustering(df, analysis, str(tmp_path / "c"), ks=(2, 3), n_init=1)
    assert assignments.count() == 200 and summary.agg(F.sum("records")).first()[0] == 200
    per = plan.run_search(df, assignments, summary, str(tmp_path / "s"))
    assert per.count() == 8
    with pytest.raises(ValueError):
        plan.relevance("other")


def test_streaming_scores_like_a_batch(spark, tmp_path):
    from brindle.streaming.scoring import score_rows, score_stream

    df = spark.createDataFrame([(i, float(i % 7), float(i % 3)) for i in range(50)], "id long, a double, b double")
    scaler = features.fit_scaler(df, ("a", "b"))
    centres = np.array([[-1.0, 0.0], [1.0, 0.0]])
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    score_stream(stream, scaler, centres, str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(score_rows(df, scaler, centres)).count() == 0
