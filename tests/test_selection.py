"""Quantiles, clusterings, silhouettes, components and checked files against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import kmeans, metrics, pca, profile
from brindle.plans.students import evaluate_grid
from brindle.sources import tables

RNG = np.random.default_rng(7)
VALUES = {
    "normal": RNG.normal(size=700),
    "ties": np.repeat([1.0, 2.0, 3.0], [300, 1, 200]),
    "scales": 10.0 ** RNG.uniform(-300, 300, 400) * RNG.choice([-1, 1], 400),
    "one": np.array([3.5]),
    "infinite": np.array([-np.inf] * 3 + list(RNG.normal(size=60)) + [np.inf] * 4),
    "huge": np.array([-1.7e308, 1.7e308, 0, 1, 2, -1.7e308]),
}


@pytest.mark.parametrize("limits", [(4_096, 4_096), (5, 8)])
def test_quantiles_are_exact(spark, monkeypatch, limits):
    monkeypatch.setattr(profile, "FETCHED", limits[0])
    monkeypatch.setattr(profile, "BINS", limits[1])
    n = max(map(len, VALUES.values()))
    rows = [tuple(float(v[i]) if i < len(v) else (None if i % 2 else math.nan) for v in VALUES.values()) + (None,) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in (*VALUES, "nothing")))
    shares = (0, 0.1, 0.25, 0.5, 0.75, 0.999, 1)
    got = profile.quantiles(df, (*VALUES, "nothing"), shares)
    assert got.pop("nothing") == [None] * len(shares)
    for c, found in got.items():
        v = np.sort(VALUES[c])
        for q, value in zip(shares, found, strict=True):
            low, high = v[math.floor(q * (len(v) - 1))], v[math.ceil(q * (len(v) - 1))]
            part = q * (len(v) - 1) - math.floor(q * (len(v) - 1))
            assert value == low if low == high or part == 0 else value == pytest.approx(low + (high - low) * part, rel=1e-12, nan_ok=True)


def test_quantiles_outside_their_first_stretch(spark, monkeypatch):
    monkeypatch.setattr(profile, "RANK_ACCURACY", 4)  # approximate ranks that are far off
    v = np.sort(RNG.normal(size=999))
    df = spark.createDataFrame([(float(x),) for x in v], "a double").repartition(6)
    assert profile.quantiles(df, ("a",), (0.25, 0.5, 0.9))["a"] == pytest.approx([v[249] + 0.5 * (v[250] - v[249]), v[499], v[898] + 0.2 * (v[899] - v[898])])


def test_distinct_counts_of_all_types(spark):
    rows = [(1, 0.0, "a", b"x", [1], True), (1, -0.0, "a", b"y", [1, 2], None), (None, math.nan, None, None, None, False), (2, 2.5, "A", b"x", [1], True)]
    df = spark.createDataFrame(rows, "i int, d double, s string, b binary, l array<int>, f boolean")
    got = {r.variable: (r.dtype, r.null_count, r.null_rate, r.unique_count) for r in profile.column_quality(df).collect()}
    assert got == {"i": ("int", 1, 0.25, 2), "d": ("double", 1, 0.25, 2), "s": ("string", 1, 0.25, 2), "b": ("binary", 1, 0.25, 2), "l": ("array<int>", 1, 0.25, 2), "f": ("boolean", 1, 0.25, 2)}
    empty = {r.variable: (r.null_count, r.null_rate, r.unique_count) for r in profile.column_quality(df.filter("i > 9")).collect()}
    assert empty["i"] == (0, None, 0) and len(empty) == 6


def test_nearest_breaks_ties_as_exact_distances_do():
    x = np.concatenate([RNG.normal(size=(200, 3)), [[0.5, 0, 0], [0, 0.5, 0], [1e8, 1e8, 1e8]]])
    many = [np.array([[0.0, 0, 0], [1, 0, 0], [0, 1, 0]]), np.array([[1e8, 1e8, 1e8 + 1e-6], [1e8, 1e8, 1e8], [2, 2, 2]])]
    at, least = kmeans.nearest(x, np.concatenate(many), np.array([0, 3]))
    for r, centres in enumerate(many):
        d = kmeans.squared_distances(x, centres)
        assert (at[:, r] == d.argmin(axis=1)).all() and (least[:, r] == d.min(axis=1)).all()


def points(spark, n=240):
    x = np.concatenate([RNG.normal(c, 0.4, (n // 4, 2)) for c in ((0, 0), (5, 0), (0, 5), (9, 9))])
    x = np.concatenate([x, np.repeat(x[:1], 30, axis=0)])
    return x, spark.createDataFrame([([float(a), float(b)],) for a, b in x], "x array<double>").repartition(5)


def test_grid_finds_the_groups_and_no_restart_is_better(spark):
    x, df = points(spark)
    best = kmeans.fit_grid(df, range(2, 6), n_init=4)
    assert sorted(best[4].sizes.tolist()) == [60, 60, 60, 90]
    assert all(best[k].inertia > best[k + 1].inertia for k in range(2, 5))
    d = kmeans.squared_distances(x, best[4].centres)
    assert best[4].inertia == pytest.approx(d.min(axis=1).sum())
    alone = kmeans.fit_kmeans(df, 4, n_init=4)
    assert alone.inertia == pytest.approx(best[4].inertia)
    with pytest.raises(ValueError):
        kmeans.fit_kmeans(df.filter("x[0] > 1e9"), 2)
    same = spark.createDataFrame([([1.0, 2.0],)] * 9, "x array<double>")
    assert kmeans.fit_kmeans(same, 3, n_init=2).inertia == 0


def test_farthest_points(spark):
    x, df = points(spark)
    many = [np.array([[0.0, 0]]), np.array([[9.0, 9], [0, 0]])]
    for centres, far in zip(many, kmeans.farthest(df, many, 5), strict=True):
        d = kmeans.squared_distances(x, centres).min(axis=1)
        assert ((far[:, None] - centres) ** 2).sum(axis=2).min(axis=1) == pytest.approx(np.sort(d)[::-1][:5])


@pytest.mark.parametrize("group", [8_192, 40])
def test_silhouettes_of_several_labellings(spark, monkeypatch, group):
    monkeypatch.setattr(metrics, "GROUP", group)
    monkeypatch.setattr(metrics, "BLOCK", 16)
    x, _ = points(spark, 120)
    labels = [RNG.integers(0, 3, len(x)) * 5, np.arange(len(x)) % 2, np.zeros(len(x), int), (np.arange(len(x)) == 3) * 1]
    df = spark.createDataFrame([([float(v) for v in p], *[int(own[i]) for own in labels]) for i, p in enumerate(x)], "x array<double>, a int, b int, c int, d int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    got = metrics.silhouettes(df, ["a", "b", "c", "d"])
    for own, value in zip(labels, got, strict=True):
        ids = sorted(set(own.tolist()))
        if len(ids) < 2:
            assert math.isnan(value)
            continue
        s = []
        for i in range(len(x)):
            mine = own == own[i]
            a = d[i, mine].sum() / (mine.sum() - 1) if mine.sum() > 1 else 0.0
            b = min(d[i, own == c].mean() for c in ids if c != own[i])
            s.append((b - a) / max(a, b) if max(a, b) else 0.0)
        assert value == pytest.approx(np.mean(s), abs=1e-12)
    assert metrics.silhouette_samples(df, cluster="a").count() == len(x)


def test_evaluated_grid(spark):
    x, df = points(spark)
    rows, models = evaluate_grid(df, "r", range(2, 5), 2)
    assert [r[:2] for r in rows] == [("r", 2), ("r", 3), ("r", 4)] and rows[2][2] == pytest.approx(models[4].inertia)
    assert max(rows, key=lambda r: r[3])[1] == 4 and rows[2][8] == len(x)
    quick, _ = evaluate_grid(df, "r", [4], 2, exact=False)
    assert abs(quick[0][3] - rows[2][3]) < 0.2


def test_components_of_nearly_equal_columns(spark):
    a, t, u = RNG.normal(size=500), RNG.normal(size=500), RNG.normal(size=500)
    raw = np.column_stack([a + 1e3, a + 1e-7 * u + 1e3, 2 * t])
    df = spark.createDataFrame([tuple(map(float, r)) for r in raw], "a double, b double, c double").repartition(7)
    model = pca.fit_pca(df, ("a", "b", "c"))
    s = np.linalg.svd(raw - raw.mean(axis=0))[1]
    assert np.sqrt(model.variances * 499) == pytest.approx(s, rel=1e-5)
    assert np.allclose(model.loadings @ model.loadings.T, np.eye(3), atol=1e-14) and np.allclose(model.means, raw.mean(axis=0))
    none = pca.fit_pca(df.filter("a > 1e9"), ("a", "b"))
    assert (none.variances == 0).all() and (none.means == 0).all()


def test_checked_csv(spark, tmp_path):
    (tmp_path / "f.csv").write_text("i,x,s\n1,2.5,a\n2,ten,b\n3,NaN,c\n4,1,d,more\n5\n6,7,\n")
    read = tables.read_csv_checked(spark, str(tmp_path), "i int, x double, s string", ("i", "s"))
    assert sorted(map(tuple, read.good.collect())) == [(1, 2.5, "a"), (3, None, "c"), (6, 7.0, None)]
    assert sorted(r.line for r in read.bad.collect()) == ["2,ten,b", "4,1,d,more", "5"]
    assert [tuple(r) for r in read.report.collect()] == [("f.csv", 6, 3, 3)]
    with pytest.raises(ValueError, match="missing columns"):
        tables.read_csv_checked(spark, str(tmp_path), "i int, x double, s string", ("i", "zz"))


def test_of_equal_clusterings_the_first_by_its_centres(spark):
    """With seven clusters 0 and 2 or 310 and 312 go together, at the same inertia."""
    places = spark.createDataFrame([([float(v)],) for v in (0, 2, 30, 31, 300, 310, 312, 2000, 2030) * 4], "x array<double>")
    for seed in (42, 1, 2, 3):
        model = kmeans.fit_grid(places, [7], seed=seed)[7]
        assert sorted(model.centres[:, 0].tolist()) == [0, 2, 30.5, 300, 311, 2000, 2030] and model.inertia == 10


def test_crowds_of_equal_points_add_no_rounding(spark):
    """Half a million rows at three places are as exact as three weights."""
    places = np.array([0.1, 0.3, 7.7])
    df = spark.range(500_001).select(F.array(F.element_at(F.array(*[F.lit(float(v)) for v in places]), (F.col("id") % 3 + 1).cast("int"))).alias("x"))
    want = 166_667 * ((places[:2] - places[:2].mean()) ** 2).sum()
    rows, _ = evaluate_grid(df, "r", [2], 2)
    assert abs(rows[0][2] / want - 1) < 2e-15 and rows[0][6:9] == (166_667, 333_334, 500_001)
