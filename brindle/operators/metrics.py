"""Internal quality of clusterings: sizes, inertia, silhouette, Calinski-Harabasz, Davies-Bouldin.

Points are rows ``(x array<double>, cluster int)``; clusters are keyed by id, so
gaps in the ids do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.kmeans import _matrix
from brindle.sources.shared import written

#: Points of a group in the exact silhouette, and of a block whose distances are held at once.
GROUP, BLOCK = 8_192, 1_024


def cluster_sizes(points: DataFrame, cluster: str = "cluster") -> DataFrame:
    return points.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Summary:
    """One labelling: its cluster ids in order and, by cluster, rows, mean, sum of squared distances and mean distance to the mean."""

    ids: np.ndarray
    n: np.ndarray
    means: np.ndarray
    square: np.ndarray
    distance: np.ndarray

    @property
    def inertia(self) -> float:
        return float(self.square.sum())

    @property
    def calinski_harabasz(self) -> float:
        """(B / (k - 1)) / (W / (n - k)); infinite without spread, NaN for one cluster or n <= k."""
        n, k = int(self.n.sum()), len(self.ids)
        if k <= 1 or k >= n:
            return math.nan
        centre = self.n @ self.means / n
        between = float((self.n * ((self.means - centre) ** 2).sum(axis=1)).sum())
        return math.inf if self.inertia == 0 else (between / (k - 1)) / (self.inertia / (n - k))

    @property
    def davies_bouldin(self) -> float:
        """Mean over clusters of the worst (scatter + scatter) / distance; infinite for equal centres, NaN for one cluster."""
        if len(self.ids) <= 1:
            return math.nan
        far = np.sqrt(((self.means[:, None] - self.means[None]) ** 2).sum(axis=2))
        ratio = np.divide(self.distance[:, None] + self.distance, far, out=np.full_like(far, math.inf), where=far > 0)
        np.fill_diagonal(ratio, -math.inf)
        return float(ratio.max(axis=1).mean())


def _labels(points: DataFrame, labels: Sequence[str]) -> list[np.ndarray]:
    """The cluster ids of each labelling: k rows each on the driver."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("long").alias("c")) for i, c in enumerate(labels)])).alias("p")
    rows = points.select(pairs).select("p.*").filter("c IS NOT NULL").distinct().collect()
    return [np.array(sorted(r["c"] for r in rows if r["i"] == i), np.int64) for i in range(len(labels))]


def _cells(points: DataFrame, x: str, labels: Sequence[str], ids: Sequence[np.ndarray], weight: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """``x``, the places of each row's clusters when all labellings' clusters stand one after the other, and its weight ``n``."""
    base = np.cumsum([0, *[len(i) for i in ids]])
    place = [F.array_position(F.array(*[F.lit(int(v)) for v in own]), F.col(f"`{c}`").cast("long")) - 1 + int(base[i]) if len(own) else F.lit(None).cast("long") for i, (c, own) in enumerate(zip(labels, ids, strict=True))]
    return points.select(F.col(f"`{x}`").alias("x"), F.array(*[p.cast("int") for p in place]).alias("c"), (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("n")), base


def summaries(points: DataFrame, labels: Sequence[str], x: str = "x", weight: str | None = None) -> list[Summary]:
    """Sizes, means and spreads of the clusters of several labellings, all of them in the same passes; ``weight``: rows of a point."""
    ids = _labels(points, labels)
    rows, base = _cells(points, x, labels, ids, weight)
    k = int(base[-1])
    first = rows.select(F.size("x")).first()
    p = first[0] if first else 0
    n, means, square, distance = np.zeros(k), np.zeros((k, p)), np.zeros(k), np.zeros(k)

    def gathered(run, schema: str, values: int) -> list:
        sums = [F.sum(F.col("v")[j]) for j in range(values)]
        return rows.mapInArrow(run, schema).groupBy("c").agg(F.sum("n").alias("n"), F.array(*sums).alias("v")).collect()

    def totals(batches):
        size, total = np.zeros(k), np.zeros((k, p))
        for v, c, w in _points(batches, p):
            for own in c.T:
                size += np.bincount(own, w, minlength=k)
                np.add.at(total, own, v * w[:, None])
        yield pa.RecordBatch.from_pydict({"c": np.arange(k, dtype=np.int32), "n": size, "v": list(total)})

    def spreads(batches):
        out = np.zeros((k, 2))
        for v, c, w in _points(batches, p):
            for own in c.T:
                far = ((v - means[own]) ** 2).sum(axis=1)
                out[:, 0] += np.bincount(own, far * w, minlength=k)
                out[:, 1] += np.bincount(own, np.sqrt(far) * w, minlength=k)
        yield pa.RecordBatch.from_pydict({"c": np.arange(k, dtype=np.int32), "n": np.zeros(k), "v": list(out)})

    if k:
        for r in gathered(totals, "c int, n double, v array<double>", p):
            n[r["c"]], means[r["c"]] = r["n"], np.array(r["v"]) / r["n"]
        for r in gathered(spreads, "c int, n double, v array<double>", 2):
            square[r["c"]], distance[r["c"]] = r["v"][0], r["v"][1] / n[r["c"]]
    return [Summary(own, n[a:z], means[a:z], square[a:z], distance[a:z]) for own, a, z in zip(ids, base, base[1:], strict=False)]


def _points(batches: Iterator[pa.RecordBatch], p: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield _matrix(batch.column(0), p), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1), batch.column(2).to_numpy(zero_copy_only=False).astype(float)


def inertia(points: DataFrame, x: str = "x", cluster: str = "cluster") -> float:
    """Sum of squared distances to cluster means."""
    return summaries(points, [cluster], x)[0].inertia


def calinski_harabasz(points: DataFrame, x: str = "x", cluster: str = "cluster") -> float:
    return summaries(points, [cluster], x)[0].calinski_harabasz


def davies_bouldin(points: DataFrame, x: str = "x", cluster: str = "cluster") -> float:
    return summaries(points, [cluster], x)[0].davies_bouldin


def distances(a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Euclidean distances: from one matrix product, and from differences where that would cancel digits."""
    norms = (a * a).sum(axis=1)[:, None] + (z * z).sum(axis=1)
    square = norms - 2.0 * (a @ z.T)
    i, j = np.nonzero(square < 1e-3 * norms)
    for start in range(0, len(i), 1 << 16):
        at = slice(start, start + (1 << 16))
        square[i[at], j[at]] = ((a[i[at]] - z[j[at]]) ** 2).sum(axis=1)
    return np.sqrt(np.maximum(square, 0.0))


def _silhouettes(points: DataFrame, labels: Sequence[str], x: str, ids: Sequence[np.ndarray], weight: str | None = None) -> DataFrame:
    """``n, c, v``: different points with their number of rows, places of their clusters and silhouettes, by labelling.

    Points are dealt to groups, and each pair of groups is a cell with one matrix
    of distances, which serves the points of both.  A group goes to the cells of
    its row and column: with G groups there are G (G + 1) / 2 cells and a point
    travels to G of them.  Only sums of distances by cluster leave a cell.
    """
    rows, base = _cells(points, x, labels, ids, weight)
    k = int(base[-1])
    # Equal points of equal clusters are one point with a weight, so a crowd of them is one row.
    made = written(rows.groupBy("x", "c").agg(F.sum("n").alias("n")), "points")
    groups = max(1, -(-made.count() // GROUP))
    packed = made.withColumn("g", F.pmod(F.xxhash64("x", "c"), F.lit(groups)).cast("int")).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("x", "c", "n"))).alias("v"))
    cells = packed.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(F.least("g", "h").alias("i"), F.greatest("g", "h").alias("j"), "g", "v")

    def unpacked(cell: pa.StructScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = cell.field("n").to_numpy()
        weight = np.zeros((len(n), k))
        own = cell.field("c").flatten().to_numpy().reshape(len(n), -1)
        np.put_along_axis(weight, own, n[:, None].astype(float), axis=1)
        return cell.field("x").flatten().to_numpy().reshape(len(n), -1), weight, own

    def run(table: pa.Table) -> pa.Table:
        sides = [(g, *unpacked(v.values), v.values) for g, v in zip(table["g"].to_pylist(), table["v"], strict=True)]
        (_, a, wa, _, _), (_, z, wz, _, _) = sides[0], sides[-1]
        out = [np.zeros((len(a), k)), np.zeros((len(z), k))]
        for i in range(0, len(a), BLOCK):
            for j in range(0, len(z), BLOCK):
                d = distances(a[i : i + BLOCK], z[j : j + BLOCK])
                out[0][i : i + BLOCK] += d @ wz[j : j + BLOCK]
                if len(sides) > 1:
                    out[1][j : j + BLOCK] += d.T @ wa[i : i + BLOCK]
        parts = [pa.table({"g": pa.array([g] * len(x), pa.int32()), "at": pa.array(range(len(x)), pa.int32()), "c": v.field("c"), "n": v.field("n"), "s": pa.array(list(s), pa.list_(pa.float64()))}) for (g, x, _, _, v), s in zip(sides, out, strict=False)]
        return pa.concat_tables([t.cast(parts[0].schema) for t in parts])

    sums = cells.groupBy("i", "j").applyInArrow(run, "g int, at int, c array<int>, n long, s array<double>")
    sums = sums.groupBy("g", "at").agg(F.first("c").alias("c"), F.first("n").alias("n"), F.array(*[F.sum(F.col("s")[j]) for j in range(k)]).alias("s"))
    sizes = np.zeros(k)
    for r in made.select("n", F.explode("c").alias("c")).groupBy("c").agg(F.sum("n").alias("n")).collect():
        sizes[r["c"]] = r["n"]

    def values(batches):
        for batch in batches:
            s = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            own = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            out, at = np.empty(own.shape), np.arange(len(own))
            for l, (a, z) in enumerate(zip(base, base[1:], strict=False)):
                mine = own[:, l]
                alone = sizes[mine] <= 1
                inner = np.where(alone, 0.0, s[at, mine] / np.maximum(sizes[mine] - 1, 1))
                means = s[:, a:z] / sizes[a:z]
                means[at, mine - a] = math.inf
                outer = means.min(axis=1)
                top = np.maximum(inner, outer)
                out[:, l] = np.divide(outer - inner, top, out=np.zeros(len(top)), where=(top > 0) & np.isfinite(top))
            yield pa.RecordBatch.from_pydict({"n": batch.column(0), "c": batch.column(1), "v": pa.array(list(out), pa.list_(pa.float64()))})

    return sums.select("n", "c", "s").mapInArrow(values, "n long, c array<int>, v array<double>")


def silhouettes(points: DataFrame, labels: Sequence[str], x: str = "x", weight: str | None = None) -> list[float]:
    """Exact mean silhouette of each of several labellings of the same points, from the same distances.

    NaN for under two clusters or as many clusters as points.
    """
    ids = _labels(points, labels)
    total = points.count() if weight is None else points.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    some = [i for i, own in enumerate(ids) if 2 <= len(own) < total]
    out = [math.nan] * len(labels)
    if some:
        found = _silhouettes(points, [labels[i] for i in some], x, [ids[i] for i in some], weight)
        row = found.agg(*[(F.sum(F.col("n") * F.col("v")[j]) / F.sum("n")).alias(str(j)) for j in range(len(some))]).first()
        for j, i in enumerate(some):
            out[i] = float(row[j])
    return out


def silhouette_samples(points: DataFrame, x: str = "x", cluster: str = "cluster") -> DataFrame:
    """Exact Euclidean silhouette of each point: ``cluster``, ``silhouette``.

    A point alone in its cluster has a = 0.  All distances of different points
    are needed, so the work is quadratic; see :func:`_silhouettes`.
    """
    ids = _labels(points, [cluster])
    if not 2 <= len(ids[0]) < points.count():
        return points.select(F.col(cluster).alias("cluster"), F.lit(None).cast("double").alias("silhouette"))
    names = F.array(*[F.lit(int(v)) for v in ids[0]])
    found = _silhouettes(points, [cluster], x, ids)
    return found.select(F.get(names, F.col("c")[0]).cast("int").alias("cluster"), F.col("v")[0].alias("silhouette"), F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("cluster", "silhouette")


def silhouette(points: DataFrame, x: str = "x", cluster: str = "cluster") -> float:
    """Mean silhouette; NaN for under two clusters or as many clusters as points."""
    return silhouettes(points, [cluster], x)[0]


def centroid_silhouette(points: DataFrame, x: str = "x", cluster: str = "cluster", weight: str | None = None) -> float:
    """An approximation in one pass, for large tables: distances to cluster means instead of to points."""
    found = summaries(points, [cluster], x, weight)[0]
    ids, centres = found.ids, found.means
    if len(ids) < 2:
        return math.nan

    def run(batches):
        for batch in batches:
            v = _matrix(batch.column(0), centres.shape[1])
            if not len(v):
                continue
            own = np.searchsorted(ids, batch.column(1).to_numpy(zero_copy_only=False))
            d = np.stack([np.sqrt(((v - c) ** 2).sum(axis=1)) for c in centres], axis=1)
            a = d[np.arange(len(d)), own].copy()
            d[np.arange(len(d)), own] = np.inf
            b = d.min(axis=1)
            top = np.maximum(a, b)
            yield pa.RecordBatch.from_pydict({"s": np.divide(b - a, top, out=np.zeros(len(a)), where=top > 0), "n": batch.column(2)})

    n = (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("n")
    return float(points.select(x, cluster, n).mapInArrow(run, "s double, n long").agg(F.sum(F.col("s") * F.col("n")) / F.sum("n")).first()[0])
