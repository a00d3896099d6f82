"""Approximate nearest neighbours by balanced posting lists.

Inner product is made a distance by one extra coordinate.  Centroids come from
balanced bisection of a bounded sample, so lists are of like size; a vector goes
to its nearest list and, if it lies on a boundary, to those beyond it too.
Centroids are searched by best-first walks over an in-memory neighbour graph; a
query reads every list whose distance is within a ratio of the nearest one's.
The ratio is fitted: the smallest that finds ``TARGET`` of the true neighbours,
among all rows, of a bounded number of queries; so it narrows as the table
grows and neighbours come nearer.  Lists are scanned by shelves of adjacent
ones: a query goes to a shelf once and leaves it with its best.  Shelves that
turn out large (many equal vectors) are split, and so are the queries of a
shelf, so no task gets a crowd of vectors or of queries of unbounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm._shared import cut, record, schemas, slim, table

TOP = 20
#: Vectors that the centroids are fitted on at most (smallest hashes of ids); all are indexed.
SAMPLE = 20_000
#: Vectors per list aimed at, and centroids at most (they are held in memory; larger lists are split).
LIST, CENTROIDS = 128, 4_096
#: Lists for one vector at most; it lies on a boundary if a list is so little farther than the nearest.
REPLICAS, BOUNDARY = 4, 1.002
#: Share of the true neighbours that the fitted ratio finds, and queries of the fit.
TARGET, FITTED = 0.94, 512
#: A part of a shelf's vectors, and of its queries, at most on average.
PART, QUERIES_PART = 8_192, 16_384
#: Lists that one task scans together, so that a query's best of all of them leave it once.
SHELF = 32


def bisect(x: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of a balanced tree: each node is split in halves along a 2-means direction."""
    rng = np.random.default_rng(11)
    todo, done = [(x, lists)], []
    while todo:
        part, n = todo.pop()
        if n <= 1 or len(part) < 2:
            done.append(part.mean(axis=0))
            continue
        a, b = part[rng.choice(len(part), 2, replace=False)]
        for _ in range(6):
            near = ((part - a) ** 2).sum(1) <= ((part - b) ** 2).sum(1)
            if near.all() or not near.any():
                break
            a, b = part[near].mean(0), part[~near].mean(0)
        order = np.argsort(part @ (b - a), kind="stable")
        cut_at = len(part) * (n // 2) // n
        todo += [(part[order[:cut_at]], n // 2), (part[order[cut_at:]], n - n // 2)]
    return np.array(done)


class Graph:
    """Neighbour graph over centroids with batched best-first search."""

    def __init__(self, centroids: np.ndarray, degree: int = 24) -> None:
        self.c = centroids
        self.square = (centroids**2).sum(1)
        d = self.square[:, None] + self.square[None, :] - 2 * centroids @ centroids.T
        np.fill_diagonal(d, np.inf)
        n = len(centroids)
        near = np.argsort(d, axis=1, kind="stable")[:, : min(degree, n - 1)]
        far = np.random.default_rng(5).integers(0, n, (n, 4))  # a few long edges keep the graph connected
        self.edges = np.concatenate([near, far], axis=1)

    def distances(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.maximum((q**2).sum(1)[:, None] + self.square[ids] - 2 * np.einsum("bd,bkd->bk", q, self.c[ids]), 0.0)

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest centroids of each query found, nearest first; squared distances."""
        n, b = len(self.c), len(q)
        k = min(k, n)
        width = min(n, k + 16)
        ids = np.broadcast_to(np.linspace(0, n - 1, width).astype(np.int64), (b, width)).copy()
        dist = self.distances(q, ids)
        order = np.argsort(dist, axis=1, kind="stable")
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        opened = np.zeros((b, n), bool)
        seen = np.zeros((b, n), bool)
        np.put_along_axis(seen, ids, True, 1)
        rows = np.arange(b)
        while len(rows):
            state = np.take_along_axis(opened[rows], ids[rows], 1)
            live = ~state.all(1)
            rows = rows[live]
            if not len(rows):
                break
            best = ids[rows, np.argmax(~state[live], axis=1)]
            opened[rows, best] = True
            new = self.edges[best]
            d = self.distances(q[rows], new)
            d[seen[rows[:, None], new]] = np.inf
            new_sorted = np.sort(new, axis=1)
            if (new_sorted[:, 1:] == new_sorted[:, :-1]).any():  # an edge twice counts once
                for r in range(len(rows)):
                    _, first = np.unique(new[r], return_index=True)
                    mask = np.ones(new.shape[1], bool)
                    mask[first] = False
                    d[r, mask] = np.inf
            seen[rows[:, None], new] = True
            all_ids = np.concatenate([ids[rows], new], 1)
            all_d = np.concatenate([dist[rows], d], 1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :width]
            ids[rows], dist[rows] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_d, order, 1)
        return ids[:, :k], dist[:, :k]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim).astype(np.float64)


def _lift(x: np.ndarray, scale: float, top: float) -> np.ndarray:
    """Scaled vectors with a coordinate that gives each the norm of the longest."""
    x = x / scale
    return np.concatenate([x, np.sqrt(np.maximum(top - (x**2).sum(1), 0.0))[:, None]], axis=1)


def _ask(x: np.ndarray, scale: float) -> np.ndarray:
    """Queries as points of the space of lists."""
    return np.concatenate([x / scale, np.zeros((len(x), 1))], axis=1)


def _near_lists(ids: np.ndarray, d: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of the lists within a ratio of the nearest (distances are squared)."""
    return np.nonzero(d <= ratio * ratio * d[:, :1] + 1e-12)


def _best(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A task's best ``k`` rows for each of a few queries, of those that reach the query's floor."""
    found, score = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
    for batch in batches:
        for at in range(0, batch.num_rows, 2_048):
            part = batch.slice(at, 2_048)
            own = part.column(0).to_numpy()
            now = q @ _matrix(part.column(1), q.shape[1]).T
            now[(now < floor[:, None]) | (own[None, :] == ids[:, None])] = -np.inf
            found = np.concatenate([found, np.broadcast_to(own, now.shape)], axis=1)
            score = np.concatenate([score, now], axis=1)
            if score.shape[1] > k:
                top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                found, score = np.take_along_axis(found, top, 1), np.take_along_axis(score, top, 1)
    rows, place = np.nonzero(np.isfinite(score))
    yield record(schema, [pa.array(rows, pa.int32()), found[rows, place], score[rows, place]])


def true_neighbours(base: DataFrame, drawn_ids: np.ndarray, drawn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest of all rows of ``FITTED`` queries: queries, then query and vector of each pair.

    The queries are the last of the sample, which holds no other order than that
    of hashes.  A query's k-th best within the sample is a floor of its k-th
    best of all, so tasks send little.  At most ``FITTED * k`` pairs come back.
    """
    spark = base.sparkSession
    ids, q = drawn_ids[-FITTED:], drawn[-FITTED:]
    near = q @ drawn.T
    near[ids[:, None] == drawn_ids[None, :]] = -np.inf
    last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] if near.shape[1] > k else np.full(len(q), -np.inf)
    floor = last - 1e-9 * (1 + np.abs(np.where(np.isfinite(last), last, 0.0)))
    s, a = schemas([], "q int, id long, score double")
    best = base.select("id", "v").mapInArrow(slim(lambda it: _best(it, ids, q, floor, k, a)), s).groupBy("q", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    pairs = best.withColumn("rank", rank).filter(F.col("rank") <= k).select("q", "id").collect()
    wanted = spark.createDataFrame([(x,) for x in {r["id"] for r in pairs}], "id long")
    member = {r["id"]: r["v"] for r in base.join(F.broadcast(wanted), "id").groupBy("id").agg(F.min("v").alias("v")).collect()}
    v = np.array([member[r["id"]] for r in pairs], float).reshape(len(pairs), q.shape[1])
    return q, np.array([r["q"] for r in pairs], np.int64), v


def fit_ratio(graph: Graph, q: np.ndarray, asks: np.ndarray, members: np.ndarray, scale: float, top: float) -> tuple[float, int]:
    """The smallest ratio that finds ``TARGET`` of the pairs of a query ``q[asks[i]]`` and its neighbour ``members[i]``.

    With it, the lists within that ratio for nine of ten queries: what a search looks for first.
    """
    lists = len(graph.c)
    if not len(asks) or lists < 2:
        return 1.0, 1
    every = np.broadcast_to(np.arange(lists), (1, lists))
    far = np.sqrt(np.concatenate([graph.distances(_ask(q[i : i + 1], scale), every) for i in range(len(q))]))
    far /= np.maximum(far.min(axis=1, keepdims=True), 1e-12)
    need = np.full(len(asks), np.inf)
    for at in range(0, len(asks), 512):
        ids, d = graph.search(_lift(members[at : at + 512], scale, top), REPLICAS)
        rows, place = _near_lists(ids, d, BOUNDARY)
        np.minimum.at(need, at + rows, far[asks[at + rows], ids[rows, place]])
    ratio = float(np.quantile(need, TARGET, method="higher"))
    return ratio, int(np.quantile((far <= ratio).sum(axis=1), 0.9)) + 1


def _assign(batches: Iterator[pa.RecordBatch], graph: Graph, dim: int, scale: float, top: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            ids, d = graph.search(_lift(_matrix(part.column(1), dim), scale, top), REPLICAS)
            rows, place = _near_lists(ids, d, BOUNDARY)
            take = pa.array(rows, pa.int32())
            yield record(schema, [pa.array(ids[rows, place], pa.int32()), part.column(0).take(take), part.column(1).take(take)])


def _probe(batches: Iterator[pa.RecordBatch], graph: Graph, dim: int, scale: float, ratio: float, first: int, sizes: np.ndarray, need: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            q = _ask(_matrix(part.column(1), dim), scale)
            left, width = np.arange(len(q)), min(first, len(sizes))
            while len(left):
                ids, d = graph.search(q[left], width)
                # Lists before a list of those used may hold too few vectors.
                enough = np.cumsum(sizes[ids], axis=1) - sizes[ids] < need
                use = (d <= ratio * ratio * d[:, :1] + 1e-12) | enough
                whole = ~use[:, -1] if width < len(sizes) else np.ones(len(left), bool)
                rows, place = np.nonzero(use & whole[:, None])
                asked = ids[rows, place]
                order = np.lexsort((asked, rows))
                rows, asked = rows[order], asked[order]
                shelf = asked // SHELF
                first_of = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (shelf[1:] != shelf[:-1]))[: len(rows)])
                take = pa.array(left[rows[first_of]], pa.int32())
                several = pa.ListArray.from_arrays(pa.array(np.append(first_of, len(rows)), pa.int32()), pa.array(asked, pa.int32()))
                yield record(schema, [pa.array(shelf[first_of], pa.int32()), several.cast(schema.field(1).type), part.column(0).take(take), part.column(1).take(take)])
                left, width = left[~whole], min(2 * width, len(sizes))


def nearest(queries: tuple[np.ndarray, np.ndarray, list[np.ndarray]], vectors: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` largest inner products of each query in the lists it asks, ties to the smaller id; equal vectors score equally.

    Queries are ``(ids, vectors, lists asked)``, vectors ``(ids, vectors, list)``.
    A vector may be in several lists and an id may be repeated: each id counts once.
    """
    qi, q, asked = queries
    vi, v, vl = vectors
    order = np.lexsort((vi, vl))
    vi, v, vl = vi[order], v[order], vl[order]
    lists, first = np.unique(vl, return_index=True)
    edges = np.append(first, len(vl))
    out = []
    for at in range(0, len(q), 256):
        some = asked[at : at + 256]
        row = np.repeat(np.arange(len(some)), [len(x) for x in some])
        each = np.concatenate(some)
        rough = np.full((len(some), len(vl)), -np.inf)
        for n, (a, b) in zip(lists, zip(edges, edges[1:], strict=False), strict=True):
            rows = row[each == n]
            rough[rows, a:b] = q[at + rows] @ v[a:b].T
        rough[vi[None, :] == qi[at : at + 256, None]] = -np.inf
        for i, scores in enumerate(rough, at):
            ok = np.flatnonzero(scores > -np.inf)
            take = k * REPLICAS
            while len(ok):
                s, several = scores[ok], ok
                if len(ok) > take:
                    floor = np.partition(s, len(s) - take)[len(s) - take]
                    several = ok[s >= floor - 1e-9 * (1 + abs(floor))]
                exact = (v[several] * q[i]).sum(axis=1)  # row by row, so the sum's order is the same for equal rows
                best = np.lexsort((vi[several], -exact))
                _, once = np.unique(vi[several][best], return_index=True)
                if len(once) >= k or len(several) == len(ok):
                    best = best[np.sort(once)[:k]]
                    out.append((np.full(len(best), qi[i]), vi[several][best], exact[best]))
                    break
                take *= 4
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def ann_search(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", every: int = 20, k: int = TOP, sample: int = SAMPLE) -> DataFrame:
    """The ``k`` nearest by inner product of each vector whose key is divisible by ``every``.

    Columns: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (the inner
    product in double precision).  Candidates are all rows but those with the
    query's own key; ties go to the smaller key.

    Vectors that are null, zero, of another length than most valid ones (of
    lengths equally frequent, the smaller counts), or hold null or non-finite components take no part, nor do null keys.
    Repeated rows of one key are one candidate.  With fewer than ``k``
    candidates all are given; an empty table gives an empty one; other columns
    are ignored.
    """
    spark = vectors.sparkSession
    good = F.col("v").isNotNull() & F.expr("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))") & F.expr("exists(v, x -> x <> 0)")
    base = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{column}`").alias("v")).filter(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))
    final, _ = schemas([], "query_id long, rank int, vec_id long, score double")
    shape = base.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if shape is None:
        return spark.createDataFrame([], final)
    dim = shape["dim"]
    base = base.filter(F.size("v") == dim)
    stats = base.agg(F.count(F.lit(1)).alias("n"), F.max(F.expr("array_max(transform(v, x -> abs(double(x))))")).alias("scale")).first()
    n, scale = stats["n"], float(stats["scale"])
    top = float(base.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x.cast("double") / scale) * (x.cast("double") / scale)))).first()[0])
    sampled = base.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "v").collect()
    drawn_ids, drawn = np.array([r["id"] for r in sampled], np.int64), np.array([r["v"] for r in sampled], float)
    lists = int(min(max(1, -(-n // LIST)), CENTROIDS, max(1, len(drawn) // 4)))
    graph = Graph(bisect(_lift(drawn, scale, top), lists))
    ratio, first = fit_ratio(graph, *true_neighbours(base, drawn_ids, drawn, k), scale, top)
    kind = base.schema["v"].dataType.simpleString()
    s1, a1 = schemas([], f"list int, id long, v {kind}")
    posted = cut(base.select("id", "v").mapInArrow(slim(lambda it: _assign(it, graph, dim, scale, top, a1)), s1), "posted")
    sizes = np.zeros(len(graph.c), np.int64)
    for r in posted.groupBy("list").count().collect():  # one row per centroid
        sizes[r["list"]] = r["count"]
    shelves = -(-len(sizes) // SHELF)
    s4, a4 = schemas([], f"shelf int, lists array<int>, id long, v {kind}")
    asked = cut(base.filter(F.col("id") % every == 0).mapInArrow(slim(lambda it: _probe(it, graph, dim, scale, ratio, first, sizes, 8 * k * REPLICAS, a4)), s4), "asked")
    crowd = np.zeros(shelves, np.int64)
    for r in asked.groupBy("shelf").count().collect():  # one row per shelf
        crowd[r["shelf"]] = r["count"]
    stock = np.add.reduceat(sizes, np.arange(0, len(sizes), SHELF))
    parts, crowds = -(-stock // PART), -(-crowd // QUERIES_PART)
    shelf = F.floor(F.col("list") / SHELF).cast("int")
    of = lambda values: F.element_at(F.array(*[F.lit(int(max(1, x))) for x in values]), shelf + 1) if len(set(values.tolist()) | {1}) > 1 else F.lit(1)
    left = posted.select(shelf.alias("shelf"), "list", "id", "v", F.pmod(F.xxhash64("id"), of(parts)).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), (of(crowds) - 1).cast("int"))).alias("c"))
    asks = asked.withColumn("list", F.col("shelf") * SHELF)
    right = asks.select("shelf", "lists", "id", "v", F.explode(F.sequence(F.lit(0), (of(parts) - 1).cast("int"))).alias("p"), F.pmod(F.xxhash64("id"), of(crowds)).cast("int").alias("c"))
    s2, a2 = schemas([], "query_id long, vec_id long, score double")

    def scan(vectors_: pa.Table, queries: pa.Table) -> pa.Table:
        """Each query's best of the lists it asked here."""
        if not vectors_.num_rows or not queries.num_rows:
            return a2.empty_table()
        several = queries.column("lists").combine_chunks()
        asked_ = np.split(several.flatten().to_numpy(), np.cumsum(several.value_lengths().to_numpy())[:-1])
        get = lambda t: (t.column("id").to_numpy(), _matrix(t.column("v").combine_chunks(), dim))
        best = nearest((*get(queries), asked_), (*get(vectors_), vectors_.column("list").to_numpy()), k)
        return pa.Table.from_arrays([pa.array(x) for x in best], schema=a2)

    keys = ["shelf", "p", "c"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, s2)
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_search(table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_ann_search": op2_ann_search}
ORACLE: dict[str, str] = {}
