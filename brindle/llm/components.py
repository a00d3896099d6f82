"""Connected components of a link table, without gathering it anywhere.

Each task contracts the links it holds to stars around their smallest nodes.
While a node has different roots in different stars, rounds of smallest roots
join what the tasks could not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm._shared import cut, forget, record, schemas, slim

#: Links that one task contracts, on average.
LINKS = 1_000_000


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of each one's component."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        new = new[root]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _contract(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if held:
        yield record(schema, contract(*(np.concatenate(x) for x in zip(*held, strict=True))))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``links``; the root is its component's smallest node.

    Minima combine before they are shuffled, so a node with very many links
    does not meet in one task.  An empty table gives an empty one.
    """
    spark_schema, arrow = schemas([], "node long, root long")
    held = cut(links.select(a, b), "links")
    tasks = max(1, -(-held.count() // LINKS))
    stars = cut(held.coalesce(tasks).mapInArrow(slim(lambda it: _contract(it, arrow)), spark_schema), "stars")
    forget(held)
    return merge(stars)


def merge(stars: DataFrame) -> DataFrame:
    """Stars with one root for every node: rounds of the smallest root among the neighbours, then one step along the roots."""
    torn = stars.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    if not torn.limit(1).count():
        return stars
    both = cut(stars.select(F.col("node").alias("x"), F.col("root").alias("y")).union(stars.select("root", "node")).distinct(), "links")
    roots = cut(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y")).select("node", F.least("node", "y").alias("root")), "roots")
    while True:
        near = both.join(roots, both["y"] == roots["node"]).groupBy("x").agg(F.min("root").alias("low"))
        lower = roots.join(near, roots["node"] == near["x"], "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("low", "root")).alias("root"))
        hop = roots.select(F.col("node").alias("at"), F.col("root").alias("further"))
        new = cut(lower.join(hop, lower["root"] == hop["at"], "left").select("node", "old", F.least("root", F.coalesce("further", "root")).alias("root")), "roots")
        changed = new.filter(F.col("old") != F.col("root")).limit(1).count()
        forget(roots)
        roots = new.select("node", "root")
        if not changed:
            forget(both, stars)
            return roots
