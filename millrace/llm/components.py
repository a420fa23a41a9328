"""Connected components of links, by alternating large-star and small-star steps.

Links stay distributed; each round is written to the shared folder and read back. A round groups by
node with partial minima and joins them back, so a hub of very many links is split by the skew join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, ship


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its tree) for the nodes of some links that aren't their own smallest."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of links becomes stars over the same components."""
    for batch in batches:
        if batch.num_rows:
            u, v = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_pydict({"u": pa.array(u), "v": pa.array(v)})


def _stars(e: DataFrame) -> bool:
    """Whether each u has one v, which is no u itself: then every component is a star around its root."""
    nodes = e.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(e.select("v", F.lit(0), F.lit(1)))
    return not nodes.groupBy("id").agg(F.sum("up").alias("ups"), F.max("root").alias("root")).filter("ups > 1 OR ups = 1 AND root = 1").limit(1).collect()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) with the smallest id reachable, for every id that some link names. Ids are long.

    Null and self links are dropped; repeated links do no harm; no links give no rows.
    """
    ship(links.sparkSession)
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter(F.col("u") != F.col("v")).mapInArrow(_local, "u bigint, v bigint")
    e = cut(e.distinct())
    while not _stars(e):
        # Large star: larger neighbours of u move to u's smallest neighbour, u included.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e1 = both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        e1 = cut(e1)
        # Small star: u and its smaller neighbours move to the smallest of them. Here v < u always.
        low = e1.groupBy("u").agg(F.min("v").alias("m"))
        moved = e1.join(low, "u")
        e2 = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").union(low.select("u", F.col("m").alias("v"))).distinct()
        e = cut(e2)
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
