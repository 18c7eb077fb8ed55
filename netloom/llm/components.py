"""Connected components by alternating large-star and small-star steps in DataFrames; few links are settled at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import stored

FEW = 1 << 18  # links, 4 MB, that the driver settles; a round of stars takes it a dozen jobs, whose plans and tasks cost it far more


def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(low.select("u", F.col("m").alias("v")))


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1, the least node of each one's component."""
    low = np.arange(n)
    while True:
        a, b = low[u], low[v]
        apart = a != b
        if not apart.any():
            return low
        u, v = u[apart], v[apart]
        np.minimum.at(low, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (step := low[low]).tobytes() != low.tobytes():
            low = step


def _at_once(edges: DataFrame) -> DataFrame:
    own = edges.select("u", "v").toArrow()
    nodes, at = np.unique(np.concatenate([own.column(c).to_numpy() for c in "uv"]), return_inverse=True)
    low = forest(*np.split(at, 2), len(nodes))
    rest = np.flatnonzero(low != np.arange(len(low)))
    return edges.sparkSession.createDataFrame(pa.table({"node": nodes[rest], "root": nodes[low[rest]]}), "node long, root long")


def components(edges: DataFrame, label: str = "components", few: int = FEW) -> DataFrame:
    """(node, root) for every node of `edges` (u long, v long) but the roots; a root is the least node of its component.

    No edges: an empty table. Repeated edges and loops do no harm. Each round is written to the shared folder, so a
    lost executor repeats one round at most. More than `few` links never come to the driver.
    """
    now, mark = stored(edges.where("u <> v").distinct(), label), None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"), F.sum(F.xxhash64("v", "u", F.lit(1)).cast("decimal(38,0)")).alias("s")).first()  # of a set: 128 bits of hash
        if tuple(seen) == mark or not seen.n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        if seen.n <= few:
            return stored(_at_once(now), label)
        mark = tuple(seen)
        now = stored(_small(_large(now).distinct()).distinct(), label)
