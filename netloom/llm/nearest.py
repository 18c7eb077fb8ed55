"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample; clusters that hold too much of the sample are split, so lists are balanced.
A graph over the centroids, held in memory, is searched best-first for the centroids near a vector. Each vector is
posted to the near centroids whose distance is within REPLICATE times the nearest one's, REPLICAS at most (boundary
vectors so live in several lists). A query reads the lists whose
centroid lies within PROBE times its nearest centroid's distance, and goes on to farther ones until the lists are sure to
hold k other vectors; so it gets k answers wherever there are k candidates. Lists are read in chunks of at most CHUNK vectors,
each by a task of its own, and every chunk of a chosen list is read: no list is cut short.

Equal vectors are posted once, with the k + 1 smallest of their ids, which is all that any answer can use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm.common import partitions, stored, table

SAMPLE = 1 << 16  # vectors that the centroids are fitted on, at most
LIST, MOST_LISTS = 256, 1 << 12  # vectors in a list as aimed at, and centroids at most
DEGREE, BEAM, REPLICAS = 24, 24, 4
LEAST_STEPS = 14  # nodes that a search expands even beyond the ratio, so that it doesn't end in a local minimum
REPLICATE, PROBE = 1.04, 1.17  # distance ratios
CHUNK = 1 << 14


def _scaled(x: np.ndarray) -> np.ndarray:
    """In double precision, by a power of two that keeps squares in range; angles stay exactly as they are."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[k : k + 8192] @ centers.T - half, axis=1) for k in range(0, len(x), 8192)])


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k-means, then clusters above twice the mean size are split in two until none is left or it can't be split."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), k, replace=False)].copy()

    def means(x: np.ndarray, own: np.ndarray, centers: np.ndarray) -> np.ndarray:
        count = np.bincount(own, minlength=len(centers))
        order = np.argsort(own, kind="stable")
        some = np.flatnonzero(count)
        centers[some] = np.add.reduceat(x[order], (np.cumsum(count) - count)[some], axis=0) / count[some, None]
        empty = np.flatnonzero(count == 0)
        centers[empty] = x[rng.choice(len(x), len(empty))]
        return centers

    for _ in range(rounds):
        centers = means(x, _nearest(x, centers), centers)
    for _ in range(6):
        own = _nearest(x, centers)
        count = np.bincount(own, minlength=len(centers))
        large = np.flatnonzero(count > 2 * len(x) / len(centers))
        new = []
        for c in large:
            part = x[own == c]
            two = part[rng.choice(len(part), 2, replace=False)].copy()
            for _ in range(4):
                two = means(part, _nearest(part, two), two)
            if not np.array_equal(two[0], two[1]):
                centers[c] = two[0]
                new.append(two[1])
        if not new:
            break
        centers = np.vstack([centers, new])
    return centers


class CentroidGraph:
    """Centroids, each linked to its nearest ones and a few far ones; search() is best-first with a beam."""

    def __init__(self, centers: np.ndarray, seed: int = 6):
        k = len(centers)
        rng = np.random.default_rng(seed)
        self.centers = centers
        self.square = (centers**2).sum(axis=1)
        degree = min(DEGREE, k)
        self.links = np.empty((k, degree), np.int32)
        for a in range(0, k, 2048):
            d = self.square - 2 * centers[a : a + 2048] @ centers.T
            self.links[a : a + 2048] = np.argsort(d, axis=1, kind="stable")[:, :degree]
        self.links[:, degree - min(4, degree // 4) :] = rng.integers(0, k, (k, min(4, degree // 4))) if degree >= 4 else self.links[:, degree:]
        self.entry = rng.choice(k, min(16, k), replace=False).astype(np.int32)

    def search(self, x: np.ndarray, ratio: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, distance), nearest first, at most `beam` of each row of x; -1 fills up. Nodes within `ratio` of
        the nearest so far are expanded, nearest first."""
        n, k = len(x), len(self.centers)
        beam = min(beam, k)
        seen = np.zeros((n, k), bool)
        ids = np.tile(self.entry[: min(len(self.entry), beam)], (n, 1))
        rows = np.arange(n)[:, None]
        seen[rows, ids] = True
        dist = self._far(x, ids)
        done = np.zeros(ids.shape, bool)
        steps = 0
        while True:
            score = np.where(done, np.inf, dist)
            pick = np.argmin(score, axis=1)
            best = score[np.arange(n), pick]
            live = np.flatnonzero(np.isfinite(best) & ((best <= dist.min(axis=1) * ratio**2) | (steps < LEAST_STEPS)))
            steps += 1
            if not len(live):
                break
            done[live, pick[live]] = True
            near = self.links[ids[live, pick[live]]]
            fresh = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            fresh &= np.sort(near, axis=1)[:, :1] >= 0
            order = np.argsort(near, axis=1, kind="stable")
            sorted_ = np.take_along_axis(near, order, 1)
            again = np.zeros(near.shape, bool)
            np.put_along_axis(again, order[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], 1)
            d = np.where(fresh & ~again, self._far(x[live], near), np.inf)
            all_ids = np.hstack([ids[live], near])
            all_dist = np.hstack([dist[live], d])
            all_done = np.hstack([done[live], np.zeros(near.shape, bool)])
            best = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
            if best.shape[1] > ids.shape[1]:
                grow = best.shape[1] - ids.shape[1]
                ids = np.hstack([ids, np.zeros((n, grow), np.int32)])
                dist = np.hstack([dist, np.full((n, grow), np.inf, dist.dtype)])
                done = np.hstack([done, np.ones((n, grow), bool)])
            ids[live], dist[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_dist, best, 1)
            done[live] = np.take_along_axis(all_done, best, 1) | ~np.isfinite(dist[live])
        order = np.argsort(dist, axis=1, kind="stable")
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        return np.where(np.isfinite(dist), ids, -1), np.sqrt(np.maximum(dist, 0))

    def _far(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return (x**2).sum(axis=1)[:, None] + self.square[ids] - 2 * np.einsum("nd,nkd->nk", x, self.centers[ids])

    def lists(self, x: np.ndarray) -> Iterator[list[int]]:
        """The centroids that each vector is posted to."""
        ids, dist = self.search(x, REPLICATE, BEAM)
        near = ((ids >= 0) & (dist <= dist[:, :1] * REPLICATE))[:, :REPLICAS]
        for row, some in zip(ids, near, strict=True):
            yield row[: len(some)][some].tolist()

    def probes(self, x: np.ndarray, sizes: np.ndarray, least: int) -> Iterator[list[int]]:
        """The centroids whose lists a query reads: those within PROBE, and more until they hold `least` vectors."""
        ids, dist = self.search(x, PROBE, len(self.centers))
        own = np.where(ids >= 0, sizes[ids], 0)
        held = np.cumsum(own, axis=1)
        chosen = (ids >= 0) & ((dist <= dist[:, :1] * PROBE) | (held - own < least)) & (own > 0)
        few = np.flatnonzero(held[:, -1] < least)
        rest = {}
        if len(few):  # the search met too few lists: all centroids, nearest first
            order = np.argsort(self.square - 2 * x[few] @ self.centers.T, axis=1, kind="stable")
            own = sizes[order]
            wanted = (np.cumsum(own, axis=1) - own < least) & (own > 0)
            rest = {int(k): row[some].tolist() for k, row, some in zip(few, order, wanted, strict=True)}
        for k, (row, some) in enumerate(zip(ids, chosen, strict=True)):
            yield sorted({*row[some].tolist(), *rest.get(k, ())})


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _posted(rows: DataFrame, graph, dim: int, sizes: np.ndarray | None = None, least: int = 0) -> DataFrame:
    """Each row once for every list that its vector is posted to or, given the lists' sizes, that a query reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                b = whole.slice(a, 512)
                x = _unit(_vectors(b.column("vector"), dim))
                own = list(graph.value.lists(x) if sizes is None else graph.value.probes(x, sizes, least))
                row = np.repeat(np.arange(b.num_rows), [len(o) for o in own])
                t = pa.Table.from_batches([b]).take(pa.array(row)).append_column("list", pa.array([c for o in own for c in o], pa.int32()))
                yield from t.combine_chunks().to_batches()

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", list int")


def nearest(vectors: DataFrame, queries: F.Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `queries` selects, the k nearest found by cosine, in double
    precision on the original vectors, the query's own id left out; ties go to the smaller id.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor
    do rows without an id. Repeated rows count once. Fewer than k others: all of them. An empty table, or no queries:
    no rows. Other columns are ignored. Components stay float or double as they come.
    """
    spark = vectors.sparkSession
    n = partitions(spark)
    vector = F.col(f"`{vector_col}`")
    kind = "array<float>" if vectors.select(vector).dtypes[0][1] == "array<float>" else "array<double>"
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.cast(kind).alias("vector"), queries.alias("asks")).where(F.col("id").isNotNull() & vector.isNotNull() & fine)
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes[0]["dim"]
    rows = rows.where(F.size("vector") == dim)
    same = Window.partitionBy(F.xxhash64("vector"), "vector")
    first = rows.select("id", "vector", F.dense_rank().over(same.orderBy("id")).alias("place")).where(F.col("place") <= k + 1)
    items = stored(first.groupBy(F.xxhash64("vector").alias("key"), "vector").agg(F.array_sort(F.collect_set("id")).alias("ids")).select("ids", "vector"), "vectors")
    total = items.count()
    sample = items.orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).select("vector").toPandas()
    x = _unit(np.stack(sample["vector"].to_numpy()))
    lists = max(1, min(MOST_LISTS, total // LIST, len(x) // 8))
    graph = spark.sparkContext.broadcast(CentroidGraph(balanced_centroids(x, lists)))
    posted = stored(_posted(items, graph, dim), "postings")
    sizes = {r["list"]: r["n"] for r in posted.groupBy("list").agg(F.count("*").alias("n")).collect()}  # one row per centroid
    own_sizes = np.array([sizes.get(c, 0) for c in range(len(graph.value.centers))], np.int64)
    chunks = F.array(*(F.lit(-(-sizes.get(c, 0) // CHUNK)) for c in range(len(graph.value.centers))))
    asked = rows.where("asks")
    distinct = asked.groupBy(F.xxhash64("vector").alias("key"), "vector").agg(F.min("id").alias("q")).select("q", "vector")
    probed = _posted(distinct.repartition(n, "q"), graph, dim, own_sizes, REPLICAS * (k + 1))  # a vector is in REPLICAS lists at most, so k + 1 differ
    left = probed.withColumn("chunk", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.get(chunks, F.col("list"))))))
    right = posted.withColumn("chunk", F.pmod(F.xxhash64("vector"), F.greatest(F.lit(1), F.get(chunks, F.col("list")))).cast("int") + 1)

    def compare(_key, asks: pa.Table, own: pa.Table) -> pa.Table:
        q, score, ids = [], [], []
        if asks.num_rows and own.num_rows:
            a = _scaled(_vectors(asks.column("vector").combine_chunks(), dim))
            b = _scaled(_vectors(own.column("vector").combine_chunks(), dim))
            na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
            names, who = own.column("ids").to_pylist(), asks.column("q").to_pylist()
            low = np.array([x[0] for x in names])
            most = min(len(b), 2 * (k + 1))
            for s in range(0, len(a), 256):
                near = (a[s : s + 256] @ b.T) / nb
                top = np.argpartition(-near, most - 1, axis=1)[:, :most]
                for r, t in enumerate(top):
                    exact = (a[s + r] * b[t]).sum(axis=1) / (na[s + r] * nb[t])
                    edge = near[r][t].min()  # what ties with the last of them is looked at as well
                    if most < len(b) and (also := np.flatnonzero(near[r] >= edge - 1e-12 * abs(edge))).size > most:
                        t = also
                        exact = (a[s + r] * b[t]).sum(axis=1) / (na[s + r] * nb[t])
                    for j in np.lexsort((low[t], -exact))[: k + 1]:
                        q.append(who[s + r])
                        score.append(float(exact[j]))
                        ids.append(names[t[j]])
        return pa.table({"q": pa.array(q, pa.int64()), "score": pa.array(score, pa.float64()), "ids": pa.array(ids, pa.list_(pa.int64()))})

    found = left.groupBy("list", "chunk").cogroup(right.groupBy("list", "chunk")).applyInArrow(compare, "q long, score double, ids array<long>")
    each = found.select("q", "score", F.explode("ids").alias("vec_id")).groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = each.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    who = asked.select("id", "vector").distinct().join(distinct, "vector").select(F.col("id").alias("query_id"), "q")
    answer = who.join(top, "q").where("query_id <> vec_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answer.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
