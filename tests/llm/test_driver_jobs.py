"""What the driver keeps of jobs: few links are settled at once and small sketches come by one job."""

import uuid

import numpy as np
import pytest

from netloom.llm import repeats
from netloom.llm.components import components


def jobs(spark, make):
    """(what make returns, number of jobs it ran)"""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        return make(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def links():
    rng = np.random.default_rng(5)
    nodes = rng.integers(-(1 << 63), (1 << 63) - 1, 700)
    some = [(int(nodes[a]), int(nodes[b])) for a, b in rng.integers(0, 700, (420, 2))]
    path = [(-k, -k - 1) for k in range(60)]
    return [*some, *path, *some[:20], (7, 7), (8, 8)]


def by_hand(edges):
    low = {x: x for e in edges for x in e}
    while any(low[a] != low[b] for a, b in edges):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    return {x: y for x, y in low.items() if x != y}


@pytest.mark.parametrize("few", [1 << 18, 0])
def test_components_at_once_and_by_stars(spark, few):
    edges = links()
    got, ran = jobs(spark, lambda: components(spark.createDataFrame(edges, "u long, v long"), few=few).collect())
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.root for r in got} == by_hand(edges)
    assert ran <= 12 or not few


@pytest.mark.parametrize("edges", [[], [(3, 3)], [(2, -1)]])
def test_components_of_little(spark, edges):
    got = components(spark.createDataFrame(edges, "u long, v long"))
    assert got.dtypes == [("node", "bigint"), ("root", "bigint")]
    assert [tuple(r) for r in got.collect()] == ([(2, -1)] if (2, -1) in edges else [])


def test_small_sketch_comes_by_one_job(spark, monkeypatch):
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = spark.range(0, 3000).selectExpr("id % 2000 AS th")
        sketch, ran = jobs(spark, lambda: repeats.count_min(rows, lambda x: x, 1 / 8, 1 << 20, "th"))
        monkeypatch.setattr(repeats, "AT_ONCE", 0, raising=False)
        again = repeats.count_min(rows, lambda x: x, 1 / 8, 1 << 20, "th")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert ran <= 8
    assert all(np.array_equal(a, b) for a, b in zip(sketch.rows, again.rows, strict=True))
    keys = np.arange(2000, dtype=np.uint64)
    assert sketch.repeated(keys)[:1000].all() and not sketch.repeated(keys)[1000:].all()
