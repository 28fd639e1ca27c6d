"""Graphs above the bound of a packed run."""

import pytest
from pyspark.sql import functions as F

from groundwalk.operators import exact
from groundwalk.operators import graph as g
from groundwalk.operators import rank as r
from groundwalk.plans import results


def test_above_the_packed_bound(spark, monkeypatch):
    edges = [(x % 23, y % 19, i) for i, (x, y) in enumerate(zip(range(0, 300, 3), range(0, 900, 9), strict=False))] * 2
    rows = spark.createDataFrame([(a, b, i + j) for j, (a, b, i) in enumerate(edges)], "src int, dst int, i int")
    ranks = lambda found: {x.vertex: x.rank for x in found.ranks.collect()}
    graph = g.build_graph(rows.select("src", "dst"))
    common, packed = ranks(r.rank(graph, "common", max_iterations=4)), exact.exact_rank(rows, "i", max_iterations=4)
    monkeypatch.setattr(r, "PACKED_EDGES", 10)
    monkeypatch.setattr(exact, "PACKED_EDGES", 10)
    monkeypatch.setattr(exact, "CHUNK", 7)
    monkeypatch.setattr(exact, "packed", None)
    large = ranks(r.rank(graph, "common", max_iterations=4))
    assert large.keys() == common.keys() and all(abs(large[v] - x) < 1e-12 for v, x in common.items())
    found = exact.exact_rank(rows.repartition(3), "i", max_iterations=4)
    assert found.trace == packed.trace and ranks(found) == ranks(packed)


def test_hubs_are_dealt_and_edges_stay(spark, monkeypatch):
    """Ranks don't depend on how a source's edges are dealt, and no iteration shuffles the edges."""
    edges = spark.createDataFrame([(0, i) for i in range(1, 60)] + [(i, (i * 7) % 60) for i in range(60)] * 2, "src long, dst long")
    graph = g.build_graph(edges)
    truth = {x.vertex: x.rank for x in r.rank(graph, strategy="packed", max_iterations=6).ranks.collect()}
    for hub in (r.HUB, 5):
        monkeypatch.setattr(r, "HUB", hub)
        found = r.rank(graph, strategy="shuffle", max_iterations=6)
        assert all(abs(x.rank - truth[x.vertex]) < 1e-12 for x in found.ranks.collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = r.gather(r.by_source(graph), r.first_state(graph))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = next(line for line in plan.splitlines() if "groundwalk_edges" in line)
    above = plan.splitlines()[plan.splitlines().index(scan) - 3 : plan.splitlines().index(scan)]
    assert "Bucketed: true" in scan and not any("Exchange" in line for line in above)


def test_bins_of_a_budget(spark):
    edges = spark.createDataFrame([(i % 50, i % 7) for i in range(300)], "src long, dst long")
    assert g.build_graph(edges, max_edges_per_bin=40).edges.rdd.getNumPartitions() == 8
    assert g.build_graph(edges, max_edges_per_bin=40, partitions=11).edges.rdd.getNumPartitions() == 11
    with pytest.raises(ValueError):
        g.build_graph(edges, max_edges_per_bin=0)


def test_runs_as_csv(tmp_path, spark):
    path = str(tmp_path / "runs.csv")
    for threads, ms in ((1, 80.0), (4, 25.0)):
        results.append(path, {"experiment": "scaling", "graph": "x", "threads": threads, "compute_ms": ms})
    with pytest.raises(ValueError, match="no such"):
        results.append(path, {"other": 1})
    rows = spark.read.csv(path, header=True, inferSchema=True)
    assert rows.columns == results.COLUMNS
    assert [(x.threads, x.speedup, x.efficiency) for x in results.speed_up(rows).orderBy("threads").collect()] == [(1, 1.0, 1.0), (4, 3.2, 0.8)]


def test_pull_in_blocks(spark, monkeypatch):
    """Ranks don't depend on how edges are cut into blocks, also where a destination's edges lie in several."""
    edges = spark.createDataFrame([(i, 0) for i in range(1, 90)] + [(i, -(i * 7) % 60) for i in range(60)] * 2, "src long, dst long")
    graph = g.build_graph(edges, partitions=3)
    truth = r.rank(graph, strategy="packed", max_iterations=6)
    monkeypatch.setattr(r, "BLOCK", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        found = r.rank(graph, strategy="pull", max_iterations=6)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ranks = {x.vertex: x.rank for x in truth.ranks.collect()}
    assert all(abs(x.rank - ranks.pop(x.vertex)) < 1e-12 for x in found.ranks.collect()) and not ranks
    assert all(abs(a[1] - b[1]) < 1e-9 for a, b in zip(found.trace, truth.trace, strict=True))
    monkeypatch.setattr(r, "BROADCAST_VERTICES", 10)
    with pytest.raises(ValueError, match="at most 10"):
        r.rank(graph, strategy="pull")


def test_own_engines_and_gathers(spark):
    graph = g.build_graph(spark.createDataFrame([(1, 2), (2, 3), (2, 3), (3, 1)], "src long, dst long"))
    own = lambda graph, tolerance, most: r.RankResult(graph.vertices.selectExpr("v as vertex", "1D as rank"), most, False)
    assert r.rank(graph, own, max_iterations=7).iterations == 7
    by = lambda edges, state: edges.join(state, edges["src"] == state["v"]).groupBy(edges["dst"].alias("v")).agg(F.sum(F.col("mult") * F.col("c")).alias("x"))
    truth = {x.vertex: x.rank for x in r.rank(graph).ranks.collect()}
    assert all(abs(x.rank - truth[x.vertex]) < 1e-9 for x in r.rank(graph, strategy=by).ranks.collect())
