"""Graph engine: hand-made graphs with known ranks, engines against each other, files, plans, generator."""

import math
import random

import numpy as np
import pytest

from groundwalk.functions import rmat
from groundwalk.operators import exact
from groundwalk.operators import graph as g
from groundwalk.operators import rank as r
from groundwalk.plans import planner
from groundwalk.sources import edges as sources

SMALL = [(1, 2), (1, 3), (2, 3), (3, 1), (3, 4), (4, 3), (5, 3), (6, 3)]
GOLDEN = {
    "small": (SMALL, 36, {3: 1.814516124439, 1: 1.088709680180, 4: 1.088709680180, 2: 0.846774192001, 5: 0.580645161600, 6: 0.580645161600}),
    "triangle and tail": ([(0, 1), (1, 2), (2, 0), (3, 0)], 28, {0: 1.190476190299, 1: 1.095238097012, 2: 1.047619044781, 3: 0.666666667908}),
    "star": ([(i, 0) for i in range(1, 5)], 42, {0: 1.666666665284, 1: 0.833333333679}),
    "chain": ([(0, 1), (1, 2)], 52, {2: 1.137931034754, 1: 1.034482757570, 0: 0.827586207676}),
    "self-loop": ([(0, 0), (0, 1)], 48, {0: 1.0, 1: 1.0}),
    "multi-edge": ([(0, 1), (0, 1)], 34, {1: 1.142857145070, 0: 0.857142854930}),
    "lone self-loop": ([(5, 5)], 28, {5: 1.0}),
    "negative ids": ([(-1, -2)], 32, {-2: 1.111111109843, -1: 0.888888890157}),
    "two components": ([(0, 1), (1, 0), (10, 11)], 29, {0: 1.142857142857, 11: 0.952380953623, 10: 0.761904760663}),
}


def frame(spark, edges):
    return spark.createDataFrame(edges, "src int, dst int")


def ranks_of(result):
    return {row["vertex"]: row["rank"] for row in result.ranks.collect()}


def plain(edges, most=100, tolerance=1e-8):
    """The formula in plain Python, with the ground as a number."""
    vertices = sorted({v for e in edges for v in e})
    degree = {v: sum(a == v for a, _ in edges) for v in vertices}
    s, ground = dict.fromkeys(vertices, 1.0), 0.0
    for k in range(1, most + 1):
        c = {v: s[v] / (degree[v] + 1) for v in vertices}
        new = dict.fromkeys(vertices, ground / len(vertices))
        for a, b in edges:
            new[b] += c[a]
        gained = sum(c.values())
        delta = abs(gained - ground) + sum(abs(new[v] - s[v]) for v in vertices)
        s, ground = new, gained
        if delta < tolerance * len(vertices):
            break
    return {v: s[v] + ground / len(vertices) for v in vertices}, k


@pytest.mark.parametrize("name", GOLDEN)
def test_known_ranks(spark, name):
    edges, iterations, known = GOLDEN[name]
    found = r.rank(g.build_graph(frame(spark, edges)))
    got = ranks_of(found)
    assert (found.iterations, found.converged) == (iterations, True)
    assert all(abs(got[v] - x) < 1e-9 for v, x in known.items())
    assert math.isclose(sum(got.values()), len(got), rel_tol=1e-9) and min(got.values()) > 0


@pytest.mark.parametrize(("engine", "strategy"), [("parallel", "pull"), ("parallel", "shuffle"), ("common", "auto"), ("dense", "auto")])
def test_engines_agree(spark, engine, strategy):
    graph = g.build_graph(frame(spark, SMALL), "in-memory")
    found = r.rank(graph, engine, strategy=strategy, max_iterations=8)
    truth, _ = plain(SMALL, 8)
    assert (found.iterations, found.converged) == (8, False)
    assert all(abs(truth[v] - x) < 1e-12 for v, x in ranks_of(found).items())


def test_capped_run(spark):
    found = r.rank(g.build_graph(frame(spark, SMALL)), max_iterations=2)
    got = ranks_of(found)
    assert not found.converged and abs(got[1] - 1.425925925926) < 1e-9 and abs(got[2] - 0.759259259259) < 1e-9


def test_random_graphs_in_arrays():
    for seed in range(60):
        rng = random.Random(seed)
        n = 2 + rng.randrange(15)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(1 + rng.randrange(3 * n))]
        truth, k = plain(edges)
        ids = sorted(truth)
        at = {v: i for i, v in enumerate(ids)}
        src, dst = (np.array([at[e[c]] for e in edges]) for c in (0, 1))
        order = np.lexsort((src, dst))
        degree = np.bincount(src, minlength=len(ids))
        for serial in (False, True):
            got, iterations, _, _ = r.iterate(src[order], dst[order], np.ones(len(edges), int), degree, 1e-8, 100, serial)
            assert iterations == k and np.allclose(got, [truth[v] for v in ids], atol=1e-9)


def test_empty_graph(spark):
    found = r.rank(g.build_graph(frame(spark, [])))
    assert (found.ranks.count(), found.iterations, found.converged) == (0, 0, True)


def test_bad_arguments(spark):
    graph = g.build_graph(frame(spark, [(0, 1)]))
    for call in (lambda: r.rank(graph, tolerance=0), lambda: r.rank(graph, max_iterations=0), lambda: r.rank(graph, "other"), lambda: r.rank(graph, strategy="x"), lambda: g.build_graph(graph.edges, "tape")):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(Exception, match="null end"):
        g.build_graph(spark.createDataFrame([(1, None)], "src int, dst int"))


def test_degrees_and_neighbours(spark):
    graph = g.build_graph(frame(spark, [(1, 2), (1, 2), (3, 2), (2, 2)]))
    assert (graph.n, graph.m, graph.distinct) == (3, 4, 3)
    assert {(x.v, x.out_degree, x.in_degree) for x in graph.vertices.collect()} == {(1, 2, 0), (2, 1, 4), (3, 1, 0)}
    assert [x.src for x in g.in_neighbours(graph, 2).collect()] == [1, 1, 2, 3]
    assert {x.dst: x.sources for x in g.adjacency(graph).collect()} == {2: [1, 1, 2, 3]}
    graph.release()


def test_exact_run_ignores_partitions(spark):
    edges = [(x % 97, y % 89) for x, y in zip(range(0, 3000, 7), range(0, 9000, 13), strict=False)]
    rows = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "src int, dst int, i int")
    runs = [ranks_of(exact.exact_rank(rows.repartition(p), "i", max_iterations=10)) for p in (1, 5)]
    assert runs[0] == runs[1]


def test_dense_ids_and_prefix_sums(spark):
    rows = spark.createDataFrame([(7, 3, 0), (3, -5, 1), (7, 9, 2)], "src int, dst int, i int").repartition(3)
    assert {x.v: x.dense for x in exact.dense_ids(rows, "i").collect()} == {7: 0, 3: 1, -5: 2, 9: 3}
    counts = spark.createDataFrame([(v, v % 4) for v in range(50)], "v long, in_degree long").repartition(4)
    got = [x.upto for x in exact.prefix_sums(counts).orderBy("v").collect()]
    assert got == list(np.cumsum([v % 4 for v in range(50)]))


def test_verify(spark):
    said = r.verify(g.build_graph(frame(spark, [(0, 1), (1, 2), (2, 0)])), max_iterations=5)
    assert said["max_abs_difference"] < 1e-12 and (said["vertices"], said["edges"]) == (3, 3)


# ---- files --------------------------------------------------------------------------------------------------


def read(spark, tmp_path, text):
    path = tmp_path / "edges.csv"
    path.write_bytes(text.encode("utf-8"))
    return sorted((x.src, x.dst) for x in sources.read_edges(spark, str(path)).collect())


@pytest.mark.parametrize(
    ("text", "edges"),
    [
        ("from,to\n1,2\n3,4\n", [(1, 2), (3, 4)]),
        ("a,b\n1,2\n", [(1, 2)]),
        ("from,to,weight\n1,2,5\n3,4,abc\n\n5,6,1\n2, 3 ,7", [(1, 2), (2, 3), (3, 4), (5, 6)]),
        ('from,to\n"1","2"\n+7,-8\n', [(1, 2), (7, -8)]),
        ("from,to\n0,1\n0,1\n5,5\n", [(0, 1), (0, 1), (5, 5)]),
        ("from,to\n1,2\r\n3,4\r\n", [(1, 2), (3, 4)]),
        ("from,to\n", []),
    ],
)
def test_edge_text(spark, tmp_path, text, edges):
    assert read(spark, tmp_path, text) == sorted(edges)


@pytest.mark.parametrize("row", ["x,1", "1", "1.5,2", "2147483648,1", ",5", "5,,9", "1 2,3", "1-2,3"])
def test_bad_edge_text(spark, tmp_path, row):
    with pytest.raises(Exception, match="vertex ids|expected"):
        read(spark, tmp_path, f"from,to\n1,2\n{row}\n")


def test_lines_and_snap(spark, tmp_path):
    assert [(x.src, x.dst) for x in sources.edges_of_lines(spark, ["from,to", "1, 2", "", "3,4,x"]).collect()] == [(1, 2), (3, 4)]
    (tmp_path / "snap.txt").write_text("# c\n1\t2\r\n3 4\n5 6 7\n-1 2\nx y\n")
    assert sorted((x.src, x.dst) for x in sources.read_snap(spark, str(tmp_path / "snap.txt")).collect()) == [(1, 2), (3, 4)]


def test_ordered_reading_is_split_invariant(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("from,to\n" + "".join(f"{(i * 37) % 101},{(i * 53) % 103}\n" for i in range(4000)))
    ids = []
    for size in ("4096", "1000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = sources.read_edges(spark, str(path), ordered=True)
        ids.append({x.v: x.dense for x in exact.dense_ids(rows, "file", "block", "row").collect()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ids[0] == ids[1] and ids[0][0] == 0


def test_rank_text(spark, tmp_path):
    ranks = spark.createDataFrame([(1, 0.5), (2, 1.25), (-3, 1.25)], "vertex long, rank double")
    sources.write_ranks(ranks, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*.csv")).read_text()
    assert text == "vertex,rank\n-3,1.25\n2,1.25\n1,0.5\n"


# ---- plans and generator ------------------------------------------------------------------------------------


def parts(degrees, size):
    return [np.array(degrees[i : i + size], np.int64) for i in range(0, len(degrees), size)]


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_shards(size):
    plan = lambda d, count: planner.plan_shards(parts(d, size), count, sum(d))
    found = plan([2, 7, 1, 9, 3, 0, 4, 5], 4)
    assert sum(x.edges for x in found) == 31 and len(found) <= 4 and found[0].begin == 0 and found[-1].end == 8
    assert [x.edges for x in plan([1] * 100, 10)] == [10] * 10
    assert any(x.begin <= 2 < x.end and x.edges >= 5000 for x in plan([1, 1, 5000, 1, 1, 1, 1, 1], 4))
    assert len(plan([0] * 20, 8)) == 1 and plan([], 3) == []
    with pytest.raises(ValueError):
        plan([1], 0)


@pytest.mark.parametrize("size", [1, 2, 1000])
def test_bins(size):
    cut = lambda d, m: [(x.begin, x.end, x.edges, x.oversized) for x in planner.plan_bins(parts(d, size), m)]
    assert cut([2] * 5, 4) == [(0, 2, 4, False), (2, 4, 4, False), (4, 5, 2, False)]
    assert cut([1, 10, 1], 4) == [(0, 1, 1, False), (1, 2, 10, True), (2, 3, 1, False)]
    assert cut([10, 0, 11], 4) == [(0, 1, 10, True), (1, 2, 0, False), (2, 3, 11, True)]
    assert cut([1, 1, 1], 100) == [(0, 3, 3, False)] and cut([], 3) == []
    assert sum(x[2] for x in cut([1, 3, 2, 4, 1, 1, 2], 5)) == 14 and max(x[2] for x in cut([1, 3, 2, 4, 1, 1, 2], 5)) <= 5
    with pytest.raises(ValueError):
        cut([1], 0)


def test_budget_and_waves():
    assert planner.max_edges_per_bin(512 << 20, 1000) > planner.max_edges_per_bin(128 << 20, 1000) > planner.max_edges_per_bin(128 << 20, 10**6)
    assert planner.max_edges_per_bin(1, 0) == 1
    with pytest.raises(ValueError):
        planner.max_edges_per_bin(0, 0)
    assert (planner.waves(0, 1), planner.waves(10, 0), planner.waves(10, 3 * (64 << 10)), planner.waves(10, 1 << 40)) == (0, 10, 4, 1)


def java_doubles(seed):
    state = (seed ^ rmat.MULTIPLIER) & rmat.MASK
    while True:
        bits = []
        for n in (26, 27):
            state = (state * rmat.MULTIPLIER + rmat.INCREMENT) & rmat.MASK
            bits.append(state >> (48 - n))
        yield ((bits[0] << 27) + bits[1]) * 2.0**-53


def test_rmat_is_the_sequential_stream(spark):
    draws, want = java_doubles(12345), []
    for _ in range(400):
        a = b = 0
        for bit in range(6, -1, -1):
            u = next(draws)
            if u < 0.57:
                continue
            if u < 0.57 + 0.19:
                b |= 1 << bit
            elif u < 0.57 + 0.19 + 0.19:
                a |= 1 << bit
            else:
                a |= 1 << bit
                b |= 1 << bit
        want.append((a, b))
    assert want[:5] == [(48, 0), (26, 64), (16, 32), (65, 8), (0, 2)]
    for parts in (1, 7):
        got = [(x.src, x.dst) for x in rmat.rmat(spark, 7, 400, seed=12345, partitions=parts).orderBy("id").collect()]
        assert got == want
    found = r.rank(g.build_graph(frame(spark, want)))
    top = sorted(ranks_of(found).items(), key=lambda x: -x[1])[:3]
    assert found.iterations == 35 and [v for v, _ in top] == [0, 1, 2] and abs(top[0][1] - 8.997078100236) < 1e-9


def test_rmat_arguments(spark):
    for scale, edges, q in ((0, 1, rmat.QUADRANTS), (31, 1, rmat.QUADRANTS), (3, -1, rmat.QUADRANTS), (3, 1, (0.5, 0.5, 0.5, 0.5)), (3, 1, (1.2, -0.2, 0, 0))):
        with pytest.raises(ValueError):
            rmat.rmat(spark, scale, edges, q)
    assert rmat.rmat(spark, 5, 0).count() == 0
