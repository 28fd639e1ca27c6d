"""Rank of vertices by a random walk with a ground vertex linked both ways to every vertex.

Per iteration: each vertex gives s / (out_degree + 1) along each out-edge and to the ground; each receives what its
in-edges bring and an equal share of the ground's previous score. The ground is never stored: its share is one
number. The run has converged when the sum of all changes, the ground's included, is less than tolerance times the number
of vertices; then the ground's score is shared out.

Engines: `parallel` and `common` run the same formula; `dense` iterates an explicit transition table with the ground
as a vertex and shares no code with them. Any function (graph, tolerance, max_iterations) -> RankResult is an engine too.
How `parallel` runs depends on sizes that are counted first:

* packed: at most PACKED_EDGES distinct edges; `common` runs like this up to there, then like `parallel`. One task holds
  the graph in arrays; a loop of jobs would spend its time on scheduling.
* pull: at most BROADCAST_VERTICES vertices. Edges are written once as blocks of arrays, at most BLOCK in each, where
  they are; an iteration is one job, which broadcasts the contributions and brings back a sum per vertex, both of known
  size. No edge moves after the build.
* shuffle: any size. Contributions meet the edges by source, sums are combined before they move to their destination.
* a function (edges, state) -> (v, x) in place of the last one's gather; see `gather`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..scratch import bucketed, discard, materialize
from .graph import Graph

TOLERANCE, MAX_ITERATIONS = 1e-8, 100
PACKED_EDGES, BROADCAST_VERTICES, BLOCK = 8_000_000, 2_000_000, 1 << 20
#: Edges of a source that one bucket holds; a source of more is dealt over several.
HUB = 1_000_000
ENGINES = ("dense", "common", "parallel")
#: Id of the ground in the dense engine; vertex ids have 32 bits.
GROUND = 1 << 40


@dataclass
class RankResult:
    """ranks: (vertex, rank). trace: (iteration, delta) of each iteration."""

    ranks: DataFrame
    iterations: int
    converged: bool
    trace: list[tuple[int, float]] = field(default_factory=list)


Engine = Callable[[Graph, float, int], RankResult]
Gather = Callable[[DataFrame, DataFrame], DataFrame]


def check_limits(tolerance: float, max_iterations: int) -> None:
    if not tolerance > 0:
        raise ValueError("tolerance must be positive")
    if max_iterations < 1:
        raise ValueError("max_iterations must be at least 1")


def rank(graph: Graph, engine: str | Engine = "parallel", tolerance: float = TOLERANCE, max_iterations: int = MAX_ITERATIONS, strategy: str | Gather = "auto") -> RankResult:
    check_limits(tolerance, max_iterations)
    if callable(engine):
        return engine(graph, tolerance, max_iterations)
    if engine not in ENGINES:
        raise ValueError(f"engine must be one of {', '.join(ENGINES)}")
    spark = graph.edges.sparkSession
    if graph.n == 0:
        return RankResult(spark.createDataFrame([], "vertex long, rank double"), 0, True)
    if engine == "dense":
        return _dense(graph, tolerance, max_iterations)
    if strategy == "auto":
        strategy = "packed" if graph.distinct <= PACKED_EDGES else "pull" if graph.n <= BROADCAST_VERTICES else "shuffle"
    if strategy == "packed" or (engine == "common" and graph.distinct <= PACKED_EDGES):
        if graph.distinct > PACKED_EDGES:
            raise ValueError(f"a packed run takes at most {PACKED_EDGES} distinct edges")
        return packed(graph, tolerance, max_iterations)
    if strategy == "pull":
        if graph.n > BROADCAST_VERTICES:
            raise ValueError(f"a pull run takes at most {BROADCAST_VERTICES} vertices")
        return pulled(graph, tolerance, max_iterations)
    if strategy != "shuffle" and not callable(strategy):
        raise ValueError("strategy must be auto, packed, pull, shuffle or a gather")
    return _distributed(graph, tolerance, max_iterations, strategy)


# ---- packed -------------------------------------------------------------------------------------------------


def iterate(src: np.ndarray, dst: np.ndarray, mult: np.ndarray, out_degree: np.ndarray, tolerance: float, max_iterations: int, serial: bool = False) -> tuple[np.ndarray, int, bool, list[float]]:
    """The loop on dense ids. `serial` adds in the order of the edges and vertices, one by one, so that results are equal
    to the last bit whatever else runs; edges must then be sorted by (dst, src)."""
    n = len(out_degree)
    s, ground, deltas = np.ones(n), 0.0, []
    if serial:
        src, dst = np.repeat(src, mult), np.repeat(dst, mult)
    total = (lambda x: float(np.cumsum(x)[-1])) if serial else (lambda x: float(x.sum()))
    for k in range(1, max_iterations + 1):
        c = s / (out_degree + 1.0)
        base = ground / n
        if serial:
            new = np.full(n, base)
            np.add.at(new, dst, c[src])
        else:
            new = base + np.bincount(dst, weights=mult * c[src], minlength=n)
        gained = total(c)
        moved = np.abs(new - s)
        delta = total(np.concatenate([[abs(gained - ground)], moved])) if serial else abs(gained - ground) + total(moved)
        s, ground = new, gained
        deltas.append(delta)
        if delta < tolerance * n:
            return s + ground / n, k, True, deltas
    return s + ground / n, max_iterations, False, deltas


def _pack(table: pa.Table, tolerance: float, max_iterations: int, serial: bool) -> pa.Table:
    """Rows (a, b, x): vertices come as (v, null, out_degree), edges as (src, dst, mult)."""
    a, x = table.column("a").to_numpy(), table.column("x").to_numpy()
    edge = table.column("b").is_valid().to_numpy()
    b = table.column("b").fill_null(0).to_numpy()[edge]
    order = np.argsort(a[~edge], kind="stable")
    ids, degree = a[~edge][order], x[~edge][order]
    src, dst, mult = np.searchsorted(ids, a[edge]), np.searchsorted(ids, b), x[edge]
    by = np.lexsort((src, dst))
    ranks, k, converged, deltas = iterate(src[by], dst[by], mult[by], degree, tolerance, max_iterations, serial)
    said = len(deltas)
    return pa.table(
        [
            pa.array([*ids.tolist(), *[None] * said], pa.int64()),
            pa.array(np.concatenate([ranks, deltas])),
            pa.array([*[k] * len(ids), *range(1, said + 1)], pa.int32()),
            pa.array([converged] * (len(ids) + said)),
        ],
        names=["vertex", "rank", "iterations", "converged"],
    )


def packed(graph: Graph, tolerance: float = TOLERANCE, max_iterations: int = MAX_ITERATIONS, serial: bool = False) -> RankResult:
    """The whole run in one task; the caller has counted the edges."""
    rows = graph.vertices.select(F.col("v").alias("a"), F.lit(None).cast("long").alias("b"), F.col("out_degree").alias("x"))
    rows = rows.union(graph.edges.select("src", "dst", "mult")).withColumn("one", F.lit(0))
    made = rows.groupBy("one").applyInArrow(lambda t: _pack(t, tolerance, max_iterations, serial), "vertex long, rank double, iterations int, converged boolean")
    made = materialize(made, "ranks")
    trace = made.where("vertex is null").orderBy("iterations").collect()  # a row per iteration
    return RankResult(made.where("vertex is not null").select("vertex", "rank"), len(trace), trace[-1]["converged"], [(r["iterations"], r["rank"]) for r in trace])


# ---- pull ---------------------------------------------------------------------------------------------------


def _blocks(ids):
    """Edges in the order of dst -> blocks: the places of their destinations among `ids`, where each of them begins, the
    places of the sources and the repeats (none where all edges are single)."""

    def block(src: np.ndarray, dst: np.ndarray, mult: np.ndarray) -> pa.RecordBatch:
        known = ids.value
        starts = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]]))
        arrays = np.searchsorted(known, dst[starts]), starts, np.searchsorted(known, src)
        cells = [a.astype(np.int32).tobytes() for a in arrays]
        cells.append(mult.astype(np.float64).tobytes() if (mult > 1).any() else b"")
        return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], ["at", "starts", "src", "mult"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("src", "dst", "mult")])
            size += batch.num_rows
            if size >= BLOCK:
                yield block(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield block(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _sums(contributions):
    """Blocks -> (at, x): what the edges of a block bring each of its destinations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = contributions.value
        for batch in batches:
            for row in batch.to_pylist():
                brought = c[np.frombuffer(row["src"], np.int32)]
                if row["mult"]:
                    brought = brought * np.frombuffer(row["mult"])
                x = np.add.reduceat(brought, np.frombuffer(row["starts"], np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([row["at"]], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["at", "x"])

    return run


def pulled(graph: Graph, tolerance: float = TOLERANCE, max_iterations: int = MAX_ITERATIONS) -> RankResult:
    """The run with the state, three numbers for each of at most BROADCAST_VERTICES vertices, in the driver. Edges are read
    from the shared folder in each iteration, so a lost executor costs its own tasks only."""
    spark = graph.edges.sparkSession
    kept = graph.vertices.select(F.col("v").cast("long"), F.col("out_degree").cast("long")).toArrow().sort_by("v")
    ids, out_degree = kept.column("v").to_numpy(), kept.column("out_degree").to_numpy()
    n, shared = graph.n, spark.sparkContext.broadcast(ids)
    ordered = graph.edges.select("src", "dst", "mult").sortWithinPartitions("dst")
    blocks = materialize(ordered.mapInArrow(_blocks(shared), "at binary, starts binary, src binary, mult binary"), "blocks")
    s, ground, trace, converged = np.ones(n), 0.0, [], False
    for k in range(1, max_iterations + 1):
        c = s / (out_degree + 1.0)
        sent = spark.sparkContext.broadcast(c)
        new = np.full(n, ground / n)
        for row in blocks.mapInArrow(_sums(sent), "at binary, x binary").toArrow().to_pylist():
            new[np.frombuffer(row["at"], np.int32)] += np.frombuffer(row["x"])  # a block has a destination once
        sent.destroy()
        gained = float(c.sum())
        delta = abs(gained - ground) + float(np.abs(new - s).sum())
        s, ground = new, gained
        trace.append((k, delta))
        if delta < tolerance * n:
            converged = True
            break
    discard(blocks)
    shared.destroy()
    ranks = spark.createDataFrame(pa.table({"vertex": ids, "rank": s + ground / n}), "vertex long, rank double")
    return RankResult(materialize(ranks, "ranks"), len(trace), converged, trace)


# ---- distributed --------------------------------------------------------------------------------------------


def by_source(graph: Graph) -> DataFrame:
    """(k, dst, mult): edges in buckets of k, which is their source, or for a source of more than HUB edges one of its parts.
    Written once; no iteration moves them."""
    degree = graph.vertices.select(F.col("v").alias("src"), _parts(F.col("out_degree")).alias("parts"))
    dealt = graph.edges.join(degree, "src").select(F.xxhash64("src", F.pmod(F.xxhash64("dst"), "parts")).alias("k"), "src", "dst", "mult")
    buckets = _buckets(graph)
    return bucketed(dealt.repartition(buckets, "k"), "k", buckets, "edges")


def _buckets(graph: Graph) -> int:
    return int(graph.edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _parts(out_degree):
    return F.ceil(F.greatest(out_degree, F.lit(1)) / HUB)


def gather(edges: DataFrame, state: DataFrame) -> DataFrame:
    """(v, x): what its in-edges bring each vertex. state: (v, out_degree, c); edges: those of `by_source`."""
    sent = state.where("out_degree > 0").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), _parts(F.col("out_degree")) - 1)))
    side = sent.select(F.xxhash64(F.col("v"), F.col("part")).alias("k"), F.col("v").alias("from"), "c")
    # The sources' equality is no key of the join, as the buckets are of k alone.
    met = edges.join(side, "k").where(F.col("src") - F.col("from") == 0)
    return met.groupBy(F.col("dst").alias("v")).agg(F.sum(F.col("mult") * F.col("c")).alias("x"))


def step(graph: Graph, state: DataFrame, ground: float, edges: DataFrame, by: Gather = gather) -> DataFrame:
    """The next state (v, out_degree, s, p, c): new score, previous score, next contribution."""
    brought = by(edges, state.select("v", "out_degree", "c"))
    s = F.lit(ground / graph.n) + F.coalesce("x", F.lit(0.0))
    new = state.select("v", "out_degree", F.col("s").alias("p")).join(brought, "v", "left").select("v", "out_degree", "p", s.alias("s"))
    return new.withColumn("c", F.col("s") / (F.col("out_degree") + 1))


def first_state(graph: Graph) -> DataFrame:
    return graph.vertices.select("v", "out_degree", F.lit(1.0).alias("s"), F.lit(1.0).alias("p"), (F.lit(1.0) / (F.col("out_degree") + 1)).alias("c"))


def _observed(df: DataFrame, name: str, buckets: int = 0, **sums: Column) -> tuple[DataFrame, dict]:
    """df written, in `buckets` of v if asked for, with sums that its only pass has counted."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    df = df.observe(seen, *[v.alias(k) for k, v in sums.items()])
    kept = bucketed(df, "v", buckets, name) if buckets else materialize(df, name)
    return kept, {k: v or 0.0 for k, v in seen.get.items()}


def _distributed(graph: Graph, tolerance: float, max_iterations: int, strategy: str | Gather) -> RankResult:
    """By `gather`, or by a function in its place, which gets (src, dst, mult) as edges."""
    own = not callable(strategy)
    buckets, edges, by = _buckets(graph), by_source(graph) if own else graph.edges, gather if own else strategy
    state, seen = _observed(first_state(graph).repartition(buckets, "v"), "state", buckets, given=F.sum("c"))
    ground, trace, converged = 0.0, [], False
    for k in range(1, max_iterations + 1):
        gained, last = seen["given"], state
        state, seen = _observed(step(graph, state, ground, edges, by), "state", buckets, given=F.sum("c"), moved=F.sum(F.abs(F.col("s") - F.col("p"))))
        discard(last)
        delta = abs(gained - ground) + seen["moved"]
        ground = gained
        trace.append((k, delta))
        if delta < tolerance * graph.n:
            converged = True
            break
    ranks = state.select(F.col("v").alias("vertex"), (F.col("s") + F.lit(ground / graph.n)).alias("rank"))
    return RankResult(ranks, len(trace), converged, trace)


# ---- dense --------------------------------------------------------------------------------------------------


def transition_table(graph: Graph) -> DataFrame:
    """(src, dst, w) with the ground as a vertex: repeats add up, each row of the matrix sums to 1."""
    own = graph.vertices.select(F.col("v").alias("src"), (F.col("out_degree") + 1).alias("d"))
    links = graph.edges.join(own, "src").select("src", "dst", (F.col("mult") / F.col("d")).alias("w"))
    down = own.select("src", F.lit(GROUND).alias("dst"), (1.0 / F.col("d")).alias("w"))
    up = graph.vertices.select(F.lit(GROUND).alias("src"), F.col("v").alias("dst"), F.lit(1.0 / graph.n).alias("w"))
    return links.union(down).union(up)


def _dense(graph: Graph, tolerance: float, max_iterations: int) -> RankResult:
    """Score vector times transition table, as a join and a sum; kept apart from the other engines on purpose."""
    spark: SparkSession = graph.edges.sparkSession
    table = materialize(transition_table(graph), "transitions")
    ground_row = spark.createDataFrame([(GROUND, 0.0)], "v long, s double")
    scores, trace, converged = materialize(graph.vertices.select("v", F.lit(1.0).alias("s")).union(ground_row), "scores"), [], False
    for k in range(1, max_iterations + 1):
        product = table.join(scores, table["src"] == scores["v"]).groupBy(F.col("dst").alias("v")).agg(F.sum(F.col("w") * F.col("s")).alias("s"))
        both = product.join(scores.select("v", F.col("s").alias("p")), "v", "left")
        scores, seen = _observed(both, "scores", delta=F.sum(F.abs(F.col("s") - F.coalesce("p", F.lit(0.0)))))
        scores = scores.select("v", "s")
        trace.append((k, seen["delta"]))
        if seen["delta"] < tolerance * graph.n:
            converged = True
            break
    ground = scores.where(F.col("v") == GROUND).first()["s"]
    ranks = scores.where(F.col("v") != GROUND).select(F.col("v").alias("vertex"), (F.col("s") + F.lit(ground / graph.n)).alias("rank"))
    return RankResult(ranks, len(trace), converged, trace)


def compare(graph: Graph, engine: str = "parallel", max_iterations: int = MAX_ITERATIONS) -> tuple[DataFrame, RankResult, RankResult]:
    """(vertex, rank, truth) of an engine and the dense engine, and both results."""
    fast, truth = rank(graph, engine, max_iterations=max_iterations), rank(graph, "dense", max_iterations=max_iterations)
    return fast.ranks.join(truth.ranks.withColumnRenamed("rank", "truth"), "vertex", "full_outer"), fast, truth


def verify(graph: Graph, engine: str = "parallel", max_iterations: int = MAX_ITERATIONS) -> dict:
    """Sizes, iterations of the engine and of the dense engine, and the largest difference of their ranks."""
    both, fast, truth = compare(graph, engine, max_iterations)
    most = both.agg(F.coalesce(F.max(F.abs(F.col("rank") - F.col("truth"))), F.lit(0.0))).first()[0]
    return {"vertices": graph.n, "edges": graph.m, "engine": engine, "iterations": fast.iterations, "dense_iterations": truth.iterations, "max_abs_difference": most}
