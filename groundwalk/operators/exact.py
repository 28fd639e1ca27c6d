"""Runs whose results don't depend on partitions or order of arrival, to the last bit.

Vertices get dense ids in order of first appearance in the input, `src` before `dst` in a row, and everything is
added in the order of these ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from .graph import Graph, build_graph
from .rank import MAX_ITERATIONS, PACKED_EDGES, TOLERANCE, RankResult, check_limits, first_state, packed

#: Vertices whose values are added at once where a run is distributed.
CHUNK = 1 << 16


def dense_ids(ordered: DataFrame, *place: str) -> DataFrame:
    """(v, dense) of rows (src, dst, *place); `place` sorts rows in input order.

    The numbering is one sort of the vertices: ranges of first places are counted, and each range starts where those
    before it end, so no task sees all vertices.
    """
    ends = ordered.select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.lit(0).alias("end")), F.struct(F.col("dst").alias("v"), F.lit(1).alias("end")))).alias("e"), *place)
    first = ends.groupBy("e.v").agg(F.min(F.struct(*place, F.col("e.end"))).alias("at"))
    return numbered(first, F.col("at"), "dense").select("v", "dense")


def numbered(rows: DataFrame, by: Column, name: str) -> DataFrame:
    """rows and their place 0, 1, ... in the order of `by`, which has to tell all rows apart."""
    sorted_rows = rows.withColumn("_by", by).repartitionByRange("_by").withColumn("_part", F.spark_partition_id()).persist()
    sizes = sorted_rows.groupBy("_part").count()
    # As many rows as partitions.
    starts = sizes.withColumn("_start", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_start")
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_by")) - 1
    return sorted_rows.withColumn("_in", place).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_in")).drop("_by", "_part", "_in", "_start")


def prefix_sums(vertices: DataFrame, order: str = "v", value: str = "in_degree") -> DataFrame:
    """(order, value, upto): running totals over all rows by `order`, two-level so that no task sees all rows."""
    rows = vertices.select(order, value).repartitionByRange(order).withColumn("_part", F.spark_partition_id()).persist()
    totals = rows.groupBy("_part").agg(F.sum(value).alias("_sum"))
    starts = totals.withColumn("_start", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_start")
    own = F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_own", own).join(F.broadcast(starts), "_part").select(order, value, (F.col("_start") + F.col("_own")).alias("upto"))


def relabel(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(src, dst) as dense ids."""
    left = edges.join(ids.select(F.col("v").alias("src"), F.col("dense").alias("a")), "src")
    return left.join(ids.select(F.col("v").alias("dst"), F.col("dense").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def exact_rank(ordered: DataFrame, *place: str, tolerance: float = TOLERANCE, max_iterations: int = MAX_ITERATIONS) -> RankResult:
    """Ranks of rows (src, dst, *place), equal to the last bit for any partitioning. Up to PACKED_EDGES edges, repeats
    counted, one task iterates; more are distributed, with the same sums in the same order."""
    check_limits(tolerance, max_iterations)
    ids = dense_ids(ordered, *place).persist()
    graph: Graph = build_graph(relabel(ordered, ids))
    if graph.n == 0:
        return RankResult(ordered.sparkSession.createDataFrame([], "vertex long, rank double"), 0, True)
    found = packed(graph, tolerance, max_iterations, serial=True) if graph.m <= PACKED_EDGES else distributed(graph, tolerance, max_iterations)
    ranks = found.ranks.join(ids, F.col("vertex") == F.col("dense")).select(F.col("v").cast("long").alias("vertex"), "rank")
    return RankResult(ranks, found.iterations, found.converged, found.trace)


def ordered_gather(edges: DataFrame, contributions: DataFrame, base: float) -> DataFrame:
    """(v, s): one gather, added from `base` on in ascending order of the source, repeats one by one."""
    met = edges.join(contributions.select(F.col("v").alias("src"), "c"), "src")
    terms = F.array_sort(F.flatten(F.collect_list(F.array_repeat(F.struct("src", "c"), F.col("mult").cast("int")))))
    return met.groupBy(F.col("dst").alias("v")).agg(F.aggregate(terms, F.lit(base), lambda acc, x: acc + x["c"]).alias("s"))


def in_turn(values: DataFrame, dtype: type = np.float64) -> Iterator[np.ndarray]:
    """The x of rows (v, x) in the order of v, which numbers them from 0: CHUNK at a time pass through the driver."""

    def chunk(table: pa.Table) -> pa.Table:
        own = table.sort_by("v")
        return pa.table([own.column("chunk").slice(0, 1), pa.array([own.column("x").to_numpy().tobytes()], pa.binary())], names=["chunk", "x"])

    chunks = values.select("v", "x", F.floor(F.col("v") / CHUNK).cast("long").alias("chunk")).groupBy("chunk").applyInArrow(chunk, "chunk long, x binary")
    for row in materialize(chunks, "chunks").orderBy("chunk").toLocalIterator():
        yield np.frombuffer(row["x"], dtype)


def ordered_sum(values: DataFrame, start: float | None = None) -> float:
    """Sum of rows (v, x) one by one in the order of v, after `start`."""
    for x in in_turn(values):
        start = float(np.cumsum(x if start is None else np.concatenate([[start], x]))[-1])
    return start or 0.0


def distributed(graph: Graph, tolerance: float, max_iterations: int) -> RankResult:
    """The loop of `packed` with serial sums, to the last bit, for any number of edges."""
    state, ground, trace, converged = materialize(first_state(graph).select("v", "out_degree", "s", "c"), "state"), 0.0, [], False
    for k in range(1, max_iterations + 1):
        base = ground / graph.n
        gained = ordered_sum(state.select("v", F.col("c").alias("x")))
        brought = ordered_gather(graph.edges, state.select("v", "c"), base)
        new = state.select("v", "out_degree", F.col("s").alias("p")).join(brought, "v", "left").select("v", "out_degree", "p", F.coalesce("s", F.lit(base)).alias("s"))
        state = materialize(new.withColumn("c", F.col("s") / (F.col("out_degree") + 1)), "state")
        delta = ordered_sum(state.select("v", F.abs(F.col("s") - F.col("p")).alias("x")), abs(gained - ground))
        ground = gained
        trace.append((k, delta))
        if delta < tolerance * graph.n:
            converged = True
            break
    ranks = state.select(F.col("v").alias("vertex"), (F.col("s") + F.lit(ground / graph.n)).alias("rank"))
    return RankResult(ranks, len(trace), converged, trace)
