"""A directed multigraph as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STORAGE = {"in-memory": StorageLevel.MEMORY_AND_DISK, "out-of-core": StorageLevel.DISK_ONLY}


@dataclass
class Graph:
    """edges: (src, dst, mult), each pair once with its number of edges, partitioned by dst. vertices: (v, out_degree,
    in_degree), which count repeats and self-loops. n vertices, m edges, `distinct` pairs."""

    edges: DataFrame
    vertices: DataFrame
    n: int
    m: int
    distinct: int
    kept: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for df in self.kept:
            df.unpersist()


def collapse(edges: DataFrame) -> DataFrame:
    """(src, dst, mult): repeated edges become one row with their number."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("mult"))


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("out_degree"))


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("in_degree"))


def vertex_set(edges: DataFrame) -> DataFrame:
    """(v): every id that starts or ends an edge, once."""
    return edges.select(F.col("src").alias("v")).union(edges.select(F.col("dst").alias("v"))).distinct()


def degrees(collapsed: DataFrame) -> DataFrame:
    """(v, out_degree, in_degree) in one aggregation over both ends; an end that is missing counts 0."""
    zero = F.lit(0).cast("long")
    ends = collapsed.select(F.col("src").alias("v"), F.col("mult").alias("o"), zero.alias("i")).union(collapsed.select(F.col("dst").alias("v"), zero.alias("o"), F.col("mult").alias("i")))
    return ends.groupBy("v").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def build_graph(edges: DataFrame, storage: str = "out-of-core", partitions: int | None = None, max_edges_per_bin: int | None = None) -> Graph:
    """A kept graph of (src, dst) rows; rows with a null end raise. With `max_edges_per_bin`, which
    `planner.max_edges_per_bin` derives from a memory budget, there are so many partitions that none holds more edges on
    average; this counts the edges first."""
    if storage not in STORAGE:
        raise ValueError(f"storage must be one of {sorted(STORAGE)}")
    ends = [F.coalesce(F.col(c).cast("long"), F.raise_error(F.lit("an edge has a null end")).cast("long")).alias(c) for c in ("src", "dst")]
    if max_edges_per_bin is not None:
        if max_edges_per_bin < 1:
            raise ValueError("max_edges_per_bin must be at least 1")
        partitions = max(partitions or 1, -(-edges.count() // max_edges_per_bin))
    parts = collapse(edges.select(*ends))
    parts = (parts.repartition(partitions, "dst") if partitions else parts.repartition("dst")).persist(STORAGE[storage])
    counts = parts.agg(F.count("*"), F.coalesce(F.sum("mult"), F.lit(0))).first()
    vertices = degrees(parts).persist(STORAGE[storage])
    return Graph(parts, vertices, vertices.count(), int(counts[1]), int(counts[0]), [parts, vertices])


def in_neighbours(graph: Graph, vertex: int) -> DataFrame:
    """(src) of the edges into a vertex, ascending, repeats kept."""
    return graph.edges.where(F.col("dst") == vertex).select(F.explode(F.array_repeat("src", F.col("mult").cast("int"))).alias("src")).orderBy("src")


def adjacency(graph: Graph) -> DataFrame:
    """(dst, sources): the sorted sources of each vertex with in-edges, repeats kept. For graphs whose largest in-degree
    fits in a task."""
    lists = F.array_sort(F.flatten(F.collect_list(F.array_repeat("src", F.col("mult").cast("int")))))
    return graph.edges.groupBy("dst").agg(lists.alias("sources"))
