"""The registered queries of the graph engine and the SQL they are held against."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rmat as rmat_module
from ..operators import exact
from ..operators import graph as g
from ..operators import rank as r
from ..sources import edges as sources
from . import planner, results
from .derived import GRAPHS, SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
_PARTS = "part_succession"


def _register(name: str, sql: str | None = None):
    def put(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLE[name] = sql
        return query

    return put


def _graph(spark: SparkSession, sf_dir: str, name: str = _PARTS) -> g.Graph:
    return g.build_graph(GRAPHS[name](spark, sf_dir))


def _ranks(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    return r.rank(_graph(spark, sf_dir, name), **options).ranks.select("vertex", F.round("rank", 6).alias("rank"))


# ---- SQL ----------------------------------------------------------------------------------------------------

_E = f"e AS MATERIALIZED ({SQL[_PARTS]})"


def _walk(graph: str, most: int = 100) -> str:
    return _walk_of(SQL[graph], most)


def _walk_of(edges: str, most: int = 100) -> str:
    """CTEs of the whole iteration with the ground as vertex 2^40: it(k, v, s), n, dl(k, d), stop(k)."""
    return f"""WITH RECURSIVE e AS MATERIALIZED ({edges}),
vx AS MATERIALIZED (SELECT src v FROM e UNION SELECT dst FROM e),
n AS MATERIALIZED (SELECT count(*)::DOUBLE n FROM vx),
od AS MATERIALIZED (SELECT v, coalesce(c,0)+1 d FROM vx LEFT JOIN (SELECT src, count(*) c FROM e GROUP BY src) o ON o.src=vx.v),
t AS MATERIALIZED (SELECT e.src, e.dst, count(*)/max(od.d)::DOUBLE w FROM e JOIN od ON od.v=e.src GROUP BY e.src, e.dst
  UNION ALL SELECT v, 1099511627776, 1.0::DOUBLE/d FROM od UNION ALL SELECT 1099511627776, v, 1.0/n FROM vx, n),
it(k,v,s) AS (SELECT 0, v, 1.0::DOUBLE FROM vx UNION ALL SELECT 0, 1099511627776, 0.0::DOUBLE
  UNION ALL SELECT k+1, t.dst, sum(t.w*it.s) FROM it JOIN t ON it.v=t.src WHERE k<{most} GROUP BY k+1, t.dst),
dl AS (SELECT a.k, sum(abs(a.s-b.s)) d FROM it a JOIN it b ON a.v=b.v AND a.k=b.k+1 GROUP BY a.k),
stop AS (SELECT coalesce(min(k),{most}) k FROM dl, n WHERE d<1e-8*n)
"""


_FINAL = "final AS (SELECT a.v AS vertex, round(a.s+g.s/n.n,6) AS rank FROM it a, it g, n, stop WHERE a.k=stop.k AND g.k=stop.k AND a.v<1099511627776 AND g.v=1099511627776)"


def _rank_sql(graph: str, most: int = 100) -> str:
    return _walk(graph, most) + f", {_FINAL} SELECT vertex, rank FROM final"


# ---- scans, sets, degrees -----------------------------------------------------------------------------------


@_register("edge_scan", SQL[_PARTS])
def edge_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GRAPHS[_PARTS](spark, sf_dir)


@_register("edge_scan_csv", f"WITH {_E} SELECT CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst FROM e")
def edge_scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges written as `from,to` text and read back by the checked reader."""
    from ..scratch import shared_dir

    path = f"{shared_dir(spark)}/edges-{spark.sparkContext.applicationId}-{zlib.crc32(sf_dir.encode())}.csv"
    sources.write_edges(GRAPHS[_PARTS](spark, sf_dir), path)
    return sources.read_edges(spark, path)


@_register("snap_filter", "SELECT CAST(regexp_extract(line, '^([0-9]+)', 1) AS INTEGER) AS src, CAST(regexp_extract(line, '([0-9]+)$', 1) AS INTEGER) AS dst FROM (SELECT l_partkey || CASE WHEN l_linenumber % 5 = 0 THEN ' # ' ELSE chr(9) END || l_suppkey AS line FROM lineitem) WHERE regexp_matches(line, '^[0-9]+\\t[0-9]+$')")
def snap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines of which only those of exactly two numbers are edges."""
    from ..scratch import shared_dir

    path = f"{shared_dir(spark)}/snap-{spark.sparkContext.applicationId}-{zlib.crc32(sf_dir.encode())}.txt"
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    mark = F.when(F.col("l_linenumber") % 5 == 0, " # ").otherwise("\t")
    lines.select(F.concat(F.col("l_partkey").cast("string"), mark, F.col("l_suppkey").cast("string")).alias("value")).write.mode("overwrite").text(path)
    return sources.read_snap(spark, path)


@_register("edge_lines", "SELECT CAST(n_nationkey AS INTEGER) AS src, CAST(n_regionkey AS INTEGER) AS dst FROM nation")
def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of text in memory: a line for each of the 25 nations."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey").collect()
    return sources.edges_of_lines(spark, ["from,to", *(f" {a} , {b}" for a, b in nations), ""])


@_register("edge_count", f"WITH {_E} SELECT count(*) AS edges FROM e")
def edge_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GRAPHS[_PARTS](spark, sf_dir).agg(F.count("*").alias("edges"))


@_register("vertex_set", f"WITH {_E} SELECT src AS v FROM e UNION SELECT dst FROM e")
def vertex_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.vertex_set(GRAPHS[_PARTS](spark, sf_dir))


@_register("vertex_count", f"WITH {_E} SELECT count(*) AS vertices FROM (SELECT src FROM e UNION SELECT dst FROM e)")
def vertex_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.vertex_set(GRAPHS[_PARTS](spark, sf_dir)).agg(F.count("*").alias("vertices"))


@_register("in_degree", f"WITH {_E} SELECT dst AS v, count(*) AS in_degree FROM e GROUP BY dst")
def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.in_degrees(GRAPHS[_PARTS](spark, sf_dir))


@_register("out_degree", f"WITH {_E} SELECT src AS v, count(*) AS out_degree FROM e GROUP BY src")
def out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.out_degrees(GRAPHS[_PARTS](spark, sf_dir))


@_register("degree_join", f"WITH e AS MATERIALIZED ({SQL['cust_supp']}) SELECT v, coalesce(o.c, 0) AS out_degree, coalesce(i.c, 0) AS in_degree FROM (SELECT src AS v FROM e UNION SELECT dst FROM e) LEFT JOIN (SELECT src, count(*) c FROM e GROUP BY src) o ON o.src = v LEFT JOIN (SELECT dst, count(*) c FROM e GROUP BY dst) i ON i.dst = v")
def degree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.degrees(g.collapse(GRAPHS["cust_supp"](spark, sf_dir))).select("v", "out_degree", "in_degree")


@_register("self_loops", f"WITH e AS ({SQL['nation_trade']}) SELECT src AS v, count(*) AS loops FROM e WHERE src = dst GROUP BY src")
def self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GRAPHS["nation_trade"](spark, sf_dir).where("src = dst").groupBy(F.col("src").alias("v")).agg(F.count("*").alias("loops"))


@_register("multi_edge_collapse", f"WITH {_E} SELECT src, dst, count(*) AS mult FROM e GROUP BY src, dst")
def multi_edge_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.collapse(GRAPHS[_PARTS](spark, sf_dir))


_STORED = f"WITH {_E} SELECT v, coalesce(o.c, 0) AS out_degree, coalesce(i.c, 0) AS in_degree FROM (SELECT src AS v FROM e UNION SELECT dst FROM e) LEFT JOIN (SELECT src, count(*) c FROM e GROUP BY src) o ON o.src = v LEFT JOIN (SELECT dst, count(*) c FROM e GROUP BY dst) i ON i.dst = v"


@_register("build_in_memory", _STORED)
def build_in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.build_graph(GRAPHS[_PARTS](spark, sf_dir), storage="in-memory").vertices.select("v", "out_degree", "in_degree")


@_register("build_by_budget", _STORED)
def build_by_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An out-of-core build cut by a memory budget."""
    most = planner.max_edges_per_bin(34 << 20, 20_000)
    return g.build_graph(GRAPHS[_PARTS](spark, sf_dir), max_edges_per_bin=most).vertices.select("v", "out_degree", "in_degree")


@_register("in_neighbours", f"WITH {_E} SELECT src FROM e WHERE dst = 7")
def in_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.in_neighbours(_graph(spark, sf_dir), 7)


@_register("adjacency_lists", f"WITH {_E} SELECT dst, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS sources FROM e GROUP BY dst")
def adjacency_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.adjacency(_graph(spark, sf_dir)).select("dst", F.concat_ws(",", F.col("sources").cast("array<string>")).alias("sources"))


@_register("hyper_nodes", f"WITH e AS ({SQL['user_handoff']}), d AS (SELECT dst AS v, count(*) AS in_degree FROM e GROUP BY dst) SELECT v, in_degree FROM d WHERE in_degree > 1.1 * (SELECT (SELECT count(*) FROM e) / count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e))")
def hyper_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices whose in-degree is over 1.1 times the mean."""
    graph = _graph(spark, sf_dir, "user_handoff")
    return graph.vertices.where(F.col("in_degree") > F.lit(1.1 * graph.m / graph.n)).select("v", "in_degree")


# ---- dense ids, running sums, plans -------------------------------------------------------------------------


def _placed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    place = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*place[1:]))
    return lines.select(F.col("l_partkey").alias("src"), following.alias("dst"), *place).where("dst is not null")


_PLACED = "p AS MATERIALIZED (SELECT src, dst, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos FROM (SELECT *, l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst FROM lineitem) WHERE dst IS NOT NULL), ids AS (SELECT v, row_number() OVER (ORDER BY min(pos)) - 1 AS dense FROM (SELECT src AS v, 2 * pos AS pos FROM p UNION ALL SELECT dst, 2 * pos + 1 FROM p) GROUP BY v)"
_PLACE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@_register("dense_ids", f"WITH {_PLACED} SELECT v, dense FROM ids")
def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in order of first appearance."""
    return exact.dense_ids(_placed_edges(spark, sf_dir), *_PLACE).select("v", F.col("dense").cast("long").alias("dense"))


@_register("dense_encode", f"WITH {_PLACED} SELECT a.dense AS src, b.dense AS dst, count(*) AS mult FROM p JOIN ids a ON a.v = p.src JOIN ids b ON b.v = p.dst GROUP BY 1, 2")
def dense_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges rewritten to dense ids, by two joins with the dictionary."""
    edges = _placed_edges(spark, sf_dir)
    coded = exact.relabel(edges, exact.dense_ids(edges, *_PLACE)).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    return g.collapse(coded)


@_register("dense_ids_of_text", f"WITH {_PLACED} SELECT v, dense FROM ids")
def dense_ids_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in order of first appearance in text of several files, read in parallel."""
    from ..scratch import shared_dir

    path = f"{shared_dir(spark)}/placed-{spark.sparkContext.applicationId}-{zlib.crc32(sf_dir.encode())}.csv"
    sources.write_edges(_placed_edges(spark, sf_dir).withColumn("place", F.struct(*_PLACE)), path, order="place")
    found = exact.dense_ids(sources.read_edges(spark, path, ordered=True), "file", "block", "row")
    return found.select(F.col("v").cast("long").alias("v"), F.col("dense").cast("long").alias("dense"))


@_register("csc_prefix_sums", f"WITH {_E} SELECT dst AS v, count(*) AS in_degree, CAST(sum(count(*)) OVER (ORDER BY dst) AS BIGINT) AS upto FROM e GROUP BY dst")
def csc_prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.prefix_sums(g.in_degrees(GRAPHS[_PARTS](spark, sf_dir)))


def _degrees_in_turn(graph: g.Graph) -> Iterator[np.ndarray]:
    """In-degrees in the order of the vertices."""
    placed = exact.numbered(graph.vertices.select("v", "in_degree"), F.col("v"), "place")
    return exact.in_turn(placed.select(F.col("place").alias("v"), F.col("in_degree").cast("long").alias("x")), np.int64)


def _ranges(spark: SparkSession, plan: list[planner.Range]) -> DataFrame:
    return spark.createDataFrame([(x.begin, x.end, x.edges, x.oversized) for x in plan], "first long, past long, edges long, oversized boolean")


def _greedy_sql(graph: str, close: str, flag: str) -> str:
    """Ranges over running in-degrees by a recursive fold; `close` says when a range ends before vertex i."""
    return f"""WITH RECURSIVE e AS MATERIALIZED ({SQL[graph]}),
d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY v) - 1 AS i, coalesce(c, 0) AS c FROM (SELECT src AS v FROM e UNION SELECT dst FROM e) LEFT JOIN (SELECT dst, count(*) AS c FROM e GROUP BY dst) ON dst = v),
q AS MATERIALIZED (SELECT count(*) AS n, CAST(sum(c) AS BIGINT) AS m FROM d),
f(i, part, acc) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), (SELECT c FROM d WHERE i = 0)
  UNION ALL SELECT d.i, f.part + CASE WHEN {close} THEN 1 ELSE 0 END, CASE WHEN {close} THEN d.c ELSE f.acc + d.c END FROM f JOIN d ON d.i = f.i + 1, q)
SELECT min(f.i) AS first, max(f.i) + 1 AS past, CAST(sum(d.c) AS BIGINT) AS edges, {flag} AS oversized FROM f JOIN d USING (i) GROUP BY part"""


_EIGHTHS = "f.part < 7 AND f.acc >= greatest(1, q.m // 8)"
_MOST = "(q.m // 20)"
_TWENTIETHS = (f"f.acc + d.c > {_MOST}", f"max(d.c) > (SELECT {_MOST} FROM q)")


@_register("shard_plan", _greedy_sql("nation_trade", _EIGHTHS, "false"))
def shard_plan(spark: SparkSession, sf_dir: str, name: str = "nation_trade") -> DataFrame:
    """Ranges of vertices with an eighth of the edges each."""
    graph = _graph(spark, sf_dir, name)
    return _ranges(spark, planner.plan_shards(_degrees_in_turn(graph), 8, graph.m))


@_register("bin_plan", _greedy_sql("nation_trade", *_TWENTIETHS))
def bin_plan(spark: SparkSession, sf_dir: str, name: str = "nation_trade") -> DataFrame:
    """Ranges of vertices with at most a twentieth of the edges each."""
    graph = _graph(spark, sf_dir, name)
    return _ranges(spark, planner.plan_bins(_degrees_in_turn(graph), max(1, graph.m // 20)))


@_register("shard_plan_parts", _greedy_sql(_PARTS, _EIGHTHS, "false"))
def shard_plan_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_plan(spark, sf_dir, _PARTS)


@_register("bin_plan_parts", _greedy_sql(_PARTS, *_TWENTIETHS))
def bin_plan_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_plan(spark, sf_dir, _PARTS)


_BUDGETS = (0, 1 << 16, 5 << 16, 1 << 30)


@_register("wave_count", f"WITH {_E}, b AS (SELECT count(DISTINCT dst // 64) AS bins FROM e) SELECT free, bins, ceil(bins / least(greatest(free // 65536, 1), bins))::BIGINT AS waves FROM b, (SELECT unnest({list(_BUDGETS)})::BIGINT AS free)")
def wave_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes over the edges if only so many ranges of 64 destinations can be open at once, for several budgets."""
    bins = bin_counts(spark, sf_dir).count()
    return spark.createDataFrame([(free, bins, planner.waves(bins, free)) for free in _BUDGETS], "free long, bins long, waves long")


@_register("bin_counts", f"WITH {_E} SELECT dst // 64 AS bin, count(*) AS edges FROM e GROUP BY 1")
def bin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges per range of 64 destinations."""
    return GRAPHS[_PARTS](spark, sf_dir).groupBy(F.floor(F.col("dst") / 64).alias("bin")).agg(F.count("*").alias("edges"))


@_register("bin_route", f"WITH {_E}, b AS (SELECT i * 64 AS first, (i + 1) * 64 AS past FROM range(0, 400) r(i)) SELECT first, past, src, dst FROM e JOIN b ON dst >= first AND dst < past WHERE dst BETWEEN 100 AND 140")
def bin_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a destination window with the range that holds them; a range join turned into arithmetic."""
    rows = GRAPHS[_PARTS](spark, sf_dir).where("dst between 100 and 140")
    first = F.floor(F.col("dst") / 64) * 64
    return rows.select(first.alias("first"), (first + 64).alias("past"), "src", "dst")


@_register("bin_route_all", f"WITH {_E}, b AS (SELECT i * 64 AS first, (i + 1) * 64 AS past FROM (SELECT unnest(range(0, (SELECT max(dst) // 64 + 1 FROM e))) AS i)) SELECT first, past, src, dst FROM e JOIN b ON dst >= first AND dst < past")
def bin_route_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge with the range of its destination."""
    first = F.floor(F.col("dst") / 64) * 64
    return GRAPHS[_PARTS](spark, sf_dir).select(first.alias("first"), (first + 64).alias("past"), "src", "dst")


# ---- one step -----------------------------------------------------------------------------------------------

_OD = "vx AS (SELECT src v FROM e UNION SELECT dst FROM e), od AS (SELECT v, coalesce(c,0)+1 AS d FROM vx LEFT JOIN (SELECT src, count(*) c FROM e GROUP BY src) o ON o.src=vx.v)"


@_register("first_step_contrib", f"WITH {_E}, {_OD} SELECT v, round(1.0 / d, 9) AS c FROM od")
def first_step_contrib(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.first_state(_graph(spark, sf_dir)).select("v", F.round("c", 9).alias("c"))


@_register("one_gather_step", f"WITH {_E}, {_OD} SELECT vx.v AS v, round(coalesce(x, 0), 9) AS s FROM vx LEFT JOIN (SELECT dst, sum(1.0::DOUBLE / d) x FROM e JOIN od ON od.v = e.src GROUP BY dst) ON dst = vx.v")
def one_gather_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores after one step; the ground starts at 0."""
    graph = _graph(spark, sf_dir)
    return r.step(graph, r.first_state(graph), 0.0, r.by_source(graph)).select("v", F.round("s", 9).alias("s"))


@_register("ordered_gather", f"WITH {_E}, {_OD} SELECT dst AS v, round(0.5 + sum(1.0::DOUBLE / d), 9) AS s FROM e JOIN od ON od.v = e.src GROUP BY dst")
def ordered_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _graph(spark, sf_dir)
    return exact.ordered_gather(graph.edges, r.first_state(graph).select("v", "c"), 0.5).select("v", F.round("s", 9).alias("s"))


@_register("ground_mass", f"WITH {_E}, {_OD} SELECT round(sum(1.0::DOUBLE / d), 6) AS ground FROM od")
def ground_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.first_state(_graph(spark, sf_dir)).agg(F.round(F.sum("c"), 6).alias("ground"))


@_register("transition_matrix", f"WITH {_E}, {_OD}, n AS (SELECT count(*)::DOUBLE n FROM vx) SELECT e.src AS src, e.dst AS dst, round(count(*)/max(od.d)::DOUBLE, 9) AS w FROM e JOIN od ON od.v=e.src GROUP BY e.src, e.dst UNION ALL SELECT v, 1099511627776, round(1.0::DOUBLE/d, 9) FROM od UNION ALL SELECT 1099511627776, v, round(1.0/n, 9) FROM vx, n")
def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.transition_table(_graph(spark, sf_dir)).select("src", "dst", F.round("w", 9).alias("w"))


# ---- ranks --------------------------------------------------------------------------------------------------


@_register("rank_parallel", _rank_sql(_PARTS))
def rank_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark, sf_dir, _PARTS)


@_register("rank_pull", _rank_sql(_PARTS))
def rank_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distributed run with broadcast contributions."""
    return _ranks(spark, sf_dir, _PARTS, strategy="pull")


@_register("rank_shuffle", _rank_sql("nation_trade"))
def rank_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distributed run for any number of vertices."""
    return _ranks(spark, sf_dir, "nation_trade", strategy="shuffle")


@_register("rank_common", _rank_sql(_PARTS))
def rank_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark, sf_dir, _PARTS, engine="common")


@_register("rank_dense", _rank_sql("nation_trade"))
def rank_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark, sf_dir, "nation_trade", engine="dense")


@_register("rank_exact", _rank_sql(_PARTS))
def rank_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit-exact run in order of first appearance."""
    return exact.exact_rank(_placed_edges(spark, sf_dir), *_PLACE).ranks.select("vertex", F.round("rank", 6).alias("rank"))


@_register("rank_capped_2_iterations", _rank_sql(_PARTS, 2))
def rank_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark, sf_dir, _PARTS, max_iterations=2)


@_register("rank_bipartite_not_converged", _rank_sql("cust_supp"))
def rank_bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark, sf_dir, "cust_supp")


@_register("rank_nation", _rank_sql("nation_trade"))
def rank_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark, sf_dir, "nation_trade")


@_register("rank_handoff", _rank_sql("user_handoff"))
def rank_handoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark, sf_dir, "user_handoff")


# Leaders are ordered by nine digits, which sums in another order don't change, and shown with six.
_FINE = _FINAL.replace(",6) AS rank", ",9) AS fine")


def _fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.rank(_graph(spark, sf_dir)).ranks.select("vertex", F.round("rank", 9).alias("rank"))


@_register("top_n", _walk(_PARTS) + f", {_FINE} SELECT vertex, round(fine, 6) AS rank FROM final ORDER BY fine DESC, vertex LIMIT 10")
def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.leaderboard(_fine(spark, sf_dir)).limit(10).select("vertex", F.round("rank", 6).alias("rank"))


@_register("leaderboard_position", _walk(_PARTS) + f", {_FINE} SELECT vertex, round(fine, 6) AS rank, row_number() OVER (ORDER BY fine DESC, vertex) AS position FROM final")
def leaderboard_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = _fine(spark, sf_dir)
    placed = exact.numbered(ranks, F.struct((-F.col("rank")).alias("a"), "vertex"), "position")
    return placed.select("vertex", F.round("rank", 6).alias("rank"), (F.col("position") + 1).cast("long").alias("position"))


@_register("total_mass", _walk("nation_trade") + f", {_FINAL} SELECT count(*) AS vertices, round(sum(rank), 3) AS mass, max_by(vertex, rank) AS leader FROM final")
def total_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark, sf_dir, "nation_trade").agg(F.count("*").alias("vertices"), F.round(F.sum("rank"), 3).alias("mass"), F.max_by("vertex", "rank").alias("leader"))


@_register("verify_max_diff", _walk("nation_trade") + f", {_FINAL} SELECT vertex, rank, rank AS truth, 0.0::DOUBLE AS difference FROM final")
def verify_max_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rank tables that `verify` compares, and their differences."""
    both, _, _ = r.compare(_graph(spark, sf_dir, "nation_trade"))
    return both.select("vertex", F.round("rank", 6).alias("rank"), F.round("truth", 6).alias("truth"), F.round(F.abs(F.col("rank") - F.col("truth")), 9).alias("difference"))


_RUNS = "SELECT n_regionkey AS graph, 1 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS threads, 1000.0::DOUBLE / (1 + n_nationkey) AS compute_ms FROM nation"


@_register("speed_up", f"WITH r AS ({_RUNS}) SELECT graph, threads, compute_ms, round(base / compute_ms, 6) AS speedup, round(base / compute_ms * least_threads / threads, 6) AS efficiency FROM (SELECT *, first_value(compute_ms) OVER w AS base, first_value(threads) OVER w AS least_threads FROM r WINDOW w AS (PARTITION BY graph ORDER BY threads))")
def speed_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speed-up and efficiency over a table of runs."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    threads = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) + 1
    runs = nation.select(F.col("n_regionkey").alias("graph"), threads.cast("long").alias("threads"), (F.lit(1000.0) / (F.col("n_nationkey") + 1)).alias("compute_ms"))
    return results.speed_up(runs).select("graph", "threads", "compute_ms", F.round("speedup", 6).alias("speedup"), F.round("efficiency", 6).alias("efficiency"))


@_register("iteration_trace", _walk(_PARTS) + "SELECT CAST(dl.k AS INTEGER) AS k, round(d, 6) AS delta, d < 1e-8 * n AS converged FROM dl, n, stop WHERE dl.k <= stop.k")
def iteration_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _graph(spark, sf_dir)
    found = r.rank(graph)
    return spark.createDataFrame([(k, round(d, 6), d < r.TOLERANCE * graph.n) for k, d in found.trace], "k int, delta double, converged boolean")


@_register("l1_delta_k", _walk(_PARTS, 3) + "SELECT round(d, 6) AS delta FROM dl WHERE k = 3")
def l1_delta_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of all changes in the third iteration, from a distributed run."""
    found = r.rank(_graph(spark, sf_dir), max_iterations=3, strategy="pull")
    return spark.createDataFrame([(round(found.trace[-1][1], 6),)], "delta double")


@_register("rank_csv_output", _walk(_PARTS) + f", {_FINAL} SELECT vertex, rank FROM final")
def rank_csv_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks written as `vertex,rank` text at full precision and read back."""
    from ..scratch import shared_dir

    path = f"{shared_dir(spark)}/ranks-{spark.sparkContext.applicationId}-{zlib.crc32(sf_dir.encode())}.csv"
    sources.write_ranks(r.rank(_graph(spark, sf_dir)).ranks, path)
    return spark.read.csv(path, header=True, schema="vertex long, rank double").select("vertex", F.round("rank", 6).alias("rank"))


_RMAT = """WITH RECURSIVE j(k, a, c) AS (SELECT 0, 25214903917::HUGEINT, 11::HUGEINT UNION ALL SELECT k + 1, a * a % 281474976710656, (a * c + c) % 281474976710656 FROM j WHERE k < 18),
s(k, id, x) AS (SELECT 0, id, xor(99, 25214903917)::HUGEINT FROM range(20000) r(id) UNION ALL SELECT s.k + 1, id, CASE WHEN (id * 20 >> s.k) & 1 = 1 THEN (a * x + c) % 281474976710656 ELSE x END FROM s JOIN j ON j.k = s.k),
b(n, id, x, u, f, t) AS (SELECT 0, id, x, 0::DOUBLE, 0, 0 FROM s WHERE k = 19
  UNION ALL SELECT n + 1, id, z, w, 2 * f + CASE WHEN w >= 0.57::DOUBLE + 0.19::DOUBLE THEN 1 ELSE 0 END, 2 * t + CASE WHEN (w >= 0.57 AND w < 0.57::DOUBLE + 0.19::DOUBLE) OR w >= 0.57::DOUBLE + 0.19::DOUBLE + 0.19::DOUBLE THEN 1 ELSE 0 END
  FROM (SELECT *, ((y // 4194304) * 134217728 + z // 2097152)::DOUBLE / 9007199254740992::DOUBLE AS w FROM (SELECT *, (y * 25214903917 + 11) % 281474976710656 AS z FROM (SELECT *, (x * 25214903917 + 11) % 281474976710656 AS y FROM b WHERE n < 10))))
"""
_RMAT_EDGES = _RMAT + "SELECT id, f::INTEGER AS src, t::INTEGER AS dst FROM b WHERE n = 10"
_RMAT_PAIRS = f"SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM ({_RMAT_EDGES})"


@_register("rmat_edges", _RMAT_EDGES)
def rmat_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rmat_module.rmat(spark, 10, 20_000, seed=99)


@_register("rmat_rank", _walk_of(_RMAT_PAIRS) + f", {_FINAL} SELECT vertex, rank FROM final")
def rmat_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = g.build_graph(rmat_module.rmat(spark, 10, 20_000, seed=99).select("src", "dst"))
    return r.rank(graph).ranks.select("vertex", F.round("rank", 6).alias("rank"))
