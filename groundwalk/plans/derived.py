"""Directed graphs over the star-schema tables: each as a DataFrame of (src, dst) and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SQL = {
    "part_succession": """SELECT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst FROM lineitem) WHERE dst IS NOT NULL""",
    "nation_trade": """SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey""",
    "cust_supp": """SELECT o_custkey AS src, -(l_suppkey + 1) AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "user_handoff": """SELECT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL""",
}


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def part_succession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part to the next part of its order; a window per order."""
    lines = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst")).where("dst is not null")


def nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation of the customer to nation of the supplier."""
    lines, orders = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey"), _table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    customers, suppliers = _table(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), _table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst"))


def cust_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to supplier, the latter as negative ids: bipartite, every supplier dangling."""
    lines, orders = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey"), _table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(F.col("o_custkey").alias("src"), (-(F.col("l_suppkey") + 1)).alias("dst"))


def user_handoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User of an event to the user of the next event.

    The next event is found within each day; a day's last event leads to the first of the next day that has events, so
    no task sees more than a day, and only one row per day is put in order on its own.
    """
    events = _table(spark, sf_dir, "events", "ts", "event_id", "user_id").withColumn("day", F.to_date("ts"))
    firsts = events.groupBy("day").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"))
    following = firsts.select("day", F.lead("first").over(Window.orderBy("day")).alias("following"))
    within = F.lead("user_id").over(Window.partitionBy("day").orderBy("ts", "event_id"))
    rows = events.select("day", F.col("user_id").alias("src"), within.alias("own")).join(following, "day", "left")
    return rows.select("src", F.coalesce("own", "following").alias("dst")).where("dst is not null")


GRAPHS = {"part_succession": part_succession, "nation_trade": nation_trade, "cust_supp": cust_supp, "user_handoff": user_handoff}
