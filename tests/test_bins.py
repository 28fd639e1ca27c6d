"""Edges routed to bins: all of them."""

from pyspark.sql import functions as F

from groundwalk.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_every_edge_is_routed(spark):
    routed = QUERIES["bin_route_all"](spark, DATA)
    assert routed.count() == QUERIES["edge_scan"](spark, DATA).count()
    assert routed.where((F.col("dst") < F.col("first")) | (F.col("dst") >= F.col("past"))).count() == 0
