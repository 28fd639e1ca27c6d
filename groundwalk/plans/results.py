"""Tables of benchmark runs."""

from __future__ import annotations

import csv
import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a run, in the order of the file.
COLUMNS = ["experiment", "graph", "vertices", "edges", "threads", "xmx", "preprocess_ms", "compute_ms", "iterations", "peak_rss_mib"]


def append(path: str, run: dict) -> None:
    """Adds a run to a CSV file, which starts with the names of the columns. What a run lacks stays empty."""
    if unknown := set(run) - set(COLUMNS):
        raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
    new = not os.path.exists(path) or not os.path.getsize(path)
    with open(path, "a", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, COLUMNS, restval="", lineterminator="\n")
        if new:
            out.writeheader()
        out.writerow(run)


def speed_up(runs: DataFrame) -> DataFrame:
    """runs (graph, threads, compute_ms) with speedup against the graph's run of the fewest threads, and efficiency, which
    is the speedup by thread."""
    by_graph = Window.partitionBy("graph").orderBy("threads")
    first = runs.withColumn("base_ms", F.first("compute_ms").over(by_graph)).withColumn("base_threads", F.first("threads").over(by_graph))
    speedup = F.col("base_ms") / F.col("compute_ms")
    return first.withColumn("speedup", speedup).withColumn("efficiency", speedup * F.col("base_threads") / F.col("threads")).drop("base_ms", "base_threads")
