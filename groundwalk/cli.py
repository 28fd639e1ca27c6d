"""Command line: rank, verify and generate."""

from __future__ import annotations

import argparse
import os
import shutil
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .functions import rmat
from .operators import graph as g
from .operators import rank as r
from .plans import planner
from .sources import edges as sources

VERSION = "groundwalk 0.1.0"


def _choice(options: tuple[str, ...]):
    def read(text: str) -> str:
        if text.lower() not in options:
            raise argparse.ArgumentTypeError(f"'{text}' is not one of: {', '.join(options)}")
        return text.lower()

    return read


def _at_least(least: int):
    def read(text: str) -> int:
        try:
            value = int(text)
        except ValueError:
            raise argparse.ArgumentTypeError(f"'{text}' is not a whole number") from None
        if value < least:
            raise argparse.ArgumentTypeError(f"must be at least {least}")
        return value

    return read


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="groundwalk", description="Rank vertices of directed graphs.")
    top.add_argument("--version", action="version", version=VERSION)
    commands = top.add_subparsers(dest="command")
    ranked = commands.add_parser("rank", help="rank the vertices of an edge list")
    ranked.add_argument("input", metavar="edges.csv")
    ranked.add_argument("output", metavar="output.csv", nargs="?")
    ranked.add_argument("--repeat", type=_at_least(1), default=1)
    ranked.add_argument("--print-top", type=_at_least(0))
    verified = commands.add_parser("verify", help="compare an engine with the dense one")
    verified.add_argument("input", metavar="edges.csv")
    for command in (ranked, verified):
        command.add_argument("--engine", type=_choice(r.ENGINES), default="parallel")
        command.add_argument("--graph", type=_choice(tuple(g.STORAGE)), default="out-of-core")
        command.add_argument("--threads", type=_at_least(1))
        command.add_argument("--memory-mib", type=_at_least(1), help="memory for edges: sets the number of partitions of an out-of-core graph")
        command.add_argument("--max-iterations", type=_at_least(1), default=r.MAX_ITERATIONS)
    generated = commands.add_parser("generate", help="write a random power-law graph")
    generated.add_argument("output", metavar="out.csv")
    generated.add_argument("--scale", type=int, required=True)
    generated.add_argument("--edges", type=int, required=True)
    generated.add_argument("--seed", type=int, default=42)
    return top


def peak_resident_bytes() -> int:
    """Of this process, -1 where the system doesn't say."""
    try:
        for line in Path("/proc/self/status").read_text().splitlines():
            if line.startswith("VmHWM:"):
                return int(line.split()[1]) * 1024
    except OSError:
        pass
    return -1


def _single_file(write, path: str) -> None:
    """What `write` puts into a folder as one part file, under the name `path`."""
    folder = f"{path}.parts"
    write(folder)
    parts = sorted(Path(folder).glob("part-*.csv"))
    with open(path, "wb") as out:
        for i, part in enumerate(parts):
            with open(part, "rb") as own:
                if i:
                    own.readline()  # the names of the columns stand once
                shutil.copyfileobj(own, out)
    for left in Path(folder).iterdir():
        left.unlink()
    Path(folder).rmdir()


def _print_ranks(ranks: DataFrame, limit: int | None) -> None:
    rows = sources.leaderboard(ranks)
    found = (rows if limit is None else rows.limit(limit)).collect()
    print("ranks:" if limit is None else f"top {len(found)} leaders:")
    for row in found:
        print(f"  {row['vertex']}\t{row['rank']:.6f}")


def _built(spark: SparkSession, options: argparse.Namespace) -> g.Graph:
    threads = options.threads or os.cpu_count() or 1
    edges = sources.read_edges(spark, options.input)
    if options.graph != "out-of-core" or options.memory_mib is None:
        return g.build_graph(edges, options.graph, 4 * threads)
    most = planner.max_edges_per_bin(options.memory_mib << 20, g.vertex_set(edges).count())
    return g.build_graph(edges, options.graph, max_edges_per_bin=most)


def _rank(spark: SparkSession, options: argparse.Namespace) -> None:
    began = time.perf_counter()
    graph = _built(spark, options)
    built = time.perf_counter() - began
    took, found = 0.0, None
    for k in range(options.repeat):
        began = time.perf_counter()
        found = r.rank(graph, options.engine, max_iterations=options.max_iterations)
        took = time.perf_counter() - began
        if options.repeat > 1:
            print(f"compute[{k}]: {took * 1000:.1f} ms")
    print(f"preprocess: {built * 1000:.1f} ms\ncompute: {took * 1000:.1f} ms")
    print(f"vertices: {graph.n}\nedges: {graph.m}")
    if options.graph == "out-of-core":
        heap = options.memory_mib << 20 if options.memory_mib else spark.sparkContext._jvm.Runtime.getRuntime().maxMemory()
        bins = graph.edges.rdd.getNumPartitions()
        print(f"heap ceiling: {heap / 2**20:.0f} MiB\npasses: {planner.waves(bins, planner.available_bytes(heap, graph.n))}")
        print(f"partitions: {graph.edges.rdd.getNumPartitions()} (<= {planner.max_edges_per_bin(heap, graph.n)} edges at once)")
    print(f"iterations: {found.iterations} ({'converged' if found.converged else 'max reached'})")
    if (rss := peak_resident_bytes()) >= 0:
        print(f"peak RSS: {rss / 2**20:.1f} MiB")
    if options.output:
        _single_file(lambda folder: sources.write_ranks(found.ranks, folder), options.output)
        print(f"wrote ranks to {options.output}")
    if options.print_top is not None or not options.output:
        _print_ranks(found.ranks, options.print_top)


def _verify(spark: SparkSession, options: argparse.Namespace) -> None:
    said = r.verify(_built(spark, options), options.engine, options.max_iterations)
    print(f"vertices: {said['vertices']}\nedges: {said['edges']}\nengine: {said['engine']}")
    print(f"iterations: {said['iterations']} (dense: {said['dense_iterations']})\nmax abs difference: {said['max_abs_difference']:.3e}")


def _generate(spark: SparkSession, options: argparse.Namespace) -> None:
    made = rmat.rmat(spark, options.scale, options.edges, seed=options.seed)
    _single_file(lambda folder: sources.write_edges(made, folder, order="id"), options.output)
    print(f"wrote {options.edges} edges over {1 << options.scale} vertex ids to {options.output}")


def main(arguments: list[str] | None = None) -> int:
    top = parser()
    options = top.parse_args(arguments)
    if not options.command:
        top.print_help()
        return 0
    if options.command == "generate":
        try:
            rmat.check(options.scale, options.edges, rmat.QUADRANTS)
        except ValueError as error:
            top.error(str(error))
    elif options.threads and options.engine != "parallel" and options.graph != "out-of-core":
        top.error("--threads needs --engine=parallel or --graph=out-of-core")
    spark = SparkSession.builder.appName("groundwalk").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    {"rank": _rank, "verify": _verify, "generate": _generate}[options.command](spark, options)
    return 0


if __name__ == "__main__":
    sys.exit(main())
