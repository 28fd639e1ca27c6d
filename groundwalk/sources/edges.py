"""Edge lists and leaderboards as files.

An edge list is text with a header, its first two columns are `from` and `to`: 32-bit ids, possibly negative. Names of
columns don't matter, further columns and blank lines are ignored, fields are trimmed and may be quoted.
Duplicates and self-loops stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "src string, dst string"


def _vertex(column: str) -> Column:
    text = F.trim(F.regexp_replace(F.col(column), "[\\t\\r]", ""))
    number = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("int"))
    said = F.concat(F.lit("vertex ids must be int32, found: "), F.coalesce(F.col("src"), F.lit("")), F.lit(","), F.coalesce(F.col("dst"), F.lit("")))
    return F.coalesce(number, F.raise_error(F.when(F.col("dst").isNull(), F.concat(F.lit("expected 'from,to', found: "), F.coalesce(F.col("src"), F.lit("")))).otherwise(said)).cast("int"))


def _checked(rows: DataFrame, *more: str) -> DataFrame:
    full = rows.where("src is not null or dst is not null")
    return full.select(_vertex("src").alias("src"), _vertex("dst").alias("dst"), *more)


def read_edges(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """(src INT, dst INT) of CSV text; a row that isn't two ids raises. The scan is split as Spark splits text.

    `ordered` adds file, block, row: together the place of a row in the input, whatever the splits.
    """
    rows = spark.read.csv(path, schema=_SCHEMA, header=True, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True)
    if not ordered:
        return _checked(rows)
    placed = rows.select("src", "dst", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return _checked(placed, "file", "block", "row")


def edges_of_lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    """(src, dst) of CSV text in memory, the header first."""
    text = spark.createDataFrame([(x,) for x in lines[1:] if x.strip()], "value string")
    cells = F.from_csv("value", F.lit(_SCHEMA + ", rest string"), {"mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    return _checked(text.select(cells.alias("c")).select("c.src", "c.dst"))


def read_snap(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of white-space separated text: rows of exactly two unsigned numbers, all other lines are dropped."""
    cells = F.split(F.trim(F.regexp_replace("value", "\\r", "")), "[ \\t]+")
    rows = spark.read.text(path).select(cells.alias("c")).where((F.size("c") == 2) & F.col("c")[0].rlike("^[0-9]+$") & F.col("c")[1].rlike("^[0-9]+$"))
    return _checked(rows.select(F.col("c")[0].alias("src"), F.col("c")[1].alias("dst")))


def leaderboard(ranks: DataFrame) -> DataFrame:
    """Rank descending, then vertex ascending."""
    return ranks.orderBy(F.desc("rank"), F.asc("vertex"))


def write_ranks(ranks: DataFrame, path: str, single: bool = True) -> None:
    """`vertex,rank` with a header, in leaderboard order; one part file if `single`, else one per range of ranks."""
    rows = leaderboard(ranks.select("vertex", F.col("rank").cast("string").alias("text"), "rank"))
    rows = rows.select("vertex", F.col("text").alias("rank"))
    (rows.coalesce(1) if single else rows).write.mode("overwrite").csv(path, header=True)


def write_edges(edges: DataFrame, path: str, order: str | None = None) -> None:
    """`from,to` with a header, in the order of column `order`."""
    rows = edges.orderBy(order) if order else edges
    rows.select(F.col("src").alias("from"), F.col("dst").alias("to")).write.mode("overwrite").csv(path, header=True)
