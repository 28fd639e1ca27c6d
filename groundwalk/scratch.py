"""Tables cut out of a long plan and kept in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where none is set, a temporary folder on a local master, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines of the cluster share")
        found = tempfile.mkdtemp(prefix="groundwalk-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back: lost executors recompute nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """As `materialize`, in sorted buckets of `key`: joins on it with as many partitions don't move the table."""
    spark = df.sparkSession
    table = f"groundwalk_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(key).option("compression", "zstd").option("path", f"{shared_dir(spark)}/{table}").format("parquet").saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolved before the name leaves the catalogue; the files stay
    spark.sql(f"DROP TABLE {table}")
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that `materialize` wrote, when nothing will read it again."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for file in df.inputFiles():
        folder = file.rsplit("/", 1)[0]
        if folder.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            return
