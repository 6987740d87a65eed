"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to so many bytes of its written table, which memory takes a few times, and dealt by key beyond.
BROADCAST_BYTES = 4 * 2**20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only one JVM (master local) may go without it and gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), f"quarrydoc-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def hadoop(spark: SparkSession, path: str):
    """The path as Hadoop's, and its file system."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath, hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hpath, fs = hadoop(spark, path)
    fs.deleteOnExit(hpath)
    return path


def table(df: DataFrame, name: str, codec: str | None = None, group_bytes: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, a lost executor costs nothing done.

    codec: other than the session's; group_bytes: of a row group, which writers and readers hold whole, where rows are large (else looked at each hundred rows).
    """
    path = fresh_path(df.sparkSession, name)
    writer = df.write.option("compression", codec) if codec else df.write
    if group_bytes:
        writer = writer.option("parquet.block.size", group_bytes).option("parquet.block.size.row.check.min", 1).option("parquet.page.size.row.check.min", 1)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of `table` that nothing unwritten reads any more."""
    for t in tables:
        hpath, fs = hadoop(t.sparkSession, t.scratch_path)
        fs.delete(hpath, True)


def size_of(side: DataFrame) -> int:
    """Bytes of the files of a table of `table`."""
    hpath, fs = hadoop(side.sparkSession, side.scratch_path)
    return fs.getContentSummary(hpath).getLength()


def is_small(side: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the files of a table of `table` are small."""
    return size_of(side) <= most


def hinted(side: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A table of `table` to be broadcast when its files are small."""
    return F.broadcast(side) if is_small(side, most) else side
