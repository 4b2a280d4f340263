"""Intermediate tables, written to the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables, below spark.checkpoint.dir, which all executors share.

    Where the setting is absent, a temporary folder is used in local mode and the setting is filled in; on a cluster that is an error.
    The application's own sub-folder is deleted when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="vigilake-")
        spark.conf.set("spark.checkpoint.dir", base)
    root = f"{base.rstrip('/')}/vigilake-scratch/{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_delete, spark, root)
    return root


_roots: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may have gone already; the folder is then left to the owner of the checkpoint folder
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has been written to."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def save(df: DataFrame, name: str, partition_by: str | None = None, block: int | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage, survives lost executors.

    block: stored (compressed) bytes of a row group, the least that a task reads of a file and holds at once; small ones for large rows
    and for rows that cost much to work on. Its size is looked at from ten rows on, not only from a hundred on.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.option("compression", "zstd")
    writer = writer.options(**{"parquet.block.size": block, "parquet.page.size.row.check.min": 10}) if block else writer
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none if there is no such folder."""
    fs, p = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written whole."""
    fs, p = file_system(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file; false if it is there already (of several that try, one succeeds where the file system creates atomically)."""
    fs, p = file_system(spark, path)
    try:
        out = fs.create(p, False)
    except Exception as e:
        if fs.exists(p):
            return False
        raise e
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True
