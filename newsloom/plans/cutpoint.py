"""Cut points: tables in the shared folder where lineage ends."""

from __future__ import annotations

import atexit
import getpass
import uuid

from pyspark.sql import DataFrame, SparkSession


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local master may fall back to one of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file:///tmp/newsloom-{getpass.getuser()}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if spark.sparkContext._jsc is not None and jvm is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_roots: set[str] = set()


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder. One folder holds all of an application's; it goes
    when the Python process ends."""
    root = f"{shared_dir(spark)}/newsloom/{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_quietly_delete, spark, root)
    return f"{root}/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there.

    A lost executor makes Spark reread files, not recompute what came before. The write's
    shuffle files go with it, for nothing reads them after.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._newsloom_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files behind a materialized table that no later job reads."""
    _delete(df.sparkSession, df._newsloom_path)


def _quietly_delete(spark: SparkSession, root: str) -> None:
    try:
        _delete(spark, root)
    except Exception:  # noqa: BLE001  the JVM may be gone by now; its shared folder is the cluster's to clean
        pass
