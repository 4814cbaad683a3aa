"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "vecloop", cpus: int | str = "*") -> SparkSession:
    """A local session for tests and the benchmark; on a cluster use the submitted one."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("VECLOOP_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own: there, driver and
    executors are one machine.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="vecloop-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other table uses."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/vecloop/{app}/{name}-{uuid.uuid4().hex}"


def write_and_reread(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and continue from the written table.

    Cuts the lineage, and fixes values that depend on how rows were spread over partitions.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``fresh_path`` named, whatever is in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove_intermediates(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder; for the end of a job, when no result is read any more."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        remove(spark, f"{root.rstrip('/')}/vecloop/{spark.sparkContext.applicationId}")


def shared_uri(spark: SparkSession, path: str) -> str:
    """The path as a full URI, which tasks can open with ``open_folder``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def open_folder(uri: str):
    """The pyarrow file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    if uri.startswith("file:/"):  # Hadoop writes file:/x where others write file:///x
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)
