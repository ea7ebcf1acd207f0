"""The folder that driver and executors share, and tables written to it.

Lineage is cut by writing Parquet there, so a lost executor costs a re-read and never a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def steady(spark: SparkSession) -> SparkSession:
    """The session, with rows of a union dealt anew where a window or aggregate asks for rows of a key together. Spark 4.1 takes a
    union of equally partitioned sides to be partitioned so, which gave rows of one key to two windows (measured)."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder. Where the session names none, a temporary one is set in local mode, as in tests; on a
    cluster that would be another folder on each machine, so it is an error."""
    steady(spark)
    root = spark.conf.get(SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set(SETTING, root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_root(spark)}/work/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt by columns to twice as many tasks as the session shuffles to, for steps whose work is far larger than their bytes: small
    partitions are otherwise put together by bytes, in the end to one task. (Dealt to as many, Spark would leave it out where a
    join or window has dealt by the same columns before.)"""
    return df.repartition(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def publish(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet and read it back, with its schema given so that empty tables keep theirs."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders through the file system that Spark uses for them."""
    jvm = spark._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Delete all that the engine and its operators have left in the shared folder: tables, streams, archives and files that results
    were read from."""
    remove(spark, f"{shared_root(spark)}/work")
