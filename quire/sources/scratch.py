"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files go as soon as the query that made them has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset (tests, a single machine) one below the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/quire-scratch").rstrip("/")


def settle(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder, in folders by the columns ``by``, and read it back: lineage and plan end at a replicated table."""
    spark = df.sparkSession
    path, was = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        w = df.write.option("compression", "zstd")
        (w.partitionBy(*by) if by else w).parquet(path)
    finally:
        spark.conf.set(_CLEAN, was)
    made = spark.read.schema(df.schema).parquet(path)
    made.quire_path = path
    return made


def drop(*tables: DataFrame, part: str = "") -> None:
    """Delete tables that ``settle`` has written, or a folder of them, once nothing reads them any more; shuffles that nothing refers to go too."""
    import gc

    spark = SparkSession.active()
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{t.quire_path}/{part}" if part else t.quire_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()
