"""Intermediate tables that outlive the executors which computed them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A temporary folder stands in only for a local master, as in tests; on a
    cluster such a folder would not be visible to the other machines.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="dealerscope-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir() or folder


def fresh_path(spark: SparkSession) -> str:
    """A path not used before, in this application's subfolder of the shared folder."""
    own = f"{scratch_root(spark).rstrip('/')}/dealerscope-{spark.sparkContext.applicationId}"
    return f"{own}/{uuid.uuid4().hex}"


def materialise(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` once and return a scan of the written table.

    Used where a result is read by several later branches (so the facts behind it
    are scanned once) and between the steps of an iteration (so lineage stays short). All
    tables of one application lie in one folder, which can go when the application has ended.
    ``options`` are the writer's, such as the compression.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
