"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names it; only in local mode (tests, a laptop) is a
temporary folder made where that is unset: on a cluster nobody else could read it.  A written table outlives lost executors, is columnar,
and gives the optimizer its size.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or _own(spark)


def _own(spark: SparkSession) -> str:
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rivulet-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once and read back: lineage ends here."""
    spark = df.sparkSession
    path = f"{folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rivulet_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a written table that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._rivulet_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
