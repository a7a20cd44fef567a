"""Intermediate tables in the folder that driver and executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_OWN = "spark.darkroom.shared.dir"
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a new one only where none is set and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN, None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="darkroom-")
        spark.conf.set(_OWN, found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/steps-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def forgotten(*tables: DataFrame) -> None:
    """Removes the files of tables that written() returned, once nothing reads them."""
    for t in tables:
        spark = t.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_paths[t])
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
