"""What several operators of this package share."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: the space and \x09-\x0D; exactly what bytes.split() splits on.
WHITE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a folder of our own only where none is set and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.darkroom.shared.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="darkroom-")
        spark.conf.set("spark.darkroom.shared.dir", found)
    return found


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_tables(spark: SparkSession) -> None:
    """Removes what stored() has written in this application; results that still read it must be written before."""
    _remove(spark, _tables(spark))
    for t in spark.catalog.listTables():
        if t.name.startswith(BUCKETED):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")


BUCKETED = "darkroom_bucketed_"
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: With this setting a query's shuffle files go when it ends; what stored() returns reads the written table alone.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, *partition_by: str, buckets: tuple[int, str] | None = None) -> DataFrame:
    """df, written as a table in the shared folder and read back: cuts lineage and survives lost executors.

    buckets: so many, by that column, so that a later grouping by it needs no exchange."""
    spark = df.sparkSession
    made = uuid.uuid4().hex
    path = f"{_tables(spark)}/{name}-{made}"
    out = df.write.option("compression", "zstd")
    out = out.partitionBy(*partition_by) if partition_by else out
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        if buckets:
            out.bucketBy(*buckets).option("path", path).saveAsTable(f"{BUCKETED}{made}")
        else:
            out.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    table = spark.table(f"{BUCKETED}{made}") if buckets else spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def dropped(*tables: DataFrame, part: str = "") -> None:
    """Removes the files of tables that stored() returned, or those of one partition, once what was made of them is stored itself."""
    for t in tables:
        _remove(t.sparkSession, f"{_paths[t]}/{part}")


def one_text(docs: DataFrame, key: str, text: str, keys: DataFrame) -> DataFrame:
    """(_k, _label, _t): a row for each of keys(_k, _label) that docs has; of several texts of a key, the one whose hash is least."""
    met = docs.select(F.col(key).alias("_k"), F.struct(F.xxhash64(text).alias("h"), F.col(text).alias("t")).alias("_r")).join(keys, "_k")
    return met.groupBy("_k", "_label").agg(F.min("_r").alias("_r")).select("_k", "_label", F.col("_r.t").alias("_t"))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it holds, Python workers get so many rows at once; for operators on long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
