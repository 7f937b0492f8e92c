"""The folder that driver and executors share, and tables written there once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a new temporary folder if all runs in one process, and on a cluster an error, as executors would write to disks of their own."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        place = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back, for what is used more than once: columns that a use doesn't need aren't read."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def laid_out(df: DataFrame, key: str, name: str, buckets: int | None = None, dealt: bool = False) -> DataFrame:
    """df, written once as a table in buckets by a hash of key and read back: groups, windows and joins by key (alone or with more) read it without an exchange.

    buckets are as many as the session's shuffle partitions if not given. One shuffle comes before the write, so that a
    bucket is one file; a df that is dealt by key already, as after a join by it, needs none.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, name)
    table = re.sub(r"\W", "_", path.rsplit("/", 1)[1])
    dealt_rows = df if dealt else df.repartition(n, key)
    dealt_rows.write.bucketBy(n, key).option("compression", "zstd").option("path", path).saveAsTable(table)
    return spark.table(table)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
