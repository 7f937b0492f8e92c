"""Helpers shared by the training-data operators: table access, shared scratch tables, size-checked lookups."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but ASCII white space; fixed by the contracts of the operators on words.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a small side is broadcast; beyond it the lookup is a salted shuffle join.
BROADCAST_ROWS = 20_000
#: Rows of one key beyond which a join takes the key apart from the others.
HOT_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new temporary one if all runs in one process; on a cluster an error, as executors would write to disks of their own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = spark.sparkContext.getCheckpointDir()
    if not place:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        place = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as a table in the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    scratch_paths(spark).append(path)
    return out


def scratch_paths(spark: SparkSession) -> list[str]:
    """Paths of the tables that written() has made in this application, in order; discard() takes them out."""
    sc = spark.sparkContext
    if not hasattr(sc, "_spanloom_scratch"):
        sc._spanloom_scratch = []
    return sc._spanloom_scratch


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables made by written() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    if path in scratch_paths(spark):
        scratch_paths(spark).remove(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it (also inside lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lookup(big: DataFrame, small: DataFrame, key: str, how: str = "inner", salts: int = 32) -> DataFrame:
    """big joined with small, unique on the non-null column key: small is broadcast only if it is counted to be at most BROADCAST_ROWS rows; else it is copied to each of `salts` salts, so that no key's rows meet in one task."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    return spread.join(salted, [key, "_salt"], how).drop("_salt")


def counted_join(big: DataFrame, small: DataFrame, keys: list[str], count: str) -> DataFrame:
    """The inner join of big with small, which is unique on the non-null columns keys and has in column count how many rows of big a key has.

    Keys of more than HOT_ROWS rows are looked up apart, in a counted broadcast or with salts, and their rows are left
    out of the shuffle by key, so that no key's rows meet in one task.
    """
    hot = small.where(F.col(count) > HOT_ROWS)
    n = hot.limit(BROADCAST_ROWS + 1).count()
    if not n:
        return big.join(small, keys)
    cold = small.where(F.col(count) <= HOT_ROWS)
    if n <= BROADCAST_ROWS:
        calm, warm = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti"), big.join(F.broadcast(hot), keys)
        return calm.join(cold, keys).unionByName(warm)
    # so many hot keys are a small share of big, which has HOT_ROWS rows of each
    salt, every = F.pmod(F.xxhash64(*big.columns), F.lit(32)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(31)))
    return big.withColumn("_salt", salt).join(small.withColumn("_salt", every), [*keys, "_salt"]).drop("_salt")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each SparkContext."""
    sc = spark.sparkContext
    if not getattr(sc, "_spanloom_shipped", False):
        package = Path(__file__).resolve().parents[1]
        made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{package.name}", "zip", package.parent, package.name)
        sc.addPyFile(made)
        sc._spanloom_shipped = True


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows and bytes, so that tables with very long texts fit in a Python worker; and the package where the workers find it."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
