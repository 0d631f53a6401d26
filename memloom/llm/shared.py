"""Tables in the folder that driver and executors share, and running totals that no single task has to compute."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.session import checkpoint_folder


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only on a local master without that setting."""
    folder = checkpoint_folder(spark) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` written once as a table in the shared folder and read again, so lost executors cost no recomputation."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def hash_bucket(value: Column, bits: int) -> Column:
    """The top ``bits`` bits of a 64-bit hash, in the order of the hash as an unsigned number."""
    return F.shiftrightunsigned(value, 64 - bits)


def running_total(df: DataFrame, group: list[str], bucket: str, order: list[str], amount: str, name: str, slim: DataFrame | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` over the rows of the same group that come before this one.

    Rows are ordered by ``bucket``, then by ``order``. A group may hold most of the table: its rows are summed per
    (group, bucket), and only one row per bucket takes part in the running sum across buckets. ``slim`` has the same rows
    with fewer columns, for the sums.
    """
    sums = (df if slim is None else slim).groupBy(*group, bucket).agg(F.sum(amount).alias("__sum"))
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(c).alias(f"__{c}") for c in [*group, bucket]], F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    match = F.lit(True)
    for c in [*group, bucket]:
        match = match & F.col(c).eqNullSafe(F.col(f"__{c}"))
    summed = df.withColumn("__inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    joined = summed.join(offsets, match)
    return joined.withColumn(name, F.col("__inside") + F.col("__before")).drop("__inside", "__before", *[f"__{c}" for c in [*group, bucket]])
