"""Checkpoints in the folder that all executors share, dealing and numbering of rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sums import parts, total


def _shared(spark: SparkSession) -> str:
    """The folder of checkpoints, which the driver and all executors share; the session's is kept where it has one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a frame that several later steps read."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path of its own for files that other tasks read."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows over the session's number of shuffle partitions, ahead of costly work on each; a number that is named isn't lowered for small inputs."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def numbered(df: DataFrame, by: str) -> DataFrame:
    """Adds n, 1 for the row of the least `by`: rows are range partitioned, counted, and numbered within their partition."""
    spread = cut(df.repartitionByRange(by).withColumn("_p", F.spark_partition_id()))
    sizes = spread.groupBy("_p").agg(F.count(F.lit(1)).alias("size")).orderBy("_p").collect()  # one row a partition
    before, total = [], 0
    for r in sizes:
        before.append((r._p, total))
        total += r["size"]
    offsets = df.sparkSession.createDataFrame(before or [(0, 0)], "_p int, _before long")
    at = F.row_number().over(Window.partitionBy("_p").orderBy(by))
    return spread.join(F.broadcast(offsets), "_p").withColumn("n", at + F.col("_before")).drop("_p", "_before")


def ranked(df: DataFrame, key: str, by: str, amount: str | None = None) -> DataFrame:
    """Adds nth, 1 for the row of the least `by` among those of its key, and upto, the sum of `amount` so far if one is named.

    Rows are range partitioned by both, so that a key of very many rows is dealt over tasks.
    """
    added = list(parts(F.lit(0.0))) if amount else []
    if amount:
        df = df.withColumns(parts(F.col(amount)))
    pieces = cut(df.repartitionByRange(key, by).withColumn("_p", F.spark_partition_id()))
    sizes = pieces.groupBy(key, "_p").agg(F.count(F.lit(1)).alias("_size"), *[F.sum(c).alias(c) for c in added])
    earlier = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition at most
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before")
    sizes = sizes.select(key, "_p", *[before(c) for c in ("_size", *added)])
    here = Window.partitionBy(key, "_p").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = pieces.join(sizes, [key, "_p"]).withColumn("nth", F.row_number().over(here) + F.col("_size_before"))
    if amount:
        so_far = {c: F.sum(c).over(here) + F.col(f"{c}_before") for c in added}
        out = out.withColumn("upto", total(so_far.__getitem__))
    return out.drop("_p", *added, *[f"{c}_before" for c in ("_size", *added)])
