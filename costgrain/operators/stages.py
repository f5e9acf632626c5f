"""Cutting a plan where it would otherwise be worked out again and again."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that the cluster names in ``spark.checkpoint.dir``.

    Where none is set, one machine gets a temporary one (tests) and a cluster an error:
    its executors don't see each other's disks.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="costgrain-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as a checkpoint and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Rows with their number from 1 in ``order``, over ranges that tasks sort side by side; rows that tie are numbered in some order."""
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a range
    starts = sizes.select("_part", before.alias("_start"))
    joined = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_start", "_at")
