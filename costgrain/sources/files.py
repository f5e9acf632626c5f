"""Reading files as ordered lines or as whole texts, within size limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Larger files are not read but told by ``too_large``; longer lines are marked and not parsed.
FILE_BYTES, LINE_BYTES = 512 << 20, 16 << 20


def lines(spark: SparkSession, path: str, glob: str = "*.jsonl", most: int | None = None) -> DataFrame:
    """(source_path, source_offset, line, oversize) of all lines of the files below ``path``.

    The offset is that of the line's first byte. Blocks of a file are read by different tasks; byte counts are added
    up inside each block, and over the blocks of a file, a row each, so that a large file stays spread. Files have FILE_BYTES at most; a line of over ``most`` (LINE_BYTES) bytes is marked.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
    meta = F.col("_metadata")
    rows = raw.select("value", meta["file_path"].alias("source_path"), meta["file_size"].alias("_size"), meta["file_block_start"].alias("_block")).where(F.col("_size") <= FILE_BYTES)
    placed = rows.withColumn("_nth", F.monotonically_increasing_id())
    size = F.octet_length("value") + 1
    before = W.unboundedPreceding, -1
    starts = rows.groupBy("source_path", "_block").agg(F.sum(size).alias("_bytes")).select("source_path", "_block", F.coalesce(F.sum("_bytes").over(W.partitionBy("source_path").orderBy("_block").rowsBetween(*before)), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum(size).over(W.partitionBy("source_path", "_block").orderBy("_nth").rowsBetween(*before)), F.lit(0))
    joined = placed.withColumn("_inside", inside).join(starts, ["source_path", "_block"])
    text = F.rtrim("value", F.lit("\r"))
    return joined.select("source_path", (F.col("_start") + F.col("_inside")).cast("long").alias("source_offset"), text.alias("line"), (F.octet_length("value") > (LINE_BYTES if most is None else most)).alias("oversize"))


def whole_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(source_path, content) of the files below ``path``."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("wholetext", True).text(path)
    return raw.select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("content"), F.col("_metadata.file_size").alias("_size")).where(F.col("_size") <= FILE_BYTES).drop("_size")


def binary_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(source_path, content) of the binary files below ``path``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return raw.where(F.col("length") <= FILE_BYTES).select(F.col("path").alias("source_path"), "content")


def too_large(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """An anomaly for each file below ``path`` that is left out for its size; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length")
    none = F.lit(None).cast("string")
    large = found.where(F.col("length") > FILE_BYTES)
    return large.select(F.lit("file_too_large").alias("type"), none.alias("session"), none.alias("turn_id"), F.col("path").alias("source_path"), F.lit(0).cast("long").alias("source_offset"), F.to_json(F.struct("length")).alias("details"))


def hashed(files: DataFrame, parser_version: str) -> DataFrame:
    """Files with content_hash and parser_version: with source_path, what a checkpoint holds."""
    return files.withColumns({"content_hash": F.sha2("content", 256), "parser_version": F.lit(parser_version)})


def changed(files: DataFrame, checkpoints: DataFrame, parser_version: str) -> DataFrame:
    """Files whose content or parser is not that of their checkpoint."""
    return hashed(files, parser_version).join(checkpoints, ["source_path", "content_hash", "parser_version"], "left_anti")


def stem(path):
    """File name without folders and last suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
