"""Pieces that several corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: White space between words: blank, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one named in ``spark.checkpoint.dir``.

    Where none is set, one machine gets a temporary one (tests); a cluster gets an
    error, because its executors don't see each other's disks.
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


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as a compressed table and go on from there.

    Like ``cut``, for what is large: a checkpoint is not compressed. ``forget`` removes it."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have the files of shuffles dropped whose frames are gone: Spark does so only
    after its driver has collected garbage, which a large driver seldom does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}+|{SPACE}+$", "")
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, f"{SPACE}+"))


def word_count(text: Column) -> Column:
    """Number of words of a text, as a long; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def in_training(doc_id: Column, modulus: int, held_out: int) -> Column:
    """True for documents that models may learn from; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus != held_out


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def small(batches: Iterable[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many, so that few texts are unpacked at a time."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def batch_of(schema: pa.Schema, *columns: Iterable) -> pa.RecordBatch:
    """A record batch from lists or arrays in the order of ``schema``."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def apart(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``key`` recomputed, so that Spark no longer knows it is
    already dealt by it. A join then deals both sides anew, which lets adaptive
    execution split a hot key of the other side."""
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long")))


def with_offsets(df: DataFrame, groups: list[str], order: list[str], totals: dict[str, Column], chunks: int, chunk: Column | None = None) -> DataFrame:
    """Add exclusive running totals within each group, without a task per group.

    ``totals`` maps each new column to the quantity it sums. A group is cut into
    ``chunks`` by a hash of ``order``, or by the number ``chunk``; chunk sums are added up over the few
    chunks, rows only inside their own chunk, so a group that holds most rows is
    spread like any other. The order is by (chunk, ``order``): fixed, but
    scattered. ``groups`` must hold no nulls; rows that tie in all of ``order``
    should be equal in whatever is summed.
    """
    chunked = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)) if chunk is None else chunk)
    keys = [*groups, "_chunk"]
    sums = chunked.groupBy(*keys).agg(*(F.sum(v).alias(f"_sum_{k}") for k, v in totals.items()))
    before = W.partitionBy(*groups).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*keys, *(F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_at_{k}") for k in totals))
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = chunked.withColumns({k: F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in totals.items()})
    out = placed.join(starts, keys)
    return out.select(*df.columns, *((F.col(k) + F.col(f"_at_{k}")).cast("long").alias(k) for k in totals))


def chunks_for(rows: int, per_chunk: int = 20_000, least: int = 256) -> int:
    """How many chunks keep each at about ``per_chunk`` rows."""
    return max(least, -(-rows // per_chunk))


def runs(sorted_keys) -> Iterator[tuple[int, int]]:
    """Start and end of each run of two or more equal values in a sorted array."""
    import numpy as np

    edges = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1], [True])))
    long = np.flatnonzero(np.diff(edges) > 1)
    yield from zip(edges[long].tolist(), edges[long + 1].tolist(), strict=True)
