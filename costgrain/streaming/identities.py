"""Sets of identities kept from snapshot to snapshot, and what came and went between two.

A snapshot is dealt to buckets, and each bucket has a digest: how many identities, and
two sums of their hashes. Two snapshots are compared by their digests first; only
buckets with unlike ones are read and joined, so equal snapshots cost their digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costgrain.operators.stages import cut
from costgrain.streaming.store import Store, bucket_of

DIGEST = "snapshot string, bucket string, n long, low string, high string"


class Identities:
    """Named snapshots below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, digits: int = 2):
        self.store, self.digits = Store(spark, folder), digits

    def keep(self, name: str, identities: DataFrame) -> None:
        """Keep the different values of the column ``identity`` as a snapshot, in the place of one of that name; null is none."""
        at = self.store.snapshot()
        rows = cut(identities.select("identity").where("identity is not null").distinct())
        bucket = bucket_of(F.col("identity"), self.digits)
        half = lambda a: F.sum(F.conv(F.substring(F.sha2("identity", 256), a, 15), 16, 10).cast("decimal(38,0)")).cast("string")
        digests = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), half(1).alias("low"), half(16).alias("high")).select(F.lit(name).alias("snapshot"), "bucket", "n", "low", "high")
        table = f"set-{name}"
        others = self.store.read("digests", DIGEST, at=at).where(F.col("snapshot") != name)
        new = {table: (sorted(at["tables"].get(table, {})), self.store.write(table, rows, bucket, ["identity"]))}
        self.store.commit(at, replace=new | {"digests": (sorted(at["tables"].get("digests", {})), self.store.write("digests", others.unionByName(digests)))})

    def unlike(self, before: str, after: str) -> list[str]:
        """The buckets in which two snapshots differ, by their digests alone."""
        digests = self.store.read("digests", DIGEST)
        a, b = (digests.where(F.col("snapshot") == s).select("bucket", F.struct("n", "low", "high").alias(c)) for s, c in ((before, "a"), (after, "b")))
        return sorted(r[0] for r in a.join(b, "bucket", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("bucket").collect())

    def difference(self, before: str, after: str) -> DataFrame:
        """(identity, change) of identities that were ``added`` or ``removed`` between two snapshots."""
        at, buckets = self.store.snapshot(), self.unlike(before, after)
        a, b = (self.store.read(f"set-{s}", "identity string", buckets, at) for s in (before, after))
        added, removed = b.join(a, "identity", "left_anti"), a.join(b, "identity", "left_anti")
        return added.withColumn("change", F.lit("added")).unionByName(removed.withColumn("change", F.lit("removed")))
