"""A ledger in files that batches and streams append to.

A batch's records go through the truth ladder against what the ledger holds; what
they supersede is noted as links, and nothing that was written is changed. Events,
links, poison and index of a batch become visible together, and a batch that comes again
changes nothing.

The index has for each event the few things that later batches ask for. It is
dealt to buckets, by session where a key holds the session and by the key where it
doesn't, and a batch opens only the buckets of its own sessions and keys: what it reads grows
with them and not with the ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costgrain.functions.identity import stable_id
from costgrain.functions.vocabulary import TOKENS, is_measured, source_kind, source_rank
from costgrain.operators import ladder
from costgrain.operators.stages import cut
from costgrain.sources.observation import COLUMNS
from costgrain.streaming.store import Store, bucket_of

EVENTS = COLUMNS | {"id": "string", "event_hash": "string", "logical_event_hash": "string", "source_kind": "string", "batch": "long"}
LINKS = "old_id string, superseded_by string, batch long"
POISON = "type string, session string, turn_id string, source_path string, source_offset long, details string"
#: What a key is for: finding records of the same thing in a session, hashes and events that are taken, what is superseded.
SAME, HASH, EVENT, GONE = "same", "hash", "event", "gone"
INDEX = "use string, key string, id string, session string, source_kind string, measured boolean, of string"
#: Hex digits of a bucket, and folders a bucket may have before ``ingest`` compacts the index.
DIGITS, FOLDERS = 2, 32
#: Records of a batch that one task sorts and joins at most, about.
ROWS = 1 << 17


def _ddl(columns: dict) -> str:
    return ", ".join(f"{c} {t}" for c, t in columns.items())


class Ledger:
    """Events and superseding links below ``folder``, a path that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str, digits: int = DIGITS, folders: int = FOLDERS):
        self.spark, self.store, self.digits, self.folders = spark, Store(spark, folder), digits, folders

    def events(self) -> DataFrame:
        """All events with ``superseded_by``."""
        at = self.store.snapshot()
        rows, links = self.store.read("events", _ddl(EVENTS), at=at), self.store.read("links", LINKS, at=at)
        by = links.groupBy("old_id").agg(F.min("superseded_by").alias("superseded_by"))
        return rows.join(by, rows["id"] == by["old_id"], "left").drop("old_id")

    def poisoned(self) -> DataFrame:
        """Anomalies of the observations that could not be stored."""
        return self.store.read("poison", POISON)

    def _bucket(self) -> Column:
        return bucket_of(F.col("of"), self.digits)

    def _keys(self, rows: DataFrame) -> DataFrame:
        """The keys that rows with identities are asked for: use, key and ``of``, what decides the bucket.

        Identities that begin with a source event hold no session: they may be taken by another session's record.
        """
        apart = F.col("source_event_id").isNotNull() & (F.col("request_id").isNull() | (F.col("source") == "snapshot_delta"))
        event = F.concat_ws("\0", "adapter", "source_kind", "source_event_id")
        key = lambda use, key, of: F.struct(F.lit(use).alias("use"), key.alias("key"), of.alias("of"))
        logical = F.coalesce("logical_event_hash", "event_hash")
        some = F.array(
            key(SAME, logical, F.col("session")), key(SAME, F.col("event_hash_v1"), F.col("session")),
            key(HASH, F.col("event_hash"), F.when(apart, F.col("event_hash")).otherwise(F.col("session"))),
            F.when(F.col("source_event_id").isNotNull(), key(EVENT, F.sha2(event, 256), event)),
        )
        return rows.withColumn("_k", F.explode(F.array_compact(some))).select("*", "_k.*").drop("_k")

    def known(self, rows: DataFrame, at: dict | None = None) -> DataFrame:
        """The part of the index that rows (with identities) may meet: their buckets, no others."""
        touched = [r[0] for r in self._keys(rows).select(self._bucket()).distinct().collect()]  # at most 16 to the power of ``digits``
        return self.store.read("index", INDEX, touched, at)

    def ingest(self, observations: DataFrame, batch: int) -> None:
        """Add a batch of observations. Batches are numbered upwards: one that isn't above the last
        has been taken before and changes nothing. What can't be stored is set apart (``poisoned``) and stops no other."""
        at = self.store.snapshot()
        if batch <= at["notes"].get("batch", -1):
            return
        # With a number of partitions that doesn't go by the batch, what a task holds would grow with it.
        conf, name = observations.sparkSession.conf, "spark.sql.shuffle.partitions"
        was = conf.get(name)
        conf.set(name, str(max(int(was), observations.count() // ROWS + 1)))
        try:
            self._ingest(observations, batch, at)
        finally:
            conf.set(name, was)

    def _ingest(self, observations: DataFrame, batch: int, at: dict) -> None:
        sound, broken = poison(observations.select(*COLUMNS))
        clean = cut(ladder.deduplicate(sound).withColumns({"source_kind": source_kind(F.col("source"), F.col("source_subtype")), "logical_event_hash": F.lit(None).cast("string")}))
        index = self.known(clean, at)
        gone = index.where(F.col("use") == GONE).select(F.col("key").alias("id"))
        stored = index.where(F.col("use") == SAME).join(gone, "id", "left_anti").select("id", "session", F.col("key").alias("event_hash"), F.lit(None).cast("string").alias("logical_event_hash"), "source_kind", "measured")
        new, links = ladder.supersede(stored, clean.drop("logical_event_hash"))
        new = cut(new)
        # Of two keys the hash is settled by the ladder; the other is the event of an adapter and kind.
        fresh = new.where("old_id is null").withColumn("_event", F.when(F.col("source_event_id").isNotNull(), F.sha2(F.concat_ws("\0", "adapter", "source_kind", "source_event_id"), 256)))
        fresh = fresh.join(index.where(F.col("use") == EVENT).select(F.col("key").alias("_event")).distinct(), "_event", "left_anti")
        fresh = fresh.join(index.where(F.col("use") == HASH).select(F.col("key").alias("event_hash")).distinct(), "event_hash", "left_anti").drop("_event")
        rows = cut(fresh.unionByName(new.where("old_id is not null")).withColumns({"id": stable_id("event", F.col("event_hash")), "batch": F.lit(batch).cast("long")}))
        named = rows.select(F.col("event_hash").alias("superseded_by"), F.col("id").alias("_id"), "session")
        linked = cut(links.join(named, "superseded_by").select("old_id", F.col("_id").alias("superseded_by"), F.lit(batch).cast("long").alias("batch"), "session"))
        # A stored record is found by its logical hash only; the legacy one is what others ask by.
        keys = self._keys(rows).where(~((F.col("use") == SAME) & (F.col("key") != F.coalesce("logical_event_hash", "event_hash"))))
        entries = keys.select("use", "key", "id", "session", "source_kind", is_measured().alias("measured"), "of").distinct()
        ends = linked.select(F.lit(GONE).alias("use"), F.col("old_id").alias("key"), F.lit(None).cast("string").alias("id"), "session", F.lit(None).cast("string").alias("source_kind"), F.lit(None).cast("boolean").alias("measured"), F.col("session").alias("of"))
        write = self.store.write
        add = {"events": write("events", rows.select(*EVENTS)), "links": write("links", linked.drop("session")), "poison": write("poison", broken), "index": write("index", entries.unionByName(ends), self._bucket(), ["use", "key"])}
        after = self.store.commit(at, add, notes={"batch": batch})
        if max(map(len, after["tables"]["index"].values()), default=0) > self.folders:
            self.compact()

    def compact(self) -> None:
        """Write the buckets of the index that have several folders into one; what is superseded is left out."""
        at = self.store.snapshot()
        many = [b for b, paths in at["tables"].get("index", {}).items() if len(paths) > 1]
        rows = self.store.read("index", INDEX, many, at)
        gone = rows.where(F.col("use") == GONE).select(F.col("key").alias("id")).distinct()
        same = rows.where(F.col("use") == SAME).join(gone, "id", "left_anti").select(*rows.columns)
        kept = rows.where(F.col("use").isin(HASH, EVENT)).unionByName(same)
        self.store.commit(at, replace={"index": (many, self.store.write("index", kept, self._bucket(), ["use", "key"]))})

    def follow(self, observations: DataFrame, checkpoint: str, trigger: dict | None = None):
        """Ingest a stream of observations, a micro-batch a batch; however late a
        better record comes, it supersedes. Returns the running query."""
        write = observations.writeStream.foreachBatch(lambda df, n: self.ingest(df, n)).option("checkpointLocation", checkpoint)
        return write.trigger(**(trigger or {"availableNow": True})).start()


def poison(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound observations, and those that can't be stored: a negative count, no session or adapter, no known source."""
    negative = F.least(*(F.coalesce(F.col(t), F.lit(0)) for t in [*TOKENS, "cost_micros"])) < 0
    bad = negative | F.col("session").isNull() | F.col("adapter").isNull() | source_rank(F.col("source")).isNull()
    marked = rows.withColumn("_bad", bad)
    broken = marked.where("_bad").select(F.lit("poison_row").alias("type"), "session", "turn_id", "source_path", "source_offset", F.to_json(F.struct(F.sha2(F.to_json(F.struct(*COLUMNS)), 256).alias("fingerprint"), is_measured().alias("measured"))).alias("details"))
    return marked.where("not _bad").drop("_bad"), broken
