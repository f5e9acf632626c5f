"""Repair of stored snapshots, with a log and a way back.

Snapshots that were stored as if they were deltas are rewritten to what was used.
A repair is known by the digest of its plan. What the rows were goes to
before-images, a line to the maintenance log, and the buckets of the events that change
are written anew: all in one commit, so a repair is there whole or not at all.
One that the log has is not applied again; taking it back gives the first rows,
removes its anomalies and its line, and it may then run once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costgrain.functions.identity import stable_id
from costgrain.functions.vocabulary import TOKENS
from costgrain.operators import deltas
from costgrain.operators.stages import cut
from costgrain.streaming.store import Store, bucket_of

#: What the log and the anomalies say.
KIND, VERSION, ANOMALY = "snapshot_overcount", "1", "snapshot_repair_negative_delta"
IMAGES = "run_id string, id string, session string, " + ", ".join(f"{t} long" for t in TOKENS)
ANOMALIES = "run_id string, id string, type string, session string, event_id string, details string"
LOG = "id string, kind string, version string, run_id string, rows long, baseline_rows long, delta_rows long, backward_rows long, sessions long"


class Repairs:
    """Events (id, session, observed_at, source_offset, token counts and more: ``columns``, DDL) below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, columns: str, digits: int = 2):
        self.store, self.columns, self.digits = Store(spark, folder), columns, digits

    def _bucket(self) -> Column:
        return bucket_of(F.col("session"), self.digits)

    def load(self, events: DataFrame) -> None:
        """Add events."""
        self.store.commit(self.store.snapshot(), {"events": self.store.write("events", events, self._bucket())})

    def events(self) -> DataFrame:
        return self.store.read("events", self.columns)

    def log(self) -> DataFrame:
        return self.store.read("log", LOG)

    def anomalies(self) -> DataFrame:
        return self.store.read("anomalies", ANOMALIES)

    @staticmethod
    def plan(candidates: DataFrame) -> DataFrame:
        """Each row's ``action`` and new counts."""
        return deltas.repair_snapshots(candidates)

    def apply(self, wrong: Column) -> str | None:
        """Repair the events that ``wrong`` tells; the run's id, or None where nothing is to do or the log has it."""
        at = self.store.snapshot()
        if at["notes"].get("repair"):
            return None
        events = self.store.read("events", self.columns, at=at)
        plan = cut(self.plan(events.where(wrong)))
        sign = F.xxhash64("id", "action", *TOKENS, *(f"new_{t}" for t in TOKENS))
        count = lambda a: F.count(F.when(F.col("action") == a, 1))
        told = plan.agg(F.count("*"), count("baseline"), count("delta"), count("backward"), F.countDistinct(F.coalesce("session", F.lit(""))), F.bit_xor(sign), F.sum(sign.cast("decimal(38,0)")).cast("string")).first()
        if not told[0]:
            return None
        run = f"repair_{told[0]}_{told[5] & (1 << 64) - 1:016x}_{told[6].lstrip('-')}"
        touched = [r[0] for r in plan.select(self._bucket()).distinct().collect()]
        new = plan.select("id", *(f"new_{t}" for t in TOKENS), F.lit(True).alias("_hit"))
        names = events.columns
        rewritten = self.store.read("events", self.columns, touched, at).join(new, "id", "left").select(*(F.when(F.col("_hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in TOKENS else c for c in names))
        images = plan.select(F.lit(run).alias("run_id"), "id", "session", *TOKENS)
        odd = plan.where("action = 'backward'").select(
            F.lit(run).alias("run_id"), stable_id("anom", F.concat_ws(":", F.lit(ANOMALY), F.lit(run), "id")).alias("id"), F.lit(ANOMALY).alias("type"), "session", F.col("id").alias("event_id"), F.to_json(F.struct(*TOKENS), {"ignoreNullFields": "false"}).alias("details")
        )
        spark = events.sparkSession
        line = spark.range(1).select(stable_id("maint", F.lit(f"{KIND}:{run}")).alias("id"), F.lit(KIND).alias("kind"), F.lit(VERSION).alias("version"), F.lit(run).alias("run_id"), *(F.lit(n).cast("long").alias(c) for n, c in zip(told[:5], ("rows", "baseline_rows", "delta_rows", "backward_rows", "sessions"), strict=True)))
        write = self.store.write
        self.store.commit(at, {"images": write("images", images, self._bucket()), "anomalies": write("anomalies", odd), "log": write("log", line)}, {"events": (touched, write("events", rewritten, self._bucket()))}, {"repair": run})
        return run

    def restore(self) -> str | None:
        """Take the repair back; its run's id, or None where there is none."""
        at = self.store.snapshot()
        run = at["notes"].get("repair")
        if not run:
            return None
        touched = sorted(at["tables"]["images"])
        images = self.store.read("images", IMAGES, at=at).where(F.col("run_id") == run).select("id", *(F.col(t).alias(f"_{t}") for t in TOKENS), F.lit(True).alias("_hit"))
        now = self.store.read("events", self.columns, touched, at)
        before = now.join(images, "id", "left").select(*(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in TOKENS else c for c in now.columns))
        empty = {n: (sorted(at["tables"][n]), {}) for n in ("images", "anomalies", "log")}
        self.store.commit(at, replace={"events": (touched, self.store.write("events", before, self._bucket())), **empty}, notes={"repair": None})
        return run
