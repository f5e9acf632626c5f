"""Import of prototype ledgers: all tables in one commit, again and again without doubling.

Projects, items, sessions, events, spans, groups and attributions of the files become
visible together; a run that dies before leaves nothing, and what it wrote is removed by
``Store.clean``. Records whose hash is there, or whose event of adapter and kind is, are counted as
duplicates and change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costgrain.functions.identity import stable_id
from costgrain.operators import attribution, ladder
from costgrain.operators.stages import cut
from costgrain.sources.observation import COLUMNS
from costgrain.streaming.store import Store, bucket_of

_EVENTS = ", ".join(f"{c} {t}" for c, t in COLUMNS.items()) + ", id string, event_hash string, source_kind string"
SCHEMAS = {
    "projects": "id string, title string, created_at string", "items": "id string, project_id string, title string, created_at string", "sessions": "id string, session string, project_id string",
    "events": _EVENTS, "spans": "span_id string, usage_event_id string, session string, measurement_status string",
    "groups": "group_id string, span_id string, version int, active boolean", "attributions": "group_id string, work_item_id string, role string, weight int, confidence double",
}
#: What of an event decides whether another one enters.
_KEYS = "event_hash string, adapter string, source_kind string, source_event_id string"


class Imports:
    """The tables of ``SCHEMAS`` below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, digits: int = 2):
        self.store, self.digits = Store(spark, folder), digits

    def table(self, name: str, at: dict | None = None) -> DataFrame:
        return self.store.read(name, SCHEMAS[name], at=at)

    def apply(self, rows: DataFrame) -> dict[str, int]:
        """Import observations with project and task (``documents.prototypes_of``): how many records, how many
        entered, how many were there already.

        An observation's project and item go by their names, its whole attribution to that item.
        A session belongs to the project of its last record by place.
        """
        at = self.store.snapshot()
        project = stable_id("prj", F.lower("project"))
        named = cut(rows.withColumn("_project", project).withColumn("_item", stable_id("wrk", F.concat_ws(":", "_project", "task"))))
        bucket = bucket_of(F.col("source_event_id"), self.digits)
        touched = [r[0] for r in named.select(bucket).distinct().collect()]
        known = self.store.read("keys", _KEYS, touched, at)
        entered = ladder.insert_or_ignore(known, named.select(*COLUMNS)).select(*COLUMNS, "event_hash", "source_kind")
        fresh = cut(entered.withColumn("id", stable_id("evt", F.col("event_hash"))))
        of = named.select("source_event_id", "_project", "_item").distinct()
        events = fresh.join(of, "source_event_id").withColumn("superseded_by", F.lit(None).cast("string"))
        spans, groups, shares = attribution.default_attribution(events, None, F.col("_item"))
        new = lambda df, name: df.join(self.table(name, at).select("id"), "id", "left_anti")
        projects = new(named.groupBy(F.col("_project").alias("id")).agg(F.min_by("project", F.struct("source_path", "source_offset")).alias("title"), F.min("observed_at").alias("created_at")), "projects")
        items = new(named.groupBy(F.col("_item").alias("id")).agg(F.first("_project").alias("project_id"), F.min("task").alias("title"), F.min("observed_at").alias("created_at")), "items")
        last = named.groupBy("session").agg(F.max_by("_project", F.struct("source_path", "source_offset")).alias("project_id")).withColumn("id", stable_id("ses", F.concat_ws(":", F.lit("prototype"), "session"))).select("id", "session", "project_id")
        on = bucket_of(F.col("id"), self.digits)
        buckets = [r[0] for r in last.select(on).distinct().collect()]
        others = self.store.read("sessions", SCHEMAS["sessions"], buckets, at).join(last.select("id"), "id", "left_anti")
        write = self.store.write
        add = {
            "projects": write("projects", projects), "items": write("items", items), "events": write("events", fresh.select(*COLUMNS, "id", "event_hash", "source_kind")), "spans": write("spans", spans),
            "groups": write("groups", groups), "attributions": write("attributions", shares), "keys": write("keys", fresh.select("event_hash", "adapter", "source_kind", "source_event_id"), bucket, ["event_hash"]),
        }
        self.store.commit(at, add, {"sessions": (buckets, write("sessions", others.unionByName(last), on))})
        records, inserted = named.count(), fresh.count()
        return {"records": records, "inserted": inserted, "duplicates": records - inserted}
