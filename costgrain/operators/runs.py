"""Runs that people start and stop by hand, as rows to append."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costgrain.sources.documents import manual_run


def _id(prefix: str, value: str) -> str:
    return f"{prefix}_{hashlib.sha256(value.encode()).hexdigest()[:24]}"


def start(spark: SparkSession, project_key: str, task: str, now: str, parent: str | None = None) -> dict[str, DataFrame]:
    """Rows that a start adds: work_items and manual_runs. Ids are made from names, so a second start adds no second item."""
    project = _id("prj", project_key)
    above = _id("wi", f"{project}:{parent}") if parent else None
    item = _id("wi", f"{project}:{task}")
    run = "run_" + hashlib.sha256(f"{now}:{task}".encode()).hexdigest()[:16]
    items = ([(above, project, None, "objective", parent, now)] if parent else []) + [(item, project, above, "manual_task", task, now)]
    return {
        "work_items": spark.createDataFrame(items, "id string, project_id string, parent_id string, type string, title string, created_at string"),
        "manual_runs": spark.createDataFrame([(run, _id("ses", f"manual:{run}"), project, item, now, None, "active")], "id string, session string, project_id string, work_item_id string, started_at string, stopped_at string, state string"),
    }


def active(runs: DataFrame) -> DataFrame:
    """The run that was started last and not stopped: of each run its last state counts."""
    state = runs.groupBy("id").agg(F.max_by(F.struct(*[c for c in runs.columns if c != "id"]), F.when(F.col("state") == "active", 0).otherwise(1)).alias("r")).select("id", "r.*")
    return state.where("state = 'active'").orderBy(F.desc("started_at"), "id").limit(1)


def stop(runs: DataFrame, now: str, counts: dict[str, int | None]) -> tuple[DataFrame, DataFrame]:
    """Rows that a stop adds: the run's end, and its observation with the counts told. Without an active run it is an error."""
    row = active(runs).first()
    if row is None:
        raise LookupError("no active run")
    ended = runs.sparkSession.createDataFrame([tuple(row[c] if c not in ("stopped_at", "state") else {"stopped_at": now, "state": "stopped"}[c] for c in runs.columns)], runs.schema)
    return ended, manual_run(runs.sparkSession, row["id"], now, counts)
