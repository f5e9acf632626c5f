"""Who pays: versioned attribution of events to work items, as appends only.

A span stands for one event; its groups are versions, of which the last active
one counts, and the weights of a group add up to ``WHOLE``. Corrections append
groups; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from costgrain.functions.identity import stable_id
from costgrain.functions.vocabulary import LIFECYCLE, is_measured

WHOLE = 10_000


def current(groups: DataFrame) -> DataFrame:
    """The last version of each span's groups, where it is active."""
    last = W.partitionBy("span_id").orderBy(F.desc("version"), F.desc("group_id"))
    return groups.withColumn("_n", F.row_number().over(last)).where("_n = 1 and active").drop("_n")


def default_attribution(events: DataFrame, spans: DataFrame | None, work_item: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans, groups and attributions of active events without a span; lifecycle counters get none."""
    new = events.where(F.col("superseded_by").isNull() & ~F.col("source_kind").isin(LIFECYCLE))
    if spans is not None:
        new = new.join(spans.select(F.col("usage_event_id").alias("id")), "id", "left_anti")
    made = new.select(
        stable_id("span", F.col("id")).alias("span_id"), F.col("id").alias("usage_event_id"), "session", F.when(is_measured(), "measured").otherwise("unavailable").alias("measurement_status"), work_item.alias("work_item_id")
    )
    group = stable_id("group", F.concat_ws(":", "span_id", F.lit("1")))
    groups = made.select(group.alias("group_id"), "span_id", F.lit(1).alias("version"), F.lit(True).alias("active"))
    rows = made.select(group.alias("group_id"), "work_item_id", F.lit("primary").alias("role"), F.lit(WHOLE).alias("weight"), F.lit(1.0).alias("confidence"))
    return made.drop("work_item_id"), groups, rows


def attach(spans: DataFrame, groups: DataFrame, session: str, work_item_id: str) -> tuple[DataFrame, DataFrame]:
    """A new group for each span of a session that gives all of it to one item."""
    version = groups.groupBy("span_id").agg(F.max("version").alias("_v"))
    mine = spans.where(F.col("session") == session).select("span_id").join(version, "span_id", "left").withColumn("version", F.coalesce("_v", F.lit(0)) + 1)
    group = stable_id("group", F.concat_ws(":", "span_id", F.col("version").cast("string")))
    new = mine.select(group.alias("group_id"), "span_id", "version", F.lit(True).alias("active"))
    rows = new.select("group_id", F.lit(work_item_id).alias("work_item_id"), F.lit("primary").alias("role"), F.lit(WHOLE).alias("weight"), F.lit(1.0).alias("confidence"))
    return new, rows


def detach(spans: DataFrame, groups: DataFrame, session: str) -> DataFrame:
    """Versions that end the attribution of a session's spans."""
    new, _ = attach(spans, groups, session, "")
    return new.withColumn("active", F.lit(False))


def merge_items(attributions: DataFrame, source: Column, target: Column) -> DataFrame:
    """Attributions with ``source`` given to ``target``: of a group's rows for one
    item the weights add up, the first role stays and the greatest confidence."""
    moved = attributions.withColumn("work_item_id", F.when(F.col("work_item_id") == source, target).otherwise(F.col("work_item_id")))
    return moved.groupBy("group_id", "work_item_id").agg(F.sum("weight").alias("weight"), F.min_by("role", "ordinal").alias("role"), F.max("confidence").alias("confidence"))


def split_item(attributions: DataFrame, chosen: DataFrame, source: Column, new_item: Column) -> DataFrame:
    """Attributions in which the groups in ``chosen`` (group_id) give ``new_item`` what
    they gave ``source``; other targets stay."""
    marked = attributions.join(chosen.select("group_id").distinct().withColumn("_in", F.lit(True)), "group_id", "left")
    moved = F.when(F.col("_in") & (F.col("work_item_id") == source), new_item).otherwise(F.col("work_item_id"))
    return marked.withColumn("work_item_id", moved).drop("_in")


def broken_groups(attributions: DataFrame) -> DataFrame:
    """Groups whose weights don't add up to the whole; there must be none."""
    return attributions.groupBy("group_id").agg(F.sum("weight").alias("weight")).where(F.col("weight") != WHOLE)
