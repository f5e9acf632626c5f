"""Upkeep of a ledger: checkpoints, generations, vocabulary, integrity, hook turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from costgrain.functions.vocabulary import TOKENS


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of stored and incoming rows of a key the last by ``order``, whole."""
    both = stored.unionByName(incoming)
    rest = [c for c in both.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def generation_conflicts(stored: DataFrame, incoming: DataFrame, version: str, old: list[str]) -> DataFrame:
    """Sessions of ``incoming`` that hold records of an old parser while a new one brings more."""
    if version in old:
        return incoming.limit(0)
    before = stored.where(F.col("parser_version").isin(old)).select("session").distinct()
    return incoming.join(before, "session", "left_semi")


def migrate_kinds(events: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Kinds by the mapping: new kind, the old one, and whether it was migrated or has no place."""
    from costgrain.functions.vocabulary import is_recognised

    kind = F.col("source_kind")
    new: Column = kind
    for a, b in mapping.items():
        new = F.when(kind == a, b).otherwise(new)
    marked = events.withColumns({"old_source_kind": kind, "migrated": kind.isin(list(mapping)), "unmapped": ~kind.isin(list(mapping)) & ~is_recognised(kind)})
    return marked.withColumn("source_kind", new)


def backup_of(migrated: DataFrame, key: str) -> DataFrame:
    """(key, old_source_kind) of the rows that ``migrate_kinds`` gave another kind."""
    return migrated.where(F.col("migrated") & ~F.col("source_kind").eqNullSafe(F.col("old_source_kind"))).select(key, "old_source_kind")


def backup_rows(spark: SparkSession, backup: DataFrame | None) -> DataFrame:
    """One row: how many rows the backup of a migration holds; 0 where none ever ran."""
    if backup is None:
        return spark.range(1).select(F.lit(0).cast("long").alias("backup_rows"))
    return backup.agg(F.count("*").alias("backup_rows"))


def restore_kinds(migrated: DataFrame) -> DataFrame:
    """What ``migrate_kinds`` began with."""
    return migrated.withColumn("source_kind", F.col("old_source_kind")).drop("old_source_kind", "migrated", "unmapped")


def integrity(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """(rule, rows): how many events break each rule of the ledger."""
    negative = F.least(*(F.coalesce(F.col(t), F.lit(0)) for t in TOKENS)) < 0
    own = events.agg(
        F.count(F.when(negative, 1)).alias("negative_tokens"), F.count(F.when(F.col("session").isNull(), 1)).alias("missing_session"), F.count(F.when(F.col("parent_agent_id").isNotNull() & F.col("agent_id").isNull(), 1)).alias("orphan_agent")
    )
    one = own.select(F.explode(F.array(*(F.struct(F.lit(c).alias("rule"), F.col(c).alias("rows")) for c in own.columns))).alias("x")).select("x.*")
    strange = events.where("session is not null").join(sessions.select("session").distinct(), "session", "left_anti")
    return one.unionByName(strange.agg(F.count("*").alias("rows")).select(F.lit("unknown_session").alias("rule"), "rows"))


def turns_of_hooks(hooks: DataFrame, key: list[str], order: str) -> DataFrame:
    """Turns that prompts open, each with the stop that ends it (``ended_by``), if any.

    A stop ends the latest turn that is open; one that finds none does nothing.
    Prompts and stops pair like brackets: the depth is the running sum of opens
    less closes, never below zero, and in each depth they take turns.
    """
    w = W.partitionBy(*key).orderBy(order)
    opens = F.col("kind") == "UserPromptSubmit"
    closes = F.col("kind").isin("Stop", "StopFailure")
    some = hooks.where(opens | closes).withColumn("_sum", F.sum(F.when(opens, 1).otherwise(-1)).over(w))
    deep = some.withColumn("_depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(w)))
    level = deep.withColumn("_level", F.when(opens, F.col("_depth")).otherwise(F.lag("_depth", 1, 0).over(w)))
    pair = W.partitionBy(*key, "_level").orderBy(order)
    ended = F.when(F.lead("kind").over(pair).isin("Stop", "StopFailure"), F.lead(order).over(pair))
    return level.withColumn("ended_by", ended).where(opens).drop("_sum", "_depth", "_level")
