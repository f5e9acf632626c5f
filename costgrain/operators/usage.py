"""Totals over ledger events, with each exclusion worked out once as a flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costgrain.functions.vocabulary import DELTAS, LIFECYCLE, NOTICES, TOKENS, TURN_COUNTERS, is_measured

#: Counters that a turn's counter and the sum of its details are compared by.
COMPARED = [t for t in TOKENS if t != "cache_write_tokens"]
POLICIES = ("AlreadyInParent", "Independent", "Unknown")


def active(events: DataFrame) -> DataFrame:
    """Events that nothing supersedes."""
    return events.where("superseded_by is null")


def flagged(events: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Active events with is_lifecycle, is_delta, is_subagent, is_covered and measured.

    A turn counter is covered when its session and turn also have an active
    event that is neither a turn counter nor a lifecycle counter. Only counters
    are looked up; all other events stay where they are. A child session is one
    whose root is another; a null session is unknown to be one: null when there
    are child sessions, as in three-valued logic.
    """
    rows = active(events)
    kind = F.col("source_kind")
    counter = kind.isin(TURN_COUNTERS)
    detail = rows.where(~kind.isin(TURN_COUNTERS + LIFECYCLE) & F.col("turn_id").isNotNull() & F.col("session").isNotNull())
    pairs = detail.select("session", "turn_id").distinct().withColumn("_met", F.lit(True))
    counters = rows.where(counter).join(pairs, ["session", "turn_id"], "left").withColumn("is_covered", F.coalesce("_met", F.lit(False))).drop("_met")
    both = counters.select(*rows.columns, "is_covered").unionByName(rows.where(~counter).withColumn("is_covered", F.lit(False)))
    agent = F.col("parent_agent_id").isNotNull() | F.contains(F.lower("source_kind"), F.lit("subagent"))
    if sessions is None:
        both = both.withColumn("is_subagent", agent)
    else:
        children = sessions.where("root_session is not null and root_session <> session").select("session").distinct().withColumn("_child", F.lit(True))
        some = F.lit(bool(children.take(1)))
        child = F.when(F.col("_child"), True).when(F.col("session").isNull() & some, F.lit(None).cast("boolean")).otherwise(False)
        both = both.join(children, "session", "left").withColumn("is_subagent", agent | child).drop("_child")
    return both.withColumns({"is_lifecycle": kind.isin(LIFECYCLE), "is_delta": kind.isin(DELTAS), "measured": is_measured()})


def totals(flags: DataFrame, policy: str, by: list[str] | None = None) -> DataFrame:
    """requests, measured, unavailable and tokens under a policy for sub-agents.

    AlreadyInParent leaves their events out, Independent counts them like any,
    Unknown counts them as requests that are unavailable and adds no tokens.
    Deltas add tokens but are no requests.
    """
    if policy not in POLICIES:
        raise ValueError(policy)
    rows = flags.where("not is_lifecycle and not is_covered")
    sub = F.coalesce("is_subagent", F.lit(False))
    if policy == "AlreadyInParent":
        rows = rows.where(~F.col("is_subagent"))  # null falls out with the children
        sub = F.lit(False)
    elif policy == "Independent":
        sub = F.lit(False)
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    counted, measured = ~F.col("is_delta"), F.col("measured")
    out = [
        one(counted).alias("requests"),
        one(counted & ~sub & measured).alias("measured"),
        one(counted & (sub | ~measured)).alias("unavailable"),
        *(F.coalesce(F.sum(F.when(~sub, F.col(t))), F.lit(0)).alias(t) for t in TOKENS),
    ]
    return rows.groupBy(*(by or [])).agg(*out)


def completeness(measured: Column, unavailable: Column, anomalous: Column) -> Column:
    """Percent of measurements that are there; null where there are none."""
    whole = measured + unavailable + anomalous
    return F.when(whole > 0, F.lit(100.0) * measured / whole)


def duplicate_requests(events: DataFrame) -> DataFrame:
    """(request_id, n) of requests that several active events other than deltas have."""
    rows = active(events).where(F.col("request_id").isNotNull() & ~F.col("source_kind").isin(DELTAS))
    return rows.groupBy("request_id").agg(F.count("*").alias("n")).where("n > 1")


def duplicate_lifecycle(events: DataFrame) -> DataFrame:
    """(session, turn_id) with several lifecycle counters, or with one beside a
    request of the same turn or the same request id. One join for each of the two."""
    rows = active(events)
    life = rows.where(F.col("source_kind").isin(LIFECYCLE))
    other = rows.where(~F.col("source_kind").isin(LIFECYCLE + DELTAS))
    many = life.groupBy("session", "turn_id").count().where("count > 1").select("session", "turn_id")
    turns = other.where("turn_id is not null").select("session", "turn_id").distinct()
    asked = other.where("request_id is not null").select("session", "request_id").distinct()
    by_turn = life.join(turns, ["session", "turn_id"], "left_semi").select("session", "turn_id")
    by_request = life.join(asked, ["session", "request_id"], "left_semi").select("session", "turn_id")
    return many.unionByName(by_turn).unionByName(by_request).distinct()


def counter_conflicts(events: DataFrame) -> DataFrame:
    """(session, turn_id, conflict): does the first counter of a turn differ from
    the sum of its details in any of four counters? The write counter is not compared."""
    rows = active(events).where("turn_id is not null")
    counter = F.col("source_kind").isin(TURN_COUNTERS)
    life = F.col("source_kind").isin(LIFECYCLE)
    sums = [F.sum(F.when(~counter & ~life, F.coalesce(t, F.lit(0)))).alias(f"d_{t}") for t in COMPARED]
    first = F.min_by(F.when(counter, F.struct(*(F.coalesce(t, F.lit(0)).alias(t) for t in COMPARED))), F.when(counter, F.struct("source_path", "source_offset"))).alias("c")
    by_turn = rows.groupBy("session", "turn_id").agg(*sums, first, F.count(F.when(~counter & ~life, 1)).alias("details"))
    differs = F.lit(False)
    for t in COMPARED:
        differs = differs | (F.col(f"c.{t}") != F.col(f"d_{t}"))
    return by_turn.where("c is not null and details > 0").select("session", "turn_id", differs.alias("conflict"))


def anomaly_counts(anomalies: DataFrame) -> DataFrame:
    """Unresolved anomalies, notices apart from the others."""
    notice = F.col("type").isin(NOTICES)
    return anomalies.where("resolved_at is null").agg(F.count(F.when(~notice, 1)).alias("anomalous"), F.count(F.when(notice, 1)).alias("notices"))


def settle_turns(events: DataFrame, is_counter: Column) -> tuple[DataFrame, DataFrame]:
    """(records that count, conflicts) of observations.

    A turn's counters count only where it has no details; of several records of one identity in
    one turn the one of highest authority does. A conflict is the first counter of a turn, with the sums
    ``d_`` of its details, where they differ. Records without a turn stay as they are.
    """
    from costgrain.operators import ladder
    from costgrain.sources.observation import COLUMNS

    counter = F.coalesce(is_counter, F.lit(False))
    turn = ["session", "turn_id"]
    loose = events.where("turn_id is null").select(*COLUMNS)
    detail = ladder.deduplicate(events.where(F.col("turn_id").isNotNull() & ~counter), turn).select(*COLUMNS)
    counters = events.where(F.col("turn_id").isNotNull() & counter).select(*COLUMNS)
    sums = detail.groupBy(*turn).agg(*(F.sum(F.coalesce(t, F.lit(0))).alias(f"d_{t}") for t in COMPARED))
    fallback = ladder.deduplicate(counters.join(sums.select(*turn), turn, "left_anti"), turn).select(*COLUMNS)
    firsts = counters.groupBy(*turn).agg(F.min_by(F.struct(*COLUMNS), F.struct("source_path", "source_offset")).alias("c")).select("c.*")
    differs = F.lit(False)
    for t in COMPARED:
        differs = differs | (F.coalesce(t, F.lit(0)) != F.col(f"d_{t}"))
    return loose.unionByName(detail).unionByName(fallback), firsts.join(sums, turn).where(differs)
