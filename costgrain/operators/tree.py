"""Work-item trees: paths, direct totals of each item, and totals with what is below."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costgrain.functions.money import weighted
from costgrain.functions.vocabulary import TOKENS
from costgrain.operators.stages import cut
from costgrain.operators.usage import POLICIES

TOTALS = [*TOKENS, "requests", "measured", "unavailable", "anomalous", "priced", "amount_micros"]
#: The largest sum that totals hold; more stays there.
MOST = (1 << 63) - 1


def paths(items: DataFrame) -> DataFrame:
    """Items (id, parent_id, project_id, maybe more) with ``path``, the ids from their root down.

    An item whose parent is missing or in another project is a root. Items in a
    cycle, or below one, have no root and are left out. Pointers double: each round joins every
    item that has not reached its root to the one its pointer is at, and takes
    over the way from there, so that rounds grow with the logarithm of the depth. A round that brings
    no item to its root leaves only those of cycles.
    """
    parents = items.select(F.col("id").alias("_pid"), F.col("project_id").alias("_pp"))
    known = items.join(parents, (F.col("parent_id") == F.col("_pid")) & F.col("project_id").eqNullSafe(F.col("_pp")), "left")
    now = cut(known.withColumns({"_up": F.col("_pid"), "path": F.array("id")}).drop("_pid", "_pp"))
    rest = now.where("_up is not null").count()
    while rest:
        heads = now.select(F.col("id").alias("_head"), F.col("_up").alias("_next"), F.col("path").alias("_way"))
        met = now.where("_up is not null").join(heads, F.col("_up") == F.col("_head"))
        moved = met.withColumns({"_up": F.col("_next"), "path": F.concat("_way", "path")}).select(*now.columns)
        now = cut(now.where("_up is null").unionByName(moved))
        before, rest = rest, now.where("_up is not null").count()
        if rest == before:
            break
    return now.where("_up is null").drop("_up")


def closure(with_paths: DataFrame) -> DataFrame:
    """(id, ancestor) for every item and each item on its path, itself too."""
    return with_paths.select("id", F.explode("path").alias("ancestor"))


def inclusive(direct: DataFrame, with_paths: DataFrame, columns: list[str]) -> DataFrame:
    """(id, columns) summed over each item and all below; sums stop at MOST."""
    met = closure(with_paths).join(direct, "id", "left")
    capped = [F.least(F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0)), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias(c) for c in columns]
    return met.groupBy(F.col("ancestor").alias("id")).agg(*capped)


def direct_totals(items: DataFrame, attributions: DataFrame, spans: DataFrame, flags: DataFrame, costs: DataFrame, anomalies: DataFrame, policy: str) -> DataFrame:
    """Totals of each item (id) by the policy for sub-agents.

    ``attributions`` are the active ones: span_id, work_item_id, weight. ``spans``:
    span_id, usage_event_id, session, measurement_status. ``flags`` are flagged
    active events with id; ``costs`` the latest of each event. Tokens and money
    are shared by weight; requests are not: an event of two items is a request of
    both. Anomalies count for each item by the sessions of its spans.
    """
    if policy not in POLICIES:
        raise ValueError(policy)
    event = flags.withColumnRenamed("id", "usage_event_id").withColumnRenamed("measured", "_known").drop("session")
    amount = costs.select("usage_event_id", "amount_micros", F.lit(1).alias("_cost"))
    met = attributions.join(spans, "span_id").join(event, "usage_event_id").join(amount, "usage_event_id", "left")
    sub = F.coalesce("is_subagent", F.lit(False))
    out = F.col("is_lifecycle") | F.col("is_covered")
    hidden = out | (sub if policy != "Independent" else F.lit(False))
    request = ~out & ~F.col("is_delta") & (~sub if policy == "AlreadyInParent" else F.lit(True))
    unknown = sub if policy == "Unknown" else F.lit(False)
    span_measured = F.col("measurement_status") == "measured"
    one = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    sums = met.groupBy("work_item_id").agg(
        *(F.coalesce(F.sum(F.when(~hidden, weighted(F.col(t), F.col("weight")))), F.lit(0)).alias(t) for t in TOKENS),
        one(request).alias("requests"),
        one(request & ~unknown & span_measured).alias("measured"),
        one(request & (unknown | ~span_measured)).alias("unavailable"),
        one(~hidden & F.col("_cost").isNotNull()).alias("priced"),
        F.coalesce(F.sum(F.when(~hidden, weighted(F.col("amount_micros"), F.col("weight")))), F.lit(0)).alias("amount_micros"),
    )
    counts = anomalies_of_items(attributions, spans, anomalies)
    joined = items.select("id").join(sums.withColumnRenamed("work_item_id", "id"), "id", "left").join(counts, "id", "left")
    return joined.select("id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in TOTALS))


def anomalies_of_items(attributions: DataFrame, spans: DataFrame, anomalies: DataFrame) -> DataFrame:
    """(id, anomalous): unresolved anomalies, notices apart, of the sessions an item has spans in."""
    from costgrain.functions.vocabulary import NOTICES

    sessions = attributions.join(spans, "span_id").select(F.col("work_item_id").alias("id"), "session").distinct()
    open_ = anomalies.where(F.col("resolved_at").isNull() & ~F.col("type").isin(NOTICES)).select("session", "anomaly_id")
    by_session = open_.groupBy("session").agg(F.countDistinct("anomaly_id").alias("n"))  # an anomaly has one session
    return sessions.join(by_session, "session").groupBy("id").agg(F.sum("n").alias("anomalous"))
