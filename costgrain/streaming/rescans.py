"""Rescans of rows that a source rewrites in place, held against what earlier scans saw.

A checkpoint for each row keeps its last counters, the last known cost and the epochs of
both. Checkpoints are dealt to buckets by row; a scan opens the buckets of
its own rows, and what it makes (records, anomalies, new checkpoints in the place of the old
buckets) becomes visible in one commit. Scans are numbered upwards; one that comes again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from costgrain.functions.vocabulary import TOKENS
from costgrain.operators import deltas
from costgrain.operators.stages import cut
from costgrain.streaming.store import Store, bucket_of

_EPOCHS = ["token_epoch", "token_sequence", "cost_epoch", "cost_sequence"]
CHECKPOINT = "row_key string, " + ", ".join(f"{c} long" for c in [*TOKENS, "cost_micros", *_EPOCHS]) + ", cost_available boolean"
#: The kind of what differs from an earlier scan, and the anomalies.
DELTA_KIND, REGRESSION, COST_MISSING, COST_REGRESSION = "hermes_snapshot_delta", "token_category_regression", "provider_cost_missing", "provider_cost_regression"


class Rescans:
    """Checkpoints, deltas and anomalies below ``folder``. ``columns`` (DDL) are those of the rows beside
    row_key, token counters and cost_micros that deltas and anomalies carry on; ``order`` sorts rows of one key in one scan."""

    def __init__(self, spark: SparkSession, folder: str, columns: str, order: list[str], digits: int = 2):
        self.store, self.columns, self.order, self.digits = Store(spark, folder), columns, order, digits
        self.carried = [c.strip().split(" ")[0] for c in columns.split(",")]

    def checkpoints(self) -> DataFrame:
        return self.store.read("checkpoints", CHECKPOINT)

    def deltas(self) -> DataFrame:
        """Rows as they were first seen (``source_event_id`` null) and, under an id of epochs and sequences, what later scans add."""
        return self.store.read("deltas", f"scan long, row_key string, {self.columns}, source_event_id string, source_kind string, " + ", ".join(f"{c} long" for c in [*_EPOCHS, *TOKENS, "cost_micros"]))

    def anomalies(self) -> DataFrame:
        return self.store.read("anomalies", f"scan long, type string, row_key string, {self.columns}, details string")

    def scan(self, rows: DataFrame, number: int) -> None:
        """Take in a scan: row_key, counters, cost_micros and the carried columns; rows without a key count as one."""
        at = self.store.snapshot()
        if number <= at["notes"].get("scan", -1):
            return
        new = cut(rows.select(F.coalesce("row_key", F.lit("")).alias("row_key"), *TOKENS, "cost_micros", *self.carried))
        bucket = bucket_of(F.col("row_key"), self.digits)
        touched = [r[0] for r in new.select(bucket).distinct().collect()]
        stored = self.store.read("checkpoints", CHECKPOINT, touched, at)
        old = stored.join(new.select("row_key").distinct(), "row_key", "left_semi")
        none = lambda c: F.lit(None).cast(new.schema[c].dataType).alias(c)
        first = old.select("row_key", *TOKENS, "cost_micros", *(none(c) for c in self.carried), F.lit(0).alias("_new"), F.col("cost_available").alias("_there"), *(F.col(c).alias(f"_{c}") for c in _EPOCHS))
        both = first.unionByName(new.withColumns({"_new": F.lit(1), "_there": F.col("cost_micros").isNotNull()} | {f"_{c}": F.lit(None).cast("long") for c in _EPOCHS}))
        order = ["_new", *self.order]
        w = W.partitionBy("row_key").orderBy(*order)
        steps = deltas.epoch_deltas(both, ["row_key"], order)
        base = {f"_{c}": F.coalesce(F.max(f"_{c}").over(W.partitionBy("row_key")), F.lit(0)) for c in _EPOCHS}
        marked = steps.withColumns({"_first": F.row_number().over(w) == 1, "_had": F.lag("_there").over(w), "_before": F.lag("token_epoch").over(w), "_cost_before": F.lag("cost_epoch").over(w)} | base)
        grew = F.coalesce(sum((F.col(f"delta_{t}") for t in TOKENS), F.lit(0)) > 0, F.lit(False)) & ~F.col("_first")
        dearer = F.col("delta_cost_micros").isNotNull() & ~F.col("_first")
        marked = marked.withColumns({"_grew": grew, "_dearer": dearer, "_falls": F.col("token_epoch") > F.col("_before"), "_cheaper": F.col("cost_epoch") > F.col("_cost_before")})
        # An epoch that goes on counts on from the checkpoint; a new one begins at nought.
        counted = lambda flag, epoch: F.sum(flag.cast("long")).over(W.partitionBy("row_key", epoch).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
        sequences = {"token_sequence": counted(F.col("_grew"), "token_epoch") + F.when(F.col("token_epoch") == 0, F.col("_token_sequence")).otherwise(0), "cost_sequence": counted(F.col("_dearer"), "cost_epoch") + F.when(F.col("cost_epoch") == 0, F.col("_cost_sequence")).otherwise(0)}
        done = cut(marked.withColumns(sequences).withColumns({"token_epoch": F.col("token_epoch") + F.col("_token_epoch"), "cost_epoch": F.col("cost_epoch") + F.col("_cost_epoch")}))
        fresh = done.where("_new = 1")
        name = F.concat(F.col("row_key"), F.lit(":delta:te"), F.col("token_epoch"), F.lit("ts"), F.col("token_sequence"), F.lit(":ce"), F.col("cost_epoch"), F.lit("cs"), F.col("cost_sequence"))
        later = F.when(~F.col("_first"), True)
        made = fresh.where("_first or _grew or _dearer").select(
            F.lit(number).cast("long").alias("scan"), "row_key", *self.carried, F.when(later, name).alias("source_event_id"), F.when(later, DELTA_KIND).alias("source_kind"), *_EPOCHS,
            *(F.when(F.col("_first"), F.col(t)).otherwise(F.coalesce(f"delta_{t}", F.lit(0))).alias(t) for t in TOKENS), F.when(F.col("_first"), F.col("cost_micros")).otherwise(F.col("delta_cost_micros")).alias("cost_micros"),
        )
        missing = F.col("cost_micros").isNull() & F.coalesce("_had", F.lit(False))
        kinds = F.array_compact(F.array(F.when(F.col("_falls"), REGRESSION), F.when(missing, COST_MISSING), F.when(F.col("_cheaper"), COST_REGRESSION)))
        details = F.to_json(F.struct("token_epoch", "cost_epoch", *TOKENS, "cost_micros"), {"ignoreNullFields": "false"})
        odd = fresh.select(F.lit(number).cast("long").alias("scan"), F.explode(kinds).alias("type"), "row_key", *self.carried, details.alias("details"))
        last = F.max_by(F.struct(*(F.coalesce(t, F.lit(0)).alias(t) for t in TOKENS), *_EPOCHS, F.col("_there").alias("cost_available")), F.struct(*order))
        known = F.max_by(F.col("cost_micros"), F.when(F.col("cost_micros").isNotNull(), F.struct(*order)))
        now = done.groupBy("row_key").agg(last.alias("l"), known.alias("cost_micros")).select("row_key", *(f"l.{t}" for t in TOKENS), "cost_micros", *(f"l.{c}" for c in _EPOCHS), "l.cost_available")
        kept = stored.join(new.select("row_key").distinct(), "row_key", "left_anti")
        write = self.store.write
        self.store.commit(at, {"deltas": write("deltas", made), "anomalies": write("anomalies", odd)}, {"checkpoints": (touched, write("checkpoints", kept.unionByName(now), bucket))}, {"scan": number})
