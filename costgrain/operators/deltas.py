"""Cumulative counters turned into what was used between two readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from costgrain.functions.vocabulary import TOKENS

#: Counters whose fall says that a stream began anew; the write counter is not among them.
RESET = [t for t in TOKENS if t != "cache_write_tokens"]


def snapshot_deltas(snapshots: DataFrame, stream: list[str], order: list[str]) -> DataFrame:
    """Differences of successive snapshots, with the ``negative`` ones marked.

    The first snapshot of a stream gives nothing. A counter that is unknown on
    either side is unknown in the difference. If any counter falls, the row is
    marked negative and holds no difference; the next one counts from it.
    """
    w = W.partitionBy(*stream).orderBy(*order)
    before = snapshots.withColumns({f"_{t}": F.lag(t).over(w) for t in TOKENS} | {"_nth": F.row_number().over(w)})
    falls = [F.coalesce(F.col(t) < F.col(f"_{t}"), F.lit(False)) for t in TOKENS]
    marked = before.where("_nth > 1").withColumn("negative", _any(falls))
    out = {t: F.when(~F.col("negative"), F.col(t) - F.col(f"_{t}")) for t in TOKENS}
    return marked.withColumns(out).drop("_nth", *(f"_{t}" for t in TOKENS))


def _any(flags: list[Column]) -> Column:
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out


def counter_deltas(readings: DataFrame, stream: list[str], order: list[str]) -> DataFrame:
    """What each reading adds in a stream of cumulative and plain ones, and whether it ``reset``.

    Plain readings count as they are and raise the base. A cumulative one counts
    what it exceeds the base by, unknown as zero; the first of a stream, and one
    that falls below the base, count whole. A write counter that falls while the
    others don't is unknown (null) in the result.
    """
    w = W.partitionBy(*stream).orderBy(*order)
    cumulative = F.coalesce(F.col("is_cumulative"), F.lit(False))
    segmented = readings.withColumns({"_cum": cumulative, "_nth": F.row_number().over(w), "_seg": F.sum(cumulative.cast("int")).over(w)})
    inside = W.partitionBy(*stream, "_seg").orderBy(*order)
    # A segment begins with a cumulative reading: the base is all that its rows add up to.
    based = segmented.withColumns({f"_sum_{t}": F.sum(F.coalesce(t, F.lit(0))).over(inside) for t in TOKENS})
    before = based.withColumns({f"_was_{t}": F.lag(f"_sum_{t}").over(w) for t in TOKENS})
    falls = _any([F.coalesce(t, F.lit(0)) < F.col(f"_was_{t}") for t in RESET])
    counts = F.col("_cum") & (F.col("_nth") > 1)
    marked = before.withColumn("reset", counts & falls)
    out = {}
    for t in TOKENS:
        step = F.coalesce(t, F.lit(0)) - F.col(f"_was_{t}")
        out[t] = F.when(counts & ~F.col("reset"), F.when(step >= 0, step)).otherwise(F.col(t))
    return marked.withColumns(out).drop("_cum", "_nth", "_seg", *(f"_{k}_{t}" for t in TOKENS for k in ("sum", "was")))


def epoch_deltas(snapshots: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Differences of repeated scans of one row, tokens and cost each in epochs of its own.

    A fall of any token counter starts a new token epoch and gives no tokens
    (null). Cost is held against the last known one: a rise gives the difference,
    a fall starts a new cost epoch and gives none, unknown gives none and keeps
    what was known. The first scan of a row counts whole; unknown tokens are zero.
    """
    w = W.partitionBy(*key).orderBy(*order)
    known = F.last("cost_micros", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    before = snapshots.withColumns({f"_{t}": F.lag(F.coalesce(t, F.lit(0))).over(w) for t in TOKENS} | {"_known": known, "_nth": F.row_number().over(w)})
    falls = (F.col("_nth") > 1) & _any([F.coalesce(t, F.lit(0)) < F.col(f"_{t}") for t in TOKENS])
    cost_falls = F.coalesce(F.col("cost_micros") < F.col("_known"), F.lit(False))
    marked = before.withColumns({"_falls": falls, "_cost_falls": cost_falls})
    epochs = {"token_epoch": F.sum(F.col("_falls").cast("long")).over(w), "cost_epoch": F.sum(F.col("_cost_falls").cast("long")).over(w)}
    steps = {f"delta_{t}": F.when(~F.col("_falls"), F.coalesce(t, F.lit(0)) - F.coalesce(F.col(f"_{t}"), F.lit(0))) for t in TOKENS}
    cost = F.when(F.col("_known").isNull(), F.col("cost_micros")).when(F.col("cost_micros") > F.col("_known"), F.col("cost_micros") - F.col("_known"))
    done = marked.withColumns(epochs | steps | {"delta_cost_micros": cost})
    return done.drop("_nth", "_known", "_falls", "_cost_falls", *(f"_{t}" for t in TOKENS))


def repair_snapshots(events: DataFrame) -> DataFrame:
    """Rewrite snapshots that were stored as if they were deltas; plan and result in one.

    Rows of a session are ordered by the second of their time, then offset. The
    first and any that falls behind become zero (not unknown); the others become
    the difference, unknown counters staying unknown. ``action`` says which.
    """
    second = F.date_trunc("second", F.try_to_timestamp("observed_at"))
    keyed = events.withColumn("_when", F.coalesce(second.cast("string"), F.col("observed_at")))
    w = W.partitionBy(F.coalesce("session", F.lit(""))).orderBy("_when", "source_offset")
    before = keyed.withColumns({f"_{t}": F.lag(t).over(w) for t in TOKENS} | {"_nth": F.row_number().over(w)})
    falls = _any([F.coalesce(F.col(t) < F.col(f"_{t}"), F.lit(False)) for t in TOKENS])
    marked = before.withColumn("action", F.when(F.col("_nth") == 1, "baseline").when(falls, "backward").otherwise("delta"))
    out = {f"new_{t}": F.when(F.col("action") != "delta", F.lit(0).cast("long")).otherwise(F.col(t) - F.col(f"_{t}")) for t in TOKENS}
    return marked.withColumns(out).drop("_when", "_nth", *(f"_{t}" for t in TOKENS))


def sticky(records: DataFrame, partition: list[str], order: list[str], columns: list[str], ends: Column, own: bool = False, chunk: Column | None = None) -> DataFrame:
    """Carry the last known value of ``columns`` forward; rows marked ``ends`` clear
    it for what follows them, and with ``own`` for themselves too.

    ``chunk`` numbers pieces that a partition's order goes through one after another. Values are then
    carried inside each piece, what a piece leaves to the next is carried over the pieces, and a large partition is many
    tasks' work.
    """
    if chunk is None:
        w = W.partitionBy(*partition).orderBy(*order)
        cut = F.coalesce(F.sum(ends.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0 if own else -1)), F.lit(0))
        inside = W.partitionBy(*partition, "_cut").orderBy(*order)
        return records.withColumn("_cut", cut).withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns}).drop("_cut")
    piece = [*partition, "_chunk"]
    within = W.partitionBy(*piece).orderBy(*order)
    rows = records.withColumns({"_chunk": chunk, "_ends": F.coalesce(ends.cast("int"), F.lit(0))})
    cuts = rows.withColumn("_cut", F.coalesce(F.sum("_ends").over(within.rowsBetween(W.unboundedPreceding, 0 if own else -1)), F.lit(0)))
    marked = cuts.withColumn("_all", F.sum("_ends").over(W.partitionBy(*piece)))
    last = lambda c: F.max_by(c, F.when((F.col("_cut") == F.col("_all")) & F.col(c).isNotNull(), F.struct(*order)))
    left = marked.groupBy(*piece).agg((F.max("_all") > 0).cast("int").alias("_ended"), *(last(c).alias(f"_left_{c}") for c in columns))
    over = W.partitionBy(*partition).orderBy("_chunk")  # a row a piece
    since = left.withColumn("_since", F.sum("_ended").over(over))
    told = since.withColumns({f"_left_{c}": F.last(f"_left_{c}", ignorenulls=True).over(W.partitionBy(*partition, "_since").orderBy("_chunk")) for c in columns})
    came = told.select(*piece, *(F.lag(f"_left_{c}").over(over).alias(f"_came_{c}") for c in columns))
    carried = marked.withColumns({c: F.last(c, ignorenulls=True).over(W.partitionBy(*piece, "_cut").orderBy(*order)) for c in columns}).join(came, piece)
    filled = {c: F.when(F.col("_cut") == 0, F.coalesce(c, f"_came_{c}")).otherwise(F.col(c)) for c in columns}
    return carried.withColumns(filled).select(*records.columns)
