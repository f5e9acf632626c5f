"""The truth ladder: which of several records of one thing counts, within and across batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from costgrain.functions.identity import with_identity
from costgrain.functions.vocabulary import TOKENS, is_measured, source_kind, source_rank, stored_rank
from costgrain.operators.stages import cut

#: Order of records in which a tie goes to the first.
ORDER = ["source_path", "source_offset"]


def _standing(observations: DataFrame) -> DataFrame:
    return with_identity(observations).withColumns({"rank": source_rank(F.col("source")), "measured": is_measured()})


def deduplicate(observations: DataFrame, within: list[str] | None = None) -> DataFrame:
    """One record for each identity (in each group of ``within``): of highest rank, then measured, then first."""
    best = W.partitionBy(*(within or []), "identity").orderBy(F.desc("rank"), F.desc("measured"), *ORDER)
    return _standing(observations).withColumn("_nth", F.row_number().over(best)).where("_nth = 1").drop("_nth")


def conflicts(observations: DataFrame) -> DataFrame:
    """(identity, conflicts): records whose tokens differ from those of the best one before them."""
    marked = _standing(observations).withColumn("_ord", F.struct(*ORDER))
    before = W.partitionBy("identity").orderBy("_ord").rowsBetween(W.unboundedPreceding, -1)
    nth = F.row_number().over(W.partitionBy("identity").orderBy("_ord"))
    numbered = marked.withColumn("_nth", nth)
    usage = F.struct(*TOKENS)
    winner = F.max_by(usage, F.struct("rank", "measured", (-F.col("_nth")).alias("n"))).over(before)
    differs = (F.col("_nth") > 1) & ~usage.eqNullSafe(winner)
    return numbered.withColumn("_differs", differs.cast("long")).groupBy("identity").agg(F.sum("_differs").alias("conflicts"))


def insert_or_ignore(ledger: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Records of ``incoming`` that enter: neither their hash nor their (adapter,
    kind, source event) is in the ledger or an earlier record that enters.

    Rounds: a record enters when it is first of what is left in both keys; what
    meets a key of those that entered goes. Usually the first round is the last;
    where there are more, each is cut from the one before.
    """
    kind = source_kind(F.col("source"), F.col("source_subtype"))
    left = with_identity(incoming).withColumn("source_kind", kind)
    triple = ["adapter", "source_kind", "source_event_id"]

    def without(rows: DataFrame, taken: DataFrame) -> DataFrame:
        rest = rows.join(taken.select("event_hash"), "event_hash", "left_anti")
        return rest.join(taken.where("source_event_id is not null").select(*triple), triple, "left_anti")

    if ledger is not None:
        left = without(left, ledger)
    entered = None
    while True:
        by_hash = F.row_number().over(W.partitionBy("event_hash").orderBy(*ORDER))
        by_event = F.row_number().over(W.partitionBy(*triple, F.when(F.col("source_event_id").isNull(), F.col("event_hash"))).orderBy(*ORDER))
        ranked = left.withColumns({"_h": by_hash, "_e": by_event})
        first = ranked.where("_h = 1 and _e = 1").drop("_h", "_e")
        entered = first if entered is None else entered.unionByName(first)
        # Only a record that is first in one key but not the other can leave room for others.
        if not ranked.where("(_h = 1) <> (_e = 1)").take(1):
            return entered
        left = cut(without(left, first))


def supersede(ledger: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a batch changes: (new records, links from superseded to superseding ones).

    ``ledger`` has active records with id, session, event_hash, logical_event_hash
    source_kind, and either its token counts or whether it is ``measured``; ``batch`` is deduplicated. A record meets the active ones of
    its session under either identity scheme. Where it outranks all of them (a
    stored kind out of the vocabulary outranks anything) it enters under an id
    made from its identity and the old one's; where one holds, it is dropped.
    """
    named = batch.withColumn("keys", F.array_distinct(F.array("event_hash", "event_hash_v1")))
    measured = F.col("measured") if "measured" in ledger.columns else is_measured()
    stored = ledger.select(F.col("id").alias("old_id"), "session", F.coalesce("logical_event_hash", "event_hash").alias("key"), stored_rank(F.col("source_kind")).alias("old_rank"), measured.alias("old_measured"))
    met = named.select("*", F.explode("keys").alias("key")).join(stored, ["session", "key"]).select("event_hash", "session", "rank", "measured", "old_id", "old_rank", "old_measured", "identity").distinct()
    outranks = (F.col("rank") > F.col("old_rank")) | ((F.col("rank") == F.col("old_rank")) & F.col("measured") & ~F.col("old_measured"))
    verdict = met.groupBy("session", "event_hash").agg(F.bool_and(outranks).alias("wins"), F.min("old_id").alias("old_id"))
    judged = named.drop("keys").join(verdict, ["session", "event_hash"], "left")
    enters = judged.where("wins is null or wins")
    new_hash = F.sha2(F.concat("identity", F.lit("\0supersedes\0"), "old_id"), 256)
    new = enters.withColumns({"logical_event_hash": F.col("event_hash"), "event_hash": F.when(F.col("old_id").isNotNull(), new_hash).otherwise(F.col("event_hash"))})
    links = met.join(verdict.where("wins").select("session", "event_hash"), ["session", "event_hash"]).select("old_id", F.sha2(F.concat("identity", F.lit("\0supersedes\0"), "old_id"), 256).alias("superseded_by"))
    return new.drop("wins"), links.distinct()


def sequence_numbers(turns: DataFrame, highest: DataFrame | None = None) -> DataFrame:
    """Number the new (session, turn_id) by first appearance, after the session's highest so far."""
    first = turns.where("turn_id is not null").groupBy("session", "turn_id").agg(F.min(F.struct(*ORDER)).alias("_first"))
    nth = F.row_number().over(W.partitionBy("session").orderBy("_first", "turn_id"))
    numbered = first.withColumn("sequence_number", nth - 1).drop("_first")
    if highest is None:
        return numbered
    return numbered.join(highest, "session", "left").withColumn("sequence_number", F.col("sequence_number") + F.coalesce(F.col("highest") + 1, F.lit(0))).drop("highest")
