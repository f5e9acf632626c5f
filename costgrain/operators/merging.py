"""Merging work items: chains of merges, and what follows an item to where it went."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from costgrain.operators import attribution
from costgrain.operators.stages import cut


class MergeCycle(ValueError):
    """Merges that lead back to where they began."""


def checked(merges: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merges that hold, those refused with a ``reason``) of (source, target, sequence).

    An item can't be merged into itself, an unknown item or one of another project, nor if it is merged
    already: by its status, or by an earlier merge of these. Repeated merges are refused like others.
    """
    of = items.select("id", "project_id", "status")
    a, b = of.toDF("source", "_p", "_status"), of.toDF("target", "_q", "_other")
    met = merges.join(a, "source", "left").join(b, "target", "left")
    reason = (
        F.when(F.col("source") == F.col("target"), "itself").when(F.col("_status").isNull(), "unknown source").when(F.col("_other").isNull(), "unknown target")
        .when(~F.col("_p").eqNullSafe(F.col("_q")), "another project").when(F.col("_status") == "merged", "merged already")
    )
    told = met.withColumn("reason", reason)
    nth = F.row_number().over(W.partitionBy("source").orderBy("sequence", "target"))
    sound = told.where("reason is null").withColumn("_nth", nth)
    again = sound.where("_nth > 1").withColumn("reason", F.lit("merged already"))
    names = ["source", "target", "sequence"]
    return sound.where("_nth = 1").select(*names), told.where("reason is not null").select(*names, "reason").unionByName(again.select(*names, "reason"))


def last_targets(merges: DataFrame) -> DataFrame:
    """(source, target) with the target that a chain of merges ends at; a source has one merge.

    Pointers double: each round a pointer takes over where its target points to, so rounds grow with the
    logarithm of the longest chain. Pointers that are still under way when even the
    longest chain there could be has been walked are those of a cycle, which is an error.
    """
    now = cut(merges.select("source", "target", F.lit(False).alias("done")))
    steps, most = 1, now.count()
    while True:
        on = now.select(F.col("source").alias("_at"), F.col("target").alias("_next"), F.col("done").alias("_done"))
        met = now.where("not done").join(on, F.col("target") == F.col("_at"), "left")
        moved = met.select("source", F.coalesce("_next", "target").alias("target"), F.col("_at").isNull().alias("done"))
        now = cut(now.where("done").unionByName(moved))
        rest = now.where("not done")
        if not rest.take(1):
            return now.select("source", "target")
        if steps > most:
            raise MergeCycle(f"merges lead back to {sorted(r.source for r in rest.orderBy('source').limit(5).collect())}")
        steps *= 2


def merge_all(merges: DataFrame, items: DataFrame, notes: DataFrame, attributions: DataFrame) -> dict[str, DataFrame]:
    """What merges (source, target, sequence) make of items (id, parent_id, project_id, status), notes
    (work_item_id, ...) and attributions (see ``attribution.merge_items``): tables of these names, and ``refused``.

    A merge into an item that is merged itself, before or after, counts for what that ends at. Children and
    notes follow; of a group's rows that come to one item the weights add up. A child that
    would become its own parent (merged into from above) goes to no parent.
    """
    sound, refused = checked(merges, items)
    sound = cut(sound)
    to = cut(last_targets(sound))
    here = to.select(F.col("source").alias("_from"), F.col("target").alias("_to"))
    status = F.when(F.col("_to").isNotNull(), "merged").otherwise(F.col("status"))
    marked = items.join(here, items["id"] == F.col("_from"), "left").withColumn("status", status).select(*items.columns)
    up = F.coalesce("_to", "parent_id")
    moved = marked.join(here, F.col("parent_id") == F.col("_from"), "left").withColumn("parent_id", F.when(up != F.col("id"), up)).select(*items.columns)
    noted = notes.join(here, F.col("work_item_id") == F.col("_from"), "left").withColumn("work_item_id", F.coalesce("_to", "work_item_id")).select(*notes.columns)
    shared = attributions.join(here, F.col("work_item_id") == F.col("_from"), "left")
    return {"items": moved, "notes": noted, "attributions": attribution.merge_items(shared, F.col("_from"), F.col("_to")), "refused": refused}
