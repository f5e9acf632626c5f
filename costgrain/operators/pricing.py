"""Rates as of a day, and what events cost at them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from costgrain.functions.identity import stable_id
from costgrain.functions.money import cost_micros, rate_to_micros


def day(text: Column) -> Column:
    """The date before the T of a timestamp, also unpadded; null where it is none."""
    part = F.substring_index(text, "T", 1)
    return F.when(part.rlike(r"^\d{1,4}-\d{1,2}-\d{1,2}$"), F.try_to_date(part, "y-M-d"))


def _since(effective: Column, date: Column) -> Column:
    """Is a rate effective on a date? By days where both are dates, else by text."""
    a, b = day(effective), day(date)
    return F.when(a.isNotNull() & b.isNotNull(), a <= b).otherwise(effective <= date)


def rates_in_micros(snapshot: DataFrame) -> DataFrame:
    """A price snapshot with its decimal-text rates as exact micro-dollars per million."""
    columns = ["input_rate", "cached_rate", "write_rate", "output_rate", "reasoning_rate"]
    return snapshot.withColumns({c: rate_to_micros(F.col(c)) for c in columns})


def resolve(events: DataFrame, rates: DataFrame) -> DataFrame:
    """Events with the rate of their model on their day: an exact pattern before a
    wildcard, a longer one before a shorter, a later date before an earlier.

    Different (model, date) pairs are resolved, not events: there are few, so
    events meet them by an equality join however many there are. The pairs meet
    rates by equality too, on every beginning of the model's name. A rate without
    a timestamp to hold it against always applies.
    """
    date = F.substring_index("source_timestamp", "T", 1)
    keyed = events.withColumns({"_model": F.coalesce("model", F.lit("")), "_date": F.coalesce(date, F.lit(""))})
    pairs = keyed.select("_model", "_date").distinct()
    # A pattern fits a model when it is the model, or when its head is one of the model's beginnings.
    beginnings = F.expr("transform(sequence(0, length(_model)), n -> struct(false as exact, left(_model, n) as head))")
    asked = pairs.select("_model", "_date", F.explode(F.concat(beginnings, F.array(F.struct(F.lit(True).alias("exact"), F.col("_model").alias("head"))))).alias("_p"))
    asked = asked.select("_model", "_date", F.col("_p.exact").alias("_exact"), F.col("_p.head").alias("_head"))
    wild = F.col("model_pattern").endswith("*")
    prepared = rates.withColumns({"_exact": ~wild, "_head": F.when(wild, F.expr("left(model_pattern, length(model_pattern) - 1)")).otherwise(F.col("model_pattern"))})
    met = asked.join(prepared, ["_exact", "_head"]).where((F.col("_date") == "") | _since(F.col("effective_from"), F.col("_date")))
    best = W.partitionBy("_model", "_date").orderBy(F.desc("_exact"), F.desc(F.octet_length("_head")), F.desc_nulls_last(day(F.col("effective_from"))), F.desc("effective_from"), "pricing_version_id")
    chosen = met.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_exact", "_head")
    return keyed.join(chosen, ["_model", "_date"], "left").drop("_model", "_date")


def price(events: DataFrame, rates: DataFrame) -> DataFrame:
    """Events with pricing_version_id and amount_micros; null where there is no rate."""
    return resolve(events, rates).withColumn("amount_micros", F.when(F.col("pricing_version_id").isNotNull(), cost_micros()))


def pricing_version(provider: Column, pattern: Column, effective: Column, digest: Column) -> Column:
    return stable_id("price", F.concat_ws(":", provider, pattern, effective, digest))


def apply_prices(events: DataFrame, rates: DataFrame, costs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New cost rows of active events, and counters: priced, unavailable, already."""
    priced = price(events.where("superseded_by is null"), rates)
    rows = priced.select("id", "pricing_version_id", "amount_micros")
    made = rows.where("amount_micros is not null")
    if costs is None:
        new = made
    else:
        new = made.join(costs.select(F.col("usage_event_id").alias("id"), "pricing_version_id"), ["id", "pricing_version_id"], "left_anti")
    counts = rows.agg(F.count("amount_micros").alias("with_price"), F.count(F.when(F.col("amount_micros").isNull(), 1)).alias("unavailable"))
    added = new.agg(F.count("*").alias("priced"))
    counters = counts.crossJoin(added).select("priced", "unavailable", (F.col("with_price") - F.col("priced")).alias("already"))  # one row each
    return new.withColumnRenamed("id", "usage_event_id"), counters


def latest_costs(costs: DataFrame) -> DataFrame:
    """The cost of each event that was calculated last; ties to the greater version id."""
    best = W.partitionBy("usage_event_id").orderBy(F.desc("calculated_at"), F.desc("pricing_version_id"))
    return costs.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
