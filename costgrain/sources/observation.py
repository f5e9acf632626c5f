"""The one schema that every source is read into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costgrain.functions.vocabulary import TOKENS

STRINGS = ["adapter", "source", "source_subtype", "source_event_id", "session", "request_id", "turn_id", "agent_id", "parent_agent_id", "source_timestamp", "observed_at", "model", "service_tier", "region"]
COLUMNS = {c: "string" for c in STRINGS} | {t: "bigint" for t in TOKENS} | {"cost_micros": "bigint", "source_path": "string", "source_offset": "bigint", "parser_version": "string"}
SCHEMA = T.StructType([T.StructField(c, T.StringType() if t == "string" else T.LongType()) for c, t in COLUMNS.items()])


def observation(rows: DataFrame, more: dict[str, Column] | None = None, **columns: Column) -> DataFrame:
    """Rows as observations: the given columns, null where none is given; ``more`` are columns beside those of the schema."""
    return rows.select(*(columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()), *(c.alias(n) for n, c in (more or {}).items()))


def count(*values: Column) -> Column:
    """The first that is a count: there and not negative."""
    return F.coalesce(*(F.when(v >= 0, v) for v in values))


def first(*values: Column) -> Column:
    return F.coalesce(*values)


def anomaly(rows: DataFrame, kind: Column, session: Column, turn: Column, details: Column) -> DataFrame:
    """Rows as anomalies with their place and a JSON text of details."""
    return rows.select(kind.alias("type"), session.cast("string").alias("session"), turn.cast("string").alias("turn_id"), "source_path", F.col("source_offset").cast("long"), details.alias("details"))
