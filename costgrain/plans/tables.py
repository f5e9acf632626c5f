"""Ledger-shaped tables derived from the test tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costgrain.functions.identity import with_identity
from costgrain.functions.vocabulary import source_kind

SOURCES = {"error": "unavailable", "view": "snapshot_delta", "signup": "snapshot_delta", "click": "transcript_request", "purchase": "official_telemetry"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage observations, one for each row of events."""
    e = read(spark, sf_dir, "events")
    kind, n, user = F.col("event_type"), F.col("event_id"), F.col("user_id")
    source = F.create_map(*(F.lit(x) for pair in SOURCES.items() for x in pair))[kind]
    cents = F.round(F.col("value") * 100).cast("long")
    k = F.get_json_object("props", "$.k").cast("long")
    known = kind != "error"
    return e.select(
        F.lit("events").alias("adapter"), source.alias("source"),
        F.when(kind == "signup", F.when(n % 5 == 0, "final_request_counter").when(n % 5 == 1, "subagent_stop").otherwise("turn_counter")).when(kind == "click", "assistant").alias("source_subtype"),
        F.when(kind == "view", F.concat(F.lit("e"), F.call_function("div", n, F.lit(2)).cast("string"))).alias("source_event_id"),
        F.concat(F.lit("s"), user.cast("string")).alias("session"),
        F.when(kind.isin("click", "purchase"), F.concat(F.lit("r"), (n % 7).cast("string"))).alias("request_id"),
        F.concat(F.lit("t"), (k % 10).cast("string")).alias("turn_id"), F.lit(None).cast("string").alias("agent_id"),
        F.when((user % 5 == 0) & (n % 3 == 0), "a0").alias("parent_agent_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("source_timestamp"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("observed_at"),
        F.concat(F.lit("model-"), (user % 4).cast("string")).alias("model"),
        F.when(known, cents).alias("input_tokens"), F.when(kind.isin("click", "purchase"), n % 100).alias("cached_input_tokens"),
        F.when(kind == "purchase", n % 7).alias("cache_write_tokens"), F.when(known, k).alias("output_tokens"), F.when(n % 11 == 0, k).alias("reasoning_tokens"),
        F.when(kind == "purchase", cents * 3).alias("cost_micros"), F.lit("events").alias("source_path"), n.alias("source_offset"),
    )


OBS = """obs AS (
  SELECT 'events' AS adapter,
    CASE event_type WHEN 'error' THEN 'unavailable' WHEN 'view' THEN 'snapshot_delta' WHEN 'signup' THEN 'snapshot_delta' WHEN 'click' THEN 'transcript_request' WHEN 'purchase' THEN 'official_telemetry' END AS source,
    CASE WHEN event_type = 'signup' THEN CASE event_id % 5 WHEN 0 THEN 'final_request_counter' WHEN 1 THEN 'subagent_stop' ELSE 'turn_counter' END WHEN event_type = 'click' THEN 'assistant' END AS source_subtype,
    CASE WHEN event_type = 'view' THEN 'e' || CAST(event_id // 2 AS VARCHAR) END AS source_event_id,
    's' || CAST(user_id AS VARCHAR) AS session,
    CASE WHEN event_type IN ('click', 'purchase') THEN 'r' || CAST(event_id % 7 AS VARCHAR) END AS request_id,
    't' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS VARCHAR) AS turn_id, CAST(NULL AS VARCHAR) AS agent_id,
    CASE WHEN user_id % 5 = 0 AND event_id % 3 = 0 THEN 'a0' END AS parent_agent_id,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS source_timestamp, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS observed_at,
    'model-' || CAST(user_id % 4 AS VARCHAR) AS model,
    CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) END AS input_tokens,
    CASE WHEN event_type IN ('click', 'purchase') THEN event_id % 100 END AS cached_input_tokens,
    CASE WHEN event_type = 'purchase' THEN event_id % 7 END AS cache_write_tokens,
    CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS output_tokens,
    CASE WHEN event_id % 11 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS reasoning_tokens,
    CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) * 3 END AS cost_micros,
    'events' AS source_path, event_id AS source_offset
  FROM events
), named AS (
  SELECT *,
    CASE WHEN source = 'snapshot_delta' AND source_event_id IS NOT NULL THEN adapter || ':delta:' || source_event_id
      WHEN request_id IS NOT NULL THEN adapter || ':request:' || session || ':' || coalesce(turn_id, '') || ':' || request_id
      WHEN source_event_id IS NOT NULL THEN adapter || ':event:' || source_event_id
      WHEN source = 'snapshot_delta' AND turn_id IS NOT NULL THEN adapter || ':counter:' || session || ':' || turn_id
      ELSE adapter || ':' || session || ':' || coalesce(turn_id, '') || ':' || coalesce(model, '') || ':' || coalesce(source_timestamp, '') || ':' || coalesce(CAST(input_tokens AS VARCHAR), '') || ':' || coalesce(CAST(output_tokens AS VARCHAR), '') || ':' || CAST(source_offset AS VARCHAR) END AS identity,
    CASE WHEN source = 'snapshot_delta' AND source_event_id IS NOT NULL THEN adapter || ':delta:' || source_event_id
      WHEN request_id IS NOT NULL THEN adapter || ':request:' || request_id
      WHEN source_event_id IS NOT NULL THEN adapter || ':event:' || source_event_id
      WHEN source = 'snapshot_delta' AND turn_id IS NOT NULL THEN adapter || ':counter:' || session || ':' || turn_id
      ELSE adapter || ':' || session || ':' || coalesce(turn_id, '') || ':' || coalesce(model, '') || ':' || coalesce(source_timestamp, '') || ':' || coalesce(CAST(input_tokens AS VARCHAR), '') || ':' || coalesce(CAST(output_tokens AS VARCHAR), '') || ':' || CAST(source_offset AS VARCHAR) END AS identity_v1,
    CASE source WHEN 'unavailable' THEN 0 WHEN 'explicit_cli' THEN 1 WHEN 'snapshot_delta' THEN 2 WHEN 'transcript_request' THEN 3 WHEN 'provider_fields' THEN 4 WHEN 'official_telemetry' THEN 5 END AS rank,
    coalesce(input_tokens, cached_input_tokens, cache_write_tokens, output_tokens, reasoning_tokens) IS NOT NULL AS measured,
    CASE WHEN source_subtype IN ('final_request_counter', 'subagent_stop', 'turn_counter') THEN source_subtype ELSE source END AS source_kind
  FROM obs
)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger events: every observation stored, each 17th superseded."""
    named = with_identity(observations(spark, sf_dir)).withColumn("source_kind", source_kind(F.col("source"), F.col("source_subtype")))
    old = F.when(F.col("source_offset") % 17 == 0, "x").alias("superseded_by")
    return named.select("*", F.concat(F.lit("ev"), F.col("source_offset").cast("string")).alias("id"), old)


LEDGER = OBS + """, ledger AS (
  SELECT *, 'ev' || CAST(source_offset AS VARCHAR) AS id, CASE WHEN source_offset % 17 = 0 THEN 'x' END AS superseded_by FROM named
)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with their root: every ninth is a child of the session before it."""
    u = read(spark, sf_dir, "events").select("user_id").distinct()
    root = F.when(F.col("user_id") % 9 == 0, F.col("user_id") - 1).otherwise(F.col("user_id"))
    return u.select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session"), F.concat(F.lit("s"), root.cast("string")).alias("root_session"))


SESSIONS = """sessions AS (
  SELECT DISTINCT 's' || CAST(user_id AS VARCHAR) AS session, 's' || CAST(CASE WHEN user_id % 9 = 0 THEN user_id - 1 ELSE user_id END AS VARCHAR) AS root_session FROM events
)"""

FLAGS = LEDGER + ", " + SESSIONS + """, flags AS (
  SELECT l.*, source_kind IN ('final_request_counter', 'subagent_stop', 'subagent_lifecycle_counter') AS is_lifecycle,
    source_kind IN ('hermes_snapshot_delta', 'snapshot_delta') AS is_delta,
    parent_agent_id IS NOT NULL OR lower(source_kind) LIKE '%subagent%' OR session IN (SELECT session FROM sessions WHERE root_session <> session) AS is_subagent,
    source_kind IN ('codex_turn_counter', 'turn_counter', 'turn_summary', 'cumulative_turn_counter') AND EXISTS (
      SELECT 1 FROM ledger d WHERE d.session = l.session AND d.turn_id = l.turn_id AND d.superseded_by IS NULL
        AND d.source_kind NOT IN ('codex_turn_counter', 'turn_counter', 'turn_summary', 'cumulative_turn_counter', 'final_request_counter', 'subagent_stop', 'subagent_lifecycle_counter')) AS is_covered
  FROM ledger l WHERE superseded_by IS NULL
)"""

#: Provider, pattern, first day, and dollars per million of the five kinds of tokens.
RATES = [
    ("acme", "model-*", "2024-1-1", "1.5", "0.15", "1.875", "6", None),
    ("acme", "model-1", "2024-01-01", "3.00", "0.30", "3.75", "15.00", None),
    ("acme", "model-1", "2024-01-15", "2.50", "0.25", None, "12.345678", "20"),
    ("acme", "model-2*", "2024-01-10", "4", None, "5", "20.1", "7.5"),
]
RATE_COLUMNS = ["provider", "model_pattern", "effective_from", "input_rate", "cached_rate", "write_rate", "output_rate", "reasoning_rate"]


def rates(spark: SparkSession) -> DataFrame:
    """The rate table with its version ids; four rows."""
    from costgrain.operators.pricing import rates_in_micros

    rows = [(f"v{k}", *r) for k, r in enumerate(RATES)]
    schema = ", ".join(f"{c} string" for c in ["pricing_version_id", *RATE_COLUMNS])
    return rates_in_micros(spark.createDataFrame(rows, schema))


def _sql(x) -> str:
    return "CAST(NULL AS VARCHAR)" if x is None else f"'{x}'"


_micros = lambda c: f"CAST(CAST({c} AS DECIMAL(18,6)) * 1000000 AS BIGINT) AS {c}"
_date = lambda c: f"make_date(CAST(split_part({c}, '-', 1) AS BIGINT), CAST(split_part({c}, '-', 2) AS BIGINT), CAST(split_part({c}, '-', 3) AS BIGINT))"
RATES_SQL = f"""rates AS (
  SELECT pricing_version_id, model_pattern, effective_from, {_date('effective_from')} AS since, {', '.join(_micros(c) for c in RATE_COLUMNS[3:])},
    CASE WHEN model_pattern LIKE '%*' THEN 0 ELSE 1 END AS exact, replace(model_pattern, '*', '') AS head
  FROM (VALUES {', '.join('(' + ', '.join(_sql(x) for x in (f'v{k}', *r)) + ')' for k, r in enumerate(RATES))}) AS t(pricing_version_id, {', '.join(RATE_COLUMNS)})
)"""
_term = lambda t, r: f"CASE WHEN coalesce({t}, 0) > 0 THEN ({t} * {r} + 500000) // 1000000 ELSE 0 END"
_gap = lambda t, r: f"(coalesce({t}, 0) > 0 AND {r} IS NULL)"
_pairs = [("input_tokens", "input_rate"), ("cached_input_tokens", "cached_rate"), ("cache_write_tokens", "write_rate"), ("output_tokens", "output_rate"), ("reasoning_tokens", "coalesce(reasoning_rate, output_rate)")]
PRICED = LEDGER + ", " + RATES_SQL + f""", priced AS (
  SELECT * EXCLUDE (nth), CASE WHEN pricing_version_id IS NOT NULL AND NOT ({' OR '.join(_gap(*p) for p in _pairs)}) THEN CAST({' + '.join(_term(*p) for p in _pairs)} AS BIGINT) END AS amount_micros
  FROM (
    SELECT l.*, r.* EXCLUDE (model_pattern, effective_from, since, exact, head),
      row_number() OVER (PARTITION BY l.source_offset ORDER BY exact DESC NULLS LAST, length(head) DESC, since DESC) AS nth
    FROM ledger l LEFT JOIN rates r ON (CASE WHEN exact = 1 THEN l.model = head ELSE starts_with(l.model, head) END) AND since <= CAST(split_part(l.source_timestamp, 'T', 1) AS DATE)
  ) WHERE nth = 1
)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work items: regions, nations under them, customers under nations; one project."""
    made = lambda t, key, up, name: read(spark, sf_dir, t).select(F.concat(F.lit(t[0]), F.col(key).cast("string")).alias("id"), up.alias("parent_id"), F.col(name).alias("title"), F.lit("p").alias("project_id"))
    region = made("region", "r_regionkey", F.lit(None).cast("string"), "r_name")
    nation = made("nation", "n_nationkey", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), "n_name")
    customer = made("customer", "c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), "c_name")
    return region.unionByName(nation).unionByName(customer)


ITEMS = """items AS (
  SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS parent_id, r_name AS title FROM region
  UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR), n_name FROM nation
  UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 'n' || CAST(c_nationkey AS VARCHAR), c_name FROM customer
)"""


def spans(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """A span for each event (of the ledger, if none are given) that is no lifecycle counter."""
    e = (ledger(spark, sf_dir) if events is None else events).where("source_kind not in ('final_request_counter', 'subagent_stop')")
    from costgrain.functions.vocabulary import is_measured

    return e.select(F.concat(F.lit("sp"), F.col("source_offset").cast("string")).alias("span_id"), F.col("id").alias("usage_event_id"), "session", F.when(is_measured(), "measured").otherwise("unavailable").alias("measurement_status"), "source_offset", F.substring("session", 2, 20).cast("long").alias("user_id"))


def attributions(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Active attributions: two fifths of the spans are shared 60/40 by a customer and a nation."""
    s = spans(spark, sf_dir, events).select("span_id", "source_offset", "user_id")
    first = s.select("span_id", F.concat(F.lit("g"), F.col("source_offset").cast("string")).alias("group_id"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("work_item_id"), F.lit("primary").alias("role"), F.when(F.col("source_offset") % 5 < 2, 6000).otherwise(10000).alias("weight"), F.lit(0).alias("ordinal"), F.lit(0.9).alias("confidence"))
    second = s.where("source_offset % 5 < 2").select("span_id", F.concat(F.lit("g"), F.col("source_offset").cast("string")).alias("group_id"), F.concat(F.lit("n"), (F.col("user_id") % 25).cast("string")).alias("work_item_id"), F.lit("secondary").alias("role"), F.lit(4000).alias("weight"), F.lit(1).alias("ordinal"), F.lit(0.8).alias("confidence"))
    return first.unionByName(second)


SPANS = """spans AS (
  SELECT 'sp' || CAST(source_offset AS VARCHAR) AS span_id, id AS usage_event_id, session, CASE WHEN measured THEN 'measured' ELSE 'unavailable' END AS measurement_status, source_offset, CAST(substr(session, 2) AS BIGINT) AS user_id
  FROM ledger WHERE source_kind NOT IN ('final_request_counter', 'subagent_stop')
), attributions AS (
  SELECT span_id, 'g' || CAST(source_offset AS VARCHAR) AS group_id, 'c' || CAST(user_id AS VARCHAR) AS work_item_id, 'primary' AS role, CASE WHEN source_offset % 5 < 2 THEN 6000 ELSE 10000 END AS weight, 0 AS ordinal, 0.9 AS confidence FROM spans
  UNION ALL
  SELECT span_id, 'g' || CAST(source_offset AS VARCHAR), 'n' || CAST(user_id % 25 AS VARCHAR), 'secondary', 4000, 1, 0.8 FROM spans WHERE source_offset % 5 < 2
)"""


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies: one for every 29th event; each third is a notice, each fifth resolved."""
    n = F.col("event_id")
    e = read(spark, sf_dir, "events").where("event_id % 29 = 0")
    return e.select(n.alias("anomaly_id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session"), F.when(n % 3 == 0, "unmapped_source_kind").otherwise("negative_delta").alias("type"), F.when(n % 5 == 0, "2024-02-01").alias("resolved_at"))


ANOMALIES = """anomalies AS (
  SELECT event_id AS anomaly_id, 's' || CAST(user_id AS VARCHAR) AS session, CASE WHEN event_id % 3 = 0 THEN 'unmapped_source_kind' ELSE 'negative_delta' END AS type, CASE WHEN event_id % 5 = 0 THEN '2024-02-01' END AS resolved_at
  FROM events WHERE event_id % 29 = 0
)"""
