"""Queries over the source readers, the ledger and reports, each with its DuckDB twin.

The records that a reader gets are made from the test tables: the reader sees
JSON text, its twin the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from costgrain.functions import money, text
from costgrain.functions.vocabulary import TOKENS
from costgrain.operators import attribution
from costgrain.operators.stages import numbered, shared_folder
from costgrain.plans import reports
from costgrain.plans import tables as t
from costgrain.plans.queries import query
from costgrain.sources import documents, transcripts
from costgrain.streaming.ledger import Ledger, poison

_TOK = ", ".join(TOKENS)
_CENTS, _K = "CAST(round(abs(value) * 100) AS BIGINT)", "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _events(spark, sf_dir):
    """The events with cents and k, and short names: n, u."""
    e = t.read(spark, sf_dir, "events")
    return e.select("event_type", F.col("event_id").alias("n"), F.col("user_id").alias("u"), F.round(F.abs("value") * 100).cast("long").alias("cents"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def _name(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _json_by_type(lines: dict, **options):
    """The JSON text of a struct of columns for each event type."""
    out = F.lit(None).cast("string")
    for kind, fields in lines.items():
        out = F.when(F.col("event_type") == kind, F.to_json(F.struct(*fields)) if isinstance(fields, list) else F.lit(fields)).otherwise(out)
    return out


def _request_lines(spark, sf_dir):
    cents, k, n = F.col("cents"), F.col("k"), F.col("n")
    s = _name("s", "u")
    creation = F.struct((n % 3).alias("ephemeral_1h_input_tokens"), (n % 5).alias("ephemeral_5m_input_tokens")).alias("cache_creation")
    click = F.struct(cents.alias("input_tokens"), (n % 100).alias("cache_read_input_tokens"), creation, k.alias("output_tokens"), F.struct((k % 3).alias("thinking_tokens")).alias("output_tokens_details"))
    bought = F.struct(cents.alias("input_tokens"), (n % 7).alias("cache_creation_input_tokens"), k.alias("outputTokens"), (-1 - n).alias("reasoning_tokens"))
    lines = _json_by_type(
        {
            "click": [F.lit("assistant").alias("type"), s.alias("session_id"), _name("r", "n").alias("requestId"), F.struct(F.lit("m").alias("id"), F.lit("inner").alias("model"), click.alias("usage")).alias("message")],
            "view": [F.lit("usage_snapshot").alias("type"), s.alias("sessionId"), _name("e", "n").alias("event_id"), F.struct(cents.alias("inputTokens"), k.alias("output_tokens")).alias("usage")],
            "purchase": [F.lit("otel_api_request").alias("type"), s.alias("session_id"), _name("r", "n").alias("request_id"), F.lit("outer").alias("model"), (cents * 3).alias("cost_micros"), bought.alias("usage")],
            "signup": [F.lit(3).alias("version"), s.alias("session_id"), F.struct(cents.alias("input_tokens")).alias("usage")],
            "error": '{"type": "assistant", ',
        }
    )
    return _events(spark, sf_dir).select(F.lit("f").alias("source_path"), F.col("n").alias("source_offset"), lines.alias("line"), F.lit(False).alias("oversize"))


_REQUESTS = f"""e AS (SELECT event_type, event_id AS n, user_id AS u, {_CENTS} AS cents, {_K} AS k FROM events),
v AS (SELECT *, row_number() OVER w AS nth, cents - lag(cents) OVER w AS dc, k - lag(k) OVER w AS dk FROM e WHERE event_type = 'view' WINDOW w AS (PARTITION BY u ORDER BY n))"""


@query(
    f"""WITH {_REQUESTS} SELECT n AS source_offset, 's' || CAST(u AS VARCHAR) AS session, 'snapshot_delta' AS source, 'e' || CAST(n AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS model, dc AS input_tokens, CAST(NULL AS BIGINT) AS cached_input_tokens, CAST(NULL AS BIGINT) AS cache_write_tokens, dk AS output_tokens, CAST(NULL AS BIGINT) AS reasoning_tokens, CAST(NULL AS BIGINT) AS cost_micros FROM v WHERE nth > 1 AND dc >= 0 AND dk >= 0
UNION ALL SELECT n, 's' || CAST(u AS VARCHAR), 'transcript_request', 'r' || CAST(n AS VARCHAR), 'inner', cents, n % 100, n % 3 + n % 5, k, k % 3, NULL FROM e WHERE event_type = 'click'
UNION ALL SELECT n, 's' || CAST(u AS VARCHAR), 'official_telemetry', 'r' || CAST(n AS VARCHAR), 'outer', cents, NULL, n % 7, k, NULL, cents * 3 FROM e WHERE event_type = 'purchase'"""
)
def request_transcripts(spark, sf_dir):
    """Request records with counts in several places and names, and snapshots that become differences."""
    rows, _ = transcripts.requests_of(_request_lines(spark, sf_dir))
    return rows.select("source_offset", "session", "source", F.coalesce("request_id", "source_event_id").alias("key"), "model", *TOKENS, "cost_micros")


@query(f"WITH {_REQUESTS} SELECT n AS source_offset, 'negative_delta' AS type FROM v WHERE nth > 1 AND (dc < 0 OR dk < 0) UNION ALL SELECT n, CASE event_type WHEN 'signup' THEN 'unsupported_version' ELSE 'malformed_line' END FROM e WHERE event_type IN ('signup', 'error')")
def request_anomalies(spark, sf_dir):
    """Snapshots that fall, lines of a version that is not known, and lines that are no JSON."""
    _, odd = transcripts.requests_of(_request_lines(spark, sf_dir))
    return odd.select("source_offset", "type")


def _stream_lines(spark, sf_dir):
    cents, k, n, s = F.col("cents"), F.col("k"), F.col("n"), _name("s", "u")
    lines = _json_by_type(
        {
            "view": [F.lit("turn_start").alias("type"), s.alias("session_id"), _name("t", "n").alias("turn_id"), F.when(n % 2 == 0, _name("a", "n")).alias("agentId")],
            "signup": [F.lit("turn/completed").alias("method")],
            "click": [F.lit("usage").alias("type"), s.alias("threadId"), _name("r", "n").alias("requestId"), F.lit("m1").alias("model"), F.struct(cents.alias("prompt_tokens"), k.alias("completion_tokens"), F.struct((n % 9).alias("cached_tokens")).alias("prompt_tokens_details")).alias("usage")],
            "purchase": [F.lit("v1").alias("version"), F.lit("token_usage").alias("event"), s.alias("session_id"), _name("x", "n").alias("turnId"), _name("q", "n").alias("id"), F.struct(cents.alias("input_tokens"), k.alias("output_tokens"), (n % 5).alias("reasoning_tokens")).alias("token_usage")],
            "error": [F.lit("v77").alias("protocol_version"), F.struct(cents.alias("input_tokens")).alias("usage")],
        }
    )
    return _events(spark, sf_dir).select(_name("f", "u").alias("source_path"), n.alias("source_offset"), lines.alias("line"), F.lit(False).alias("oversize"))


_STREAM = f"""e AS (SELECT event_type, event_id AS n, user_id AS u, {_CENTS} AS cents, {_K} AS k FROM events WHERE event_type <> 'error'),
c AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM e),
d AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN 't' || CAST(n AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY u, seg ORDER BY n) AS turn, last_value(CASE WHEN event_type = 'view' AND n % 2 = 0 THEN 'a' || CAST(n AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY u ORDER BY n) AS agent FROM c)"""


@query(
    f"""WITH {_STREAM} SELECT n AS source_offset, 's' || CAST(u AS VARCHAR) AS session, CASE event_type WHEN 'click' THEN 'r' ELSE 'q' END || CAST(n AS VARCHAR) AS request_id, CASE event_type WHEN 'click' THEN turn ELSE 'x' || CAST(n AS VARCHAR) END AS turn_id, agent AS agent_id,
CASE event_type WHEN 'click' THEN 'transcript_request' ELSE 'official_telemetry' END AS source, cents AS input_tokens, CASE event_type WHEN 'click' THEN n % 9 END AS cached_input_tokens, k AS output_tokens, CASE event_type WHEN 'purchase' THEN n % 5 END AS reasoning_tokens FROM d WHERE event_type IN ('click', 'purchase')"""
)
def event_streams(spark, sf_dir):
    """Stream records that take turn and agent from earlier lines."""
    rows, _ = transcripts.streams_of(_stream_lines(spark, sf_dir))
    return rows.select("source_offset", "session", "request_id", "turn_id", "agent_id", "source", "input_tokens", "cached_input_tokens", "output_tokens", "reasoning_tokens")


@query("SELECT event_id AS source_offset, 'unsupported_version' AS type, CAST(NULL AS VARCHAR) AS session, 'f' || CAST(user_id AS VARCHAR) AS source_path, '{\"unsupported_version\":\"v77\"}' AS details FROM events WHERE event_type = 'error'")
def event_stream_anomalies(spark, sf_dir):
    """What a stream's reader tells of records it can't take: here those of an unknown version."""
    _, odd = transcripts.streams_of(_stream_lines(spark, sf_dir))
    return odd.select("source_offset", "type", "session", "source_path", "details")


def _turn_contents(spark, sf_dir):
    turn = F.struct(F.col("n").alias("turnNumber"), F.when(F.col("n") % 4 > 0, F.col("cents")).alias("inputTokens"), F.when(F.col("n") % 4 > 0, F.col("k")).alias("outputTokens"), (F.col("n") % 5).alias("modelCalls"), (F.col("cents") * 1000 + F.col("n") % 1000).alias("costUsdTicks"), (F.col("cents") + F.col("k") + F.when(F.col("n") % 3 == 0, 1).otherwise(0)).alias("totalTokens"))
    by_user = _events(spark, sf_dir).groupBy("u").agg(F.collect_list(F.when(F.col("event_type") == "click", turn)).alias("turns"), F.sum("cents").alias("c"))
    body = F.struct(_name("s", "u").alias("sessionId"), F.lit(1).alias("version"), F.struct(F.col("c").alias("inputTokens"), F.lit("m2").alias("primaryModelId")).alias("session"), "turns")
    return by_user.select(_name("f", "u").alias("source_path"), F.to_json(body).alias("content"))


_TURN_SQL = f"""e AS (SELECT event_type, event_id AS n, user_id AS u, {_CENTS} AS cents, {_K} AS k FROM events),
m AS (SELECT u, n, cents, k, n % 5 = 0 AS failed, n % 5 = 0 OR n % 4 = 0 AS off FROM e WHERE event_type = 'click')"""


@query(
    f"""WITH {_TURN_SQL} SELECT 's' || CAST(u AS VARCHAR) AS session, 'turn_' || CAST(n AS VARCHAR) AS turn_id, CASE WHEN failed THEN 'grok_turn_failed' WHEN off THEN 'grok_turn_unmeasured' ELSE 'grok_turn_usage' END AS source_subtype, 'm2' AS model, CASE WHEN NOT off THEN cents END AS input_tokens, CASE WHEN NOT off THEN k END AS output_tokens, CASE WHEN NOT off THEN cents + n % 1000 // 1000 END AS cost_micros FROM m
UNION ALL SELECT 's' || CAST(u AS VARCHAR), NULL, 'grok_session_usage', 'm2', CAST(sum(cents) AS BIGINT), NULL, NULL FROM e GROUP BY u HAVING count(*) FILTER (WHERE event_type = 'click') = 0"""
)
def turn_files(spark, sf_dir):
    """Files with a list of turns; of a failed or unmeasured turn nothing counts."""
    rows, _ = documents.turns_of(_turn_contents(spark, sf_dir))
    return rows.select("session", "turn_id", "source_subtype", "model", "input_tokens", "output_tokens", "cost_micros")


@query(f"WITH {_TURN_SQL} SELECT 's' || CAST(u AS VARCHAR) AS session, 'turn_' || CAST(n AS VARCHAR) AS turn_id, CASE WHEN off THEN 'missing_provider_measurements' ELSE 'token_sum_mismatch' END AS type FROM m WHERE off OR n % 3 = 0")
def turn_anomalies(spark, sf_dir):
    _, odd = documents.turns_of(_turn_contents(spark, sf_dir))
    return odd.select("session", "turn_id", "type")


def _run_contents(spark, sf_dir):
    c = t.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("u"), F.round(F.abs("c_acctbal") * 100).cast("long").alias("cents"))
    key, cents = F.col("u"), F.col("cents")
    dollars = F.concat((cents / 100).cast("long").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    side = F.create_map(F.lit("title"), F.struct((cents % 50).alias("input_tokens"), F.when(key % 2 == 0, "0.5").alias("cost_usd")))
    body = F.struct(
        F.when(key % 3 > 0, _name("s", "u")).alias("session_id"), F.when(key % 5 == 0, "lab/tiny:free").otherwise("lab/big").alias("model"), (key % 7 == 0).alias("failed"), F.when(key % 4 > 0, cents).alias("input_tokens"), F.when(key % 4 == 1, key).alias("cache_read_tokens"),
        F.when(key % 6 == 0, dollars).alias("actual_cost_usd"), F.when(key % 6 < 3, "1.0000005").alias("estimated_cost_usd"), F.when(key % 8 == 0, F.struct(side.alias("by_task"))).alias("auxiliary"),
    )
    return c.select(F.concat(F.lit("dir/f"), key.cast("string"), F.lit(".usage.json")).alias("source_path"), F.to_json(body).alias("content"))


@query(
    """WITH c AS (SELECT c_custkey AS u, CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS cents, CASE WHEN c_custkey % 3 > 0 THEN 's' || CAST(c_custkey AS VARCHAR) ELSE 'f' || CAST(c_custkey AS VARCHAR) || '.usage' END AS session FROM customer),
r AS (SELECT *, u % 7 <> 0 AND u % 4 > 0 AS known, u % 7 = 0 AS failed, CASE WHEN u % 6 = 0 THEN cents * 10000 WHEN u % 6 < 3 THEN 1000001 WHEN u % 5 = 0 THEN 0 END AS told FROM c)
SELECT session, 'turn_1' AS turn_id, CASE WHEN known THEN 'provider_fields' ELSE 'unavailable' END AS source, CASE WHEN failed THEN 'hermes_failed_run' WHEN NOT known THEN 'hermes_unmeasured' ELSE 'hermes_oneshot_usage' END AS source_subtype, CASE WHEN known THEN cents END AS input_tokens, CASE WHEN known AND u % 4 = 1 THEN u END AS cached_input_tokens, CASE WHEN known THEN told END AS cost_micros FROM r
UNION ALL SELECT session, 'task_title', 'provider_fields', 'hermes_auxiliary_title', cents % 50, NULL, CASE WHEN u % 2 = 0 THEN 500000 WHEN u % 5 = 0 THEN 0 END FROM r WHERE u % 8 = 0"""
)
def oneshot_runs(spark, sf_dir):
    """Reports of one-shot runs with side tasks; the actual cost before an estimate, a free model for nothing."""
    rows, _ = documents.runs_of(_run_contents(spark, sf_dir))
    return rows.select("session", "turn_id", "source", "source_subtype", "input_tokens", "cached_input_tokens", "cost_micros")


@query(
    f"""SELECT 's' || CAST(user_id AS VARCHAR) AS session, 'r' || CAST(event_id AS VARCHAR) AS request_id, CASE WHEN event_id % 2 = 0 THEN 'own' ELSE 'shared' END AS model, {_CENTS} AS input_tokens, {_K} AS output_tokens, event_id AS source_offset, 'otel:s' || CAST(user_id AS VARCHAR) || ':' || CAST(event_id AS VARCHAR) AS source_event_id, 'unix-ns:' || CAST(event_id AS VARCHAR) AS source_timestamp
FROM events WHERE event_type IN ('click', 'purchase') AND NOT (event_type = 'purchase' AND event_id % 3 = 0)"""
)
def telemetry_payloads(spark, sf_dir):
    """Log payloads with lists of attributes: a record's own come before those of its resource."""
    a = lambda key, value, kind="stringValue": F.struct(F.lit(key).alias("key"), F.struct(*(F.when(F.lit(kind == x), value.cast("string")).alias(x) for x in ("stringValue", "intValue"))).alias("value"))
    own = F.array(
        a("event.name", F.when((F.col("event_type") == "purchase") & (F.col("n") % 3 == 0), "tool_result").otherwise("claude_code.api_request")), a("request_id", _name("r", "n")), a("event.sequence", F.col("n"), "intValue"),
        a("input_tokens", F.col("cents"), "intValue"), a("output_tokens", F.col("k")), a("model", F.when(F.col("n") % 2 == 0, "own")),
    )
    records = _events(spark, sf_dir).where("event_type in ('click', 'purchase')").groupBy("u").agg(F.collect_list(F.struct(F.col("n").cast("string").alias("timeUnixNano"), own.alias("attributes"))).alias("logRecords"))
    outer = F.struct(F.array(a("session.id", _name("s", "u")), a("model", F.lit("shared"))).alias("attributes"))
    line = F.to_json(F.struct(F.array(F.struct(outer.alias("resource"), F.array(F.struct("logRecords")).alias("scopeLogs"))).alias("resourceLogs")))
    return documents.telemetry(records.select(line.alias("line"))).select("session", "request_id", "model", "input_tokens", "output_tokens", "source_offset", "source_event_id", "source_timestamp")


def _prototypes(spark, sf_dir):
    record = F.struct(F.when(F.col("c_custkey") % 3 > 0, F.lit(" Alpha ")).alias("project"), _name("task ", "c_custkey").alias("task_name"), F.when(F.col("c_custkey") % 4 > 0, _name("s", "c_custkey")).alias("session"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_custkey")).alias("input"))
    by_nation = t.read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey", record.alias("r")))).alias("x"))
    items = F.transform("x", lambda x: x["r"])
    content = F.when(F.col("c_nationkey") % 2 == 0, F.to_json(items)).otherwise(F.to_json(F.struct(items.alias("records"))))
    return documents.prototypes_of(by_nation.select(_name("p", "c_nationkey").alias("source_path"), content.alias("content")))


_PROTOTYPES = """p AS (SELECT 'p' || CAST(c_nationkey AS VARCHAR) AS source_path, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n, CASE WHEN c_custkey % 3 > 0 THEN 'Alpha' ELSE 'Prototype import' END AS project, 'task ' || CAST(c_custkey AS VARCHAR) AS task, CASE WHEN c_custkey % 4 > 0 THEN 's' || CAST(c_custkey AS VARCHAR) END AS told, CASE WHEN c_custkey % 5 > 0 THEN c_custkey END AS input_tokens FROM customer)"""


@query(f"WITH {_PROTOTYPES} SELECT source_path || ':' || CAST(n AS VARCHAR) AS source_event_id, project, task, coalesce(told, 'prototype-' || CAST(n AS VARCHAR)) AS session, input_tokens FROM p")
def prototype_ledgers(spark, sf_dir):
    """Arrays of records, bare or under a key."""
    return _prototypes(spark, sf_dir).select("source_event_id", "project", "task", "session", "input_tokens")


@query(f"WITH {_PROTOTYPES} SELECT count(*) AS records, count(input_tokens) AS measured, count(*) - count(input_tokens) AS unavailable, count(DISTINCT project) AS projects FROM p")
def prototype_preview(spark, sf_dir):
    return documents.prototype_preview(_prototypes(spark, sf_dir))


# Money.

_PRICE = "printf('%d.%02d', cents // 100, cents % 100)"


@query(
    f"""WITH p AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN cents * 10000 WHEN 2 THEN cents // 100 * 1000000 ELSE cents * 10000 + p_partkey % 100 + CASE WHEN p_partkey % 5 = 3 THEN 1 ELSE 0 END END AS from_text,
CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE cents * 10000 END AS from_number, (cents * 7 + p_partkey) // 1000 AS from_ticks FROM p"""
)
def money_texts(spark, sf_dir):
    """Micro-dollars of decimal text, of numbers, and of thousandths."""
    p = t.read(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))
    key, cents = F.col("p_partkey"), F.col("cents")
    whole, rest = (cents / 100).cast("long").cast("string"), F.lpad((cents % 100).cast("string"), 2, "0")
    tail = F.lpad((key % 100).cast("string"), 4, "0")
    shown = F.when(key % 5 == 0, F.concat(F.lit("-"), whole)).when(key % 5 == 1, F.concat(whole, F.lit("."), rest)).when(key % 5 == 2, whole).otherwise(F.concat(whole, F.lit("."), rest, tail, F.when(key % 5 == 3, "5").otherwise("4"), F.lit("9")))
    number = F.when(key % 3 == 0, -cents / 100).otherwise(cents / 100)
    return p.select("p_partkey", money.dollar_text_to_micros(shown).alias("from_text"), money.float_dollars_to_micros(number).alias("from_number"), money.thousandths(cents * 7 + key).alias("from_ticks"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN 'gemini-' || CAST(p_partkey AS VARCHAR) || '.5-pro' END AS model FROM part")
def model_names(spark, sf_dir):
    """The first name of a model family inside other text."""
    name = F.concat(F.lit("\x02x gemini-"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 1, ".5-pro-control").otherwise(".5-pro"), F.lit(" gemini-2"))
    return t.read(spark, sf_dir, "part").select("p_partkey", text.model_name(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(name)).alias("model"))


# Ledger and attribution.


def _full(rows):
    """Observations with the columns that the test tables have nothing for."""
    return rows.withColumns({"service_tier": F.lit(None).cast("string"), "region": F.lit(None).cast("string"), "parser_version": F.lit("1")})


@query(
    f"""WITH {t.OBS}, old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY rank DESC, measured DESC, source_offset) AS nth FROM named WHERE source_offset % 2 = 0) WHERE nth = 1),
new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY rank DESC, measured DESC, source_offset) AS nth FROM named WHERE source_offset % 2 = 1) WHERE nth = 1),
met AS (SELECT n.source_offset AS new_offset, o.source_offset AS old_offset, CASE o.source_kind WHEN 'unavailable' THEN 0 WHEN 'snapshot_delta' THEN 2 WHEN 'turn_counter' THEN 2 WHEN 'transcript_request' THEN 3 WHEN 'final_request_counter' THEN 3 WHEN 'subagent_stop' THEN 3 WHEN 'official_telemetry' THEN 5 ELSE 255 END AS old_rank, n.rank, n.measured, o.measured AS old_measured FROM new n JOIN old o ON n.session = o.session AND n.identity = o.identity),
won AS (SELECT * FROM met WHERE rank > old_rank OR (rank = old_rank AND measured AND NOT old_measured))
SELECT source_offset, source_offset IN (SELECT old_offset FROM won) AS superseded FROM old
UNION ALL SELECT source_offset, false FROM new WHERE source_offset IN (SELECT new_offset FROM won) OR (source_offset NOT IN (SELECT new_offset FROM met) AND identity NOT IN (SELECT identity FROM old))"""
)
def ledger_replay(spark, sf_dir):
    """Two batches, the second one twice: what supersedes what, and nothing counts twice."""
    ledger = Ledger(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")
    rows = _full(t.observations(spark, sf_dir))
    for batch, odd in ((0, 0), (1, 1), (1, 1)):
        ledger.ingest(rows.where(F.col("source_offset") % 2 == odd), batch)
    return ledger.events().select("source_offset", F.col("superseded_by").isNotNull().alias("superseded"))


@query(f"WITH {t.OBS} SELECT source_offset, CASE WHEN source_offset % 10 = 3 THEN 'poison_row' WHEN source_offset % 10 = 5 THEN 'poison_row' WHEN source_offset % 10 = 7 AND output_tokens > 0 THEN 'poison_row' ELSE 'sound' END AS verdict FROM obs")
def poison_rows(spark, sf_dir):
    """Rows without a session, of an unknown source, or with a negative count are set apart."""
    n = F.col("source_offset") % 10
    rows = _full(t.observations(spark, sf_dir))
    made = rows.withColumns({"session": F.when(n != 3, F.col("session")), "source": F.when(n == 5, "hearsay").otherwise(F.col("source")), "output_tokens": F.when(n == 7, -F.col("output_tokens")).otherwise(F.col("output_tokens"))})
    sound, broken = poison(made)
    return sound.select("source_offset", F.lit("sound").alias("verdict")).unionByName(broken.select("source_offset", F.col("type").alias("verdict")))


_ATTACHED = f"WITH {t.LEDGER}, {t.SPANS}, mine AS (SELECT span_id, CASE WHEN source_offset % 3 = 0 THEN source_offset % 4 + 2 ELSE 1 END AS version FROM spans WHERE session = 's7')"


def _attach(spark, sf_dir, f):
    spans = t.spans(spark, sf_dir)
    groups = spans.where("source_offset % 3 = 0").select("span_id", (F.col("source_offset") % 4 + 1).alias("version"))
    return f(spans, groups)


@query(f"{_ATTACHED} SELECT span_id, version, 'group_' || substr(sha256(span_id || ':' || CAST(version AS VARCHAR)), 1, 24) AS group_id, 'w' AS work_item_id, 10000 AS weight FROM mine")
def attach_session(spark, sf_dir):
    new, rows = _attach(spark, sf_dir, lambda s, g: attribution.attach(s, g, "s7", "w"))
    return new.join(rows, "group_id").select("span_id", "version", "group_id", "work_item_id", "weight")


@query(f"{_ATTACHED} SELECT span_id, version, false AS active FROM mine")
def detach_session(spark, sf_dir):
    return _attach(spark, sf_dir, lambda s, g: attribution.detach(s, g, "s7")).select("span_id", "version", "active")


# Reports.


def _nodes(spark, sf_dir):
    """The items with paths, creation days and totals made from their titles."""
    from costgrain.operators.tree import paths

    n = F.length("title")
    made = {c: (n * (k + 3)).cast("long") for k, c in enumerate(TOKENS)} | {"requests": (n % 3).cast("long"), "measured": (n % 2).cast("long"), "unavailable": F.lit(1).cast("long"), "anomalous": (n % 5).cast("long"), "priced": F.lit(1).cast("long"), "amount_micros": (n * 123_457).cast("long")}
    return paths(t.items(spark, sf_dir)).withColumns({"created_at": F.concat(F.lit("d"), (n % 2).cast("string")), "title": F.concat(F.when(n % 4 == 0, "=").otherwise('"'), "title"), **made})


_NODES = f"{t.ITEMS}, nodes AS (SELECT id, parent_id, CASE WHEN length(title) % 4 = 0 THEN '=' ELSE '\"' END || title AS title, length(title) AS n FROM items)"


@query(
    f"""WITH {_NODES} SELECT id, '"p","key","=P",'  || '"' || id || '","' || CASE WHEN title LIKE '=%' THEN '''' ELSE '' END || replace(title, '"', '""') || '","' || coalesce(parent_id, '') || '",' || {" || ',' || ".join(f'CAST(n * {k + 3} AS VARCHAR)' for k in range(5))} || ',' || CAST(n * 25 AS VARCHAR) || ',' || CAST(n % 3 AS VARCHAR) || ',' || CAST(n % 2 AS VARCHAR) || ',1,'
|| CASE WHEN n % 3 = 1 THEN CAST((n * 123457 + 50) // 100 // 10000 AS VARCHAR) || '.' || lpad(CAST((n * 123457 + 50) // 100 % 10000 AS VARCHAR), 4, '0') ELSE 'unavailable' END || ',' || printf('%.1f', 100.0::DOUBLE * (n % 2) / (n % 2 + 1 + n % 5)) AS line FROM nodes""".replace('"=P"', '"\'\'=P"')
)
def report_csv(spark, sf_dir):
    """Lines of the CSV report."""
    nodes = _nodes(spark, sf_dir)
    return reports.csv_lines(nodes, {"id": "p", "key": "key", "title": "=P"}).select(F.element_at(F.split("line", ","), 4).alias("id"), "line").select(F.regexp_replace("id", '"', "").alias("id"), "line")


@query(
    f"""WITH RECURSIVE {_NODES}, down AS (SELECT id, [('d' || CAST(n % 2 AS VARCHAR), title, id)] AS place FROM nodes WHERE parent_id IS NULL UNION ALL SELECT x.id, list_append(down.place, ('d' || CAST(x.n % 2 AS VARCHAR), x.title, x.id)) FROM nodes x JOIN down ON x.parent_id = down.id)
SELECT id, row_number() OVER (ORDER BY place) AS nth FROM down"""
)
def report_order(spark, sf_dir):
    """Parents before children, siblings by creation, title and id; numbers are given range by range."""
    return numbered(reports.in_tree_order(_nodes(spark, sf_dir)).select("id", "place"), ["place"], "nth").select("id", "nth")


@query(
    f"""WITH {_NODES}, s AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY 'd' || CAST(n % 2 AS VARCHAR) DESC, title DESC, id DESC) = 1 AS last FROM nodes)
SELECT CASE WHEN a.parent_id IS NULL THEN '' ELSE CASE WHEN c.id IS NULL THEN '' WHEN c.last THEN '    ' ELSE '│   ' END || CASE WHEN b.last THEN '    ' ELSE '│   ' END END || CASE WHEN a.last THEN '└── ' ELSE '├── ' END || a.title || '  '
|| CASE WHEN a.n % 3 = 1 THEN '$' || CAST((a.n * 123457 + 5000) // 10000 // 100 AS VARCHAR) || '.' || lpad(CAST((a.n * 123457 + 5000) // 10000 % 100 AS VARCHAR), 2, '0') || ' est. API-equivalent' ELSE 'cost unavailable' END || ' · ' || CAST(a.n * 25 AS VARCHAR) || ' tok · ' || CASE WHEN a.n % 3 > 0 THEN CASE a.n % 2 WHEN 1 THEN '50' ELSE '0' END || '% complete' ELSE '—' END || ' · 1 unavailable' AS line
FROM s a LEFT JOIN s b ON a.parent_id = b.id LEFT JOIN s c ON b.parent_id = c.id"""
)
def report_text(spark, sf_dir):
    """Lines of the drawn tree."""
    return reports.text_lines(_nodes(spark, sf_dir)).select("line")
