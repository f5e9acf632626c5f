"""Queries over discovery, hooks, quarantine, prices, anomalies, runs and real reports, each with its DuckDB twin."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from costgrain.functions import text
from costgrain.functions.vocabulary import TOKENS
from costgrain.operators import projects, runs, tree
from costgrain.operators.stages import shared_folder
from costgrain.plans import reports
from costgrain.plans import tables as t
from costgrain.plans.queries import _TREE, _direct, _direct_sql, ORACLES, query
from costgrain.plans.source_queries import _full
from costgrain.sources import databases, documents, files, prices
from costgrain.sources.observation import COLUMNS
from costgrain.streaming import hooks
from costgrain.streaming.ledger import poison

_CENTS = "CAST(round(abs(value) * 100) AS BIGINT)"


# Files.


@query("SELECT repeat(p_name, CAST(p_partkey % 7 AS INTEGER)) AS line, strlen(repeat(p_name, CAST(p_partkey % 7 AS INTEGER))) > 60 AS oversize FROM part")
def bounded_lines(spark, sf_dir):
    """Lines of files, the too long ones marked."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    t.read(spark, sf_dir, "part").select(F.expr("repeat(p_name, cast(p_partkey % 7 as int))").alias("value")).repartition(3).write.text(folder)
    return files.lines(spark, folder, "*.txt", most=60).select("line", "oversize")


_NAMES = ["data.db", "opencode.db", "session-store.db", "ledger.db", "state.db", "chat-summaries.db", "x.db", "x.json"]
_NAME_SQL = "CASE p_partkey % 9 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(_NAMES)) + " ELSE 'p' || p_partkey || '.db' END"


@query(
    f"""WITH f AS (SELECT p_partkey, {_NAME_SQL} AS name FROM part)
SELECT p_partkey, name, name LIKE '%.db' AND name NOT IN ('data.db', 'session-store.db', 'opencode.db', 'ledger.db') AND name NOT LIKE '%summaries%' AS gemini, name IN ('session-store.db', 'data.db') AS copilot, name = 'opencode.db' AS opencode FROM f"""
)
def database_names(spark, sf_dir):
    """Which databases belong to which tool, by name."""
    part = t.read(spark, sf_dir, "part").select("p_partkey")
    name = F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".db"))
    for k, n in enumerate(_NAMES):
        name = F.when(F.col("p_partkey") % 9 == k, n).otherwise(name)
    named = part.withColumn("name", name)
    path = F.concat(F.lit("/home/x.db/"), "name")
    return named.select("p_partkey", "name", *(databases.wanted(tool, path).alias(tool) for tool in ("gemini", "copilot", "opencode")))


@query("SELECT 'f' || CAST(c_custkey AS VARCHAR) AS source_path, CASE WHEN c_custkey % 5 < 3 THEN 'unsupported_version' ELSE 'sound' END AS verdict FROM customer")
def run_versions(spark, sf_dir):
    """Reports of one-shot runs of versions that are read, and of others."""
    key = F.col("c_custkey")
    told = F.struct(F.when(key % 5 == 0, 99).when(key % 5 == 3, 98).alias("version"), F.when(key % 5 == 1, "9.10").when(key % 5 == 4, "9.").alias("schema_version"), F.when(key % 5 == 2, True).alias("unsupported_version"), F.lit(3).alias("input_tokens"), F.lit("s").alias("session_id"))
    made = t.read(spark, sf_dir, "customer").select(F.concat(F.lit("f"), key.cast("string")).alias("source_path"), F.to_json(told).alias("content"))
    out, odd = documents.runs_of(made)
    return out.select("source_path", F.lit("sound").alias("verdict")).unionByName(odd.select("source_path", F.col("type").alias("verdict")))


@query("SELECT user_id, epoch_us(max(ts)) AS latest_us FROM events WHERE event_id % 4 < 3 GROUP BY user_id")
def latest_timestamps(spark, sf_dir):
    """The latest instant of each user over texts in several forms, some of them none."""
    n, ts = F.col("event_id"), F.col("ts").cast("timestamp_ntz")
    at = lambda pattern, hours: F.date_format(ts + F.expr(f"interval {hours} hours"), pattern)
    shown = (
        F.when(n % 4 == 0, F.concat(at("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", 0), F.lit("123Z"))).when(n % 4 == 1, F.concat(at("yyyy-MM-dd't'HH:mm:ss.SSSSSS", 5), F.lit("+05:00")))
        .when(n % 4 == 2, F.concat(at("yyyy-MM-dd HH:mm:ss.SSSSSS", -3), F.lit("-03:00"))).otherwise("2999-01-01T00:00:00")
    )
    e = t.read(spark, sf_dir, "events").select("user_id", shown.alias("told"))
    return e.groupBy("user_id").agg(F.unix_micros(F.max(text.rfc3339(F.col("told")))).alias("latest_us")).where("latest_us is not null")


# Hooks.

_LINE = """CASE event_id % 5 WHEN 0 THEN '{"version":1,"kind":"Stop","capturedAt":"t' || event_id || '","payload":{"session_id":" s' || user_id || ' "}}' WHEN 1 THEN '{"version":2,"kind":"Stop","capturedAt":"t","payload":{"session_id":"s' || event_id || '"}}'
WHEN 2 THEN '{"version":1,"kind":"Stop","capturedAt":"t' || event_id || '","payload":{"session_id":" "}}' WHEN 3 THEN '{"broken é ' || event_id ELSE '  ' END"""


def _spool(spark, sf_dir):
    n, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    one = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    line = (
        F.when(F.col("event_id") % 5 == 0, one('{"version":1,"kind":"Stop","capturedAt":"t', n, '","payload":{"session_id":" s', u, ' "}}')).when(F.col("event_id") % 5 == 1, one('{"version":2,"kind":"Stop","capturedAt":"t","payload":{"session_id":"s', n, '"}}'))
        .when(F.col("event_id") % 5 == 2, one('{"version":1,"kind":"Stop","capturedAt":"t', n, '","payload":{"session_id":" "}}')).when(F.col("event_id") % 5 == 3, one('{"broken é ', n)).otherwise("  ")
    )
    return t.read(spark, sf_dir, "events").select(line.alias("line"))


@query(f"WITH l AS (SELECT event_id, {_LINE} AS line FROM events) SELECT sha256(line) AS fingerprint, CAST(strlen(line) AS INTEGER) AS bytes, CASE event_id % 5 WHEN 1 THEN 'unsupported' ELSE 'malformed' END AS label FROM l WHERE event_id % 5 IN (1, 2, 3)")
def hook_quarantine(spark, sf_dir):
    """What of a spool is set apart: fingerprints and sizes, never text."""
    return hooks.envelopes(_spool(spark, sf_dir))[1]


@query("SELECT 'Stop' AS kind, 't' || CAST(event_id AS VARCHAR) AS captured_at, 's' || CAST(user_id AS VARCHAR) AS session_id FROM events WHERE event_id % 5 = 0")
def hook_envelopes(spark, sf_dir):
    return hooks.envelopes(_spool(spark, sf_dir))[0].select("kind", "captured_at", "session_id")


@query(
    f"""SELECT event_id AS n, '{{"session_id":"s' || user_id || '","tool_name":"' || CASE event_id % 3 WHEN 0 THEN 'Edit' WHEN 1 THEN 'Read' ELSE 'Write' END || '"' || CASE WHEN event_id % 3 <> 1 AND event_id % 2 = 0 THEN ',"file_path":"/f' || event_id || '"' ELSE '' END || ',"prompt_fingerprint":"' || sha256('secret ' || {_CENTS}) || '"}}' AS payload FROM events"""
)
def hook_projection(spark, sf_dir):
    """Payloads with what may be kept of them: the prompt as a fingerprint, the path only of tools that have written."""
    n = F.col("event_id")
    e = t.read(spark, sf_dir, "events")
    tool = F.when(n % 3 == 0, "Edit").when(n % 3 == 1, "Read").otherwise("Write")
    of = {"session_id": F.concat(F.lit("s"), F.col("user_id").cast("string")), "tool_name": tool}
    payload = F.struct(*(of.get(c, F.lit(None).cast("string")).alias(c) for c in hooks.KEPT))
    prompt = F.concat(F.lit("secret "), F.round(F.abs("value") * 100).cast("long").cast("string"))
    kept = hooks.sanitise(payload, prompt, F.when(n % 2 == 0, "PostToolUse").otherwise("PreToolUse"), F.concat(F.lit("/f"), n.cast("string")))
    return e.select(n.alias("n"), F.to_json(kept).alias("payload"))


# Stored things.

_FIELD = {"string": lambda c: f"""CASE WHEN {c} IS NULL THEN '' ELSE ',"{c}":"' || {c} || '"' END""", "bigint": lambda c: f"""CASE WHEN {c} IS NULL THEN '' ELSE ',"{c}":' || {c} END"""}
_ROW_JSON = " || ".join(_FIELD[k](c) for c, k in COLUMNS.items())


@query(
    f"""WITH {t.OBS}, r AS (SELECT * REPLACE (-output_tokens - 1 AS output_tokens), CAST(NULL AS VARCHAR) AS service_tier, CAST(NULL AS VARCHAR) AS region, '1' AS parser_version FROM obs WHERE output_tokens IS NOT NULL)
SELECT source_offset, '{{"fingerprint":"' || sha256('{{' || substr({_ROW_JSON}, 2) || '}}') || '","measured":true}}' AS details FROM r"""
)
def poison_details(spark, sf_dir):
    """What is told of a row that can't be stored: the fingerprint of all its columns."""
    rows = _full(t.observations(spark, sf_dir)).where("output_tokens is not null").withColumn("output_tokens", -F.col("output_tokens") - 1)
    return poison(rows)[1].select("source_offset", "details")


@query(f"WITH {t.SESSIONS}, a AS (SELECT event_id, event_type AS type, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 12 AS k FROM events WHERE event_id % 7 = 0) SELECT 'anom_' || substr(sha256(type || ':' || 'now' || ':' || '{{\"n\":' || event_id || '}}'), 1, 24) AS id, CASE WHEN event_id % 3 < 2 THEN 's' || user_id END AS session, CASE WHEN k < 10 THEN 't' || k END AS turn_id, type FROM a")
def anomaly_records(spark, sf_dir):
    """Anomalies to append: sessions found by either of their names, turns by their id."""
    n = F.col("event_id")
    e = t.read(spark, sf_dir, "events").where("event_id % 7 = 0")
    session = F.concat(F.when(n % 3 == 0, "s").when(n % 3 == 1, "provider-").otherwise("unknown-"), F.col("user_id").cast("string"))
    k = F.get_json_object("props", "$.k").cast("long") % 12
    found = e.select(F.col("event_type").alias("type"), session.alias("session"), F.concat(F.lit("t"), k.cast("string")).alias("turn_id"), F.to_json(F.struct(n.alias("n"))).alias("details"))
    known = t.sessions(spark, sf_dir).withColumn("provider_session", F.regexp_replace("session", "^s", "provider-"))
    turns = t.ledger(spark, sf_dir).select("turn_id")
    return projects.record_anomalies(found, known, turns, "now").select("id", "session", "turn_id", "type")


def _manual(spark, sf_dir):
    """Manual runs made of orders: of every fourth there is an end."""
    o = t.read(spark, sf_dir, "orders")
    run = lambda state: o.select(F.concat(F.lit("run_"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("x").alias("session"), F.lit("p").alias("project_id"), F.lit("w").alias("work_item_id"), F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit("T00:00:00Z")).alias("started_at"), F.lit("end" if state == "stopped" else None).cast("string").alias("stopped_at"), F.lit(state).alias("state"), "o_orderkey")
    return run("active").unionByName(run("stopped").where("o_orderkey % 4 = 0")).drop("o_orderkey")


@query("SELECT 'run_' || CAST(o_orderkey AS VARCHAR) AS id, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || 'T00:00:00Z' AS started_at FROM orders WHERE o_orderkey % 4 <> 0 ORDER BY CAST(o_orderdate AS DATE) DESC, id LIMIT 1")
def active_run(spark, sf_dir):
    """The run that was started last and not stopped."""
    return runs.active(_manual(spark, sf_dir)).select("id", "started_at")


@query("WITH r AS (SELECT 'run_' || CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey % 4 <> 0 ORDER BY CAST(o_orderdate AS DATE) DESC, id LIMIT 1) SELECT id AS session, id || ':stop' AS source_event_id, 'explicit_cli' AS source, CAST((SELECT count(*) FROM orders) AS BIGINT) AS input_tokens, 'noon' AS observed_at FROM r")
def manual_stop(spark, sf_dir):
    """The observation that stopping the active run makes."""
    n = t.read(spark, sf_dir, "orders").count()
    return runs.stop(_manual(spark, sf_dir), "noon", {"input_tokens": n})[1].select("session", "source_event_id", "source", "input_tokens", "observed_at")


_MODEL_JSON = """'{"provider":"acme","modelPattern":"m' || n_nationkey || '","effectiveFrom":"2024-01-01","inputPerMillion":"' || n_nationkey || '.25","cachedInputPerMillion":' || CASE WHEN n_nationkey % 2 = 0 THEN '"0.5"' ELSE 'null' END || ',"cacheWritePerMillion":null,"outputPerMillion":"' || n_regionkey || '"' || CASE WHEN n_nationkey % 3 = 0 THEN ',"reasoningPerMillion":"7"' ELSE '' END || ',"source":"' || n_name || '"}'"""
_SNAPSHOT = """WITH m AS (SELECT *, %s AS j FROM nation), d AS (SELECT sha256('{"version":"1","updated":"2024-01-02","currency":"USD","models":[' || string_agg(j, ',' ORDER BY n_nationkey) || ']}') AS digest FROM m)""" % _MODEL_JSON


def _snapshot(spark, sf_dir) -> dict:
    models = []
    for r in t.read(spark, sf_dir, "nation").orderBy("n_nationkey").collect():  # a row a nation
        k = r["n_nationkey"]
        m = {"provider": "acme", "modelPattern": f"m{k}", "effectiveFrom": "2024-01-01", "inputPerMillion": f"{k}.25", "outputPerMillion": str(r["n_regionkey"]), "source": r["n_name"]}
        models.append(m | ({"cachedInputPerMillion": "0.5"} if k % 2 == 0 else {}) | ({"reasoningPerMillion": "7"} if k % 3 == 0 else {}))
    body = {"version": "1", "updated": "2024-01-02", "currency": "USD", "models": models}
    return body | {"sha256": prices.digest(body)}


@query(f"{_SNAPSHOT} SELECT 'price_' || substr(sha256('acme:m' || n_nationkey || ':2024-01-01:' || digest), 1, 24) AS pricing_version_id, 'm' || n_nationkey AS model_pattern, CAST(n_nationkey * 1000000 + 250000 AS BIGINT) AS input_rate, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 500000 END AS BIGINT) AS cached_rate, CAST(n_regionkey * 1000000 AS BIGINT) AS output_rate, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 7000000 END AS BIGINT) AS reasoning_rate FROM m, d")
def price_snapshot(spark, sf_dir):
    """A price snapshot whose digest is checked, as rates in micro-dollars."""
    return prices.load(spark, json.dumps(_snapshot(spark, sf_dir))).select("pricing_version_id", "model_pattern", "input_rate", "cached_rate", "output_rate", "reasoning_rate")


@query(f"WITH {t.ITEMS} SELECT id, title FROM items WHERE lower(title) LIKE '%#000000123%'")
def item_by_title(spark, sf_dir):
    """The one item whose title holds some text; several or none would be an error."""
    return projects.find_item(t.items(spark, sf_dir), "STOMER#000000123").select("id", "title")


# Reports over the totals of the ledger.



def _real_nodes(spark, sf_dir):
    with_paths = tree.paths(t.items(spark, sf_dir))
    totals = tree.inclusive(_direct(spark, sf_dir, "Independent"), with_paths, tree.TOTALS)
    return with_paths.join(totals, "id").withColumn("created_at", F.lit(None).cast("string"))


_REAL = ORACLES["tree_inclusive"].rpartition(" SELECT up.ancestor")
_REAL_SQL = f"{_REAL[0]}, inc AS (SELECT up.ancestor{_REAL[2]})"


@query(
    f"""{_REAL_SQL} SELECT i.id, '"p","k","P","' || i.id || '","' || title || '","' || coalesce(parent_id, '') || '",' || {" || ',' || ".join(f'CAST({c} AS VARCHAR)' for c in TOKENS)} || ',' || CAST({' + '.join(TOKENS)} AS VARCHAR) || ',' || requests || ',' || measured || ',' || unavailable || ','
|| CASE WHEN requests > 0 AND priced = requests THEN CAST((amount_micros + 50) // 100 // 10000 AS VARCHAR) || '.' || lpad(CAST((amount_micros + 50) // 100 % 10000 AS VARCHAR), 4, '0') ELSE 'unavailable' END || ',' || CASE WHEN measured + unavailable + anomalous > 0 THEN printf('%.1f', 100.0::DOUBLE * measured / (measured + unavailable + anomalous)) ELSE 'unavailable' END AS line FROM inc JOIN items i ON inc.id = i.id"""
)
def report_of_totals(spark, sf_dir):
    """Lines of the CSV report over the ledger's own totals."""
    lines = reports.csv_lines(_real_nodes(spark, sf_dir), {"id": "p", "key": "k", "title": "P"})
    return lines.select(F.regexp_replace(F.element_at(F.split("line", ","), 4), '"', "").alias("id"), "line")


@query(f"{_REAL_SQL} SELECT {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in tree.TOTALS)} FROM inc JOIN items i ON inc.id = i.id WHERE parent_id IS NULL")
def report_grand_total(spark, sf_dir):
    """The totals of all trees."""
    return reports.grand_total(_real_nodes(spark, sf_dir))
