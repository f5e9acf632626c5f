"""Queries over streams and stored tables, each with its DuckDB twin.

Each writes what the test tables hold to a folder of its own in several batches, lets the
stream or store take them in, and returns what it made of all of them: the twin works it out at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costgrain.functions import text
from costgrain.functions.identity import with_identity
from costgrain.functions.vocabulary import TOKENS, source_kind
from costgrain.operators import merging
from costgrain.operators.stages import shared_folder
from costgrain.operators.tree import paths
from costgrain.plans import reports
from costgrain.plans import tables as t
from costgrain.plans.queries import ORACLES, query
from costgrain.plans.source_queries import _PROTOTYPES, _STREAM, _full, _prototypes, _stream_lines
from costgrain.sources.observation import COLUMNS, SCHEMA
from costgrain.streaming import context, hooks, tail, turns
from costgrain.streaming.identities import Identities
from costgrain.streaming.imports import Imports
from costgrain.streaming.repairs import Repairs
from costgrain.streaming.rescans import Rescans

_TOK = ", ".join(TOKENS)
#: State partitions that the streams here have at least, and folders that files of users are dealt to.
PARTITIONS, FOLDERS = 4, 1_024


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _stateful(spark: SparkSession) -> SparkSession:
    """A session for streams with as many state partitions as there are cores."""
    return hooks.stateful_session(spark, max(PARTITIONS, spark.sparkContext.defaultParallelism))


def _ran(spark: SparkSession, changes: DataFrame, folder: str) -> DataFrame:
    """A stream run to its end into a table, and that table as ``spark`` reads it."""
    write = changes.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    write.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(changes.schema).parquet(f"{folder}/out")


def _text_files(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: rows (folder, file, value), those of a file one after the other, written to a file each.

    Spark's own writer tells the driver of each folder and has it move each to its place, so its memory grows with the
    number of files; here a task moves its own. A file that is written again is replaced."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, below = fs.FileSystem.from_uri(root)
        files, folder, name, out = 0, None, None, None
        part = f"{uuid.uuid4().hex}.part"

        def close() -> None:
            if out:
                out.close()
                system.move(f"{below}/{folder}/{part}", f"{below}/{folder}/{name}.txt")

        for batch in batches:
            for where, file, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (where, file) != (folder, name):
                    close()
                    if where != folder:
                        system.create_dir(f"{below}/{where}", recursive=True)
                    folder, name, files = where, file, files + 1
                    out = system.open_output_stream(f"{below}/{where}/{part}")
                out.write(value.encode() + b"\n")
        close()
        yield pa.RecordBatch.from_pydict({"files": [files]})

    return write


# Streams.


@query(ORACLES["hook_session_state"])
def hook_stream(spark, sf_dir):
    """The hook spool as a stream of three batches that overlap in time: turns are those of one batch."""
    folder, e = _folder(spark), t.read(spark, sf_dir, "events").where("event_type in ('view', 'purchase')")
    at = F.date_format(F.timestamp_seconds(F.col("event_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    payload = F.struct(F.col("user_id").cast("string").alias("session_id"), F.concat(F.lit("p\t"), F.col("event_id").cast("string")).alias("prompt_id"))
    line = F.to_json(F.struct(F.lit(1).alias("version"), F.when(F.col("event_type") == "view", "UserPromptSubmit").otherwise("Stop").alias("kind"), at.alias("capturedAt"), payload.alias("payload")))
    for k in range(3):
        e.where(F.col("event_id") % 3 == k).select(line.alias("value")).write.text(f"{folder}/in/{k}")
        own = _stateful(spark)
        lines = own.readStream.format("text").option("recursiveFileLookup", True).load(f"{folder}/in").select(F.col("value").alias("line"))
        changes = _ran(spark, hooks.turns(hooks.envelopes(lines)[0], horizon=10**9), folder)
    number = lambda c: F.unix_timestamp(F.to_timestamp(c))
    return hooks.current_turns(changes).select(F.col("session_id").cast("long").alias("user_id"), number("started_at").alias("turn"), number("ended_at").alias("ended_by"))


_COUNTER = "source_kind = 'turn_counter'"


@query(
    f"""WITH {t.OBS}, d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, turn_id, identity ORDER BY rank DESC, measured DESC, source_offset) AS nth FROM named WHERE turn_id IS NOT NULL AND NOT ({_COUNTER})) WHERE nth = 1),
c AS (SELECT * FROM named WHERE turn_id IS NOT NULL AND {_COUNTER}), f AS (SELECT *, row_number() OVER (PARTITION BY session, turn_id, identity ORDER BY rank DESC, measured DESC, source_offset) AS nth FROM c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.session = c.session AND d.turn_id = c.turn_id)),
s AS (SELECT session, turn_id, {', '.join(f'CAST(sum(coalesce({x}, 0)) AS BIGINT) AS {x}' for x in TOKENS)} FROM d GROUP BY session, turn_id),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, turn_id ORDER BY source_offset) AS nth FROM c) WHERE nth = 1)
SELECT 'kept' AS what, source_offset FROM d UNION ALL SELECT 'kept', source_offset FROM named WHERE turn_id IS NULL UNION ALL SELECT 'kept', source_offset FROM f WHERE nth = 1
UNION ALL SELECT 'conflict', first.source_offset FROM first JOIN s USING (session, turn_id) WHERE {' OR '.join(f'coalesce(first.{x}, 0) <> s.{x}' for x in TOKENS if x != 'cache_write_tokens')}"""
)
def covered_stream(spark, sf_dir):
    """Turns with details and counters as a stream of three batches."""
    folder, rows = _folder(spark), _full(t.observations(spark, sf_dir)).select(*COLUMNS)
    for k in range(3):
        rows.where(F.col("source_offset") % 3 == k).write.parquet(f"{folder}/in/{k}")
        own = _stateful(spark)
        stream = own.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        changes = _ran(spark, turns.follow_turns(stream, source_kind(F.col("source"), F.col("source_subtype")) == "turn_counter"), folder)
    return turns.net(changes).select("what", "source_offset")


@query("SELECT event_id AS n, event_type AS kind, 1 AS times FROM events UNION ALL SELECT event_id, event_type, 1 FROM events WHERE event_id % 2 = 1")
def tail_stream(spark, sf_dir):
    """Growing files followed to the byte in three runs; the last has a new parser and reads all there is anew."""
    folder = _folder(spark)
    e = t.read(spark, sf_dir, "events").select(F.col("event_id").alias("n"), F.col("event_type").alias("kind"))
    line = F.to_json(F.struct("n", "kind"))
    for k, version in ((0, "1"), (1, "1")):
        e.where(F.col("n") % 2 == k).select(line.alias("value")).coalesce(2).write.text(f"{folder}/in/{k}")
        out = _ran(spark, tail.follow(spark, f"{folder}/in", "*.txt", version, f"{folder}/a/read", blockBytes=1 << 16), f"{folder}/a")
    again = _ran(spark, tail.follow(spark, f"{folder}/in/1", "*.txt", "2", f"{folder}/b/read"), f"{folder}/b")
    parsed = out.unionByName(again).select(F.from_json("line", "struct<n: bigint, kind: string>").alias("r")).select("r.*")
    return parsed.select("n", "kind", F.lit(1).alias("times"))


@query(
    f"""WITH {_STREAM} SELECT 's' || CAST(u AS VARCHAR) AS session, CASE event_type WHEN 'click' THEN 'r' ELSE 'q' END || CAST(n AS VARCHAR) AS request_id, CASE event_type WHEN 'click' THEN turn ELSE 'x' || CAST(n AS VARCHAR) END AS turn_id, agent AS agent_id,
cents AS input_tokens, CASE event_type WHEN 'click' THEN n % 9 END AS cached_input_tokens, k AS output_tokens, CASE event_type WHEN 'purchase' THEN n % 5 END AS reasoning_tokens FROM d WHERE event_type IN ('click', 'purchase')"""
)
def followed_streams(spark, sf_dir):
    """Event streams, a file a user, followed to the byte with their context."""
    folder, own = _folder(spark), _stateful(spark)
    name = F.coalesce("source_path", F.lit("none"))
    lines = _stream_lines(spark, sf_dir).where("line is not null").select((F.crc32(name.cast("binary")) % FOLDERS).cast("string").alias("folder"), name.alias("file"), "source_offset", F.col("line").alias("value"))
    dealt = lines.repartition("folder").sortWithinPartitions("folder", "file", "source_offset").drop("source_offset")
    dealt.mapInArrow(_text_files(f"{folder}/in"), "files long").agg(F.sum("files")).collect()
    read = _ran(spark, context.follow_streams(tail.follow(own, f"{folder}/in", "*.txt", state=f"{folder}/read")), folder)
    return read.select("session", "request_id", "turn_id", "agent_id", "input_tokens", "cached_input_tokens", "output_tokens", "reasoning_tokens")


# Stored tables.

_EPOCHS = ORACLES["epoch_delta"]


@query(
    f"""WITH e AS ({_EPOCHS}), o AS (SELECT event_id AS source_offset, 's' || CAST(user_id AS VARCHAR) || ':t' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS VARCHAR) AS row_key FROM events),
x AS (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY source_offset) AS nth, {' + '.join(f'coalesce(delta_{c}, 0)' for c in TOKENS)} > 0 AS grew, delta_cost_micros IS NOT NULL AS dearer FROM e JOIN o USING (source_offset)),
y AS (SELECT *, CAST(sum(CASE WHEN grew AND nth > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY row_key, token_epoch ORDER BY source_offset) AS BIGINT) AS ts, CAST(sum(CASE WHEN dearer AND nth > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY row_key, cost_epoch ORDER BY source_offset) AS BIGINT) AS cs FROM x)
SELECT row_key, source_offset, CASE WHEN nth > 1 THEN row_key || ':delta:te' || token_epoch || 'ts' || ts || ':ce' || cost_epoch || 'cs' || cs END AS source_event_id, coalesce(delta_input_tokens, 0) AS input_tokens, coalesce(delta_output_tokens, 0) AS output_tokens, delta_cost_micros AS cost_micros FROM y WHERE nth = 1 OR grew OR dearer"""
)
def rescan_checkpoints(spark, sf_dir):
    """Three scans in three runs against stored checkpoints, of which the second comes twice."""
    rows = t.observations(spark, sf_dir).withColumn("row_key", F.concat_ws(":", "session", "turn_id"))
    most = rows.agg(F.max("source_offset")).first()[0] or 0
    folder = _folder(spark)
    for k in (0, 1, 1, 2):
        Rescans(spark, folder, "source_offset long", ["source_offset"], 1).scan(rows.where(F.floor(F.col("source_offset") * 3 / (most + 1)) == k), k)
    out = Rescans(spark, folder, "source_offset long", ["source_offset"], 1).deltas()
    return out.select("row_key", "source_offset", "source_event_id", F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"), F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"), "cost_micros")


_STORED = "id string, session string, observed_at string, source_offset long, source_kind string, " + ", ".join(f"{c} long" for c in TOKENS)


def _repairs(spark, sf_dir) -> Repairs:
    repairs = Repairs(spark, _folder(spark), _STORED, 1)
    repairs.load(t.ledger(spark, sf_dir).select("id", "session", "observed_at", "source_offset", "source_kind", *TOKENS))
    return repairs


def _snapshots() -> Column:
    return F.col("source_kind") == "snapshot_delta"


_REPAIRED = f"""WITH {t.LEDGER}, v AS (SELECT *, row_number() OVER w AS nth, {', '.join(f'lag({c}) OVER w AS was_{c}' for c in TOKENS)} FROM ledger WHERE source_kind = 'snapshot_delta' WINDOW w AS (PARTITION BY session ORDER BY observed_at, source_offset)),
m AS (SELECT *, nth > 1 AND NOT ({' OR '.join(f'coalesce({c} < was_{c}, false)' for c in TOKENS)}) AS step FROM v)"""


@query(f"{_REPAIRED} SELECT source_offset, {', '.join(f'CASE WHEN step THEN {c} - was_{c} ELSE 0 END AS {c}' for c in TOKENS)} FROM m UNION ALL SELECT source_offset, {_TOK} FROM ledger WHERE source_kind <> 'snapshot_delta'")
def repair_applied(spark, sf_dir):
    """Stored snapshots rewritten by a repair that is applied twice."""
    repairs = _repairs(spark, sf_dir)
    repairs.apply(_snapshots())
    repairs.apply(_snapshots())
    return repairs.events().select("source_offset", *TOKENS)


@query(f"{_REPAIRED} SELECT 'snapshot_overcount' AS kind, count(*) AS rows, count(*) FILTER (WHERE nth = 1) AS baseline_rows, count(*) FILTER (WHERE step) AS delta_rows, count(*) FILTER (WHERE nth > 1 AND NOT step) AS backward_rows, count(DISTINCT session) AS sessions, count(*) FILTER (WHERE nth > 1 AND NOT step) AS anomalies FROM m")
def repair_log(spark, sf_dir):
    """What the maintenance log says of a repair that was taken back and applied again."""
    repairs = _repairs(spark, sf_dir)
    repairs.apply(_snapshots())
    repairs.restore()
    repairs.apply(_snapshots())
    odd = repairs.anomalies().agg(F.count("*").alias("anomalies"))
    return repairs.log().select("kind", "rows", "baseline_rows", "delta_rows", "backward_rows", "sessions").crossJoin(odd)  # one row each


@query(f"WITH {t.LEDGER} SELECT source_offset, {_TOK} FROM ledger")
def repair_restored(spark, sf_dir):
    """A repair taken back: the rows are what they were."""
    repairs = _repairs(spark, sf_dir)
    repairs.apply(_snapshots())
    repairs.restore()
    return repairs.events().select("source_offset", *TOKENS)


#: Merges of customers along doubled keys and of nations along threes: sources, targets, the order they come in.
_MERGES = """merges AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS source, 'c' || CAST(2 * c_custkey AS VARCHAR) AS target, c_custkey AS sequence FROM customer WHERE c_custkey % 5 > 0
UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'n' || CAST(n_nationkey + 1 AS VARCHAR), n_nationkey FROM nation WHERE n_nationkey % 3 < 2),
sound AS (SELECT * FROM merges WHERE source IN (SELECT id FROM items) AND target IN (SELECT id FROM items)),
chain AS (SELECT source, target FROM sound UNION ALL SELECT c.source, s.target FROM chain c JOIN sound s ON c.target = s.source),
ends AS (SELECT source, target FROM chain WHERE target NOT IN (SELECT source FROM sound))"""


def _merged(spark, sf_dir) -> dict[str, DataFrame]:
    key = F.col("c_custkey")
    named = lambda a, c: F.concat(F.lit(a), c.cast("string"))
    customers = t.read(spark, sf_dir, "customer").where(key % 5 > 0).select(named("c", key).alias("source"), named("c", 2 * key).alias("target"), key.cast("long").alias("sequence"))
    n = F.col("n_nationkey")
    nations = t.read(spark, sf_dir, "nation").where(n % 3 < 2).select(named("n", n).alias("source"), named("n", n + 1).alias("target"), n.cast("long").alias("sequence"))
    items = t.items(spark, sf_dir).select("id", "parent_id", "project_id", F.lit("open").alias("status"))
    notes = t.read(spark, sf_dir, "orders").select(named("c", F.col("o_custkey")).alias("work_item_id"), F.col("o_orderkey").alias("note"))
    return merging.merge_all(customers.unionByName(nations), items, notes, t.attributions(spark, sf_dir))


@query(f"WITH RECURSIVE {t.ITEMS}, {_MERGES} SELECT i.id, coalesce(e.target, i.parent_id) AS parent_id, CASE WHEN i.id IN (SELECT source FROM sound) THEN 'merged' ELSE 'open' END AS status FROM items i LEFT JOIN ends e ON i.parent_id = e.source")
def merge_chain_items(spark, sf_dir):
    """Items after chains of merges: children follow, sources are merged."""
    return _merged(spark, sf_dir)["items"].select("id", "parent_id", "status")


@query(f"WITH RECURSIVE {t.ITEMS}, {_MERGES} SELECT o_orderkey AS note, coalesce(e.target, 'c' || CAST(o_custkey AS VARCHAR)) AS work_item_id FROM orders LEFT JOIN ends e ON 'c' || CAST(o_custkey AS VARCHAR) = e.source")
def merge_chain_notes(spark, sf_dir):
    return _merged(spark, sf_dir)["notes"].select("note", "work_item_id")


@query(f"WITH RECURSIVE {t.LEDGER}, {t.SPANS}, {t.ITEMS}, {_MERGES}, m AS (SELECT a.* REPLACE (coalesce(e.target, a.work_item_id) AS work_item_id) FROM attributions a LEFT JOIN ends e ON a.work_item_id = e.source) SELECT group_id, work_item_id, CAST(sum(weight) AS BIGINT) AS weight, arg_min(role, ordinal) AS role FROM m GROUP BY group_id, work_item_id")
def merge_chain_weights(spark, sf_dir):
    """Attributions after chains of merges: weights that meet add up."""
    return _merged(spark, sf_dir)["attributions"].select("group_id", "work_item_id", "weight", "role")


@query(f"WITH RECURSIVE {t.ITEMS}, {_MERGES} SELECT source, 'unknown target' AS reason FROM merges WHERE target NOT IN (SELECT id FROM items)")
def merge_refused(spark, sf_dir):
    return _merged(spark, sf_dir)["refused"].select("source", "reason")


@query(f"WITH {_PROTOTYPES} SELECT source_path || ':' || CAST(n AS VARCHAR) AS source_event_id, project, task, coalesce(told, 'prototype-' || CAST(n AS VARCHAR)) AS session, input_tokens, 10000 AS weight, CASE WHEN input_tokens IS NULL THEN 'unavailable' ELSE 'measured' END AS status FROM p")
def prototype_import(spark, sf_dir):
    """Prototype ledgers imported in two parts, the first one twice: events with the project and item they go to."""
    rows, imports = _prototypes(spark, sf_dir), Imports(spark, _folder(spark), 1)
    for part in (0, 0, 1):
        imports.apply(rows.where(F.pmod(F.crc32(F.col("source_path").cast("binary")), F.lit(2)) == part))
    spans, groups, shares = (imports.table(n) for n in ("spans", "groups", "attributions"))
    item = imports.table("items").select(F.col("id").alias("work_item_id"), F.col("title").alias("task"), F.col("project_id"))
    project = imports.table("projects").select(F.col("id").alias("project_id"), F.col("title").alias("project"))
    events = imports.table("events").select("id", "source_event_id", "session", "input_tokens")
    met = events.join(spans.select(F.col("usage_event_id").alias("id"), "span_id", F.col("measurement_status").alias("status")), "id").join(groups.select("span_id", "group_id"), "span_id").join(shares.select("group_id", "work_item_id", "weight"), "group_id")
    return met.join(item, "work_item_id").join(project, "project_id").select("source_event_id", "project", "task", "session", "input_tokens", "weight", "status")


@query(f"WITH {t.OBS} SELECT identity, 'added' AS change FROM (SELECT identity FROM named WHERE source_offset % 10 <> 1 EXCEPT SELECT identity FROM named WHERE source_offset % 10 <> 0) UNION ALL SELECT identity, 'removed' FROM (SELECT identity FROM named WHERE source_offset % 10 <> 0 EXCEPT SELECT identity FROM named WHERE source_offset % 10 <> 1)")
def identity_difference(spark, sf_dir):
    """Identities that came and went between two kept snapshots."""
    named, kept = with_identity(t.observations(spark, sf_dir)), Identities(spark, _folder(spark), 1)
    kept.keep("before", named.where("source_offset % 10 <> 0"))
    kept.keep("after", named.where("source_offset % 10 <> 1"))
    return kept.difference("before", "after")


# Reports and texts.

_BELOW = f"""{t.ITEMS}, down AS (SELECT id, parent_id, title, 0 AS depth, [(title, id)] AS place FROM items WHERE parent_id IS NULL UNION ALL SELECT x.id, x.parent_id, x.title, depth + 1, list_append(down.place, (x.title, x.id)) FROM items x JOIN down ON x.parent_id = down.id),
seen AS (SELECT *, row_number() OVER (ORDER BY place) AS nth, lead(depth) OVER (ORDER BY place) AS next FROM down)"""


@query(
    f"""WITH RECURSIVE {_BELOW} SELECT id, CASE WHEN nth = 1 THEN '[' ELSE '' END || '{{"id":"' || id || '","parent_id":' || coalesce('"' || parent_id || '"', 'null') || ',"title":"' || title || '","inclusive":{{{','.join(f'"{c}":{k}' for k, c in enumerate([*TOKENS, 'requests', 'measured', 'unavailable', 'anomalous', 'priced', 'amount_micros']))}}},"children":['
|| CASE WHEN next IS NULL THEN repeat(']}}', depth + 1) || ']' WHEN next <= depth THEN repeat(']}}', depth - next + 1) || ',' ELSE '' END AS line FROM seen"""
)
def nested_export(spark, sf_dir):
    """The pieces of a nested JSON document, each made from its own node's path."""
    numbers = {c: F.lit(k).cast("long") for k, c in enumerate([*TOKENS, "requests", "measured", "unavailable", "anomalous", "priced", "amount_micros"])}
    nodes = paths(t.items(spark, sf_dir)).withColumns({"created_at": F.lit(None).cast("string")} | numbers)
    return reports.nested_lines(nodes).select("id", "line")


@query(
    """WITH p AS (SELECT p_partkey, 'hook failed for ' || p_name || ', 日本 und «' || p_name || '» é' || CASE WHEN p_partkey % 3 = 0 THEN repeat(' éé1', 100) ELSE '' END AS message, p_name || ' 日本' AS raw FROM part),
w AS (SELECT p_partkey, array_to_string(list_transform(string_split(message, ' '), lambda x: CASE WHEN strlen(regexp_replace(regexp_replace(x, '^[^\\p{L}\\p{N}]+', ''), '[^\\p{L}\\p{N}]+$', '')) >= 4 AND list_contains(regexp_split_to_array(raw, '[^\\p{L}\\p{N}]+'), regexp_replace(regexp_replace(x, '^[^\\p{L}\\p{N}]+', ''), '[^\\p{L}\\p{N}]+$', '')) THEN '[redacted]' ELSE x END), ' ') AS s FROM p),
n AS (SELECT p_partkey, s, list_max(list_filter(generate_series(0, 300), lambda k: strlen(left(s, k)) <= 300)) AS k FROM w)
SELECT p_partkey, CASE WHEN strlen(s) > 300 THEN left(s, k) || '…[truncated]' ELSE s END AS scrubbed FROM n"""
)
def scrubbed_errors(spark, sf_dir):
    """Error messages without the words of the line, counted in bytes."""
    part = t.read(spark, sf_dir, "part")
    name = F.col("p_name")
    message = F.concat(F.lit("hook failed for "), name, F.lit(", 日本 und «"), name, F.lit("» é"), F.when(F.col("p_partkey") % 3 == 0, F.repeat(F.lit(" éé1"), F.lit(100))).otherwise(""))
    return part.select("p_partkey", text.scrub(message, F.concat(name, F.lit(" 日本"))).alias("scrubbed"))
