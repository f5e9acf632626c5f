"""Embedded databases of other tools, read where they lie: each file by one task.

Spark lists and distributes the files; inside a task a file is opened read-only
and its rows go on as JSON, which Spark parses. Files are small (FILE_BYTES at
most); they are spread, not their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costgrain.functions.money import float_dollars_to_micros, thousandths
from costgrain.functions.vocabulary import TOKENS
from costgrain.sources.files import binary_files
from costgrain.sources.observation import count, first, observation


# What the databases of each tool are called, and which others there are beside them.
NAMED = {"opencode": ["opencode.db"], "copilot": ["session-store.db", "data.db"]}
OTHERS = {"gemini": ["data.db", "session-store.db", "opencode.db", "ledger.db"]}
NOT_IN_NAME = {"gemini": "summaries"}


def wanted(tool: str, path: Column) -> Column:
    """Is the file at ``path`` a database of the tool? By its name: one of its own, or any but those of others."""
    name = F.substring_index(path, "/", -1)
    if tool in NAMED:
        return name.isin(NAMED[tool])
    return name.endswith(".db") & ~name.isin(OTHERS.get(tool, [])) & ~(F.contains(name, F.lit(NOT_IN_NAME[tool])) if tool in NOT_IN_NAME else F.lit(False))


def read_tables(spark: SparkSession, path: str, glob: str, tables: dict[str, str]) -> DataFrame:
    """(source_path, name, n, row) of queries on the databases below ``path``.

    ``tables`` maps names to SELECT statements; one whose table a file lacks
    gives nothing there. ``row`` is a JSON object; blobs are in hex.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json
        import sqlite3

        for batch in batches:
            for where, content in zip(batch["source_path"], batch["content"], strict=True):
                out = []
                db = sqlite3.connect(":memory:")
                try:
                    db.deserialize(bytes(content))
                    for name, select in tables.items():
                        try:
                            cursor = db.execute(select)
                        except sqlite3.OperationalError:
                            continue
                        names = [c[0] for c in cursor.description]
                        for n, row in enumerate(cursor):
                            shown = {k: v.hex() if isinstance(v, bytes) else v for k, v in zip(names, row, strict=True)}
                            out.append((where, name, n, json.dumps(shown)))
                except sqlite3.DatabaseError as error:
                    out.append((where, "error", 0, json.dumps({"error": str(error)})))
                finally:
                    db.close()
                yield pd.DataFrame(out, columns=["source_path", "name", "n", "row"])

    return binary_files(spark, path, glob).mapInPandas(scan, "source_path string, name string, n long, row string")


def _fallback(first_rows: DataFrame, other: DataFrame) -> DataFrame:
    """``first_rows``, and ``other`` of the files that have none of them."""
    return first_rows.unionByName(other.join(first_rows.select("source_path").distinct(), "source_path", "left_anti"))


def read_usage_events(spark: SparkSession, path: str, glob: str = "*.db", adapter: str = "copilot") -> DataFrame:
    """Observations of databases with usage events, else of their session sums. Cost is in thousandths of a micro-dollar; 0 is unknown."""
    raw = read_tables(spark, path, glob, {"events": "SELECT * FROM assistant_usage_events ORDER BY rowid", "sessions": "SELECT * FROM sessions"})
    fields = "id: string, session_id: string, turn_index: bigint, agent_id: string, parent_tool_call_id: string, model: string, input_tokens: bigint, output_tokens: bigint, cache_read_tokens: bigint, cache_write_tokens: bigint, reasoning_tokens: bigint, total_nano_aiu: bigint, created_at: string"
    sums = "id: string, model: string, total_input_tokens: bigint, total_output_tokens: bigint, total_cached_tokens: bigint, total_reasoning_tokens: bigint, total_nano_aiu: bigint, created_at: string"
    r = F.col("r")
    zero = lambda c: F.when(c < 0, F.lit(0).cast("long")).otherwise(c)
    cost = F.when(r["total_nano_aiu"] > 0, thousandths(r["total_nano_aiu"]))
    common = {"adapter": F.lit(adapter), "source_path": F.col("source_path"), "source_offset": F.lit(0), "cost_micros": cost, "parser_version": F.lit("1"), "source_timestamp": r["created_at"], "observed_at": r["created_at"], "model": F.coalesce(r["model"], F.lit(f"{adapter}-default"))}
    events = raw.where("name = 'events'").withColumn("r", F.from_json("row", f"struct<{fields}>"))
    detail = observation(
        events, source_event_id=F.concat_ws(":", F.lit(adapter), r["session_id"], r["id"]), session=r["session_id"], request_id=r["id"], turn_id=F.concat(F.lit("turn_"), r["turn_index"].cast("string")), agent_id=r["agent_id"], parent_agent_id=r["parent_tool_call_id"],
        input_tokens=zero(r["input_tokens"]), cached_input_tokens=zero(r["cache_read_tokens"]), cache_write_tokens=zero(r["cache_write_tokens"]), output_tokens=zero(r["output_tokens"]), reasoning_tokens=zero(r["reasoning_tokens"]), **common,
    )
    sessions = raw.where("name = 'sessions'").withColumn("r", F.from_json("row", f"struct<{sums}>"))
    rollup = observation(
        sessions, source_event_id=F.concat_ws(":", F.lit(adapter), r["id"], F.lit("session")), session=r["id"], request_id=F.concat_ws(":", F.lit(adapter), r["id"], F.lit("session")),
        input_tokens=zero(r["total_input_tokens"]), cached_input_tokens=zero(r["total_cached_tokens"]), output_tokens=zero(r["total_output_tokens"]), reasoning_tokens=zero(r["total_reasoning_tokens"]), **common,
    )
    return _kinds(_fallback(detail, rollup), f"{adapter}_usage_event", f"{adapter}_unmeasured")


def _kinds(rows: DataFrame, measured: str, unmeasured: str) -> DataFrame:
    known = F.coalesce(*TOKENS).isNotNull()
    return rows.withColumns({"source": F.when(known, "provider_fields").otherwise("unavailable"), "source_subtype": F.when(known, measured).otherwise(unmeasured)})


def read_messages(spark: SparkSession, path: str, glob: str = "*.db", adapter: str = "opencode") -> DataFrame:
    """Observations of databases with messages in JSON, else of their session sums. Cost is a number of dollars."""
    raw = read_tables(spark, path, glob, {"messages": "SELECT id, session_id, time_created, data FROM message ORDER BY time_created", "sessions": "SELECT * FROM session"})
    message = "id: string, session_id: string, time_created: bigint, data: string"
    data = "modelID: string, model: struct<modelID: string, id: string>, agent: string, cost: double, role: string, tokens: struct<input: bigint, output: bigint, reasoning: bigint, cache: struct<read: bigint, write: bigint>>"
    m = raw.where("name = 'messages'").withColumn("m", F.from_json("row", f"struct<{message}>")).withColumn("r", F.from_json("m.data", f"struct<{data}>"))
    r, k = F.col("r"), F.col("m")
    used = m.where(r.isNotNull() & (r["tokens"].isNotNull() | (r["role"] == "assistant")))
    when = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    t = r["tokens"]
    detail = observation(
        used, adapter=F.lit(adapter), source_event_id=F.concat_ws(":", F.lit(adapter), k["session_id"], k["id"]), session=k["session_id"], request_id=k["id"], turn_id=k["id"], agent_id=r["agent"], source_timestamp=when(k["time_created"]), observed_at=when(k["time_created"]),
        model=first(r["modelID"], r["model"]["modelID"], r["model"]["id"]), input_tokens=count(t["input"]), cached_input_tokens=count(t["cache"]["read"]), cache_write_tokens=count(t["cache"]["write"]), output_tokens=count(t["output"]), reasoning_tokens=count(t["reasoning"]),
        cost_micros=float_dollars_to_micros(r["cost"]), source_path=F.col("source_path"), source_offset=F.lit(0), parser_version=F.lit("1"),
    )
    sums = "id: string, model: string, cost: double, tokens_input: bigint, tokens_output: bigint, tokens_reasoning: bigint, tokens_cache_read: bigint, tokens_cache_write: bigint, agent: string, time_created: bigint"
    s = raw.where("name = 'sessions'").withColumn("r", F.from_json("row", f"struct<{sums}>"))
    zero = lambda c: F.when(c < 0, F.lit(0).cast("long")).otherwise(c)
    name = F.concat_ws(":", F.lit(adapter), r["id"], F.lit("session"))
    rollup = observation(
        s, adapter=F.lit(adapter), source_event_id=name, session=r["id"], request_id=name, agent_id=r["agent"], source_timestamp=when(r["time_created"]), observed_at=when(r["time_created"]), model=r["model"], input_tokens=zero(r["tokens_input"]), cached_input_tokens=zero(r["tokens_cache_read"]),
        cache_write_tokens=zero(r["tokens_cache_write"]), output_tokens=zero(r["tokens_output"]), reasoning_tokens=zero(r["tokens_reasoning"]), cost_micros=float_dollars_to_micros(r["cost"]), source_path=F.col("source_path"), source_offset=F.lit(0), parser_version=F.lit("1"),
    )
    a = _kinds(detail, f"{adapter}_message_usage", f"{adapter}_unmeasured")
    return _fallback(a, _kinds(rollup, f"{adapter}_session_usage", f"{adapter}_unmeasured"))


def read_model_usage(spark: SparkSession, path: str, glob: str = "*state.db", adapter: str = "hermes") -> DataFrame:
    """Observations of databases with cumulative rows for each session, model, provider and task.

    ``snapshot key`` columns (session, model, source_event_id) name the row that
    ``deltas.epoch_deltas`` follows from scan to scan."""
    raw = read_tables(spark, path, glob, {"usage": "SELECT u.*, s.parent_session_id FROM session_model_usage u LEFT JOIN sessions s ON s.id = u.session_id"})
    fields = "session_id: string, model: string, billing_provider: string, task: string, api_call_count: bigint, input_tokens: bigint, output_tokens: bigint, cache_read_tokens: bigint, cache_write_tokens: bigint, reasoning_tokens: bigint, estimated_cost_usd: double, actual_cost_usd: double, last_seen: double, parent_session_id: string"
    r = F.col("r")
    rows = raw.where("name = 'usage'").withColumn("r", F.from_json("row", f"struct<{fields}>"))
    key = F.concat_ws(":", F.lit(adapter), r["session_id"], F.coalesce(r["model"], F.lit("")), F.coalesce(r["billing_provider"], F.lit("")), F.coalesce(r["task"], F.lit("")))
    when = F.date_format(F.timestamp_micros((r["last_seen"] * 1_000_000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    out = observation(
        rows, adapter=F.lit(adapter), source_event_id=key, session=r["session_id"], request_id=key, agent_id=F.concat_ws(":", F.lit(adapter), r["session_id"]), parent_agent_id=F.concat(F.lit(f"{adapter}:"), r["parent_session_id"]), source_timestamp=when, observed_at=when, model=r["model"],
        input_tokens=count(r["input_tokens"]), cached_input_tokens=count(r["cache_read_tokens"]), cache_write_tokens=count(r["cache_write_tokens"]), output_tokens=count(r["output_tokens"]), reasoning_tokens=count(r["reasoning_tokens"]),
        cost_micros=float_dollars_to_micros(first(r["actual_cost_usd"], r["estimated_cost_usd"])), source_path=F.col("source_path"), source_offset=F.col("n"), parser_version=F.lit("1"),
    )
    return _kinds(out, f"{adapter}_session_model_usage", f"{adapter}_unmeasured")


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while at < len(raw):
        value |= (raw[at] & 127) << shift
        at += 1
        if raw[at - 1] < 128:
            return value, at
        shift += 7
        if shift > 63:
            break
    raise ValueError("cut short")


def message_fields(raw: bytes) -> dict[int, int | bytes]:
    """Fields of a binary message by number: numbers for varints, bytes for lengths; of repeated ones the last. What can't be read ends it."""
    out: dict[int, int | bytes] = {}
    at = 0
    try:
        while at < len(raw):
            tag, at = _varint(raw, at)
            kind = tag & 7
            if kind == 0:
                out[tag >> 3], at = _varint(raw, at)
            elif kind == 2:
                size, at = _varint(raw, at)
                if at + size > len(raw):
                    break
                out[tag >> 3] = raw[at : at + size]
                at += size
            elif kind in (1, 5):
                at += 8 if kind == 1 else 4
            else:
                break
    except ValueError:
        pass
    return out


def read_steps(spark: SparkSession, path: str, glob: str = "*.db", adapter: str = "gemini") -> DataFrame:
    """Observations of databases whose steps hold usage in binary messages.

    Field 1 of a step's metadata is its time, field 9 its usage; steps of type 15
    and 17 count. A step whose status isn't 3 has failed and has no tokens.
    """
    raw = read_tables(spark, path, glob, {"steps": "SELECT idx, step_type, status, metadata, (SELECT cascade_id FROM trajectory_meta LIMIT 1) AS session FROM steps WHERE step_type IN (15, 17) ORDER BY idx"})
    fields = "idx: bigint, step_type: bigint, status: bigint, metadata: string, session: string"

    @F.pandas_udf("seconds long, nanos long, input long, output long, cached long, reasoning long, agent string, request string")
    def decode(blobs: pd.Series) -> pd.DataFrame:
        def one(blob):
            m = message_fields(bytes.fromhex(blob or ""))
            time, usage = (message_fields(m[k]) if isinstance(m.get(k), bytes) else {} for k in (1, 9))
            number = lambda d, k: d[k] if isinstance(d.get(k), int) and d[k] < 1 << 63 else None
            text = lambda d, k: d[k].decode("utf-8", "replace") if isinstance(d.get(k), bytes) else None
            nanos = number(time, 2)
            return number(time, 1), min(nanos, 999_999_999) if nanos is not None else 0, number(usage, 2), number(usage, 3), number(usage, 5), number(usage, 9), text(usage, 7), text(usage, 11)

        names = ["seconds", "nanos", "input", "output", "cached", "reasoning", "agent", "request"]
        frame = pd.DataFrame([one(b) for b in blobs], columns=names)
        return frame.astype(dict.fromkeys(names[:6], "Int64"))

    rows = raw.where("name = 'steps'").withColumn("r", F.from_json("row", f"struct<{fields}>")).withColumn("d", decode("r.metadata"))
    r, d = F.col("r"), F.col("d")
    failed = F.coalesce(r["status"] != 3, F.lit(False))
    when = F.date_format(F.timestamp_micros(d["seconds"] * 1_000_000 + F.floor(d["nanos"] / 1000)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    turn = F.concat(F.lit("step_"), r["idx"].cast("string"))
    session = F.coalesce(r["session"], F.col("source_path"))
    kept = lambda c: F.when(~failed, c)
    out = observation(
        rows, adapter=F.lit(adapter), source_event_id=F.concat_ws(":", F.lit(adapter), session, turn), session=session, request_id=F.coalesce(d["request"], F.concat_ws(":", F.lit(adapter), session, turn)), turn_id=turn, agent_id=d["agent"], source_timestamp=when, observed_at=when,
        input_tokens=kept(d["input"]), cached_input_tokens=kept(d["cached"]), output_tokens=kept(d["output"]), reasoning_tokens=kept(d["reasoning"]), service_tier=F.when(failed, "failed"), source_path=F.col("source_path"), source_offset=r["idx"], parser_version=F.lit("1"),
    )
    return _kinds(out, f"{adapter}_turn_usage", f"{adapter}_turn_unmeasured").withColumns({"source_subtype": F.when(F.col("service_tier") == "failed", f"{adapter}_turn_failed").otherwise(F.when(F.coalesce(*TOKENS).isNotNull(), f"{adapter}_turn_usage").otherwise(f"{adapter}_turn_unmeasured")), "service_tier": F.lit(None).cast("string")})
