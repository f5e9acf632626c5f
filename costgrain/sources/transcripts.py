"""JSON-lines transcripts of two kinds of agents: request records, and streams with sticky context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costgrain.functions.vocabulary import TOKENS
from costgrain.operators import deltas, usage
from costgrain.operators.stages import cut
from costgrain.sources.files import lines, stem, too_large
from costgrain.sources.observation import COLUMNS, anomaly, count, first, observation

_COUNTS = (
    "input_tokens inputTokens prompt_tokens cache_read_input_tokens cached_input_tokens cachedInputTokens cache_creation_input_tokens cache_write_tokens cacheWriteTokens "
    "output_tokens outputTokens completion_tokens reasoning_tokens reasoningTokens"
).split()
_USAGE = (
    "struct<" + ", ".join(f"{c}: bigint" for c in _COUNTS) + ", service_tier: string, inference_geo: string, cache_creation: struct<ephemeral_1h_input_tokens: bigint, ephemeral_5m_input_tokens: bigint>, "
    "output_tokens_details: struct<thinking_tokens: bigint>, completion_tokens_details: struct<reasoning_tokens: bigint>, prompt_tokens_details: struct<cached_tokens: bigint>>"
)
_STRINGS = (
    "type event boundary method protocol_version session_id sessionId thread_id threadId turn_id turnId prompt_id promptId request_id requestId id event_id uuid agent_id agentId "
    "parent_agent_id parentAgentId model timestamp created_at service_tier region source_kind schema_version"
).split()
_RECORD = (
    "struct<" + ", ".join(f"{c}: string" for c in _STRINGS) + f", version: VERSION, unsupported_version: boolean, is_cumulative: boolean, cost_micros: bigint, usage: {_USAGE}, token_usage: {_USAGE}, cumulative_token_usage: {_USAGE}, "
    f"message: struct<id: string, model: string, usage: {_USAGE}>, params: struct<threadId: string, turnId: string, agentId: string, parentAgentId: string, requestId: string, model: string, tokenUsage: {_USAGE}, usage: {_USAGE}>>"
)

# Versions of the stream format that are read, and what opens and ends a turn.
STREAM_VERSIONS = ["v1", "v1.0", "1.0", "2024-11-05", "codex-app-server-v1", "codex-rollout-v1", "0.2.0-rust"]
TURN_STARTS = ["turn/started", "turn_start", "turn/start", "hook_boundary", "turn_boundary", "session/started", "session_meta"]
TURN_ENDS = ["turn/completed", "turn_complete", "turn/complete", "turn_end", "turn/end", "session/completed"]


#: Bytes of a stream's file that one task carries context through.
CHUNK_BYTES = 8 << 20


def _parsed(raw: DataFrame, version: str) -> DataFrame:
    """Lines with their record ``r``; null where a line is no JSON object, or too long to be parsed.

    The record comes out of ``explode``: filters on its fields stay above that, else each of them would parse the line anew.
    """
    blank = F.trim("line") == ""
    record = F.from_json("line", _RECORD.replace("VERSION", version))
    sound = ~F.col("oversize") & F.coalesce(F.get_json_object("line", "$").startswith("{"), F.lit(False))
    return raw.where(~blank).withColumn("r", F.explode(F.array(F.when(sound, record))))


def _tokens(u, reasoning_first: bool) -> dict:
    thinking = [u["output_tokens_details.thinking_tokens"]] if not reasoning_first else [F.coalesce(u["completion_tokens_details.reasoning_tokens"], u["output_tokens_details.thinking_tokens"])]
    return {
        "input_tokens": count(u["input_tokens"], u["inputTokens"], *([u["prompt_tokens"]] if reasoning_first else [])),
        "cached_input_tokens": count(u["cached_input_tokens"], u["cachedInputTokens"], u["cache_read_input_tokens"], u["prompt_tokens_details.cached_tokens"]) if reasoning_first else count(u["cache_read_input_tokens"], u["cached_input_tokens"], u["cachedInputTokens"]),
        "cache_write_tokens": count(u["cache_creation_input_tokens"], u["cache_write_tokens"], u["cacheWriteTokens"]),
        "output_tokens": count(u["output_tokens"], u["outputTokens"], *([u["completion_tokens"]] if reasoning_first else [])),
        "reasoning_tokens": count(u["reasoning_tokens"], u["reasoningTokens"], *thinking),
    }


def _measured(tokens: list[str] = TOKENS):
    return F.coalesce(*tokens).isNotNull()


class _Usage:
    """Field access by dotted path on a struct column."""

    def __init__(self, column):
        self.column = column

    def __getitem__(self, path):
        out = self.column
        for part in path.split("."):
            out = out[part]
        return out


def read_requests(spark: SparkSession, path: str, adapter: str = "claude", parser_version: str = "1") -> tuple[DataFrame, DataFrame]:
    """Observations and anomalies of the request transcripts below ``path``; files that are too large give an anomaly."""
    out, odd = requests_of(lines(spark, path), adapter, parser_version)
    return out, odd.unionByName(too_large(spark, path, "*.jsonl"))


def requests_of(raw: DataFrame, adapter: str = "claude", parser_version: str = "1") -> tuple[DataFrame, DataFrame]:
    """Observations and anomalies of lines (source_path, source_offset, line, oversize) of request transcripts.

    Records of an unsupported version, without usage, or without any count are
    left out. Usage snapshots are cumulative: they become differences per
    session; one that falls behind gives no record but an anomaly.
    """
    parsed = _parsed(raw, "bigint")
    r = F.col("r")
    schema = r["schema_version"]
    bad = F.coalesce(r["version"] > 2, F.lit(False)) | F.coalesce(schema.startswith("99") | (schema.startswith("9") & (F.length(schema) > 2)), F.lit(False)) | F.coalesce(r["unsupported_version"], F.lit(False))
    used = parsed.where(r.isNotNull() & ~bad).withColumn("u", first(r["usage"], r["message"]["usage"])).where("u is not null")
    u = _Usage(F.col("u"))
    nested = u["cache_creation"]
    creation = F.when(count(nested["ephemeral_1h_input_tokens"], nested["ephemeral_5m_input_tokens"]).isNotNull(), F.coalesce(count(nested["ephemeral_1h_input_tokens"]), F.lit(0)) + F.coalesce(count(nested["ephemeral_5m_input_tokens"]), F.lit(0)))
    tokens = _tokens(u, False)
    tokens["cache_write_tokens"] = F.coalesce(tokens["cache_write_tokens"], creation)
    kind = F.coalesce(r["type"], F.lit(""))
    source = F.when(kind == "usage_snapshot", "snapshot_delta").when(kind == "otel_api_request", "official_telemetry").when(kind == "provider_usage", "provider_fields").otherwise("transcript_request")
    rows = observation(
        used, adapter=F.lit(adapter), source=source, source_event_id=first(r["event_id"], r["uuid"]), session=first(r["session_id"], r["sessionId"], stem(F.col("source_path"))),
        request_id=first(r["request_id"], r["requestId"], r["message"]["id"]), turn_id=first(r["turn_id"], r["prompt_id"], r["promptId"]), agent_id=first(r["agent_id"], r["agentId"]), parent_agent_id=first(r["parent_agent_id"], r["parentAgentId"]),
        source_timestamp=r["timestamp"], observed_at=r["timestamp"], model=first(r["model"], r["message"]["model"]), service_tier=first(r["service_tier"], u["service_tier"]), region=first(r["region"], u["inference_geo"]),
        cost_micros=count(r["cost_micros"]), source_path=F.col("source_path"), source_offset=F.col("source_offset"), parser_version=F.lit(parser_version), **tokens,
    ).where(_measured())
    plain = rows.where("source <> 'snapshot_delta'")
    steps = deltas.snapshot_deltas(rows.where("source = 'snapshot_delta'"), ["source_path", "session"], ["source_offset"])
    out = plain.unionByName(steps.where("not negative").drop("negative").select(*COLUMNS))
    broken = parsed.where(r.isNull())
    odd = anomaly(steps.where("negative"), F.lit("negative_delta"), F.col("session"), F.col("turn_id"), F.lit("{}")).unionByName(
        anomaly(broken, F.lit("malformed_line"), F.lit(None), F.lit(None), F.to_json(F.struct(F.octet_length("line").alias("raw_length"))))
    ).unionByName(anomaly(parsed.where(r.isNotNull() & bad), F.lit("unsupported_version"), F.lit(None), F.lit(None), F.lit("{}")))
    return out, odd


def read_streams(spark: SparkSession, path: str, adapter: str = "codex", parser_version: str = "1") -> tuple[DataFrame, DataFrame]:
    """Observations and anomalies of the event streams below ``path``; files that are too large give an anomaly."""
    out, odd = streams_of(lines(spark, path), adapter, parser_version)
    return out, odd.unionByName(too_large(spark, path, "*.jsonl"))


def stream_records(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of event streams with what each tells of its session, turn and agents and whether it ends them, and the
    anomalies of lines that are none or of an unknown version. Lines may be a stream."""
    parsed = _parsed(raw, "string")
    r = F.col("r")
    version = first(r["version"], r["protocol_version"], r["schema_version"])
    known = version.isNull() | version.isin(STREAM_VERSIONS)
    kind = F.coalesce(r["type"], r["event"], r["boundary"], r["method"], F.lit(""))
    p = r["params"]
    starts, ends = kind.isin(TURN_STARTS), kind.isin(TURN_ENDS)
    good = parsed.where(r.isNotNull() & known).withColumns(
        {
            "kind": kind,
            "_session": first(r["session_id"], r["sessionId"], r["thread_id"], r["threadId"], p["threadId"]),
            "_turn": F.when(starts, first(r["turn_id"], r["turnId"], r["id"], p["turnId"])),
            "_agent": F.when(starts, first(r["agent_id"], r["agentId"], p["agentId"])),
            "_parent": F.when(starts, first(r["parent_agent_id"], r["parentAgentId"], p["parentAgentId"])),
            "_end": F.coalesce(ends, F.lit(False)),
            "_close": kind == "session/completed",
        }
    )
    none = F.lit(None)
    bad = anomaly(
        parsed.where(r.isNull() | ~known), F.when(r.isNull(), "malformed_line").otherwise("unsupported_version"), none, none,
        F.when(r.isNull(), "{}").otherwise(F.to_json(F.struct(version.alias("unsupported_version")))),
    )
    return good, bad


#: What a record tells of the context that is carried on.
CONTEXT = ["_session", "_turn", "_agent", "_parent", "_end", "_close"]


def stream_readings(carried: DataFrame, adapter: str, own: bool = False) -> DataFrame:
    """Observations of the records that hold counts, with the context that was carried to them; ``parser_version`` tells
    cumulative readings from plain ones. With ``own`` all records, each with its own context (CONTEXT) beside it."""
    r, p = F.col("r"), F.col("r.params")
    used = carried.withColumn("u", first(r["token_usage"], r["usage"], r["cumulative_token_usage"], p["tokenUsage"], p["usage"], r["message"]["usage"]))
    used = used if own else used.where("u is not null")
    counter = (F.col("kind").isin("turn_counter", "turn_summary")) | F.get_json_object("line", "$.turn_counter").isNotNull()
    live = F.col("kind").isin("thread/tokenUsage/updated", "turn/tokenUsage/updated", "token_usage")
    named = first(r["source_kind"], F.when(counter, "codex_turn_counter").when(live, "codex_app_server").otherwise("codex_rollout"))
    source = F.when(named == "codex_turn_counter", "snapshot_delta").when(named == "codex_app_server", "official_telemetry").otherwise("transcript_request")
    cumulative = F.coalesce(r["is_cumulative"], F.lit(False)) | r["cumulative_token_usage"].isNotNull() | (F.col("kind") == "cumulative_usage")
    marked = used.withColumn("_cumulative", cumulative)
    out = observation(
        marked, {c: F.col(c) for c in CONTEXT} if own else None, adapter=F.lit(adapter), source=source, source_subtype=named, source_event_id=first(r["event_id"], r["uuid"]), session=first(r["session_id"], r["sessionId"], r["thread_id"], r["threadId"], p["threadId"], F.col("_session"), stem(F.col("source_path"))),
        request_id=first(r["request_id"], r["requestId"], r["id"], p["requestId"]), turn_id=first(r["turn_id"], r["turnId"], p["turnId"], F.col("_turn")), agent_id=first(r["agent_id"], r["agentId"], p["agentId"], F.col("_agent")),
        parent_agent_id=first(r["parent_agent_id"], r["parentAgentId"], p["parentAgentId"], F.col("_parent")), source_timestamp=first(r["timestamp"], r["created_at"]), observed_at=first(r["timestamp"], r["created_at"]), model=first(r["model"], p["model"]),
        service_tier=r["service_tier"], region=r["region"], cost_micros=count(r["cost_micros"]), source_path=F.col("source_path"), source_offset=F.col("source_offset"), parser_version=F.when(F.col("_cumulative"), "cumulative").otherwise("plain"), **_tokens(_Usage(F.col("u")), True),
    )
    return out if own else out.where(_measured())


def streams_of(raw: DataFrame, adapter: str = "codex", parser_version: str = "1") -> tuple[DataFrame, DataFrame]:
    """Observations and anomalies of lines (source_path, source_offset, line, oversize) of event streams.

    Session, turn and agent carry over from earlier lines: a turn's end clears
    the turn, a session's end all. Cumulative readings count what they exceed
    earlier ones of their stream (session, turn, model, agent) by. A turn with
    detailed records does not count its counters; where the first of these
    differs from the sum of the details, an anomaly says so. Of several records
    of one request the one of highest authority stays.
    """
    good, bad = stream_records(raw)
    order = ["source_offset"]
    chunk = (F.col("source_offset") / CHUNK_BYTES).cast("long")  # a file is carried over in pieces
    # What lines tell and what they count are each needed in several places: they are worked out once.
    told = cut(stream_readings(good, adapter, own=True))
    carried = deltas.sticky(told, ["source_path"], order, ["_turn"], F.col("_end"), own=True, chunk=chunk)
    carried = deltas.sticky(carried, ["source_path"], order, ["_session", "_agent", "_parent"], F.col("_close"), own=True, chunk=chunk)
    named = {"session": "_session", "turn_id": "_turn", "agent_id": "_agent", "parent_agent_id": "_parent"}
    # A record's own session is the one it carries; the file's name stands in where there is none.
    rows = carried.withColumns({c: F.coalesce(x, c) if c == "session" else F.coalesce(c, x) for c, x in named.items()}).where(_measured())
    none = F.lit("")
    stream = rows.withColumns({"is_cumulative": F.col("parser_version") == "cumulative", "_t": F.coalesce("turn_id", none), "_m": F.coalesce("model", none), "_a": F.coalesce("agent_id", F.lit("root"))})
    counted = cut(deltas.counter_deltas(stream, ["source_path", "session", "_t", "_m", "_a"], order).select(*COLUMNS, "reset"))
    resets = counted.where("reset")
    events = counted.select(*COLUMNS).withColumn("parser_version", F.lit(parser_version))
    kept, conflicts = usage.settle_turns(events, F.col("source_subtype") == "codex_turn_counter")
    odd = (
        anomaly(resets, F.lit("negative_delta"), F.col("session"), F.col("turn_id"), F.lit("{}"))
        .unionByName(anomaly(conflicts, F.lit("counter_conflict"), F.col("session"), F.col("turn_id"), F.to_json(F.struct(*(f"d_{t}" for t in usage.COMPARED)))))
        .unionByName(bad)
    )
    return kept, odd
