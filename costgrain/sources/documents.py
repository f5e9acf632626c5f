"""Sources that are one JSON document a file: turn lists, one-shot runs, telemetry, prototypes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costgrain.functions.money import dollar_text_to_micros, thousandths
from costgrain.functions.vocabulary import TOKENS
from costgrain.sources.files import lines, stem, too_large, whole_files
from costgrain.sources.observation import anomaly, count, first, observation

_METRICS = "inputTokens: bigint, outputTokens: bigint, cachedReadTokens: bigint, cacheCreationTokens: bigint, reasoningTokens: bigint, totalTokens: bigint, modelCalls: bigint, costUsdTicks: bigint, primaryModelId: string"
_TURNS = f"struct<sessionId: string, updatedAt: string, version: bigint, session: struct<{_METRICS}>, turns: array<struct<turnNumber: bigint, endedAt: string, {_METRICS}>>>"


def _json(files: DataFrame, schema: str) -> DataFrame:
    sound = F.coalesce(F.get_json_object("content", "$").startswith("{"), F.lit(False))
    return files.withColumn("r", F.when(sound, F.from_json("content", schema))).withColumn("source_offset", F.lit(0))


def read_turn_files(spark: SparkSession, path: str, adapter: str = "grok", parser_version: str = "1", newest: int = 1) -> tuple[DataFrame, DataFrame]:
    """Observations and anomalies of the ``usage.json`` files below ``path``; files that are too large give an anomaly."""
    out, odd = turns_of(whole_files(spark, path, "usage.json"), adapter, parser_version, newest)
    return out, odd.unionByName(too_large(spark, path, "usage.json"))


def turns_of(contents: DataFrame, adapter: str = "grok", parser_version: str = "1", newest: int = 1) -> tuple[DataFrame, DataFrame]:
    """Observations and anomalies of files (source_path, content) with a list of turns.

    The session's own counters count only where there is no turn. A turn without
    a call, or without input and output counts, is unavailable and has no
    tokens. Cost comes in thousandths of a micro-dollar and is cut off.
    """
    files = _json(contents, _TURNS)
    r = F.col("r")
    known = r["sessionId"].isNotNull() & F.coalesce(r["version"] <= newest, F.lit(True))
    good = files.where(r.isNotNull() & known)
    models = F.filter(F.transform(r["turns"], lambda t: t["primaryModelId"]), lambda m: m.isNotNull())
    default = first(r["session"]["primaryModelId"], F.get(models, 0))
    turns = good.withColumn("_default", default).select("source_path", "source_offset", "r", "_default", F.explode("r.turns").alias("m")).withColumn("_turn", F.concat(F.lit("turn_"), F.col("m.turnNumber").cast("string")))
    alone = good.where(F.coalesce(F.size(r["turns"]), F.lit(0)) <= 0).where(r["session"].isNotNull())
    whole = alone.withColumn("_default", default).select("source_path", "source_offset", "r", "_default", F.struct(F.lit(None).cast("bigint").alias("turnNumber"), F.lit(None).cast("string").alias("endedAt"), "r.session.*").alias("m"), F.lit(None).cast("string").alias("_turn"))
    rows = turns.unionByName(whole)
    m = F.col("m")
    failed = F.coalesce(m["modelCalls"] == 0, F.lit(False))
    off = failed | (m["inputTokens"].isNull() & m["outputTokens"].isNull())
    scope = F.when(F.col("_turn").isNotNull(), "turn").otherwise("session")
    event = F.concat_ws(":", F.lit(adapter), r["sessionId"], F.coalesce("_turn", F.lit("session")))
    when = first(m["endedAt"], r["updatedAt"])
    out = observation(
        rows, adapter=F.lit(adapter), source=F.when(off, "unavailable").otherwise("provider_fields"), source_subtype=F.concat(F.lit(f"{adapter}_"), scope, F.when(failed, "_failed").when(off, "_unmeasured").otherwise("_usage")),
        source_event_id=event, session=r["sessionId"], request_id=event, turn_id=F.col("_turn"), source_timestamp=when, observed_at=when, model=first(m["primaryModelId"], F.col("_default")),
        input_tokens=F.when(~off, count(m["inputTokens"])), cached_input_tokens=F.when(~off, count(m["cachedReadTokens"])), cache_write_tokens=F.when(~off, count(m["cacheCreationTokens"])), output_tokens=F.when(~off, count(m["outputTokens"])), reasoning_tokens=F.when(~off, count(m["reasoningTokens"])),
        cost_micros=F.when(~off, thousandths(m["costUsdTicks"])), source_path=F.col("source_path"), source_offset=F.lit(0), parser_version=F.lit(parser_version),
    )
    none = F.lit(None)
    total = F.coalesce(m["inputTokens"], F.lit(0)) + F.coalesce(m["outputTokens"], F.lit(0))
    odd = (
        anomaly(rows.where(off), F.lit("missing_provider_measurements"), F.col("r.sessionId"), F.col("_turn"), F.to_json(F.struct(F.when(failed, "zero_model_calls").otherwise("missing_measurements").alias("reason"))))
        .unionByName(anomaly(rows.where(~off & F.col("_turn").isNotNull() & (m["totalTokens"] > 0) & (m["totalTokens"] != total)), F.lit("token_sum_mismatch"), F.col("r.sessionId"), F.col("_turn"), F.to_json(F.struct(F.col("m.totalTokens").alias("reported_total")))))
        .unionByName(anomaly(files.where(r.isNull()), F.lit("malformed_json"), none, none, F.lit("{}")))
        .unionByName(anomaly(files.where(r.isNotNull() & r["sessionId"].isNull()), F.lit("schema_mismatch"), none, none, F.lit("{}")))
        .unionByName(anomaly(files.where(r.isNotNull() & r["sessionId"].isNotNull() & ~known), F.lit("unsupported_version"), r["sessionId"], none, F.lit("{}")))
    )
    return out, odd


def is_free_model(model):
    """True for models whose name says that they are free."""
    low = F.lower(F.trim(model))
    return F.coalesce(low.rlike(r"[:/\-]free$|:free:|(^|/)free(/|$)"), F.lit(False))


_COSTS = "actual_cost_usd: string, estimated_cost_usd: string, cost_usd: string"
_RUN_COUNTS = "input_tokens: bigint, output_tokens: bigint, cache_read_tokens: bigint, cache_write_tokens: bigint, reasoning_tokens: bigint"
_RUN = f"struct<version: bigint, schema_version: string, unsupported_version: boolean, session_id: string, model: string, failed: boolean, api_calls: bigint, total_cost: string, {_COSTS}, {_RUN_COUNTS}, auxiliary: struct<by_task: map<string, struct<{_COSTS}, {_RUN_COUNTS}>>>>"


# Names of the files of one-shot runs.
RUN_FILES = "{*usage.json,request_dump_*}"


def read_runs(spark: SparkSession, path: str, adapter: str = "hermes", parser_version: str = "1") -> tuple[DataFrame, DataFrame]:
    """Observations and anomalies of the one-shot run reports below ``path``; files that are too large give an anomaly."""
    out, odd = runs_of(whole_files(spark, path, RUN_FILES), adapter, parser_version)
    return out, odd.unionByName(too_large(spark, path, RUN_FILES))


def runs_of(contents: DataFrame, adapter: str = "hermes", parser_version: str = "1") -> tuple[DataFrame, DataFrame]:
    """Observations and anomalies of one-shot run reports (source_path, content): the run and its side tasks.

    A failed run has no tokens. Of the costs that are told, the actual one
    counts before an estimate; a free model without one costs nothing. A report of an
    unsupported version gives an anomaly and nothing else.
    """
    files = _json(contents, _RUN)
    r = F.col("r")
    schema = r["schema_version"]
    strange = F.coalesce(r["version"] >= 99, F.lit(False)) | F.coalesce(schema.startswith("99") | (schema.startswith("9") & (F.octet_length(schema) > 2)), F.lit(False)) | F.coalesce(r["unsupported_version"], F.lit(False))
    good = files.where(r.isNotNull() & ~strange).withColumn("_session", first(r["session_id"], stem(F.col("source_path"))))
    free = is_free_model(r["model"])
    session = F.col("_session")
    failed = F.coalesce(r["failed"], F.lit(False))

    def tokens(c, off):
        return {
            "input_tokens": F.when(~off, count(c["input_tokens"])), "cached_input_tokens": F.when(~off, count(c["cache_read_tokens"])), "cache_write_tokens": F.when(~off, count(c["cache_write_tokens"])),
            "output_tokens": F.when(~off, count(c["output_tokens"])), "reasoning_tokens": F.when(~off, count(c["reasoning_tokens"])),
        }

    def cost(actual, estimate, measured):
        told = F.coalesce(dollar_text_to_micros(actual), dollar_text_to_micros(estimate))
        return F.when(measured, F.coalesce(told, F.when(free, F.lit(0).cast("long"))))

    main = tokens(r, failed)
    measured = F.coalesce(*main.values()).isNotNull()
    name = F.concat_ws(":", F.lit(adapter), session, F.lit("main"))
    runs = observation(
        good, adapter=F.lit(adapter), source=F.when(measured, "provider_fields").otherwise("unavailable"), source_subtype=F.when(failed, f"{adapter}_failed_run").when(~measured, f"{adapter}_unmeasured").otherwise(f"{adapter}_oneshot_usage"),
        source_event_id=name, session=session, request_id=name, turn_id=F.lit("turn_1"), agent_id=F.concat_ws(":", F.lit(adapter), session), model=r["model"], cost_micros=cost(first(r["actual_cost_usd"], r["cost_usd"], r["total_cost"]), r["estimated_cost_usd"], measured),
        source_path=F.col("source_path"), source_offset=F.lit(0), parser_version=F.lit(parser_version), **main,
    )
    tasks = good.select("source_path", "r", "_session", F.explode("r.auxiliary.by_task").alias("task", "c"))
    side = tokens(F.col("c"), F.lit(False))
    known = F.coalesce(*side.values()).isNotNull()
    name = F.concat_ws(":", F.lit(adapter), session, F.lit("aux"), F.col("task"))
    aux = observation(
        tasks, adapter=F.lit(adapter), source=F.when(known, "provider_fields").otherwise("unavailable"), source_subtype=F.concat(F.lit(f"{adapter}_auxiliary_"), F.col("task")), source_event_id=name, session=session, request_id=name,
        turn_id=F.concat(F.lit("task_"), F.col("task")), agent_id=F.concat_ws(":", F.lit(adapter), session, F.col("task")), parent_agent_id=F.concat_ws(":", F.lit(adapter), session), model=r["model"],
        cost_micros=cost(first(F.col("c.actual_cost_usd"), F.col("c.cost_usd")), F.col("c.estimated_cost_usd"), known), source_path=F.col("source_path"), source_offset=F.lit(0), parser_version=F.lit(parser_version), **side,
    )
    none = F.lit(None)
    odd = anomaly(good.where(~measured), F.lit("missing_provider_measurements"), session, F.lit("turn_1"), F.to_json(F.struct(F.when(failed, "failed_request").otherwise("missing_measurements").alias("reason")))).unionByName(
        anomaly(files.where(r.isNull()), F.lit("malformed_json"), none, none, F.lit("{}"))
    ).unionByName(anomaly(files.where(r.isNotNull() & strange), F.lit("unsupported_version"), none, none, F.to_json(F.struct(r["version"].alias("version"), schema.alias("schema_version"), r["unsupported_version"].alias("unsupported_version")))))
    return runs.unionByName(aux), odd


_VALUE = "struct<stringValue: string, intValue: string, doubleValue: double, boolValue: boolean>"
_ATTRIBUTES = f"array<struct<key: string, value: {_VALUE}>>"
OTLP = f"struct<resourceLogs: array<struct<resource: struct<attributes: {_ATTRIBUTES}>, scopeLogs: array<struct<logRecords: array<struct<timeUnixNano: string, body: {_VALUE}, attributes: {_ATTRIBUTES}>>>>>>>"


def telemetry(payloads: DataFrame, adapter: str = "claude") -> DataFrame:
    """Observations of the api_request records in OTLP log payloads (column ``line``).

    Attributes of a record override those of its resource; records without a
    session or request id are left out.
    """
    p = payloads.select(F.explode(F.from_json("line", OTLP)["resourceLogs"]).alias("res"))
    scopes = p.select(F.col("res.resource.attributes").alias("outer"), F.explode("res.scopeLogs").alias("scope"))
    records = scopes.select("outer", F.explode("scope.logRecords").alias("rec"))
    text = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    empty = F.array().cast(_ATTRIBUTES)
    # Later entries of a key win, as in a map that is extended; keys are then looked up in it.
    both = F.concat(F.coalesce("rec.attributes", empty), F.coalesce("outer", empty))
    known = records.withColumn("all", F.filter(both, lambda a: a["key"].isNotNull() & text(a["value"]).isNotNull()))

    def of(key):
        return text(F.get(F.filter("all", lambda a: a["key"] == key), 0)["value"])

    def field(*keys):
        return F.coalesce(*(of(k) for k in keys))

    def number(key):
        v = field(key)
        return F.when(v.rlike("^[0-9]{1,18}$"), v.cast("long"))

    named = known.where(F.coalesce(field("event.name"), F.col("rec.body.stringValue")).isin("api_request", "claude_code.api_request"))
    session, request, nth = field("session.id", "session_id"), field("request_id", "gen_ai.response.id"), number("event.sequence")
    when = F.coalesce(field("event.timestamp"), F.concat(F.lit("unix-ns:"), F.col("rec.timeUnixNano")))
    out = observation(
        named, adapter=F.lit(adapter), source=F.lit("official_telemetry"), source_subtype=F.lit("otel_api_request"), source_event_id=F.concat(F.lit("otel:"), session, F.lit(":"), nth.cast("string")), session=session, request_id=request, turn_id=field("prompt.id", "turn.id"),
        agent_id=field("agent.id", "agent_id"), parent_agent_id=field("parent_agent.id", "parent_agent_id"), source_timestamp=when, observed_at=when, model=field("model", "gen_ai.request.model"), service_tier=field("service_tier"), region=field("inference_geo", "region"),
        input_tokens=number("input_tokens"), cached_input_tokens=number("cache_read_tokens"), cache_write_tokens=number("cache_creation_tokens"), output_tokens=number("output_tokens"), reasoning_tokens=number("reasoning_tokens"), cost_micros=number("cost_usd_micros"),
        source_path=F.lit("otel:http/json:/v1/logs"), source_offset=F.coalesce(nth, F.lit(0)), parser_version=F.lit("otel-http-json-v1"),
    )
    return out.where("session is not null and request_id is not null")


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Observations of landed telemetry payloads, a JSON document a line."""
    return telemetry(lines(spark, path, "*.json*"))


_PROTOTYPE = "struct<project: string, project_name: string, task: string, task_name: string, name: string, session_id: string, session: string, timestamp: string, created_at: string, model: string, input_tokens: bigint, input: bigint, cached_input_tokens: bigint, cache_read: bigint, cache_write_tokens: bigint, cache_write: bigint, output_tokens: bigint, output: bigint, reasoning_tokens: bigint>"


def read_prototype(spark: SparkSession, path: str) -> DataFrame:
    """Observations of the prototype ledgers below ``path``, with project and task."""
    return prototypes_of(whole_files(spark, path, "*.json"))


def prototypes_of(files: DataFrame) -> DataFrame:
    """Observations of prototype ledgers (source_path, content), with project and task.

    The file is an array, an object with an array under a known key, or an
    object of objects; what is no object in it is left out.
    """
    under = [F.from_json(F.get_json_object("content", f"$.{k}"), "array<string>") for k in ("records", "entries", "events", "usage", "tasks")]
    listed = F.coalesce(F.when(F.ltrim("content").startswith("["), F.from_json("content", "array<string>")), *under, F.map_values(F.from_json("content", "map<string, string>")))
    rows = files.select("source_path", F.posexplode(F.filter(listed, lambda x: F.ltrim(x).startswith("{"))).alias("n", "item")).withColumn("r", F.from_json("item", _PROTOTYPE))
    r = F.col("r")
    some = lambda *keys: F.coalesce(*(F.when(F.trim(r[k]) != "", F.trim(r[k])) for k in keys))
    place = F.concat_ws(":", "source_path", F.col("n").cast("string"))
    when = F.coalesce(some("timestamp", "created_at"), F.lit("1970-01-01T00:00:00Z"))
    own = {"project": F.coalesce(some("project", "project_name"), F.lit("Prototype import")), "task": F.coalesce(some("task", "task_name", "name"), F.lit("Imported work"))}
    return observation(
        rows, own, adapter=F.lit("prototype"), source=F.lit("explicit_cli"), source_subtype=F.lit("prototype_json"), source_event_id=place, session=F.coalesce(some("session_id", "session"), F.concat(F.lit("prototype-"), F.col("n").cast("string"))),
        request_id=F.concat(F.lit("prototype:"), place), source_timestamp=when, observed_at=when, model=r["model"], input_tokens=count(r["input_tokens"], r["input"]), cached_input_tokens=count(r["cached_input_tokens"], r["cache_read"]),
        cache_write_tokens=count(r["cache_write_tokens"], r["cache_write"]), output_tokens=count(r["output_tokens"], r["output"]), reasoning_tokens=count(r["reasoning_tokens"]), source_path=F.col("source_path"), source_offset=F.col("n"), parser_version=F.lit("prototype-v1"),
    )


def prototype_preview(rows: DataFrame) -> DataFrame:
    """records, measured (input, output or cache read is known), unavailable, projects."""
    known = F.coalesce("input_tokens", "output_tokens", "cached_input_tokens").isNotNull()
    return rows.agg(F.count("*").alias("records"), F.count(F.when(known, 1)).alias("measured"), F.count(F.when(~known, 1)).alias("unavailable"), F.countDistinct("project").alias("projects"))


def manual_run(spark: SparkSession, session: str, stopped_at: str, counts: dict[str, int | None]) -> DataFrame:
    """The one observation of a run that was started and stopped by hand."""
    row = {"adapter": "manual", "source": "explicit_cli", "source_subtype": "manual_stop", "source_event_id": f"{session}:stop", "session": session, "source_timestamp": stopped_at, "observed_at": stopped_at, "source_path": "manual", "source_offset": 0, "parser_version": "manual-v1"}
    unknown = set(counts) - set(TOKENS)
    if unknown:
        raise ValueError(f"no such counts: {sorted(unknown)}")
    from costgrain.sources.observation import SCHEMA

    full = {f.name: None for f in SCHEMA} | row | counts
    return spark.createDataFrame([tuple(full[f.name] for f in SCHEMA)], T.StructType(SCHEMA.fields))
