"""The closed vocabulary of measurement kinds, and where each stands in authority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds, ranks and lists that stored ledgers hold.

#: Rank of an incoming record by its measurement source.
SOURCE_RANK = {"unavailable": 0, "explicit_cli": 1, "snapshot_delta": 2, "transcript_request": 3, "provider_fields": 4, "official_telemetry": 5}

#: Kinds of a stored record at each rank; any other kind has rank UNKNOWN.
STORED_RANK = {
    0: [
        "unavailable", "grok_turn_failed", "grok_session_failed", "grok_turn_unmeasured", "grok_session_unmeasured", "hermes_failed_run",
        "hermes_unmeasured", "gemini_turn_failed", "gemini_turn_unmeasured", "copilot_unmeasured", "opencode_unmeasured",
    ],
    1: ["explicit_cli", "manual_stop"],
    2: ["snapshot_delta", "hermes_snapshot_delta", "codex_turn_counter", "turn_counter", "turn_summary", "cumulative_turn_counter"],
    3: ["transcript_request", "prototype_json", "final_request_counter", "subagent_stop", "subagent_lifecycle_counter"],
    4: ["provider_fields", "gemini_turn_usage", "copilot_usage_event", "opencode_message_usage", "opencode_session_usage"],
    5: ["official_telemetry"],
}
#: Recognised kinds without a rank of their own: nothing may replace them.
UNRANKED = ["codex_app_server", "codex_rollout", "grok_turn_usage", "grok_session_usage", "hermes_oneshot_usage", "hermes_session_model_usage", "otel_api_request"]
#: Open-ended kinds: anything that begins so is recognised and has rank 4.
PREFIXES = ["hermes_auxiliary_", "hermes_usage_"]
UNKNOWN = 255

LIFECYCLE = ["final_request_counter", "subagent_stop", "subagent_lifecycle_counter"]
TURN_COUNTERS = ["codex_turn_counter", "turn_counter", "turn_summary", "cumulative_turn_counter"]
DELTAS = ["hermes_snapshot_delta", "snapshot_delta"]
#: Anomalies that inform and are no gap in measurement.
NOTICES = ["unmapped_source_kind"]

TOKENS = ["input_tokens", "cached_input_tokens", "cache_write_tokens", "output_tokens", "reasoning_tokens"]


def _prefixed(kind: Column) -> Column:
    return kind.startswith(PREFIXES[0]) | kind.startswith(PREFIXES[1])


def source_rank(source: Column) -> Column:
    """Rank with which an incoming record enters."""
    rank = F.lit(None).cast("int")
    for name, r in SOURCE_RANK.items():
        rank = F.when(source == name, r).otherwise(rank)
    return rank


def stored_rank(kind: Column) -> Column:
    """Rank with which a stored record is defended; UNKNOWN is never replaced."""
    rank = F.when(_prefixed(kind), 4).otherwise(UNKNOWN)
    for r, kinds in STORED_RANK.items():
        rank = F.when(kind.isin(kinds), r).otherwise(rank)
    return rank


def is_recognised(kind: Column) -> Column:
    known = [k for kinds in STORED_RANK.values() for k in kinds] + UNRANKED
    return F.coalesce(kind.isin(known) | _prefixed(kind), F.lit(False))


def source_kind(source: Column, subtype: Column) -> Column:
    """What is stored as the kind: the subtype where it is recognised, else the source."""
    return F.when(is_recognised(subtype), subtype).otherwise(source)


def is_measured(prefix: str = "") -> Column:
    """True where at least one token count is known; unknown is not zero."""
    return F.coalesce(*(F.col(prefix + t) for t in TOKENS)).isNotNull()
