"""Stable identities of observations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, value: Column) -> Column:
    """A prefix and the first 24 hex digits of the SHA-256 of a string."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(value, 256), 1, 24))


def session_id(adapter: Column, provider_session: Column) -> Column:
    return stable_id("session", F.concat_ws(":", adapter, provider_session))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def canonical_identity(legacy: bool = False) -> Column:
    """Identity by which observations of several sources are the same.

    A snapshot delta goes by its event, a request by session, turn and request
    (in the legacy scheme by request alone), any other by its event, a turn
    counter by session and turn, and what is left by all that is known of it.
    """
    c = F.col
    delta = c("source") == "snapshot_delta"
    counter = (F.coalesce(c("source_subtype"), F.lit("")) == "codex_turn_counter") | delta
    request = [c("adapter"), F.lit("request"), c("request_id")] if legacy else [c("adapter"), F.lit("request"), c("session"), _text(c("turn_id")), c("request_id")]
    return (
        F.when(delta & c("source_event_id").isNotNull(), F.concat_ws(":", c("adapter"), F.lit("delta"), c("source_event_id")))
        .when(c("request_id").isNotNull(), F.concat_ws(":", *request))
        .when(c("source_event_id").isNotNull(), F.concat_ws(":", c("adapter"), F.lit("event"), c("source_event_id")))
        .when(counter & c("turn_id").isNotNull(), F.concat_ws(":", c("adapter"), F.lit("counter"), c("session"), c("turn_id")))
        .otherwise(
            F.concat_ws(":", c("adapter"), c("session"), _text(c("turn_id")), _text(c("model")), _text(c("source_timestamp")), _text(c("input_tokens")), _text(c("output_tokens")), _text(c("source_offset")))
        )
    )


def with_identity(observations):
    """Add identity, legacy identity and their hashes."""
    named = observations.withColumns({"identity": canonical_identity(), "identity_v1": canonical_identity(legacy=True)})
    return named.withColumns({"event_hash": F.sha2("identity", 256), "event_hash_v1": F.sha2("identity_v1", 256)})
