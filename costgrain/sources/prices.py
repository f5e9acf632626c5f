"""Price snapshots: a small signed JSON file becomes a rate table."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from costgrain.operators.pricing import rates_in_micros

_COLUMNS = {"provider": "provider", "modelPattern": "model_pattern", "effectiveFrom": "effective_from", "inputPerMillion": "input_rate", "cachedInputPerMillion": "cached_rate", "cacheWritePerMillion": "write_rate", "outputPerMillion": "output_rate", "reasoningPerMillion": "reasoning_rate"}
_ORDER = ["provider", "modelPattern", "effectiveFrom", "inputPerMillion", "cachedInputPerMillion", "cacheWritePerMillion", "outputPerMillion"]


def digest(snapshot: dict) -> str:
    """SHA-256 of the snapshot in its canonical form: compact, in fixed order, without the digest.

    Cached and write rates that are absent are null there; an absent reasoning rate is left out."""
    models = []
    for m in snapshot["models"]:
        row = {k: m.get(k) for k in _ORDER}
        if m.get("reasoningPerMillion") is not None:
            row["reasoningPerMillion"] = m["reasoningPerMillion"]
        models.append(row | {"source": m["source"]})
    body = {"version": snapshot["version"], "updated": snapshot["updated"], "currency": snapshot["currency"], "models": models}
    return hashlib.sha256(json.dumps(body, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def load(spark: SparkSession, content: str) -> DataFrame:
    """The rate table of a snapshot's text; raises where the digest is not its own."""
    snapshot = json.loads(content)
    if digest(snapshot) != snapshot["sha256"]:
        raise ValueError(f"price snapshot digest differs: {snapshot['sha256']}")
    rows = []
    for m in snapshot["models"]:
        key = ":".join((m["provider"], m["modelPattern"], m["effectiveFrom"], snapshot["sha256"]))
        rows.append(("price_" + hashlib.sha256(key.encode()).hexdigest()[:24], *(m.get(k) for k in _COLUMNS)))
    schema = ", ".join(f"{c} string" for c in ["pricing_version_id", *_COLUMNS.values()])
    return rates_in_micros(spark.createDataFrame(rows, schema))
