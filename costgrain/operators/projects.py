"""Projects: which one a session belongs to, its roots, and versions of what is said of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from costgrain.functions.identity import stable_id
from costgrain.functions.text import ascii_lower

# How sure each way of finding a project is.
CONFIDENCE = {"override": 1.0, "verified": 1.0, "config": 0.98, "git": 0.92, "manifest": 0.82, "cwd": 0.60, "inbox": 0.40}


def prefixes(path: Column) -> Column:
    """A path and all folders above it, the longest last: /a/b gives /a and /a/b."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts))), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))


def resolve(sessions: DataFrame, roots: DataFrame) -> DataFrame:
    """Sessions (session, cwd, override_key, verified_key) with project_id, method and confidence.

    A told key counts first, then a verified one, then the active root (path,
    project_id, root_type) that lies deepest above the folder, and of several
    there the surest. Every folder above is looked up by equality, so roots are
    joined by hash however many there are. Without any it is the folder itself.
    """
    sure = F.lit(0.0)
    for kind, c in CONFIDENCE.items():
        sure = F.when(F.col("root_type") == kind, c).otherwise(sure)
    live = roots.where("active").select("path", F.struct(F.length("path").alias("n"), sure.alias("confidence"), F.col("project_id"), F.col("root_type")).alias("root"))
    above = sessions.where("cwd is not null").select("session", F.explode(prefixes(F.col("cwd"))).alias("path"))
    best = above.join(live, "path").groupBy("session").agg(F.max("root").alias("root"))
    met = sessions.join(best, "session", "left")
    told = F.when(F.col("override_key").isNotNull(), F.struct(F.col("override_key").alias("project_id"), F.lit("override").alias("method"), F.lit(CONFIDENCE["override"]).alias("confidence")))
    told = told.when(F.col("verified_key").isNotNull(), F.struct(F.col("verified_key").alias("project_id"), F.lit("verified").alias("method"), F.lit(CONFIDENCE["verified"]).alias("confidence")))
    told = told.when(F.col("root").isNotNull(), F.struct(F.col("root.project_id").alias("project_id"), F.col("root.root_type").alias("method"), F.col("root.confidence").alias("confidence")))
    told = told.when(F.col("cwd").isNotNull(), F.struct(F.col("cwd").alias("project_id"), F.lit("cwd").alias("method"), F.lit(CONFIDENCE["cwd"]).alias("confidence")))
    told = told.otherwise(F.struct(F.lit("personal-unassigned").alias("project_id"), F.lit("inbox").alias("method"), F.lit(CONFIDENCE["inbox"]).alias("confidence")))
    return met.withColumn("_p", told).select("session", "_p.*")


def current_roots(changes: DataFrame) -> DataFrame:
    """Roots (project_id, path) as the last change leaves them, with first and last time seen.

    A change registers or deactivates; a move is a deactivation of the old path
    and a registration of the new one."""
    last = F.max_by("active", F.struct("at", "n")).alias("active")
    return changes.groupBy("project_id", "path").agg(last, F.max_by("root_type", F.struct("at", "n")).alias("root_type"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))


def current_items(items: DataFrame, versions: DataFrame) -> DataFrame:
    """Items with the last title, parent and type that corrections (id, field, value, version) gave them.

    A parent that is the item itself is refused; a null parent makes a root."""
    sound = versions.where(~((F.col("field") == "parent_id") & F.col("value").eqNullSafe(F.col("id"))))
    last = sound.groupBy("id", "field").agg(F.max_by(F.struct("value"), "version").alias("v"))
    wide = last.groupBy("id").agg(*(F.max(F.when(F.col("field") == f, F.col("v"))).alias(f"_{f}") for f in ("title", "parent_id", "type")))
    met = items.join(wide, "id", "left")
    new = {f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}")["value"]).otherwise(F.col(f)) for f in ("title", "parent_id", "type")}
    return met.withColumns(new).select(*items.columns)


def find_item(items: DataFrame, part: str) -> DataFrame:
    """The item whose title holds ``part``, whatever the case of a-z; several or none is an error."""
    found = items.where(F.contains(ascii_lower(F.col("title")), F.lit(part.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))))
    n = len(found.take(2))
    if n != 1:
        raise LookupError(f"{'no item' if n == 0 else 'several items'} with {part!r}")
    return found


def sound_notes(notes: DataFrame) -> DataFrame:
    """Notes of 1 to 240 characters."""
    return notes.where(F.length("text").between(1, 240))


def merge_plan(attributions: DataFrame, items: DataFrame, notes: DataFrame, source: str) -> DataFrame:
    """One row of what merging an item away touches: groups, spans, children, notes."""
    mine = attributions.where(F.col("work_item_id") == source).agg(F.countDistinct("group_id").alias("groups"), F.countDistinct("span_id").alias("spans"))
    children = items.where(F.col("parent_id") == source).agg(F.count("*").alias("children"))
    said = notes.where(F.col("work_item_id") == source).agg(F.count("*").alias("notes"))
    return mine.crossJoin(children).crossJoin(said)  # one row each


def missing_spans(attributions: DataFrame, wanted: DataFrame, source: str) -> DataFrame:
    """Spans of ``wanted`` that the item has no active attribution of; a split needs none."""
    own = attributions.where(F.col("work_item_id") == source).select("span_id").distinct()
    return wanted.select("span_id").distinct().join(own, "span_id", "left_anti")


def place_anomalies(anomalies: DataFrame, sessions: DataFrame) -> DataFrame:
    """Anomalies with their session's id, told by id or else by the provider's id."""
    by_id = sessions.select(F.col("session").alias("told"), F.col("session").alias("_a"))
    first = W.partitionBy("provider_session").orderBy("session")
    by_name = sessions.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(F.col("provider_session").alias("told"), F.col("session").alias("_b"))
    return anomalies.join(by_id, "told", "left").join(by_name, "told", "left").withColumn("session", F.coalesce("_a", "_b")).drop("_a", "_b")


def record_anomalies(found: DataFrame, sessions: DataFrame, turns: DataFrame, recorded_at: str) -> DataFrame:
    """Rows to append for anomalies (type, session, turn_id, details) as readers give them.

    The session is found by its id or its provider's, the turn by its id; what isn't found is null. The id is made of
    type, time and details, so that one recording makes one row of what is alike.
    """
    placed = place_anomalies(found.withColumnRenamed("session", "told"), sessions.select("session", "provider_session")).drop("told")
    known = turns.select(F.col("turn_id").alias("_turn")).where("_turn is not null").distinct()
    met = placed.join(known, F.col("turn_id") == F.col("_turn"), "left").withColumn("turn_id", F.col("_turn"))
    name = stable_id("anom", F.concat_ws(":", "type", F.lit(recorded_at), F.coalesce("details", F.lit("{}"))))
    rows = met.select(name.alias("id"), "session", "turn_id", "type", F.coalesce("details", F.lit("{}")).alias("details"), F.lit(recorded_at).alias("created_at"))
    return rows.groupBy("id").agg(F.min_by(F.struct("session", "turn_id", "type", "details", "created_at"), F.struct(F.col("session").isNull(), "session", F.col("turn_id").isNull(), "turn_id")).alias("r")).select("id", "r.*")


def reconcile(events: DataFrame, anomalies: DataFrame, capabilities: DataFrame) -> DataFrame:
    """One row: sessions, duplicate requests, duplicate lifecycle counters, open anomalies, and what is known of sub-agents."""
    from costgrain.operators.usage import duplicate_lifecycle, duplicate_requests

    state = capabilities.where("capability = 'subagent_tokens_already_in_parent'").agg(F.max_by(F.struct("state", "detail"), "checked_at").alias("c"))
    low = F.lower(F.trim("c.detail"))
    inside = F.coalesce((low == "true") | low.rlike(r'"already_in_parent": ?true'), F.lit(False))
    told = F.when(F.col("c").isNull(), "degraded: capability unknown or missing").when(F.col("c.state") != "available", F.concat(F.lit("degraded: subagent capability state is "), F.col("c.state"))).when(inside, "verified: child tokens included in parent (no double-counting)").otherwise("verified: child tokens independent (rolled up to parent)")
    one = lambda df, c: df.agg(F.count("*").alias(c))
    parts = [one(duplicate_requests(events), "duplicate_requests"), one(duplicate_lifecycle(events), "duplicate_lifecycle"), one(anomalies.where("resolved_at is null"), "open_anomalies"), state.select(told.alias("subagents"))]
    out = events.agg(F.countDistinct("session").alias("sessions"))
    for p in parts:
        out = out.crossJoin(p)  # one row each
    return out


def policy(capabilities: DataFrame) -> str:
    """The policy for sub-agents that the last capability tells; Unknown without one."""
    row = capabilities.where("capability = 'subagent_tokens_already_in_parent'").orderBy(F.desc("checked_at")).first()
    if row is None or row["state"] != "available":
        return "Unknown"
    detail = (row["detail"] or "").strip().lower()
    return "AlreadyInParent" if detail == "true" or '"already_in_parent":true' in detail.replace(" ", "") else "Independent"


def matching(projects: DataFrame, wanted: str, key: str = "key", name: str = "display_name") -> DataFrame:
    """Projects whose key is ``wanted`` or whose name holds it, A-Z taken for a-z; no sign is a wildcard."""
    from costgrain.functions.text import ascii_lower

    return projects.where((F.col(key) == wanted) | F.contains(ascii_lower(F.col(name)), ascii_lower(F.lit(wanted))))


def leaks_in(tables: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """(table, column, id) of every text column that holds a secret; ``tables`` maps a name to rows, id column and text columns that may be absent."""
    from costgrain.functions.text import leaks

    out = None
    for name, (rows, key, columns) in tables.items():
        there = [c for c in columns if c in rows.columns]
        if not there:
            continue
        texts = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text")) for c in there)))
        found = rows.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("id"), texts.alias("x")).where(leaks(F.col("x.text"))).select("table", "x.column", "id")
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no text column to look at")
    return out
