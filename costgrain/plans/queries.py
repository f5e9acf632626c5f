"""The accounting queries over the ledger-shaped tables, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from costgrain.functions import identity, money, text, vocabulary
from costgrain.functions.vocabulary import TOKENS
from costgrain.operators import attribution, deltas, ladder, pricing, tree, usage
from costgrain.operators.stages import cut
from costgrain.plans import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_TOK = ", ".join(TOKENS)


def query(sql: str | None):
    """Register a query under its own name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Identity and authority.


@query(f"WITH {t.OBS} SELECT source_offset, identity, identity_v1, sha256(identity) AS event_hash, 'session_' || substr(sha256(adapter || ':' || session), 1, 24) AS session_id FROM named")
def canonical_identity(spark, sf_dir):
    o = identity.with_identity(t.observations(spark, sf_dir))
    return o.select("source_offset", "identity", "identity_v1", "event_hash", identity.session_id(F.col("adapter"), F.col("session")).alias("session_id"))


@query(
    f"WITH {t.OBS} SELECT source_kind, rank, CASE source_kind WHEN 'unavailable' THEN 0 WHEN 'snapshot_delta' THEN 2 WHEN 'turn_counter' THEN 2 WHEN 'transcript_request' THEN 3 WHEN 'final_request_counter' THEN 3 WHEN 'subagent_stop' THEN 3 WHEN 'official_telemetry' THEN 5 ELSE 255 END AS stored_rank, count(*) AS n, count(*) FILTER (WHERE measured) AS measured FROM named GROUP BY ALL"
)
def source_kind_rank(spark, sf_dir):
    o = t.observations(spark, sf_dir).withColumn("source_kind", vocabulary.source_kind(F.col("source"), F.col("source_subtype")))
    ranked = o.withColumns({"rank": vocabulary.source_rank(F.col("source")), "stored_rank": vocabulary.stored_rank(F.col("source_kind"))})
    return ranked.groupBy("source_kind", "rank", "stored_rank").agg(F.count("*").alias("n"), F.count(F.when(vocabulary.is_measured(), 1)).alias("measured"))


_LADDER = f"{t.OBS}, ladder AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY rank DESC, measured DESC, source_offset) AS nth FROM named) WHERE nth = 1)"


@query(f"WITH {_LADDER} SELECT identity, source_offset, rank, {_TOK} FROM ladder")
def truth_ladder(spark, sf_dir):
    return ladder.deduplicate(t.observations(spark, sf_dir)).select("identity", "source_offset", "rank", *TOKENS)


_SAME = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in TOKENS)


@query(
    f"""WITH {t.OBS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY source_offset) AS nth FROM named),
best AS (SELECT identity, nth, arg_max(nth, rank * 10000000000 + CASE WHEN measured THEN 1000000000 ELSE 0 END - nth) OVER (PARTITION BY identity ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS won FROM numbered)
SELECT a.identity, CAST(sum(CASE WHEN best.won IS NOT NULL AND NOT ({_SAME}) THEN 1 ELSE 0 END) AS BIGINT) AS conflicts
FROM numbered a JOIN best ON a.identity = best.identity AND a.nth = best.nth LEFT JOIN numbered b ON b.identity = a.identity AND b.nth = best.won GROUP BY a.identity"""
)
def dedup_conflicts(spark, sf_dir):
    return ladder.conflicts(t.observations(spark, sf_dir))


@query(f"WITH {t.OBS} SELECT source_offset, sha256(identity) AS event_hash, source_kind FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY source_offset) AS nth FROM named) WHERE nth = 1")
def insert_or_ignore(spark, sf_dir):
    return ladder.insert_or_ignore(None, t.observations(spark, sf_dir)).select("source_offset", "event_hash", "source_kind")


@query(
    f"WITH {t.OBS} SELECT session, turn_id, CAST(row_number() OVER (PARTITION BY session ORDER BY first, turn_id) - 1 AS INTEGER) AS sequence_number FROM (SELECT session, turn_id, min(source_offset) AS first FROM named WHERE turn_id IS NOT NULL GROUP BY ALL)"
)
def sequence_numbers(spark, sf_dir):
    return ladder.sequence_numbers(t.observations(spark, sf_dir))


@query(
    f"""WITH {t.OBS}, old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY source_offset) AS nth FROM named WHERE source_offset % 2 = 0) WHERE nth = 1),
new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY rank DESC, measured DESC, source_offset) AS nth FROM named WHERE source_offset % 2 = 1) WHERE nth = 1),
stored AS (SELECT session, identity, 'ev' || CAST(source_offset AS VARCHAR) AS old_id, measured AS old_measured, CASE source_kind WHEN 'unavailable' THEN 0 WHEN 'snapshot_delta' THEN 2 WHEN 'turn_counter' THEN 2 WHEN 'transcript_request' THEN 3 WHEN 'final_request_counter' THEN 3 WHEN 'subagent_stop' THEN 3 WHEN 'official_telemetry' THEN 5 ELSE 255 END AS old_rank FROM old)
SELECT n.source_offset, o.old_id, CASE WHEN o.old_id IS NULL THEN sha256(n.identity) ELSE sha256(n.identity || chr(0) || 'supersedes' || chr(0) || o.old_id) END AS event_hash
FROM new n LEFT JOIN stored o ON n.session = o.session AND n.identity = o.identity WHERE o.old_id IS NULL OR n.rank > o.old_rank OR (n.rank = o.old_rank AND n.measured AND NOT o.old_measured)"""
)
def supersede_chain(spark, sf_dir):
    o = t.observations(spark, sf_dir)
    old = ladder.insert_or_ignore(None, o.where("source_offset % 2 = 0"))
    stored = old.select("*", F.concat(F.lit("ev"), F.col("source_offset").cast("string")).alias("id"), F.lit(None).cast("string").alias("logical_event_hash"))
    new, _ = ladder.supersede(stored, ladder.deduplicate(o.where("source_offset % 2 = 1")))
    return new.select("source_offset", "old_id", "event_hash")


# Counters.

_VIEWS = "views AS (SELECT *, row_number() OVER w AS nth, " + ", ".join(f"lag({c}) OVER w AS was_{c}" for c in TOKENS) + " FROM obs WHERE source = 'snapshot_delta' WINDOW w AS (PARTITION BY session ORDER BY source_offset))"
_FALLS = " OR ".join(f"coalesce({c} < was_{c}, false)" for c in TOKENS)


@query(f"WITH {t.OBS}, {_VIEWS} SELECT source_offset, ({_FALLS}) AS negative, " + ", ".join(f"CASE WHEN NOT ({_FALLS}) THEN {c} - was_{c} END AS {c}" for c in TOKENS) + " FROM views WHERE nth > 1")
def snapshot_delta(spark, sf_dir):
    o = t.observations(spark, sf_dir).where("source = 'snapshot_delta'")
    return deltas.snapshot_deltas(o, ["session"], ["source_offset"]).select("source_offset", "negative", *TOKENS)


def _readings(spark, sf_dir, cumulative):
    return t.observations(spark, sf_dir).withColumn("is_cumulative", cumulative)


_RESETS = " OR ".join(f"coalesce({c}, 0) < was_{c}" for c in deltas.RESET)


def _counter_sql(cumulative: str, stream: str) -> str:
    sums = ", ".join(f"CAST(sum(coalesce({c}, 0)) OVER (PARTITION BY {stream}, seg ORDER BY source_offset) AS BIGINT) AS sum_{c}" for c in TOKENS)
    lags = ", ".join(f"lag(sum_{c}) OVER w AS was_{c}" for c in TOKENS)
    out = ", ".join(f"CASE WHEN counts AND NOT reset THEN CASE WHEN coalesce({c}, 0) >= was_{c} THEN coalesce({c}, 0) - was_{c} END ELSE {c} END AS {c}" for c in TOKENS)
    return f"""WITH {t.OBS}, a AS (SELECT *, {cumulative} AS cum, row_number() OVER w AS nth, sum(CASE WHEN {cumulative} THEN 1 ELSE 0 END) OVER w AS seg FROM obs WINDOW w AS (PARTITION BY {stream} ORDER BY source_offset)),
b AS (SELECT *, {sums} FROM a), c AS (SELECT *, {lags} FROM b WINDOW w AS (PARTITION BY {stream} ORDER BY source_offset)),
d AS (SELECT *, cum AND nth > 1 AS counts, cum AND nth > 1 AND ({_RESETS}) AS reset FROM c)
SELECT source_offset, reset, {out} FROM d"""


@query(_counter_sql("true", "session, turn_id, model"))
def cumulative_delta(spark, sf_dir):
    out = deltas.counter_deltas(_readings(spark, sf_dir, F.lit(True)), ["session", "turn_id", "model"], ["source_offset"])
    return out.select("source_offset", "reset", *TOKENS)


@query(_counter_sql("source_offset % 3 = 0", "session, turn_id"))
def mixed_counter_delta(spark, sf_dir):
    out = deltas.counter_deltas(_readings(spark, sf_dir, F.col("source_offset") % 3 == 0), ["session", "turn_id"], ["source_offset"])
    return out.select("source_offset", "reset", *TOKENS)


@query(
    f"""WITH {t.OBS}, a AS (SELECT *, row_number() OVER w AS nth, {', '.join(f'lag(coalesce({c}, 0)) OVER w AS was_{c}' for c in TOKENS)}, last_value(cost_micros IGNORE NULLS) OVER (PARTITION BY session, turn_id ORDER BY source_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM obs WINDOW w AS (PARTITION BY session, turn_id ORDER BY source_offset)),
b AS (SELECT *, nth > 1 AND ({' OR '.join(f'coalesce({c}, 0) < was_{c}' for c in TOKENS)}) AS falls, coalesce(cost_micros < known, false) AS cost_falls FROM a)
SELECT source_offset, CAST(sum(CAST(falls AS BIGINT)) OVER w AS BIGINT) AS token_epoch, CAST(sum(CAST(cost_falls AS BIGINT)) OVER w AS BIGINT) AS cost_epoch, {', '.join(f'CASE WHEN NOT falls THEN coalesce({c}, 0) - coalesce(was_{c}, 0) END AS delta_{c}' for c in TOKENS)},
CASE WHEN known IS NULL THEN cost_micros WHEN cost_micros > known THEN cost_micros - known END AS delta_cost_micros FROM b WINDOW w AS (PARTITION BY session, turn_id ORDER BY source_offset)"""
)
def epoch_delta(spark, sf_dir):
    out = deltas.epoch_deltas(t.observations(spark, sf_dir), ["session", "turn_id"], ["source_offset"])
    return out.select("source_offset", "token_epoch", "cost_epoch", *(f"delta_{c}" for c in [*TOKENS, "cost_micros"]))


@query(
    f"WITH {t.OBS}, v AS (SELECT *, row_number() OVER w AS nth, " + ", ".join(f"lag({c}) OVER w AS was_{c}" for c in TOKENS) + " FROM obs WHERE source = 'snapshot_delta' WINDOW w AS (PARTITION BY session ORDER BY observed_at, source_offset)), "
    f"m AS (SELECT *, CASE WHEN nth = 1 THEN 'baseline' WHEN {_FALLS} THEN 'backward' ELSE 'delta' END AS action FROM v) SELECT source_offset, action, " + ", ".join(f"CASE WHEN action <> 'delta' THEN 0 ELSE {c} - was_{c} END AS new_{c}" for c in TOKENS) + " FROM m"
)
def repair_rewrite(spark, sf_dir):
    out = deltas.repair_snapshots(t.observations(spark, sf_dir).where("source = 'snapshot_delta'"))
    return out.select("source_offset", "action", *(f"new_{c}" for c in TOKENS))


@query(
    """WITH a AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN 'u' || CAST(turn AS VARCHAR) END AS seen, sum(CASE WHEN turn % 4 = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cut FROM conversations)
SELECT conv_id, turn, last_value(seen IGNORE NULLS) OVER (PARTITION BY conv_id, coalesce(cut, 0) ORDER BY turn) AS context FROM a"""
)
def sticky_context(spark, sf_dir):
    c = t.read(spark, sf_dir, "conversations").withColumn("context", F.when(F.col("role") == "user", F.concat(F.lit("u"), F.col("turn").cast("string"))))
    return deltas.sticky(c, ["conv_id"], ["turn"], ["context"], F.col("turn") % 4 == 3).select("conv_id", "turn", "context")


# Totals.


def _flags(spark, sf_dir):
    return usage.flagged(t.ledger(spark, sf_dir), t.sessions(spark, sf_dir))


@query(f"WITH {t.FLAGS} SELECT source_offset, is_lifecycle, is_delta, is_subagent, is_covered, measured FROM flags")
def covered_counter(spark, sf_dir):
    return _flags(spark, sf_dir).select("source_offset", "is_lifecycle", "is_delta", "is_subagent", "is_covered", "measured")


def _totals_sql(policy: str, by: str = "") -> str:
    sub = "is_subagent" if policy == "Unknown" else "false"
    where = " AND NOT is_subagent" if policy == "AlreadyInParent" else ""
    one = lambda c: f"CAST(coalesce(sum(CASE WHEN {c} THEN 1 ELSE 0 END), 0) AS BIGINT)"
    tokens = ", ".join(f"CAST(coalesce(sum(CASE WHEN NOT {sub} THEN {c} END), 0) AS BIGINT) AS {c}" for c in TOKENS)
    return f"""SELECT {by + ', ' if by else ''}{one('NOT is_delta')} AS requests, {one(f'NOT is_delta AND NOT {sub} AND measured')} AS measured, {one(f'NOT is_delta AND ({sub} OR NOT measured)')} AS unavailable, {tokens}
FROM flags WHERE NOT is_lifecycle AND NOT is_covered{where}{' GROUP BY ' + by if by else ''}"""


@query(f"WITH {t.FLAGS} {_totals_sql('AlreadyInParent')}")
def usage_already_in_parent(spark, sf_dir):
    return usage.totals(_flags(spark, sf_dir), "AlreadyInParent")


@query(f"WITH {t.FLAGS} {_totals_sql('Independent')}")
def usage_independent(spark, sf_dir):
    return usage.totals(_flags(spark, sf_dir), "Independent")


@query(f"WITH {t.FLAGS} {_totals_sql('Unknown')}")
def usage_unknown(spark, sf_dir):
    return usage.totals(_flags(spark, sf_dir), "Unknown")


@query(
    f"WITH {t.FLAGS}, {t.ANOMALIES}, tot AS ({_totals_sql('Unknown', 'session')}), an AS (SELECT session, count(*) AS n FROM anomalies WHERE resolved_at IS NULL AND type <> 'unmapped_source_kind' GROUP BY session) SELECT tot.session, measured, unavailable, coalesce(n, 0) AS anomalous, CASE WHEN measured + unavailable + coalesce(n, 0) > 0 THEN 100.0::DOUBLE * measured / (measured + unavailable + coalesce(n, 0)) END AS completeness FROM tot LEFT JOIN an ON tot.session = an.session"
)
def completeness(spark, sf_dir):
    tot = usage.totals(_flags(spark, sf_dir), "Unknown", ["session"])
    an = t.anomalies(spark, sf_dir).groupBy("session").agg(F.count(F.when(F.col("resolved_at").isNull() & ~F.col("type").isin(vocabulary.NOTICES), 1)).alias("anomalous"))
    met = tot.join(an, "session", "left").withColumn("anomalous", F.coalesce("anomalous", F.lit(0)))
    return met.select("session", "measured", "unavailable", "anomalous", usage.completeness(F.col("measured"), F.col("unavailable"), F.col("anomalous")).alias("completeness"))


@query(f"WITH {t.LEDGER} SELECT request_id, count(*) AS n FROM ledger WHERE superseded_by IS NULL AND request_id IS NOT NULL AND source_kind NOT IN ('hermes_snapshot_delta', 'snapshot_delta') GROUP BY request_id HAVING count(*) > 1")
def dup_requests(spark, sf_dir):
    return usage.duplicate_requests(t.ledger(spark, sf_dir))


_LIFE = "('final_request_counter', 'subagent_stop', 'subagent_lifecycle_counter')"


_DUPLICATES = f"""SELECT session, turn_id FROM act WHERE source_kind IN {_LIFE} GROUP BY ALL HAVING count(*) > 1
UNION SELECT a.session, a.turn_id FROM act a JOIN act b ON a.session = b.session AND ((a.turn_id IS NOT NULL AND a.turn_id = b.turn_id) OR (a.request_id IS NOT NULL AND a.request_id = b.request_id))
WHERE a.source_kind IN {_LIFE} AND b.source_kind NOT IN ('final_request_counter', 'subagent_stop', 'subagent_lifecycle_counter', 'hermes_snapshot_delta', 'snapshot_delta')"""


@query(f"WITH {t.LEDGER}, act AS (SELECT * FROM ledger WHERE superseded_by IS NULL) {_DUPLICATES}")
def dup_lifecycle(spark, sf_dir):
    return usage.duplicate_lifecycle(t.ledger(spark, sf_dir))


_TURN = "('codex_turn_counter', 'turn_counter', 'turn_summary', 'cumulative_turn_counter')"
_COMPARED = [c for c in TOKENS if c != "cache_write_tokens"]


@query(
    f"""WITH {t.LEDGER}, act AS (SELECT * FROM ledger WHERE superseded_by IS NULL AND turn_id IS NOT NULL),
d AS (SELECT session, turn_id, {', '.join(f'sum(coalesce({c}, 0)) AS d_{c}' for c in _COMPARED)} FROM act WHERE source_kind NOT IN {_TURN} AND source_kind NOT IN {_LIFE} GROUP BY ALL),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, turn_id ORDER BY source_offset) AS nth FROM act WHERE source_kind IN {_TURN}) WHERE nth = 1)
SELECT c.session, c.turn_id, ({' OR '.join(f'coalesce(c.{x}, 0) <> d_{x}' for x in _COMPARED)}) AS conflict FROM c JOIN d ON c.session = d.session AND c.turn_id = d.turn_id"""
)
def counter_conflict(spark, sf_dir):
    return usage.counter_conflicts(t.ledger(spark, sf_dir))


@query(
    f"""WITH {t.LEDGER}, {t.ANOMALIES} SELECT (SELECT count(DISTINCT session) FROM ledger) AS sessions, (SELECT count(*) FROM ledger WHERE superseded_by IS NULL) AS active_events,
(SELECT count(*) FROM anomalies WHERE resolved_at IS NULL AND type <> 'unmapped_source_kind') AS anomalous, (SELECT count(*) FROM anomalies WHERE resolved_at IS NULL AND type = 'unmapped_source_kind') AS notices"""
)
def status_counts(spark, sf_dir):
    l = t.ledger(spark, sf_dir).agg(F.countDistinct("session").alias("sessions"), F.count(F.when(F.col("superseded_by").isNull(), 1)).alias("active_events"))
    return l.crossJoin(usage.anomaly_counts(t.anomalies(spark, sf_dir)))  # one row each


@query(
    f"WITH {t.LEDGER} SELECT source_kind, count(*) AS events, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens, CAST(sum(coalesce(cost_micros, 0)) AS BIGINT) AS cost_micros, array_to_string(list_sort(list_distinct(list(model))), ',') AS models FROM ledger WHERE superseded_by IS NULL GROUP BY source_kind"
)
def adapter_counters(spark, sf_dir):
    s = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    models = F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models")
    return usage.active(t.ledger(spark, sf_dir)).groupBy("source_kind").agg(F.count("*").alias("events"), s("input_tokens"), s("output_tokens"), s("cost_micros"), models)


# Prices.


@query(f"WITH {t.PRICED} SELECT source_offset, model, pricing_version_id, amount_micros FROM priced")
def cost_micros(spark, sf_dir):
    return pricing.price(t.ledger(spark, sf_dir), t.rates(spark)).select("source_offset", "model", "pricing_version_id", "amount_micros")


@query(f"WITH {t.PRICED} SELECT model, split_part(source_timestamp, 'T', 1) AS day, max(pricing_version_id) AS pricing_version_id, count(*) AS events FROM priced GROUP BY ALL")
def price_asof(spark, sf_dir):
    out = pricing.resolve(t.ledger(spark, sf_dir), t.rates(spark))
    return out.groupBy("model", F.substring_index("source_timestamp", "T", 1).alias("day")).agg(F.max("pricing_version_id").alias("pricing_version_id"), F.count("*").alias("events"))


@query(f"WITH {t.PRICED}, a AS (SELECT * FROM priced WHERE superseded_by IS NULL) SELECT count(*) FILTER (WHERE amount_micros IS NOT NULL AND source_offset % 3 > 0) AS priced, count(*) FILTER (WHERE amount_micros IS NULL) AS unavailable, count(*) FILTER (WHERE amount_micros IS NOT NULL AND source_offset % 3 = 0) AS already FROM a")
def price_apply(spark, sf_dir):
    events, rates = t.ledger(spark, sf_dir), t.rates(spark)
    before, _ = pricing.apply_prices(events.where("source_offset % 3 = 0"), rates)
    return pricing.apply_prices(events, rates, before)[1]


@query(
    f"WITH {t.OBS} SELECT usage_event_id, calculated_at, pricing_version_id, amount_micros FROM (SELECT *, row_number() OVER (PARTITION BY usage_event_id ORDER BY calculated_at DESC, pricing_version_id DESC) AS nth FROM (SELECT session || turn_id AS usage_event_id, source_timestamp AS calculated_at, model || CAST(source_offset AS VARCHAR) AS pricing_version_id, cost_micros AS amount_micros FROM obs WHERE cost_micros IS NOT NULL)) WHERE nth = 1"
)
def latest_cost(spark, sf_dir):
    o = t.observations(spark, sf_dir).where("cost_micros is not null")
    return pricing.latest_costs(o.select(F.concat("session", "turn_id").alias("usage_event_id"), F.col("source_timestamp").alias("calculated_at"), F.concat("model", F.col("source_offset").cast("string")).alias("pricing_version_id"), F.col("cost_micros").alias("amount_micros")))


@query(
    "SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT) * 1000) AS BIGINT) AS tokens, CAST(sum((CAST(l_quantity AS BIGINT) * 1000 * (1500000 + 250000 * (l_partkey % 7)) + 500000) // 1000000) AS BIGINT) AS amount_micros, count(*) AS requests FROM lineitem GROUP BY l_orderkey"
)
def line_costs(spark, sf_dir):
    """The large fact: lines as requests, quantity as tokens, part as model."""
    tokens = F.col("l_quantity").cast("long") * 1000
    rate = 1_500_000 + 250_000 * (F.col("l_partkey") % 7)
    priced = t.read(spark, sf_dir, "lineitem").select("l_orderkey", tokens.alias("tokens"), money.div(tokens * rate + 500_000, 1_000_000).alias("amount_micros"))
    return priced.groupBy("l_orderkey").agg(F.sum("tokens").alias("tokens"), F.sum("amount_micros").alias("amount_micros"), F.count("*").alias("requests"))


# Attribution and trees.


@query(f"WITH {t.LEDGER}, {t.SPANS} SELECT work_item_id, CAST(sum((coalesce(input_tokens, 0) * weight + 5000) // 10000) AS BIGINT) AS input_tokens, count(*) AS spans FROM attributions JOIN spans USING (span_id) JOIN ledger ON ledger.id = spans.usage_event_id GROUP BY work_item_id")
def weighted_attribution(spark, sf_dir):
    met = t.attributions(spark, sf_dir).select("span_id", "work_item_id", "weight").join(t.spans(spark, sf_dir).select("span_id", "usage_event_id"), "span_id").join(t.ledger(spark, sf_dir).select(F.col("id").alias("usage_event_id"), "input_tokens"), "usage_event_id")
    return met.groupBy("work_item_id").agg(F.sum(money.weighted(F.coalesce("input_tokens", F.lit(0)), F.col("weight"))).alias("input_tokens"), F.count("*").alias("spans"))


@query(f"WITH {t.LEDGER}, {t.SPANS} SELECT group_id, CAST(sum(weight) AS BIGINT) AS weight FROM attributions WHERE NOT (ordinal = 1 AND group_id LIKE '%0') GROUP BY group_id HAVING sum(weight) <> 10000")
def group_invariant(spark, sf_dir):
    return attribution.broken_groups(t.attributions(spark, sf_dir).where(~((F.col("ordinal") == 1) & F.col("group_id").endswith("0"))))


@query(
    f"WITH {t.LEDGER}, {t.SPANS}, m AS (SELECT * REPLACE (CASE WHEN work_item_id LIKE 'c%' THEN 'n' || CAST(CAST(substr(work_item_id, 2) AS BIGINT) % 25 AS VARCHAR) ELSE work_item_id END AS work_item_id) FROM attributions) SELECT group_id, work_item_id, CAST(sum(weight) AS BIGINT) AS weight, arg_min(role, ordinal) AS role, CAST(max(confidence) AS DOUBLE) AS confidence FROM m GROUP BY group_id, work_item_id"
)
def merge_weights(spark, sf_dir):
    a = t.attributions(spark, sf_dir)
    own = F.when(F.col("work_item_id").startswith("c"), F.col("work_item_id"))
    return attribution.merge_items(a, own, F.concat(F.lit("n"), (F.expr("try_cast(substring(work_item_id, 2) as bigint)") % 25).cast("string")))


@query(f"WITH {t.LEDGER}, {t.SPANS} SELECT group_id, CASE WHEN work_item_id = 'n3' AND CAST(substr(group_id, 2) AS BIGINT) % 2 = 0 THEN 'new' ELSE work_item_id END AS work_item_id, role, weight FROM attributions")
def split_weights(spark, sf_dir):
    a = t.attributions(spark, sf_dir)
    chosen = a.where((F.col("work_item_id") == "n3") & (F.substring("group_id", 2, 20).cast("long") % 2 == 0)).select("group_id")
    return attribution.split_item(a, chosen, F.lit("n3"), F.lit("new")).select("group_id", "work_item_id", "role", "weight")


@query(f"WITH {t.LEDGER} SELECT 'span_' || substr(sha256(id), 1, 24) AS span_id, 'group_' || substr(sha256('span_' || substr(sha256(id), 1, 24) || ':1'), 1, 24) AS group_id, id AS usage_event_id, CASE WHEN measured THEN 'measured' ELSE 'unavailable' END AS measurement_status FROM ledger WHERE superseded_by IS NULL AND source_kind NOT IN {_LIFE}")
def default_attribution(spark, sf_dir):
    spans, groups, _ = attribution.default_attribution(t.ledger(spark, sf_dir), None, F.lit("uncategorized"))
    return spans.join(groups.select("group_id", "span_id"), "span_id").select("span_id", "group_id", "usage_event_id", "measurement_status")


_CLOSURE = "RECURSIVE up(id, ancestor) AS (SELECT id, id FROM items UNION ALL SELECT up.id, i.parent_id FROM up JOIN items i ON up.ancestor = i.id WHERE i.parent_id IS NOT NULL)"


@query(f"WITH RECURSIVE {t.ITEMS}, {_CLOSURE[10:]} SELECT id, ancestor FROM up")
def tree_closure(spark, sf_dir):
    return tree.closure(tree.paths(t.items(spark, sf_dir)))


def _direct_sql(policy: str) -> str:
    hidden = "(is_lifecycle OR is_covered" + ("" if policy == "Independent" else " OR is_subagent") + ")"
    request = "(NOT is_lifecycle AND NOT is_covered AND NOT is_delta" + (" AND NOT is_subagent" if policy == "AlreadyInParent" else "") + ")"
    unknown = "is_subagent" if policy == "Unknown" else "false"
    one = lambda c: f"CAST(coalesce(sum(CASE WHEN {c} THEN 1 ELSE 0 END), 0) AS BIGINT)"
    share = lambda c: f"CAST(coalesce(sum(CASE WHEN NOT {hidden} THEN ({c} * weight + 5000) // 10000 END), 0) AS BIGINT)"
    return f"""met AS (SELECT a.*, s.measurement_status, f.* EXCLUDE (session), p.amount_micros FROM attributions a JOIN spans s USING (span_id) JOIN flags f ON f.id = s.usage_event_id LEFT JOIN costs p ON p.id = f.id),
own AS (SELECT work_item_id AS id, {', '.join(f'{share(c)} AS {c}' for c in TOKENS)}, {one(request)} AS requests, {one(f"{request} AND NOT {unknown} AND measurement_status = 'measured'")} AS measured, {one(f"{request} AND ({unknown} OR measurement_status <> 'measured')")} AS unavailable,
  {one(f'NOT {hidden} AND amount_micros IS NOT NULL')} AS priced, {share('amount_micros')} AS amount_micros FROM met GROUP BY work_item_id),
an AS (SELECT x.id, sum(n) AS anomalous FROM (SELECT DISTINCT work_item_id AS id, session FROM attributions JOIN spans USING (span_id)) x JOIN (SELECT session, count(DISTINCT anomaly_id) AS n FROM anomalies WHERE resolved_at IS NULL AND type <> 'unmapped_source_kind' GROUP BY session) y ON x.session = y.session GROUP BY x.id),
direct AS (SELECT i.id, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in tree.TOTALS)} FROM items i LEFT JOIN own ON own.id = i.id LEFT JOIN an ON an.id = i.id)"""


_TREE = "WITH RECURSIVE " + t.FLAGS + ", " + t.PRICED[len(t.LEDGER) + 2 :] + ", costs AS (SELECT id, amount_micros FROM priced WHERE amount_micros IS NOT NULL), " + ", ".join((t.SPANS, t.ANOMALIES, t.ITEMS)) + ", "


def _direct(spark, sf_dir, policy):
    """The ledger is read and priced once; flags, costs, spans and attributions are parts of it."""
    kept = ["id", "session", "turn_id", "source_kind", "parent_agent_id", "superseded_by", "source_offset", *TOKENS]
    events = cut(pricing.price(t.ledger(spark, sf_dir), t.rates(spark)).select(*kept, "amount_micros"))
    costs = events.where("amount_micros is not null").select(F.col("id").alias("usage_event_id"), "amount_micros")
    flags = usage.flagged(events.select(*kept), t.sessions(spark, sf_dir)).select("id", "session", "is_lifecycle", "is_delta", "is_subagent", "is_covered", "measured", *TOKENS)
    spans = t.spans(spark, sf_dir, events).select("span_id", "usage_event_id", "session", "measurement_status")
    return tree.direct_totals(t.items(spark, sf_dir), t.attributions(spark, sf_dir, events).select("span_id", "work_item_id", "weight"), spans, flags, costs, t.anomalies(spark, sf_dir), policy)


@query(_TREE + ", ".join((_direct_sql("Unknown"),)) + f" SELECT id, {', '.join(tree.TOTALS)} FROM direct")
def tree_policy_matrix(spark, sf_dir):
    return _direct(spark, sf_dir, "Unknown")


@query(_TREE + _direct_sql("AlreadyInParent") + f" SELECT id, {', '.join(tree.TOTALS)} FROM direct")
def tree_already_in_parent(spark, sf_dir):
    return _direct(spark, sf_dir, "AlreadyInParent")


@query(_TREE + _direct_sql("Independent") + f", {_CLOSURE[10:]} SELECT up.ancestor AS id, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in tree.TOTALS)} FROM up JOIN direct ON direct.id = up.id GROUP BY up.ancestor")
def tree_inclusive(spark, sf_dir):
    return tree.inclusive(_direct(spark, sf_dir, "Independent"), tree.paths(t.items(spark, sf_dir)), tree.TOTALS)


@query(_TREE + _direct_sql("Independent") + " SELECT id, CAST(anomalous AS BIGINT) AS anomalous FROM an")
def anomalies_per_item(spark, sf_dir):
    return tree.anomalies_of_items(t.attributions(spark, sf_dir), t.spans(spark, sf_dir).select("span_id", "session"), t.anomalies(spark, sf_dir))


@query(f"WITH {t.ITEMS} SELECT id, title FROM items WHERE id = 'n7' OR contains(lower(title), lower('AN'))")
def project_filter(spark, sf_dir):
    from costgrain.operators.projects import matching

    items = t.items(spark, sf_dir)
    return matching(items, "n7", "id", "title").unionByName(matching(items.where("id <> 'n7'"), "AN", "id", "title")).select("id", "title")


# Upkeep.


@query("SELECT user_id AS path, max(event_id) AS source_offset, arg_max(event_type, event_id) AS state FROM events GROUP BY user_id")
def checkpoint_upsert(spark, sf_dir):
    """Of old and new checkpoints of a path the one that came last stays."""
    from costgrain.operators.upkeep import upsert

    e = t.read(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("source_offset"), F.col("event_type").alias("state"))
    return upsert(e.where("source_offset % 2 = 0"), e.where("source_offset % 2 = 1"), ["path"], "source_offset")


@query("SELECT user_id AS session FROM events GROUP BY user_id HAVING bool_or(event_id % 10 = 0) AND bool_or(event_type = 'purchase' AND event_id % 4 = 0)")
def generation_conflict(spark, sf_dir):
    from costgrain.operators.upkeep import generation_conflicts

    e = t.read(spark, sf_dir, "events")
    stored = e.select(F.col("user_id").alias("session"), F.when(F.col("event_id") % 10 == 0, "0.2.0").otherwise("0.3.0").alias("parser_version"))
    incoming = e.where((F.col("event_type") == "purchase") & (F.col("event_id") % 4 == 0)).select(F.col("user_id").alias("session")).distinct()
    return generation_conflicts(stored, incoming, "0.3.0", ["0.2.0"])


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'snapshot_delta' WHEN 'click' THEN 'transcript_request' ELSE event_type END AS source_kind, event_type IN ('view', 'click') AS migrated, event_type NOT IN ('view', 'click') AS unmapped FROM events")
def vocab_migration(spark, sf_dir):
    from costgrain.operators.upkeep import migrate_kinds

    e = t.read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("source_kind"))
    return migrate_kinds(e, {"view": "snapshot_delta", "click": "transcript_request"}).select("event_id", "source_kind", "migrated", "unmapped")


@query("SELECT count(*) AS backup_rows FROM events WHERE event_type IN ('view', 'click')")
def backup_rows(spark, sf_dir):
    from costgrain.operators import upkeep

    e = t.read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("source_kind"))
    moved = upkeep.migrate_kinds(e, {"view": "snapshot_delta", "click": "transcript_request", "error": "error"})
    return upkeep.backup_rows(spark, upkeep.backup_of(moved, "event_id"))


@query("SELECT 'f' || CAST(doc_id AS VARCHAR) AS source_path, sha256(text) AS content_hash FROM documents WHERE doc_id % 4 > 0 OR text IS NULL")
def changed_files(spark, sf_dir):
    """Of four files one is as its checkpoint says; one has other content, one came by an old parser, one is new."""
    from costgrain.sources import files

    d = t.read(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("source_path"), F.col("text").alias("content"), F.col("doc_id") % 4).toDF("source_path", "content", "k")
    stored = files.hashed(d.where("k = 0"), "v2").unionByName(files.hashed(d.where("k = 1").withColumn("content", F.concat("content", F.lit("x"))), "v2")).unionByName(files.hashed(d.where("k = 2"), "v1"))
    return files.changed(d, stored.select("source_path", "content_hash", "parser_version"), "v2").select("source_path", "content_hash")


@query(
    f"WITH {t.LEDGER}, {t.SESSIONS} SELECT 'negative_tokens' AS rule, count(*) AS rows FROM ledger WHERE least(coalesce(input_tokens, 0), coalesce(cached_input_tokens, 0), coalesce(cache_write_tokens, 0), coalesce(output_tokens, 0), coalesce(reasoning_tokens, 0)) < 0 UNION ALL SELECT 'missing_session', count(*) FROM ledger WHERE session IS NULL UNION ALL SELECT 'unknown_session', count(*) FROM ledger WHERE session IS NOT NULL AND session NOT IN (SELECT session FROM sessions WHERE session NOT LIKE '%7') UNION ALL SELECT 'orphan_agent', count(*) FROM ledger WHERE parent_agent_id IS NOT NULL AND agent_id IS NULL"
)
def integrity_checks(spark, sf_dir):
    from costgrain.operators.upkeep import integrity

    return integrity(t.ledger(spark, sf_dir), t.sessions(spark, sf_dir).where("session not like '%7'"))


@query(
    """WITH h AS (SELECT user_id, event_id, event_type = 'view' AS opens FROM events WHERE event_type IN ('view', 'purchase')),
s AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER w AS total FROM h WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
d AS (SELECT *, total - least(0, min(total) OVER w) AS depth FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
l AS (SELECT *, CASE WHEN opens THEN depth ELSE coalesce(lag(depth) OVER w, 0) END AS level FROM d WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
p AS (SELECT *, lead(opens) OVER w AS next_opens, lead(event_id) OVER w AS next_id FROM l WINDOW w AS (PARTITION BY user_id, level ORDER BY event_id))
SELECT user_id, event_id AS turn, CASE WHEN NOT next_opens THEN next_id END AS ended_by FROM p WHERE opens"""
)
def hook_session_state(spark, sf_dir):
    """Prompts open turns; a stop ends the last open one."""
    from costgrain.operators.upkeep import turns_of_hooks

    e = t.read(spark, sf_dir, "events").where("event_type in ('view', 'purchase')")
    hooks = e.select("user_id", "event_id", F.when(F.col("event_type") == "view", "UserPromptSubmit").otherwise("Stop").alias("kind"))
    return turns_of_hooks(hooks, ["user_id"], "event_id").select("user_id", F.col("event_id").alias("turn"), "ended_by")


# Text.


@query("SELECT p_partkey, CAST(CAST(round(p_retailprice * 100) AS BIGINT) * 10000 AS VARCHAR) AS raw, CAST((m + 5000) // 10000 // 100 AS VARCHAR) || '.' || lpad(CAST((m + 5000) // 10000 % 100 AS VARCHAR), 2, '0') AS cents, CAST((m + 500000) // 1000000 AS VARCHAR) AS whole FROM (SELECT *, CAST(round(p_retailprice * 100) AS BIGINT) * 10000 + p_partkey * 777 AS m FROM part)")
def fmt_dollars(spark, sf_dir):
    cents = F.round(F.col("p_retailprice") * 100).cast("long") * 10_000
    m = cents + F.col("p_partkey") * 777
    return t.read(spark, sf_dir, "part").select("p_partkey", cents.cast("string").alias("raw"), money.dollars(m, 2).alias("cents"), money.dollars(m, 0).alias("whole"))


@query("SELECT p_partkey, array_to_string(list_transform(list_filter(string_split_regex(replace(replace(p_name || '-x_' || p_brand, '-', ' '), '_', ' '), '\\s+'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ') AS title, trim(regexp_replace(lower(p_name || '#' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def title_slug(spark, sf_dir):
    name = F.concat("p_name", F.lit("-x_"), "p_brand")
    return t.read(spark, sf_dir, "part").select("p_partkey", text.title(name).alias("title"), text.slug(F.concat("p_name", F.lit("#"), "p_brand")).alias("slug"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages""")
def html_escape(spark, sf_dir):
    return t.read(spark, sf_dir, "pages").select("page_id", text.html_escape(F.col("html")).alias("escaped"))


@query("""SELECT page_id, CASE WHEN regexp_matches(x, '^[\\t\\r\\n]') OR regexp_matches(x, '^\\s*[=+\\-@|%]') THEN '''' ELSE '' END || replace(x, '"', '""') AS escaped FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '=' WHEN 1 THEN '  +' WHEN 2 THEN chr(9) ELSE '' END || html AS x FROM pages)""")
def csv_escape(spark, sf_dir):
    head = F.when(F.col("page_id") % 5 == 0, "=").when(F.col("page_id") % 5 == 1, "  +").when(F.col("page_id") % 5 == 2, "\t").otherwise("")
    return t.read(spark, sf_dir, "pages").select("page_id", text.csv_escape(F.concat(head, "html")).alias("escaped"))


_CANARY = "CASE doc_id % 7 WHEN 0 THEN ' ghp_abc' WHEN 1 THEN ' \"Raw_Prompt\"' WHEN 2 THEN ' \"raw_prompt\" \"prompt_storage_mode\"' ELSE '' END"


@query(f"""SELECT doc_id, contains(x, 'CANARY_SECRET') OR contains(x, 'CANARY_LEAK') OR contains(x, 'SUPER_SECRET') OR contains(x, 'sk-proj-') OR contains(x, 'ghp_') OR contains(x, 'BEGIN PRIVATE KEY') OR ((contains(lower(x), '"raw_prompt"') OR contains(lower(x), '"raw_completion"') OR contains(lower(x), '"user_prompt_content"')) AND NOT contains(x, '"prompt_storage_mode"')) AS leak FROM (SELECT doc_id, text || {_CANARY} AS x FROM documents)""")
def leak_audit(spark, sf_dir):
    d = F.col("doc_id") % 7
    tail = F.when(d == 0, " ghp_abc").when(d == 1, ' "Raw_Prompt"').when(d == 2, ' "raw_prompt" "prompt_storage_mode"').otherwise("")
    return t.read(spark, sf_dir, "documents").select("doc_id", text.leaks(F.concat("text", tail)).alias("leak"))


_SPOOL = {
    0: '{"prompt": "all of it", "session_id": "s"}',
    1: '{"prompt": "", "session_id": "s"}',
    2: '{"prompt": 5}',
    3: '{"raw_prompt": null, "prompt_storage_mode": "none"}',
    4: '{"completion": "said"}',
    5: '{"prompt": "broken',
    6: '{"payload": {"prompt": "within"}}',
    7: '{"prompt": {"a": "b"}, "completion": null}',
}
_SPOOLED = "CASE doc_id % 9 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _SPOOL.items()) + f" ELSE text || {_CANARY} END"


@query(f"""WITH x AS (SELECT doc_id, {_SPOOLED} AS x FROM documents), j AS (SELECT *, CASE WHEN json_valid(x) THEN x ELSE '{{}}' END AS j FROM x)
SELECT doc_id, contains(x, 'CANARY_SECRET') OR contains(x, 'CANARY_LEAK') OR contains(x, 'SUPER_SECRET') OR contains(x, 'sk-proj-') OR contains(x, 'ghp_') OR contains(x, 'BEGIN PRIVATE KEY') OR ((contains(lower(x), '"raw_prompt"') OR contains(lower(x), '"raw_completion"') OR contains(lower(x), '"user_prompt_content"')) AND NOT contains(x, '"prompt_storage_mode"'))
OR coalesce(json_type(j, '$.prompt') = 'VARCHAR' AND json_extract_string(j, '$.prompt') <> '', false) OR coalesce(json_type(j, '$.completion') = 'VARCHAR' AND json_extract_string(j, '$.completion') <> '', false) OR json_exists(j, '$.raw_prompt') OR json_exists(j, '$.raw_completion') AS leak FROM j""")
def spool_leak_audit(spark, sf_dir):
    d = F.col("doc_id") % 7
    tail = F.when(d == 0, " ghp_abc").when(d == 1, ' "Raw_Prompt"').when(d == 2, ' "raw_prompt" "prompt_storage_mode"').otherwise("")
    line = F.concat("text", tail)
    for k, v in _SPOOL.items():
        line = F.when(F.col("doc_id") % 9 == k, v).otherwise(line)
    return t.read(spark, sf_dir, "documents").select("doc_id", text.spool_leaks(line).alias("leak"))


_PHRASES = ["switch to the", "the switch case of", "please benchmark", "extract this", "commit", "fix it", "nothing else", "unrelated"]
_PHRASE_SQL = "CASE (conv_id + turn) % 8 " + " ".join(f"WHEN {k} THEN '{p} '" for k, p in enumerate(_PHRASES)) + " END || role"


@query(
    f"""SELECT conv_id, turn, outcome, CAST(CASE outcome WHEN 'SWITCH' THEN 0.92 WHEN 'CHILD' THEN 0.90 WHEN 'CONTINUE' THEN 0.82 ELSE 0.45 END AS DOUBLE) AS score FROM (SELECT conv_id, turn, CASE WHEN turn % 6 = 5 OR (NOT ns AND (contains(x, 'switch to') OR contains(x, 'unrelated'))) THEN 'SWITCH' WHEN turn % 2 = 0 AND (contains(x, 'benchmark') OR contains(x, 'extract')) THEN 'CHILD' WHEN contains(x, 'that') OR regexp_matches(x, '(^|[^a-z0-9])it($|[^a-z0-9])') OR ns THEN 'CONTINUE' ELSE 'UNCERTAIN' END AS outcome
FROM (SELECT conv_id, turn, lower({_PHRASE_SQL}) AS x, contains(lower({_PHRASE_SQL}), 'switch case') AS ns FROM conversations))"""
)
def classify_boundary(spark, sf_dir):
    c = t.read(spark, sf_dir, "conversations")
    phrase = F.get(F.array(*(F.lit(p + " ") for p in _PHRASES)), ((F.col("conv_id") + F.col("turn")) % 8).cast("int"))
    found = text.boundary(F.concat(phrase, "role"), F.col("turn") % 2 == 0, F.col("turn") % 6 == 5, F.lit(False))
    return c.select("conv_id", "turn", found["outcome"].alias("outcome"), found["score"].cast("double").alias("score"))


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
#: What is put before a text: assignments of which one may hold the next one's name as its value.
_ASSIGNED = ["", "Token = token = ", "token = x ", "password : API_KEY = ", "see https://x.y ghp_12345678 ", "the token=abc of ", "sk-12345678 = ", "token ="]


@query(
    f"""WITH a AS (SELECT doc_id, list_filter(string_split_regex(CASE doc_id % 8 {" ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_ASSIGNED))} END || text, '\\s+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT *, list_filter(range(1, len(w) + 1), lambda i: {_LOW.format('w[i]')} IN ('api_key', 'token', 'password') AND w[i + 1] IN ('=', ':') AND w[i + 2] IS NOT NULL) AS opens FROM a),
c AS (SELECT *, CASE WHEN len(opens) = 0 THEN [] ELSE list_reduce(list_transform(opens, lambda i: [i]), lambda x, y: CASE WHEN y[1] > x[-1] + 2 THEN list_concat(x, y) ELSE x END) END AS kept FROM b),
d AS (SELECT doc_id, list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_contains(kept, i - 1) OR list_contains(kept, i - 2) THEN ''
  WHEN list_contains(kept, i) OR (strlen(w[i]) >= 10 AND regexp_matches({_LOW.format('w[i]')}, '^(sk-|ghp_|gho_|ghu_|ghs_|ghr_)')) OR regexp_matches({_LOW.format('w[i]')}, '^(api_key|apikey|token|password).*[=:]') THEN '[redacted]'
  WHEN regexp_matches(w[i], '^https?://') THEN '' ELSE regexp_replace(w[i], '[^\\p{{L}}\\p{{N}}\\[\\]\\-]', ' ', 'g') END) AS m FROM c),
e AS (SELECT doc_id, list_filter(string_split_regex(array_to_string(m, ' '), '\\s+'), lambda x: x <> '' AND (x = '[redacted]' OR {_LOW.format('x')} NOT IN ({_STOPS})))[1:8] AS x FROM d)
SELECT doc_id, array_to_string(list_concat(x, ['work', 'work', 'work'][1:greatest(0, 3 - len(x))]), ' ') AS label FROM e"""
)
def redact_label(spark, sf_dir):
    """Labels of whole texts, before some of which stand secrets and assignments."""
    d = t.read(spark, sf_dir, "documents")
    head = F.get(F.array(*map(F.lit, _ASSIGNED)), (F.col("doc_id") % 8).cast("int"))
    return d.select("doc_id", text.redacted_label(F.concat(head, "text")).alias("label"))


_PREDICTED = "CASE WHEN d.n_chars IS NULL THEN NULL WHEN d.doc_id % 10 = 0 THEN NULL WHEN contains(d.text, '!!') OR contains(d.text, '|') THEN 0 ELSE 1 END"


@query(
    f"""WITH p AS (SELECT l.quality AS expected, {_PREDICTED} AS predicted FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id), c AS (SELECT unnest([0, 1]) AS label)
SELECT label, count(*) FILTER (WHERE expected = label AND predicted = label) AS tp, count(*) FILTER (WHERE expected <> label AND predicted = label) AS fp, count(*) FILTER (WHERE expected = label AND predicted IS DISTINCT FROM label) AS fn, count(*) FILTER (WHERE predicted IS NULL AND expected = label) AS missing FROM c, p GROUP BY label"""
)
def confusion_matrix(spark, sf_dir):
    from costgrain.operators.evaluation import confusion

    d = t.read(spark, sf_dir, "documents")
    made = F.when(F.col("doc_id") % 10 == 0, F.lit(None)).when(F.contains("text", F.lit("!!")) | F.contains("text", F.lit("|")), 0).otherwise(1)
    return confusion(t.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("expected")), d.select(F.col("doc_id").alias("id"), made.alias("predicted")).where("predicted is not null"))


@query(
    """WITH p AS (SELECT l.doc_id, CAST(l.quality AS VARCHAR) AS expected, l.doc_id % 3 = 0 AS moved_later, CASE WHEN l.doc_id % 10 > 0 THEN CAST(l.doc_id % 2 AS VARCHAR) END AS predicted, CASE WHEN l.doc_id % 10 > 0 THEN CAST(l.doc_id % 10 AS DOUBLE) / 10 END AS confidence FROM labels l)
SELECT count(*) AS total, count(*) FILTER (WHERE predicted = expected) AS correct, count(*) FILTER (WHERE predicted IS NULL) AS missing, CAST(count(*) FILTER (WHERE predicted = expected) AS DOUBLE) / count(*) AS accuracy, CAST(count(*) FILTER (WHERE predicted IS DISTINCT FROM expected) AS DOUBLE) / count(*) AS error_rate, CAST(100 * count(*) FILTER (WHERE confidence >= 0.8 AND moved_later) AS DOUBLE) / count(*) FILTER (WHERE confidence >= 0.8) AS moved_percent FROM p"""
)
def evaluation_summary(spark, sf_dir):
    """Labels and predictions come as JSON lines, some of them blank."""
    from costgrain.operators import evaluation

    d, known = F.col("doc_id"), t.read(spark, sf_dir, "labels")
    lines = lambda rows, *fields: rows.select(F.explode(F.array(F.to_json(F.struct(*fields)), F.lit("  "))).alias("line"))
    name = d.cast("string").alias("id")
    labels = lines(known, name, F.col("quality").cast("string").alias("expected"), (d % 3 == 0).alias("moved_later"))
    made = lines(known.where(d % 10 > 0), name, (d % 2).cast("string").alias("predicted"), ((d % 10).cast("double") / 10).alias("confidence"))
    return evaluation.summary(evaluation.rows_of(labels, evaluation.LABEL), evaluation.rows_of(made, evaluation.PREDICTION))


# Projects.


@query(
    """WITH s AS (SELECT 's' || CAST(c_custkey AS VARCHAR) AS session, CASE WHEN c_custkey % 11 > 0 THEN '/w/' || CAST(c_nationkey AS VARCHAR) || '/' || CAST(c_custkey AS VARCHAR) END AS cwd, CASE WHEN c_custkey % 13 = 0 THEN 'told' END AS override_key, CASE WHEN c_custkey % 17 = 0 THEN 'known' END AS verified_key, c_nationkey AS n, c_custkey AS c FROM customer)
SELECT session, CASE WHEN override_key IS NOT NULL THEN override_key WHEN verified_key IS NOT NULL THEN verified_key WHEN cwd IS NULL THEN 'personal-unassigned' WHEN c % 10 = 0 THEN 'c' || CAST(c AS VARCHAR) WHEN n < 12 THEN 'n' || CAST(n AS VARCHAR) ELSE cwd END AS project_id,
CASE WHEN override_key IS NOT NULL THEN 'override' WHEN verified_key IS NOT NULL THEN 'verified' WHEN cwd IS NULL THEN 'inbox' WHEN c % 10 = 0 THEN 'config' WHEN n < 12 THEN 'git' ELSE 'cwd' END AS method FROM s"""
)
def project_resolution(spark, sf_dir):
    from costgrain.operators.projects import resolve

    c = t.read(spark, sf_dir, "customer")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    cwd = F.concat(F.lit("/w/"), nation.cast("string"), F.lit("/"), key.cast("string"))
    sessions = c.select(F.concat(F.lit("s"), key.cast("string")).alias("session"), F.when(key % 11 > 0, cwd).alias("cwd"), F.when(key % 13 == 0, "told").alias("override_key"), F.when(key % 17 == 0, "known").alias("verified_key"))
    own = c.where("c_custkey % 10 = 0").select(cwd.alias("path"), F.concat(F.lit("c"), key.cast("string")).alias("project_id"), F.lit("config").alias("root_type"), F.lit(True).alias("active"))
    nations = t.read(spark, sf_dir, "nation").select(F.concat(F.lit("/w/"), F.col("n_nationkey").cast("string")).alias("path"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("project_id"), F.lit("git").alias("root_type"), (F.col("n_nationkey") < 12).alias("active"))
    return resolve(sessions, own.unionByName(nations)).select("session", "project_id", "method")


@query("SELECT user_id AS project_id, event_type AS path, arg_max(event_id % 3 > 0, event_id) AS active, arg_max(CASE WHEN event_id % 2 = 0 THEN 'git' ELSE 'cwd' END, event_id) AS root_type, min(event_id) AS first_seen, max(event_id) AS last_seen FROM events GROUP BY ALL")
def project_roots(spark, sf_dir):
    from costgrain.operators.projects import current_roots

    n = F.col("event_id")
    changes = t.read(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), F.col("event_type").alias("path"), n.alias("at"), n.alias("n"), (n % 3 > 0).alias("active"), F.when(n % 2 == 0, "git").otherwise("cwd").alias("root_type"))
    return current_roots(changes)


@query(
    f"""WITH {t.ITEMS}, v AS (SELECT 'c' || CAST(o_custkey AS VARCHAR) AS id, CASE o_orderkey % 3 WHEN 0 THEN 'title' ELSE 'parent_id' END AS field, CASE o_orderkey % 3 WHEN 0 THEN 'T' || CAST(o_orderkey AS VARCHAR) WHEN 1 THEN 'n' || CAST(o_orderkey % 25 AS VARCHAR) ELSE 'c' || CAST(o_custkey AS VARCHAR) END AS value, o_orderkey AS version FROM orders),
l AS (SELECT id, field, arg_max(value, version) AS value FROM v WHERE NOT (field = 'parent_id' AND value = id) GROUP BY ALL)
SELECT i.id, coalesce(a.value, i.title) AS title, coalesce(b.value, i.parent_id) AS parent_id FROM items i LEFT JOIN l a ON a.id = i.id AND a.field = 'title' LEFT JOIN l b ON b.id = i.id AND b.field = 'parent_id'"""
)
def item_versions(spark, sf_dir):
    from costgrain.operators.projects import current_items

    k, me = F.col("o_orderkey"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    value = F.when(k % 3 == 0, F.concat(F.lit("T"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("n"), (k % 25).cast("string"))).otherwise(me)
    versions = t.read(spark, sf_dir, "orders").select(me.alias("id"), F.when(k % 3 == 0, "title").otherwise("parent_id").alias("field"), value.alias("value"), k.alias("version"))
    items = t.items(spark, sf_dir).withColumn("type", F.lit("task"))
    return current_items(items, versions).select("id", "title", "parent_id")


@query(
    f"""WITH {t.LEDGER}, {t.ANOMALIES}, act AS (SELECT * FROM ledger WHERE superseded_by IS NULL),
r AS (SELECT request_id FROM act WHERE request_id IS NOT NULL AND source_kind NOT IN ('hermes_snapshot_delta', 'snapshot_delta') GROUP BY request_id HAVING count(*) > 1),
l AS ({_DUPLICATES})
SELECT (SELECT count(DISTINCT session) FROM ledger) AS sessions, (SELECT count(*) FROM r) AS duplicate_requests, (SELECT count(*) FROM l) AS duplicate_lifecycle,
(SELECT count(*) FROM anomalies WHERE resolved_at IS NULL) AS open_anomalies, 'verified: child tokens included in parent (no double-counting)' AS subagents"""
)
def reconcile_report(spark, sf_dir):
    from costgrain.operators.projects import reconcile

    name = "subagent_tokens_already_in_parent"
    known = spark.createDataFrame([(name, "unknown", None, "2024-01-01"), (name, "available", ' {"already_in_parent": true}', "2024-01-02")], "capability string, state string, detail string, checked_at string")
    return reconcile(t.ledger(spark, sf_dir), t.anomalies(spark, sf_dir), known)


@query(f"WITH {t.LEDGER}, {t.SPANS}, {t.ITEMS} SELECT (SELECT count(DISTINCT group_id) FROM attributions WHERE work_item_id = 'n3') AS groups, (SELECT count(DISTINCT span_id) FROM attributions WHERE work_item_id = 'n3') AS spans, (SELECT count(*) FROM items WHERE parent_id = 'n3') AS children, (SELECT count(*) FROM orders WHERE o_custkey % 25 = 3) AS notes")
def merge_plan(spark, sf_dir):
    from costgrain.operators.projects import merge_plan as plan

    notes = t.read(spark, sf_dir, "orders").select(F.concat(F.lit("n"), (F.col("o_custkey") % 25).cast("string")).alias("work_item_id"))
    return plan(t.attributions(spark, sf_dir), t.items(spark, sf_dir), notes, "n3")


@query(f"WITH {t.LEDGER}, {t.SPANS} SELECT span_id FROM spans WHERE source_offset % 4 = 0 AND span_id NOT IN (SELECT span_id FROM attributions WHERE work_item_id = 'n3')")
def split_check(spark, sf_dir):
    from costgrain.operators.projects import missing_spans

    return missing_spans(t.attributions(spark, sf_dir), t.spans(spark, sf_dir).where("source_offset % 4 = 0"), "n3")


_LEAK_SQL = "contains(x, 'CANARY_SECRET') OR contains(x, 'sk-proj-') OR contains(x, 'ghp_')"


@query(f"SELECT 'pages' AS \"table\", 'html' AS \"column\", CAST(page_id AS VARCHAR) AS id FROM (SELECT page_id, html || CASE WHEN page_id % 9 = 0 THEN 'sk-proj-x' ELSE '' END AS x FROM pages) WHERE {_LEAK_SQL} UNION ALL SELECT 'pages', 'url', CAST(page_id AS VARCHAR) FROM (SELECT page_id, url || CASE WHEN page_id % 8 = 0 THEN 'ghp_' ELSE '' END AS x FROM pages) WHERE {_LEAK_SQL}")
def leak_tables(spark, sf_dir):
    from costgrain.operators.projects import leaks_in

    tail = lambda c, n, s: F.concat(c, F.when(F.col("page_id") % n == 0, s).otherwise(""))
    pages = t.read(spark, sf_dir, "pages").select("page_id", tail(F.col("html"), 9, "sk-proj-x").alias("html"), tail(F.col("url"), 8, "ghp_").alias("url"))
    return leaks_in({"pages": (pages, "page_id", ["html", "url", "no_such_column"])})
