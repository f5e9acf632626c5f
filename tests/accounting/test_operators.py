import datetime
import json

import pytest
from pyspark.sql import functions as F

from costgrain.functions import money, text, vocabulary
from costgrain.functions.vocabulary import TOKENS
from costgrain.operators import attribution, deltas, evaluation, ladder, pricing, tree, upkeep, usage
from costgrain.plans import reports
from costgrain.sources.observation import COLUMNS, SCHEMA


def obs(spark, *rows):
    base = {"adapter": "a", "source": "transcript_request", "session": "s", "source_path": "p", "source_offset": 0}
    full = [{c: None for c in COLUMNS} | base | {"source_offset": n} | r for n, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in full], SCHEMA)


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], f"x {'string' if isinstance(values[0], str) else 'bigint'}")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_ranks():
    assert vocabulary.SOURCE_RANK["official_telemetry"] == 5


def test_stored_ranks(spark):
    kinds = ["hermes_auxiliary_x", "hermes_usage_y", "prototype_json", "codex_rollout", "what", "manual_stop", "grok_turn_failed"]
    assert one(spark, vocabulary.stored_rank, *kinds) == [4, 4, 3, 255, 255, 1, 0]
    assert one(spark, lambda c: vocabulary.source_kind(F.lit("provider_fields"), c), "assistant", "hermes_usage_q", "otel_api_request") == ["provider_fields", "hermes_usage_q", "otel_api_request"]


def test_ladder_prefers_rank_then_measure_then_order(spark):
    rows = obs(
        spark, {"request_id": "r", "input_tokens": 1}, {"request_id": "r", "source": "official_telemetry"}, {"request_id": "r", "source": "official_telemetry", "input_tokens": 3}, {"request_id": "r", "source": "official_telemetry", "input_tokens": 4},
        {"request_id": "r", "session": "other"},
    )
    out = ladder.deduplicate(rows).orderBy("session").collect()
    assert [(r["session"], r["source_offset"]) for r in out] == [("other", 4), ("s", 2)]
    assert {r["identity"]: r["conflicts"] for r in ladder.conflicts(rows).collect()} == {"a:request:s::r": 3, "a:request:other::r": 0}


def test_two_unique_keys_in_order(spark):
    event = lambda r, e: {"request_id": r, "source_event_id": e}
    rows = obs(spark, event("r1", "e1"), event("r2", "e1"), event("r2", "e3"), event("r3", "e3"), event("r1", "e9"))
    # r2/e1 meets e1; so r2/e3 enters; so r3/e3 doesn't; r1/e9 meets r1.
    assert sorted(r["source_offset"] for r in ladder.insert_or_ignore(None, rows).collect()) == [0, 2]


def test_supersede_needs_higher_authority(spark):
    old = ladder.insert_or_ignore(None, obs(spark, {"request_id": "r1"}, {"request_id": "r2", "source_subtype": "codex_rollout", "input_tokens": 1}, {"request_id": "r3", "input_tokens": 2}))
    stored = old.select("*", F.concat(F.lit("id"), "source_offset").alias("id"), F.lit(None).cast("string").alias("logical_event_hash"))
    batch = ladder.deduplicate(obs(spark, *({"request_id": f"r{k}", "source": "provider_fields", "input_tokens": 9} for k in (1, 2, 3, 4))))
    new, links = ladder.supersede(stored, batch)
    # r2's stored kind has no rank, so nothing replaces it; r4 is new.
    assert {(r["request_id"], r["old_id"]) for r in new.collect()} == {("r1", "id0"), ("r3", "id2"), ("r4", None)}
    assert {r["old_id"] for r in links.collect()} == {"id0", "id2"}


def test_policies(spark):
    rows = obs(spark, {"request_id": "p", "input_tokens": 500, "output_tokens": 100}, {"request_id": "c", "parent_agent_id": "x", "input_tokens": 200, "output_tokens": 40})
    flags = usage.flagged(rows.withColumns({"source_kind": F.col("source"), "superseded_by": F.lit(None).cast("string")}))
    got = {p: tuple(usage.totals(flags, p).select("input_tokens", "output_tokens", "requests", "measured", "unavailable").first()) for p in usage.POLICIES}
    assert got == {"AlreadyInParent": (500, 100, 1, 1, 0), "Independent": (700, 140, 2, 2, 0), "Unknown": (500, 100, 2, 1, 1)}
    with pytest.raises(ValueError, match="no"):
        usage.totals(flags, "no")


def test_null_session_falls_out_where_there_are_children(spark):
    rows = obs(spark, {"request_id": "a", "input_tokens": 1}, {"request_id": "b", "session": None, "input_tokens": 2}).withColumns({"source_kind": F.col("source"), "superseded_by": F.lit(None).cast("string")})
    sessions = spark.createDataFrame([("s", "s"), ("k", "s")], "session string, root_session string")
    assert usage.totals(usage.flagged(rows, sessions), "AlreadyInParent").first()["input_tokens"] == 1
    assert usage.totals(usage.flagged(rows, sessions.where("session = 's'")), "AlreadyInParent").first()["input_tokens"] == 3


def test_completeness(spark):
    out = spark.createDataFrame([(8, 1, 1), (0, 0, 0)], "m long, u long, a long").select(usage.completeness(F.col("m"), F.col("u"), F.col("a"))).collect()
    assert [r[0] for r in out] == [80.0, None]


def rates(spark, *rows):
    names = "pricing_version_id string, model_pattern string, effective_from string, input_rate string, cached_rate string, write_rate string, output_rate string, reasoning_rate string"
    return pricing.rates_in_micros(spark.createDataFrame([(f"v{k}", *r) for k, r in enumerate(rows)], names))


def test_prices(spark):
    table = rates(spark, ("m*", "2026-2-1", "3.00", "0.30", "3.75", "15.00", None), ("m1", "2026-02-01", "1", None, None, "2", None), ("mm*", "2026-03-01", "7", "1", "1", "1", "1"))
    million = dict.fromkeys(TOKENS[:4], 10**6)
    rows = obs(
        spark, {"model": "m", "source_timestamp": "2026-02-01T00:00:00Z"} | million, {"model": "m", "source_timestamp": "2026-01-31T23:00:00Z"} | million, {"model": "m1", "source_timestamp": "2026-05-01"} | {"input_tokens": 1, "output_tokens": 0},
        {"model": "m1", "source_timestamp": "2026-05-01", "cached_input_tokens": 1}, {"model": "mmx", "source_timestamp": "2026-02-15"}, {"model": "mmx", "source_timestamp": "unix-ns:5", "input_tokens": 10**6}, {"model": "zz", "source_timestamp": None},
        {"model": "m", "reasoning_tokens": 1, "source_timestamp": None},
    )
    out = {r["source_offset"]: (r["pricing_version_id"], r["amount_micros"]) for r in pricing.price(rows, table).collect()}
    assert out == {0: ("v0", 22_050_000), 1: (None, None), 2: ("v1", 1), 3: ("v1", None), 4: ("v0", 0), 5: ("v2", 7_000_000), 6: (None, None), 7: ("v0", 15)}


@pytest.mark.parametrize(("rate", "micros"), [("3", 3_000_000), ("0.15", 150_000), ("1.", 1_000_000), ("1.2345678", None), (".5", None), ("-1", None), ("", None), ("0.000001", 1)])
def test_rates(spark, rate, micros):
    out = one(spark, money.rate_to_micros, rate)[0]
    assert (None if out is None else int(out)) == micros


def test_money_text(spark):
    assert one(spark, lambda c: money.dollars(c, 2), 1_234_567, 5_000, 4_999, 0) == ["1.23", "0.01", "0.00", "0.00"]
    assert one(spark, lambda c: money.dollars(c, 6), 1_234_567) == ["1.234567"]
    assert one(spark, lambda c: money.dollars(c, 0), 1_500_000, 1_499_999) == ["2", "1"]
    assert one(spark, money.dollar_text_to_micros, "1.2345675", "1", "0.0000004", "1e3") == [1_234_568, 1_000_000, 0, None]
    assert one(spark, lambda c: money.weighted(c, F.lit(6000)), 1, 10, 10**15) == [1, 6, 6 * 10**14]


def test_mixed_counters(spark):
    rows = obs(spark, *({"input_tokens": v} for v in (10, 5, 30, 4, 32, 50))).withColumn("is_cumulative", F.col("source_offset").isin(0, 2, 4, 5))
    out = deltas.counter_deltas(rows, ["session"], ["source_offset"]).orderBy("source_offset").collect()
    # Base: 10, 15, 30, 34; 32 falls below and counts whole; then 50 - 32.
    assert [(r["input_tokens"], r["reset"]) for r in out] == [(10, False), (5, False), (15, False), (4, False), (32, True), (18, False)]


def test_epochs(spark):
    rows = obs(spark, *({"input_tokens": t, "cost_micros": c} for t, c in ((5, 100), (9, None), (4, 150), (6, 120), (6, 120))))
    out = deltas.epoch_deltas(rows, ["session"], ["source_offset"]).orderBy("source_offset").collect()
    assert [(r["delta_input_tokens"], r["delta_cost_micros"], r["token_epoch"], r["cost_epoch"]) for r in out] == [(5, 100, 0, 0), (4, None, 0, 0), (None, 50, 1, 0), (2, None, 1, 1), (0, None, 1, 1)]


def test_trees(spark):
    items = spark.createDataFrame([("a", None, "p"), ("b", "a", "p"), ("c", "b", "p"), ("d", "x", "p"), ("e", "f", "p"), ("f", "e", "p"), ("g", "a", "q")], "id string, parent_id string, project_id string")
    p = tree.paths(items)
    assert {r["id"]: r["path"] for r in p.collect()} == {"a": ["a"], "b": ["a", "b"], "c": ["a", "b", "c"], "d": ["d"], "g": ["g"]}
    direct = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1 << 62), ("g", 5)], "id string, n long")
    assert {r["id"]: r["n"] for r in tree.inclusive(direct, p, ["n"]).collect()} == {"a": (1 << 62) + 3, "b": (1 << 62) + 2, "c": 1 << 62, "d": 0, "g": 5}
    full = spark.createDataFrame([("a", tree.MOST), ("b", 9)], "id string, n long")
    assert tree.inclusive(full, p, ["n"]).where("id = 'a'").first()["n"] == tree.MOST


def test_attribution(spark):
    events = obs(spark, {"input_tokens": 1}, {"source_subtype": "subagent_stop"}, {}).withColumns({"id": F.concat(F.lit("e"), "source_offset"), "source_kind": F.coalesce("source_subtype", "source"), "superseded_by": F.lit(None).cast("string")})
    spans, groups, rows = attribution.default_attribution(events, None, F.lit("wi"))
    assert sorted((r["usage_event_id"], r["measurement_status"]) for r in spans.collect()) == [("e0", "measured"), ("e2", "unavailable")]
    assert attribution.broken_groups(rows).count() == 0
    assert attribution.default_attribution(events, spans, F.lit("wi"))[0].count() == 0
    more, new = attribution.attach(spans, groups, "s", "other")
    now = attribution.current(groups.unionByName(more))
    assert {r["version"] for r in now.collect()} == {2} and new.count() == 2
    gone = attribution.detach(spans, groups.unionByName(more), "s")
    assert attribution.current(groups.unionByName(more).unionByName(gone)).count() == 0


def test_hooks_pair_like_brackets(spark):
    kinds = ["Stop", "UserPromptSubmit", "UserPromptSubmit", "Stop", "Stop", "Stop", "UserPromptSubmit", "Note", "StopFailure", "UserPromptSubmit"]
    df = spark.createDataFrame([("s", n, k) for n, k in enumerate(kinds)], "s string, n long, kind string")
    out = {r["n"]: r["ended_by"] for r in upkeep.turns_of_hooks(df, ["s"], "n").collect()}
    assert out == {1: 4, 2: 3, 6: 8, 9: None}


def test_confusion(spark):
    labels = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, "B")], "id long, expected string")
    made = spark.createDataFrame([(1, "A"), (2, "B"), (3, "B")], "id long, predicted string")
    m = evaluation.confusion(labels, made)
    assert {tuple(r) for r in m.collect()} == {("A", 1, 0, 1, 0), ("B", 1, 1, 1, 1)}
    assert {r["label"]: (r["precision"], r["recall"]) for r in evaluation.scores(m).collect()} == {"A": (1.0, 0.5), "B": (0.5, 0.5)}


def test_labels_and_boundaries(spark):
    shown = ["please fix sk-abcdefghij and the token = xyz at https://a.b/c now quickly", "it", "TOKEN : x y", "one two three four five six seven eight nine", "password=hunter2 ok"]
    assert one(spark, text.redacted_label, *shown) == ["fix [redacted] [redacted] at quickly", "it work work", "[redacted] y work", "one two three four five six seven eight", "[redacted] ok work"]
    yes, no = F.lit(True), F.lit(False)
    label = lambda c, *k: text.boundary(c, *k)["outcome"]
    assert one(spark, lambda c: label(c, yes, no, no), "switch to x", "the switch case", "Benchmark", "commit", "fix it", "hm") == ["SWITCH", "CONTINUE", "CHILD", "UNCERTAIN", "CONTINUE", "UNCERTAIN"]
    assert one(spark, lambda c: label(c, no, no, yes), "benchmark") == ["UNCERTAIN"]
    assert one(spark, lambda c: label(c, no, yes, no), "hm") == ["SWITCH"]
    assert one(spark, text.title, "@scope/my-tool_x", "--", "éa b") == ["My Tool X", "Personal Unassigned", "Éa B"]
    assert one(spark, text.slug, " Hello, World! ", "***") == ["hello-world", "personal-unassigned"]
    assert one(spark, text.csv_escape, 'a"b', " =x", "\tq", "ok") == ['a""b', "' =x", "'\tq", "ok"]
    assert one(spark, text.html_escape, "<a href='x'>&\"") == ["&lt;a href=&#39;x&#39;&gt;&amp;&quot;"]


def test_reports(spark, tmp_path):
    names = ["id", "parent_id", "project_id", "title", "created_at", *TOKENS, "requests", "measured", "unavailable", "anomalous", "priced", "amount_micros"]
    rows = [("a", None, "p", "=Root", "1", 10, 0, 0, 5, 0, 2, 1, 1, 0, 2, 1_234_567), ("c", "a", "p", "Late", "3", 1, 0, 0, 0, 0, 1, 1, 0, 0, 0, 0), ("b", "a", "p", 'Early"<', "2", 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'string' if k < 5 else 'long'}" for k, n in enumerate(names)))
    nodes = tree.paths(df)
    csv = [r["line"] for r in reports.csv_lines(nodes, {"id": "p", "key": "k", "title": "T"}).orderBy("place").collect()]
    assert csv == ['"p","k","T","a","\'=Root","",10,0,0,5,0,15,2,1,1,1.2346,50.0', '"p","k","T","b","Early""<","a",0,0,0,0,0,0,0,0,0,unavailable,unavailable', '"p","k","T","c","Late","a",1,0,0,0,0,1,1,1,0,unavailable,100.0']
    drawn = [r["line"] for r in reports.text_lines(nodes).orderBy("place").collect()]
    assert drawn[0] == "└── =Root  $1.23 est. API-equivalent · 15 tok · 50% complete · 1 unavailable"
    assert drawn[1].startswith('    ├── Early"<  cost unavailable · 0 tok · — · 0') and drawn[2].startswith("    └── Late  cost unavailable · 1 tok · 100% complete")
    assert "&lt;" in reports.html_rows(nodes).orderBy("place").collect()[1]["line"]
    assert json.loads(reports.json_nodes(nodes).where("id = 'a'").first()["json"])["inclusive"]["requests"] == 2
    reports.write_lines(reports.csv_lines(nodes, {"id": "p", "key": "k", "title": "T"}), str(tmp_path / "out"), reports.HEADER)
    assert spark.read.text(str(tmp_path / "out")).count() == 4


def test_dates(spark):
    out = spark.createDataFrame([("2026-2-1",), ("2026-02-01T10:00:00Z",), ("unix-ns:1",), ("2026-13-01",)], "x string").select(pricing.day(F.col("x"))).collect()
    assert [r[0] for r in out] == [datetime.date(2026, 2, 1)] * 2 + [None, None]


def test_deep_trees_and_cycles(spark):
    from costgrain.operators import tree

    deep = [(f"i{k}", f"i{k - 1}" if k else None, "p", k) for k in range(2_000)]
    odd = [("a", "b", "p", 0), ("b", "a", "p", 0), ("c", "a", "p", 0), ("self", "self", "p", 0), ("other", "i0", "q", 0), ("lost", "nowhere", "p", 0)]
    out = {r["id"]: r["path"] for r in tree.paths(spark.createDataFrame(deep + odd, "id string, parent_id string, project_id string, k int")).collect()}
    assert out.keys() == {x[0] for x in deep} | {"other", "lost"} and out["other"] == ["other"]
    assert all(out[f"i{k}"] == [f"i{j}" for j in range(k + 1)] for k in (0, 1, 2, 3, 100, 1_999))
    assert tree.paths(spark.createDataFrame([], "id string, parent_id string, project_id string")).count() == 0


def plain_label_words(words):
    """What stays of words before the stop words go, told from left to right."""
    out, k = [], 0
    while k < len(words):
        low = words[k].lower()
        if low.startswith(("api_key", "apikey", "token", "password")) and ("=" in low or ":" in low):
            out.append("[redacted]")
        elif low in ("api_key", "token", "password") and k + 2 < len(words) and words[k + 1] in ("=", ":"):
            out.append("[redacted]")
            k += 2
        else:
            out.append(words[k])
        k += 1
    return [w for w in out if w not in ("=", ":")]


def test_labels_from_left_to_right(spark):
    """Names, signs and values in every order: an assignment may hold another's name as its value."""
    import itertools

    shown = [" ".join(x) for n in (1, 4, 5) for x in itertools.product(["token", "=", "zulu"], repeat=n)] + ["token = token = zulu bravo", "password : api_key = token = zulu"]
    got = one(spark, text.redacted_label, *shown)
    for s, label in zip(shown, got, strict=True):
        words = plain_label_words(s.split())[:8]
        assert label.split() == words + ["work"] * (3 - len(words)), s


def test_summary_of_an_evaluation(spark, tmp_path):
    (tmp_path / "labels.jsonl").write_text('{"id": "a", "expected": "X", "moved_later": true}\n\n{"id": "b", "expected": "Y"}\r\n{"id": "c", "expected": "X", "moved_later": false}\n')
    labels = evaluation.read_rows(spark, str(tmp_path / "labels.jsonl"), evaluation.LABEL)
    made = spark.createDataFrame([("a", "X", 0.8), ("b", "X", None)], evaluation.PREDICTION)
    assert evaluation.summary(labels, made).first()[:] == (3, 1, 1, 1 / 3, 2 / 3, 100.0)
    assert evaluation.summary(labels.limit(0), made).first()[:] == (0, 0, 0, 0.0, 0.0, None)


def test_a_broken_line_of_labels_is_an_error(spark):
    with pytest.raises(Exception, match="(?i)malformed"):
        evaluation.rows_of(spark.createDataFrame([("{broken",)], "line string"), evaluation.LABEL).collect()


def test_signs_of_a_project_filter_are_no_wildcards(spark):
    from costgrain.operators.projects import matching

    rows = spark.createDataFrame([("k1", "100% Wool"), ("k2", "1000 wool"), ("100%", "other"), ("k3", "ÄRGER"), ("k4", None)], "key string, display_name string")
    found = lambda x: sorted(r[0] for r in matching(rows, x).collect())
    assert found("100%") == ["100%", "k1"] and found("WOOL") == ["k1", "k2"] and found("ärger") == [] and found("k4") == ["k4"]


def test_backup_of_a_migration_that_never_ran_is_empty(spark):
    assert upkeep.backup_rows(spark, None).first()[0] == 0
