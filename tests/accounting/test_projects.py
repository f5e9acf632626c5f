import pytest
from pyspark.sql import functions as F

from costgrain.functions import text
from costgrain.operators import projects, runs
from costgrain.plans import reports


def test_the_deepest_surest_root_counts(spark):
    roots = spark.createDataFrame([("/a", "p1", "git", True), ("/a/b", "p2", "manifest", True), ("/a/b", "p3", "config", True), ("/a/b/c", "p4", "git", False), ("/", "root", "git", True)], "path string, project_id string, root_type string, active boolean")
    sessions = spark.createDataFrame([("s1", "/a/b/c/d", None, None), ("s2", "/a/x", None, None), ("s3", "/ab", None, None), ("s4", None, None, None), ("s5", "/a", "told", "v"), ("s6", None, None, "v")], "session string, cwd string, override_key string, verified_key string")
    out = {r["session"]: (r["project_id"], r["method"]) for r in projects.resolve(sessions, roots).collect()}
    assert out == {"s1": ("p3", "config"), "s2": ("p1", "git"), "s3": ("/ab", "cwd"), "s4": ("personal-unassigned", "inbox"), "s5": ("told", "override"), "s6": ("v", "verified")}


def test_one_item_or_an_error(spark):
    items = spark.createDataFrame([("1", "Fix Login"), ("2", "Fix Logout"), ("3", "Ärger")], "id string, title string")
    assert projects.find_item(items, "LOGI").first()["id"] == "1"
    for part in ("fix", "none", "ärger"):
        with pytest.raises(LookupError):
            projects.find_item(items, part)


def test_versions_of_items(spark):
    items = spark.createDataFrame([("a", "A", "r", "task"), ("b", "B", None, "task")], "id string, title string, parent_id string, type string")
    versions = spark.createDataFrame([("a", "title", "New", 1), ("a", "title", "Newer", 2), ("a", "parent_id", None, 3), ("b", "parent_id", "b", 4), ("b", "type", "bug", 5)], "id string, field string, value string, version int")
    assert {tuple(r) for r in projects.current_items(items, versions).collect()} == {("a", "Newer", None, "task"), ("b", "B", None, "bug")}


def test_anomalies_find_their_session(spark):
    anomalies = spark.createDataFrame([(1, "id1"), (2, "name2"), (3, "x")], "n int, told string")
    sessions = spark.createDataFrame([("id1", "name1"), ("id2", "name2"), ("id3", "name2")], "session string, provider_session string")
    assert {r["n"]: r["session"] for r in projects.place_anomalies(anomalies, sessions).collect()} == {1: "id1", 2: "id2", 3: None}


def test_policy(spark):
    name = "subagent_tokens_already_in_parent"
    table = lambda *rows: spark.createDataFrame(rows, "capability string, state string, detail string, checked_at string")
    assert projects.policy(table((name, "available", "true", "1"))) == "AlreadyInParent"
    assert projects.policy(table((name, "available", "true", "1"), (name, "available", None, "2"))) == "Independent"
    assert projects.policy(table((name, "broken", "true", "1"))) == projects.policy(table(("other", "available", "true", "1"))) == "Unknown"


def test_manual_runs(spark):
    rows = runs.start(spark, "proj", "task", "2026-01-01T00:00:00Z", "goal")
    assert rows["work_items"].count() == 2
    ended, seen = runs.stop(rows["manual_runs"], "2026-01-01T01:00:00Z", {"input_tokens": 5})
    both = rows["manual_runs"].unionByName(ended)
    assert seen.first()["input_tokens"] == 5 and seen.first()["source_subtype"] == "manual_stop"
    assert runs.active(both).count() == 0
    with pytest.raises(LookupError):
        runs.stop(both, "now", {})
    with pytest.raises(ValueError, match="no such"):
        runs.stop(rows["manual_runs"], "now", {"tokens": 1})


def test_scrubbed_errors_and_model_names(spark):
    df = spark.createDataFrame([('bad token "hunter22" at line 3', '{"password":"hunter22"}', "xx gemini-9.9-pro-control\0yy"), ("x" * 400, "y", "none")], "m string, raw string, blob string")
    out = df.select(text.scrub(F.col("m"), F.col("raw")).alias("s"), text.model_name(F.col("blob")).alias("n")).collect()
    assert out[0]["s"] == "bad token [redacted] at line 3" and out[0]["n"] == "gemini-9.9-pro"
    assert len(out[1]["s"]) == 312 and out[1]["n"] is None


def test_page(spark, tmp_path):
    from costgrain.functions.vocabulary import TOKENS

    names = [*TOKENS, "requests", "measured", "unavailable", "anomalous", "priced", "amount_micros"]
    df = spark.createDataFrame([("a", None, "<T>", "1", ["a"], *[1] * 11)], "id string, parent_id string, title string, created_at string, path array<string>, " + ", ".join(f"{n} long" for n in names))
    reports.write_html(df, str(tmp_path / "page"), "A & B", "only <an> estimate")
    lines = [r[0] for r in spark.read.text(str(tmp_path / "page")).collect()]
    assert len(lines) == 3 and "A &amp; B" in "".join(lines) and "&lt;T&gt;" in "".join(lines)
