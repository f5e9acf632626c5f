import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from costgrain.functions.vocabulary import TOKENS
from costgrain.operators import usage
from costgrain.sources import databases, documents, files, prices, transcripts
from costgrain.functions.vocabulary import source_kind


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path.parent)


def ledger(observations):
    kind = source_kind(F.col("source"), F.col("source_subtype"))
    return observations.withColumns({"source_kind": kind, "superseded_by": F.lit(None).cast("string")})


def total(observations):
    r = usage.totals(usage.flagged(ledger(observations)), "AlreadyInParent").first()
    return [r["input_tokens"], r["cached_input_tokens"], r["output_tokens"], r["reasoning_tokens"], r["requests"]]


def test_offsets_are_those_of_bytes(spark, tmp_path):
    lines = ["{}", "é" * 10, "", "x" * 1000, "last"]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    rows = files.lines(spark, str(tmp_path)).orderBy("source_offset").collect()
    assert [r["line"] for r in rows] == lines
    at = 0
    for r, line in zip(rows, lines, strict=True):
        assert r["source_offset"] == at
        at += len(line.encode()) + 1


COUNTS = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_tokens")


def reading(kind, turn, counts, **more):
    return {"type": kind, "turn_id": turn, "session_id": "s", "model": "m", "token_usage": dict(zip(COUNTS, counts, strict=False)), **more}


def asked(turn, *all_counts):
    return [reading("token_usage", turn, counts, requestId=f"{turn}/{k}") for k, counts in enumerate(all_counts)]


def summed(*all_counts):
    return [sum(x) for x in zip(*all_counts, strict=True)]


ONE, TWO, THREE = (17, 4, 9, 2), (31, 0, 5, 5), (8, 8, 1, 0)
COUNTED = reading("turn_summary", "a", summed(ONE, TWO, THREE))
OTHER = reading("turn_summary", "b", (3, 1, 2, 0))


def rising(turn, *inputs):
    return [reading("cumulative_usage", turn, (i, 0, 2 * i, 0), request_id=f"{turn}:{k}") for k, i in enumerate(inputs)]


@pytest.mark.parametrize(
    ("rows", "want", "odd"),
    [
        (asked("a", ONE, TWO, THREE), [*summed(ONE, TWO, THREE), 3], 0),
        ([COUNTED, OTHER], [*summed(ONE, TWO, THREE, (3, 1, 2, 0)), 2], 0),
        ([COUNTED, *asked("a", ONE, TWO, THREE), OTHER], [*summed(ONE, TWO, THREE, (3, 1, 2, 0)), 4], 0),
        ([COUNTED, *asked("a", ONE, TWO)], [*summed(ONE, TWO), 2], 1),
        ([OTHER, OTHER], [3, 1, 2, 0, 1], 0),
        (asked("a", ONE) * 2, [*ONE, 1], 0),
        (rising("a", 6, 11, 30) + rising("b", 4), [34, 0, 68, 0, 4], 0),
        (rising("a", 6, 2, 5), [11, 0, 22, 0, 3], 1),
    ],
)
def test_streams(spark, tmp_path, rows, want, odd):
    root = write(tmp_path / "x" / "a.jsonl", [{"type": "turn/started", "turn_id": "a", "session_id": "s"}, *rows])
    # A counter is cumulative only if it says so; here counters count whole.
    out, anomalies = transcripts.read_streams(spark, root)
    assert total(out) == want
    assert anomalies.count() == odd


def test_what_is_too_large_is_told(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "LINE_BYTES", 200)
    monkeypatch.setattr(files, "FILE_BYTES", 2_000)
    good = {"type": "assistant", "session_id": "s", "request_id": "r", "usage": {"input_tokens": 2}}
    write(tmp_path / "x" / "long-line.jsonl", [good, {"pad": "x" * 300}])
    root = write(tmp_path / "x" / "large.jsonl", [good] * 100)
    for read in (transcripts.read_requests, transcripts.read_streams):
        out, odd = read(spark, root)
        assert out.count() == 1
        assert sorted(r["type"] for r in odd.collect()) == ["file_too_large", "malformed_line"]


def test_sticky_context_and_bad_lines(spark, tmp_path):
    usage_ = {"input_tokens": 1, "output_tokens": 2}
    root = write(
        tmp_path / "x" / "file-name.jsonl",
        [
            {"type": "rollout", "usage": usage_, "request_id": "a"},
            {"type": "turn/started", "turnId": "t1", "threadId": "s1", "agentId": "g"},
            {"type": "rollout", "usage": usage_, "request_id": "b"},
            {"method": "thread/tokenUsage/updated", "params": {"tokenUsage": {"inputTokens": 5, "outputTokens": "12"}, "requestId": "c", "model": "m"}},
            {"type": "turn/completed"},
            {"type": "rollout", "usage": usage_, "request_id": "d"},
            {"type": "session/completed"},
            {"type": "rollout", "usage": {"prompt_tokens": 9, "prompt_tokens_details": {"cached_tokens": 3}}, "request_id": "e"},
            {"version": "9.9", "usage": usage_},
            "{broken",
            {"type": "note"},
        ],
    )
    out, odd = transcripts.read_streams(spark, root)
    got = {r["request_id"]: (r["session"], r["turn_id"], r["agent_id"], r["input_tokens"], r["output_tokens"], r["source"]) for r in out.collect()}
    roll = "transcript_request"
    assert got == {
        "a": ("file-name", None, None, 1, 2, roll), "b": ("s1", "t1", "g", 1, 2, roll), "c": ("s1", "t1", "g", 5, None, "official_telemetry"),
        "d": ("s1", None, "g", 1, 2, roll), "e": ("file-name", None, None, 9, None, roll),
    }
    assert sorted(r["type"] for r in odd.collect()) == ["malformed_line", "unsupported_version"]


def test_requests_and_snapshots(spark, tmp_path):
    snap = lambda i, o: {"type": "usage_snapshot", "session_id": "s", "uuid": f"e{i}", "usage": {"input_tokens": i, "output_tokens": o}}
    root = write(
        tmp_path / "x" / "t.jsonl",
        [
            {"type": "assistant", "sessionId": "s", "message": {"id": "m1", "model": "mm", "usage": {"input_tokens": 5, "cache_creation": {"ephemeral_1h_input_tokens": 3, "ephemeral_5m_input_tokens": 4}}}, "unknown": 1},
            {"type": "provider_usage", "usage": {"inputTokens": 7, "output_tokens": -3}, "request_id": "r"},
            snap(100, 10), snap(150, 30), snap(120, 40), snap(200, 50),
            {"type": "assistant", "version": 3, "usage": {"input_tokens": 1}}, {"type": "user"}, {"usage": {"input_tokens": "12"}}, '{"cut',
        ],
    )
    out, odd = transcripts.read_requests(spark, root)
    rows = out.orderBy("source_offset").collect()
    assert [(r["source"], r["input_tokens"], r["cache_write_tokens"], r["output_tokens"]) for r in rows] == [("transcript_request", 5, 7, None), ("provider_fields", 7, None, None), ("snapshot_delta", 50, None, 20), ("snapshot_delta", 80, None, 10)]
    assert rows[0]["request_id"] == "m1" and rows[0]["model"] == "mm" and rows[1]["session"] == "t"
    assert sorted(r["type"] for r in odd.collect()) == ["malformed_line", "negative_delta", "unsupported_version"]


def test_turn_files(spark, tmp_path):
    turn = lambda n, **k: {"turnNumber": n, "inputTokens": 10, "outputTokens": 5, "totalTokens": 15, "modelCalls": 1, "costUsdTicks": 1999} | k
    write(tmp_path / "a" / "usage.json", [{"sessionId": "s", "updatedAt": "2026-01-01T00:00:00Z", "session": {"inputTokens": 99, "primaryModelId": "pm"}, "turns": [turn(1), turn(2, totalTokens=99), turn(3, modelCalls=0)]}])
    write(tmp_path / "b" / "usage.json", [{"sessionId": "z", "session": {"inputTokens": 4, "outputTokens": 6}}])
    write(tmp_path / "c" / "usage.json", ["{nope"])
    out, odd = documents.read_turn_files(spark, str(tmp_path))
    rows = {(r["session"], r["turn_id"]): r for r in out.collect()}
    assert len(rows) == 4
    assert rows["s", "turn_1"]["cost_micros"] == 1 and rows["s", "turn_1"]["model"] == "pm"
    assert rows["s", "turn_3"]["source_subtype"] == "grok_turn_failed" and rows["s", "turn_3"]["input_tokens"] is None
    assert rows["z", None]["source_subtype"] == "grok_session_usage" and rows["z", None]["output_tokens"] == 6
    assert sorted(r["type"] for r in odd.collect()) == ["malformed_json", "missing_provider_measurements", "token_sum_mismatch"]


def test_runs(spark, tmp_path):
    write(tmp_path / "a" / "one-usage.json", [{"session_id": "s", "model": "x/free", "input_tokens": 5, "output_tokens": 6, "auxiliary": {"by_task": {"title": {"input_tokens": 2, "actual_cost_usd": "0.0000015"}, "none": {}}}}])
    write(tmp_path / "a" / "two-usage.json", [{"failed": True, "input_tokens": 5, "cost_usd": 1.5}])
    write(tmp_path / "a" / "three-usage.json", [{"session_id": "t", "model": "m", "input_tokens": 1, "estimated_cost_usd": "0.25"}])
    out, odd = documents.read_runs(spark, str(tmp_path))
    rows = {(r["session"], r["turn_id"]): r for r in out.collect()}
    assert rows["s", "turn_1"]["cost_micros"] == 0
    assert rows["s", "task_title"]["cost_micros"] == 2 and rows["s", "task_title"]["parent_agent_id"] == "hermes:s"
    assert rows["s", "task_none"]["source"] == "unavailable"
    assert rows["two-usage", "turn_1"]["source_subtype"] == "hermes_failed_run" and rows["two-usage", "turn_1"]["input_tokens"] is None
    assert rows["t", "turn_1"]["cost_micros"] == 250_000
    assert odd.count() == 1


def test_telemetry(spark):
    attr = lambda **k: [{"key": a.replace("__", "."), "value": v} for a, v in k.items()]
    s, i = (lambda x: {"stringValue": x}), (lambda x: {"intValue": str(x)})
    record = {"timeUnixNano": "123", "body": s("api_request"), "attributes": attr(request_id=s("r"), input_tokens=i(5), output_tokens=s("7"), event__sequence=i(3), model=s("inner"))}
    skipped = {"body": s("other"), "attributes": attr(request_id=s("q"))}
    payload = {"resourceLogs": [{"resource": {"attributes": attr(session__id=s("ses"), model=s("outer"))}, "scopeLogs": [{"logRecords": [record, skipped]}]}]}
    rows = documents.telemetry(spark.createDataFrame([(json.dumps(payload),), ("{}",), ("nope",)], "line string")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["session"], r["request_id"], r["input_tokens"], r["output_tokens"], r["model"], r["source_timestamp"], r["source_event_id"], r["source_offset"]) == ("ses", "r", 5, 7, "inner", "unix-ns:123", "otel:ses:3", 3)


def test_prototypes(spark, tmp_path):
    row = {"project_name": " P ", "task": "T", "input": 3, "output_tokens": 4}
    write(tmp_path / "a.json", [[row, 5, {"cache_write": 9}]])
    write(tmp_path / "b.json", [{"records": [row]}])
    write(tmp_path / "c.json", [{"x": row, "y": 1}])
    out = documents.read_prototype(spark, str(tmp_path))
    assert out.count() == 4
    p = documents.prototype_preview(out).first()
    assert (p["records"], p["measured"], p["unavailable"], p["projects"]) == (4, 3, 1, 2)
    assert out.where("project = 'P'").agg(F.sum("input_tokens")).first()[0] == 9


def test_databases(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "a.db")
    db.execute("CREATE TABLE assistant_usage_events(id, session_id, turn_index, agent_id, parent_tool_call_id, model, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, reasoning_tokens, total_nano_aiu, created_at)")
    db.execute("INSERT INTO assistant_usage_events VALUES('e', 's', 2, NULL, NULL, NULL, 10, -5, NULL, NULL, NULL, 2999, '2026-01-01')")
    db.execute("CREATE TABLE sessions(id, model, total_input_tokens, total_output_tokens, total_cached_tokens, total_reasoning_tokens, total_nano_aiu, created_at)")
    db.execute("INSERT INTO sessions VALUES('s', 'm', 99, 1, 1, 1, 0, NULL)")
    db.commit()
    other = sqlite3.connect(tmp_path / "b.db")
    other.execute("CREATE TABLE sessions(id, model, total_input_tokens, total_output_tokens, total_cached_tokens, total_reasoning_tokens, total_nano_aiu, created_at)")
    other.execute("INSERT INTO sessions VALUES('z', 'm', 99, 1, 1, 1, 0, NULL)")
    other.commit()
    (tmp_path / "c.db").write_bytes(b"no database at all")
    rows = {r["session"]: r for r in databases.read_usage_events(spark, str(tmp_path)).collect()}
    assert set(rows) == {"s", "z"}
    assert (rows["s"]["input_tokens"], rows["s"]["output_tokens"], rows["s"]["cost_micros"], rows["s"]["turn_id"], rows["s"]["model"]) == (10, 0, 2, "turn_2", "copilot-default")
    assert rows["z"]["input_tokens"] == 99 and rows["z"]["cost_micros"] is None


def test_messages(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "a.db")
    db.execute("CREATE TABLE message(id, session_id, time_created, data)")
    data = {"role": "assistant", "modelID": "m", "cost": 0.0000015, "tokens": {"input": 3, "output": 4, "cache": {"read": 5}}}
    db.executemany("INSERT INTO message VALUES(?,?,?,?)", [("a", "s", 1_700_000_000_000, json.dumps(data)), ("b", "s", 1, "{}"), ("c", "s", 2, json.dumps({"role": "assistant"}))])
    db.commit()
    rows = {r["request_id"]: r for r in databases.read_messages(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a", "c"}
    assert (rows["a"]["cost_micros"], rows["a"]["cached_input_tokens"], rows["a"]["source_timestamp"][:19]) == (2, 5, "2023-11-14T22:13:20")
    assert rows["c"]["source"] == "unavailable"


def test_binary_messages(spark, tmp_path):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(k, v):
        return varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 2) + varint(len(v)) + v

    usage_ = field(2, 300) + field(3, 70) + field(5, 11) + field(9, 1) + field(11, b"req")
    blob = field(1, field(1, 1_700_000_000) + field(2, 5_000)) + field(9, usage_)
    assert databases.message_fields(blob[:-3]).get(1)
    db = sqlite3.connect(tmp_path / "a.db")
    db.execute("CREATE TABLE steps(idx, step_type, status, metadata)")
    db.execute("CREATE TABLE trajectory_meta(cascade_id)")
    db.execute("INSERT INTO trajectory_meta VALUES('c')")
    db.executemany("INSERT INTO steps VALUES(?,?,?,?)", [(1, 15, 3, blob), (2, 17, 4, blob), (3, 99, 3, blob), (4, 15, 3, b"\xff")])
    db.commit()
    rows = {r["turn_id"]: r for r in databases.read_steps(spark, str(tmp_path)).collect()}
    assert set(rows) == {"step_1", "step_2", "step_4"}
    assert [rows["step_1"][c] for c in TOKENS] == [300, 11, None, 70, 1] and rows["step_1"]["request_id"] == "req"
    assert rows["step_2"]["source_subtype"] == "gemini_turn_failed" and rows["step_4"]["source_subtype"] == "gemini_turn_unmeasured"


def test_price_snapshots(spark):
    body = {"version": 1, "updated": "2026-01-01", "currency": "USD", "models": [{"provider": "p", "modelPattern": "m*", "effectiveFrom": "2026-2-1", "inputPerMillion": "3.00", "outputPerMillion": "15.00", "source": "x"}]}
    text = json.dumps(body | {"sha256": prices.digest(body)})
    r = prices.load(spark, text).first()
    assert (int(r["input_rate"]), r["cached_rate"], int(r["output_rate"])) == (3_000_000, None, 15_000_000)
    with pytest.raises(ValueError, match="digest"):
        prices.load(spark, text.replace("3.00", "4.00"))
