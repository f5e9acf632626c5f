import json

from pyspark.sql import functions as F

from costgrain.sources.observation import COLUMNS, SCHEMA
from costgrain.streaming import hooks
from costgrain.streaming.ledger import Ledger, poison


def row(**k):
    base = {c: None for c in COLUMNS} | {"adapter": "a", "source": "transcript_request", "session": "s", "source_path": "p", "source_offset": 0}
    return tuple((base | k)[c] for c in COLUMNS)


def test_late_better_records_supersede_and_replays_change_nothing(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    ledger = Ledger(spark, str(tmp_path / "ledger"))

    def land(name, *rows):
        spark.createDataFrame([row(**r) for r in rows], SCHEMA).coalesce(1).write.parquet(str(source / name))

    def follow():
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(source))
        ledger.follow(stream, str(tmp_path / "checkpoint")).awaitTermination()

    land("1", {"request_id": "r1", "input_tokens": 1}, {"request_id": "r2", "input_tokens": 2})
    follow()
    land("2", {"request_id": "r1", "source": "official_telemetry", "input_tokens": 9}, {"request_id": "r2", "input_tokens": 7}, {"request_id": "r3"})
    follow()
    follow()  # nothing new
    events = ledger.events().collect()
    active = {r["request_id"]: r["input_tokens"] for r in events if r["superseded_by"] is None}
    assert active == {"r1": 9, "r2": 2, "r3": None}
    assert len(events) == 4
    again = spark.createDataFrame([row(request_id="r1", source="official_telemetry", input_tokens=9), row(request_id="r2", input_tokens=7), row(request_id="r3")], SCHEMA)
    ledger.ingest(again, 1)  # the second batch comes again
    assert sorted(map(str, ledger.events().collect())) == sorted(map(str, events))


def test_poison(spark):
    df = spark.createDataFrame([row(input_tokens=1), row(input_tokens=-1), row(session=None), row(source="what")], SCHEMA)
    good, bad = poison(df)
    assert good.count() == 1 and bad.count() == 3


def spool_run(spark, folder, out, **options):
    """One run over the spool's lines; what has changed is added to ``out``."""
    own = hooks.stateful_session(spark, 2)
    good, _ = hooks.envelopes(hooks.follow_spool(own, str(folder)))
    write = hooks.turns(good, **options).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state")
    write.trigger(availableNow=True).start().awaitTermination()
    return own.read.schema(hooks.CHANGE).parquet(f"{out}/rows")


def hook(kind, at, session="s", **payload):
    return json.dumps({"version": 1, "kind": kind, "capturedAt": f"2026-01-01T{at // 60:02d}:{at % 60:02d}:00Z", "payload": {"session_id": session} | payload})


def test_turns_of_a_spool(spark, tmp_path):
    spool = tmp_path / "spool"
    spool.mkdir()
    (spool / "a.jsonl").write_text("\n".join([hook("UserPromptSubmit", 0, prompt_id="p\t1"), hook("UserPromptSubmit", 1), hook("Stop", 2), "{broken", json.dumps({"version": 2, "kind": "x", "capturedAt": "z"})]) + "\n")
    spool_run(spark, spool, tmp_path / "out")
    (spool / "b.jsonl").write_text("\n".join([hook("StopFailure", 3), hook("Stop", 4), hook("UserPromptSubmit", 5, prompt_id="p\t1"), hook("UserPromptSubmit", 6, prompt_id="line\nbreak"), hook("SessionEnd", 7)]) + "\n")
    changes = spool_run(spark, spool, tmp_path / "out")
    out = hooks.current_turns(changes).collect()
    assert {r["turn"]: (r["sequence"], r["started_at"][14:16], r["ended_at"] and r["ended_at"][14:16]) for r in out} == {"p\t1": (0, "00", "03"), "1": (1, "01", "02"), "line\nbreak": (2, "06", None)}
    assert [(r["started_at"][14:16], r["ended_at"][14:16]) for r in hooks.current_sessions(changes).collect()] == [("00", "07")]
    _, bad = hooks.envelopes(spark.read.text(str(spool)).select(F.col("value").alias("line")))
    assert sorted(r["label"] for r in bad.collect()) == ["malformed", "unsupported"]


def test_any_split_into_batches_gives_the_turns_of_one_batch(spark, tmp_path):
    import random

    from costgrain.operators.upkeep import turns_of_hooks

    draw = random.Random(3)
    events = [(draw.choice(["UserPromptSubmit", "UserPromptSubmit", "Stop", "StopFailure", "SessionStart"]), k, f"s{draw.randrange(3)}") for k in range(120)]
    table = spark.createDataFrame(events, "kind string, at long, session string")
    want = {(r["session"], r["at"]): r["ended_by"] for r in turns_of_hooks(table, ["session"], "at").collect()}
    minute = lambda s: s and int(s[11:13]) * 60 + int(s[14:16])
    for n, shuffled in ((1, False), (4, False), (4, True)):
        spool, out = tmp_path / f"spool{n}{shuffled}", tmp_path / f"out{n}{shuffled}"
        spool.mkdir()
        mixed = draw.sample(events, len(events)) if shuffled else events
        for k in range(n):
            part = mixed[k * len(mixed) // n : (k + 1) * len(mixed) // n]
            (spool / f"{k}.jsonl").write_text("".join(hook(kind, at, session, prompt_id=f"p{at}") + "\n" for kind, at, session in part))
            # In order, a horizon of five minutes is enough; out of order, all have to be held.
            changes = spool_run(spark, spool, out, horizon=86_400 if shuffled else 300)
        got = {(r["session_id"], minute(r["started_at"])): minute(r["ended_at"]) for r in hooks.current_turns(changes).collect()}
        assert got == want


def test_fold_names_turns_by_number_and_never_twice():
    e = lambda kind, at, prompt=None: hooks.Event(at, str(at), 0, kind, prompt, None)
    turns, stack, count, new = hooks.fold([], 0, lambda n: n == "old", [e("Stop", 0), e("UserPromptSubmit", 1), e("UserPromptSubmit", 2, "old"), e("UserPromptSubmit", 3, "0"), e("UserPromptSubmit", 4, "x"), e("Stop", 5)])
    assert (sorted(turns), stack, count, new) == (["0", "x"], ["0"], 2, ["0", "x"]) and turns["x"].ended_at == "5"


def test_state_of_ended_sessions_goes(spark, tmp_path):
    spool = tmp_path / "spool"
    spool.mkdir()
    (spool / "a.jsonl").write_text(hook("UserPromptSubmit", 0) + "\n" + hook("SessionEnd", 1) + "\n")
    spool_run(spark, spool, tmp_path / "out", after_end=0)
    (spool / "b.jsonl").write_text(hook("Stop", 5, "t") + "\n")
    spool_run(spark, spool, tmp_path / "out", after_end=0)  # the timer goes off
    (spool / "c.jsonl").write_text(hook("Stop", 9) + "\n")
    changes = spool_run(spark, spool, tmp_path / "out", after_end=0)
    assert [r["ended_at"] for r in hooks.current_turns(changes).collect()] == [None]


def test_prompts_are_kept_as_fingerprints(spark):
    df = spark.createDataFrame([('{"session_id":"s","prompt":"secret"}',)], "x string")
    payload = F.from_json("x", "struct<" + ", ".join(f"{c}: string" for c in [*hooks.KEPT, "prompt"]) + ">")
    out = df.select(F.to_json(hooks.sanitise(payload, payload["prompt"])).alias("j")).first()["j"]
    assert "secret" not in out and len(json.loads(out)["prompt_fingerprint"]) == 64


def test_rows_that_cannot_be_stored_are_set_apart(spark, tmp_path):
    from costgrain.sources.observation import SCHEMA
    from costgrain.streaming.ledger import Ledger

    def row(**known):
        full = {"adapter": "a", "source": "transcript_request", "session": "s", "source_path": "p", "source_offset": 0} | known
        return tuple(full.get(f.name) for f in SCHEMA)

    rows = [row(request_id="1", input_tokens=3), row(request_id="2", output_tokens=-1), row(request_id="3", session=None), row(request_id="4", source="hearsay")]
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    for _ in range(2):
        ledger.ingest(spark.createDataFrame(rows, SCHEMA), 0)
    assert [r["request_id"] for r in ledger.events().collect()] == ["1"]
    assert [r["type"] for r in ledger.poisoned().collect()] == ["poison_row"] * 3


def test_paths_are_kept_of_tools_that_write(spark):
    rows = [("PostToolUse", "Edit", "/a"), ("PostToolUse", "Read", "/b"), ("PreToolUse", "Write", "/c"), (None, "Write", "/d"), ("PostToolUse", "MultiEdit", None)]
    df = spark.createDataFrame(rows, "event string, tool_name string, path string")
    payload = F.struct(*(F.col("tool_name") if c == "tool_name" else F.lit(None).cast("string").alias(c) for c in hooks.KEPT))
    out = df.select(hooks.sanitise(payload, F.lit(None).cast("string"), F.col("event"), F.col("path"))["file_path"].alias("p")).collect()
    assert [r["p"] for r in out] == ["/a", None, None, None, None]


def test_an_event_without_a_session_goes_to_quarantine(spark):
    lines = [json.dumps({"version": 1, "kind": "Stop", "capturedAt": "z", "payload": p}) for p in ({"session_id": "s"}, {"session_id": " "}, {})]
    good, bad = hooks.envelopes(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert [r["session_id"] for r in good.collect()] == ["s"] and [r["label"] for r in bad.collect()] == ["malformed"] * 2


def test_a_session_of_which_nothing_is_settled_asks_for_no_names():
    from unittest.mock import MagicMock

    made = hooks.Sessions(10**9, 60, 60)
    made.init(MagicMock(getListState=lambda *a: MagicMock()))
    made.rest.get.return_value, made.pending.get.return_value = (0, 1, 0, "0", None, None), iter([(0, "0", 0, "UserPromptSubmit", "p0", None)])
    came = [hooks.Event(k, str(k), 0, "Stop" if k == 3 else "UserPromptSubmit", f"p{k}", None)._asdict() for k in (1, 2, 3)]
    made.handle.listTimers.return_value = iter(())
    told = list(made.handleInputRows(("s",), iter(came), MagicMock(getCurrentProcessingTimeInMs=lambda: 0)))
    assert sorted((c.turn, c.ended_at) for c in told) == [("p1", None), ("p2", "3")]
    made.names.containsKey.assert_not_called()
    made.open.get.assert_not_called()
    assert len(made.pending.appendList.call_args[0][0]) == 3 and not made.pending.put.called


def test_a_large_batch_is_dealt_to_more_tasks(spark, tmp_path, monkeypatch):
    from costgrain.streaming import ledger

    monkeypatch.setattr(ledger, "ROWS", 10)
    seen = []
    monkeypatch.setattr(ledger.Ledger, "_ingest", lambda self, rows, batch, at: seen.append(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (5, 100):
        ledger.Ledger(spark, str(tmp_path)).ingest(spark.range(n), 0)
    assert seen == [int(was), 11] and spark.conf.get("spark.sql.shuffle.partitions") == was
