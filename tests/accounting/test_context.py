import json
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from costgrain.functions.vocabulary import TOKENS
from costgrain.operators import deltas
from costgrain.sources import transcripts
from costgrain.sources.observation import COLUMNS
from costgrain.streaming import context, hooks, tail, turns


def records(seed, n):
    draw = random.Random(seed)
    for k in range(n):
        kind = draw.choice(["start", "use", "use", "cumulative", "counter", "end", "close", "broken", "blank"])
        usage = {"input_tokens": draw.randrange(50), "output_tokens": draw.choice([None, k])}
        yield {
            "start": {"type": "turn_start", "session_id": f"s{draw.randrange(2)}", "turn_id": f"t{draw.randrange(3)}", "agentId": draw.choice([None, "a1"])},
            "use": {"type": "usage", "requestId": f"r{draw.randrange(9)}", "model": "m", "usage": usage},
            "cumulative": {"type": "cumulative_usage", "model": draw.choice(["m", "n"]), "usage": usage},
            "counter": {"type": "turn_counter", "usage": usage},
            "end": {"method": "turn/completed"},
            "close": {"type": "session/completed"},
        }.get(kind, kind)


def text_of(found):
    return "".join(("{oops" if r == "broken" else "" if r == "blank" else json.dumps(r)) + "\n" for r in found)


def run(spark, home, name, make):
    own = hooks.stateful_session(spark, 2)
    lines = tail.follow(own, str(home / "in"))
    frame = make(lines)
    query = frame.writeStream.format("parquet").option("path", str(home / name)).option("checkpointLocation", str(home / f"{name}-state")).trigger(availableNow=True).start()
    assert query.awaitTermination(100)
    return own.read.schema(frame.schema).parquet(str(home / name))


def counter():
    return F.col("source_subtype") == "codex_turn_counter"


def test_files_that_grow_give_what_whole_files_give(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for part in range(3):
        for f in ("a", "b"):
            with open(tmp_path / f"in/{f}.jsonl", "a") as out:
                out.write(text_of(records(10 * part + ord(f), 25)))
        changes = run(spark, tmp_path, "out", lambda lines: turns.follow_turns(context.follow_streams(lines), counter()))
    got = turns.net(changes).where("what = 'kept'").select(*COLUMNS)
    want, _ = transcripts.read_streams(spark, str(tmp_path / "in"))
    text = lambda df: sorted(str(tuple(r)) for r in df.collect())
    a, b = text(got), text(want)
    assert not (set(a) ^ set(b)), sorted(set(a) ^ set(b))[:6]
    assert a == b and len(a) > 20


def test_streams_beyond_the_latest_keep_their_bases(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for part in range(3):
        with open(tmp_path / "in/a.jsonl", "a") as out:
            out.write(text_of(records(20 + part, 40)))
        changes = run(spark, tmp_path, "out", lambda lines: turns.follow_turns(context.follow_streams(lines, near=1), counter()))
    text = lambda df: sorted(str(tuple(r)) for r in df.select(*COLUMNS).collect())
    assert text(turns.net(changes).where("what = 'kept'")) == text(transcripts.read_streams(spark, str(tmp_path / "in"))[0])


class Counted:
    """State in memory that counts what is asked of it."""

    def __init__(self):
        self.asked, self.value, self.entries = 0, None, {}

    def __getattr__(self, name):
        calls = {"get": lambda: self.value, "update": lambda v: setattr(self, "value", v), "clear": self.entries.clear, "containsKey": self.entries.__contains__, "getValue": self.entries.get, "updateValue": self.entries.__setitem__}

        def call(*args):
            self.asked += 1
            return calls[name](*args)

        return call


def test_a_batch_asks_the_state_of_a_file_twice(spark):
    value, bases = Counted(), Counted()
    processor = context.Context(60, "1")
    processor.init(type("Handle", (), {"getValueState": lambda *a: value, "getMapState": lambda *a: bases}))
    none = dict.fromkeys([*COLUMNS, "_close", "_end", "_session", "_turn", "_agent", "_parent"])
    row = lambda k, n, v: none | {"source_offset": k, "_session": "s", "turn_id": f"t{n}", "parser_version": "cumulative", TOKENS[0]: v}
    as_rows = lambda found: iter([Row(**r) for r in found])
    counts = [list(processor.handleInputRows(("f",), as_rows([row(40 * b + n, n, 10 * b + n) for n in range(30)]), None)) for b in range(3)]
    assert [r[TOKENS[0]] for r in counts[0]] == list(range(30)) and all(r[TOKENS[0]] == 10 for b in counts[1:] for r in b)
    assert value.asked + bases.asked == 6
    # With more streams than lie together each has its base still.
    list(processor.handleInputRows(("f",), as_rows([row(200 + n, n, 50 + n) for n in range(30, 200)]), None))
    later = list(processor.handleInputRows(("f",), as_rows([row(500 + n, n, 100 + n) for n in range(200)]), None))
    assert [r[TOKENS[0]] for r in later] == [80] * 30 + [50] * 170 and len(value.value[5]) == context.NEAR


def test_a_file_that_begins_anew_has_no_context(spark, tmp_path):
    (tmp_path / "in").mkdir()
    use = {"type": "usage", "model": "m", "usage": {"input_tokens": 5}}
    (tmp_path / "in/a.jsonl").write_text(text_of([{"type": "turn_start", "session_id": "s", "turn_id": "t"}, use]))
    run(spark, tmp_path, "out", context.follow_streams)
    (tmp_path / "in/a.jsonl").write_text(text_of([use | {"requestId": "other"}]))
    rows = run(spark, tmp_path, "out", context.follow_streams).collect()
    assert sorted((r.session, r.turn_id) for r in rows if r.request_id is None) == [("s", "t")] and [(r.session, r.turn_id) for r in rows if r.request_id] == [("a", None)]


def test_readings_count_as_the_windows_do(spark):
    draw = random.Random(4)
    rows = [(k, draw.random() < 0.5, *[draw.choice([None, 1, 5, 9]) for _ in TOKENS]) for k in range(80)]
    table = spark.createDataFrame(rows, "n long, is_cumulative boolean, " + ", ".join(f"{t} long" for t in TOKENS)).withColumn("s", F.lit(1))
    want = [(tuple(r[t] for t in TOKENS), r.reset) for r in deltas.counter_deltas(table, ["s"], ["n"]).orderBy("n").collect()]
    base, got = None, []
    for _, cumulative, *values in rows:
        out, base, reset = context.counted(values, base, cumulative)
        got.append((tuple(out), reset))
    assert got == want
