import random
from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from costgrain.operators.usage import COMPARED, settle_turns
from costgrain.sources.observation import COLUMNS, SCHEMA
from costgrain.streaming import hooks, turns



def counter():
    return F.col("source_subtype") == "codex_turn_counter"


def rows(seed, n):
    """Details and counters in any order, some of one request, some without a turn, some without counts."""
    draw = random.Random(seed)
    out = []
    for k in range(n):
        is_counter = draw.random() < 0.3
        known = {
            "adapter": "a", "session": f"s{draw.randrange(2)}", "turn_id": draw.choice([None, "t0", "t1", "t2", "t3"]), "source_path": f"p{draw.randrange(2)}", "source_offset": k,
            "source": draw.choice(["transcript_request", "official_telemetry"]) if not is_counter else "snapshot_delta", "source_subtype": "codex_turn_counter" if is_counter else None,
            "request_id": f"r{draw.randrange(6)}" if not is_counter else None, "source_event_id": f"e{draw.randrange(2)}" if is_counter and draw.random() < 0.5 else None, "source_timestamp": f"{k}",
            "input_tokens": draw.choice([None, 3, 7, 2**60]), "output_tokens": draw.choice([None, 1]), "cost_micros": draw.choice([None, 5]),
        }
        out.append(tuple(known.get(c) for c in COLUMNS))
    return out


def by_text(found):
    return sorted(str(tuple(r)) for r in found)


def run(spark, tmp_path, parts):
    own = hooks.stateful_session(spark, 2)
    source, out = tmp_path / "in", tmp_path / "out"
    for n, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(source / str(n)))
        stream = own.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(source))
        write = turns.follow_turns(stream, counter()).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state")
        query = write.trigger(availableNow=True).start()
        assert query.awaitTermination(100)
    return turns.net(own.read.schema(turns.CHANGE).parquet(f"{out}/rows"))


@pytest.mark.parametrize("seed,cuts", [(1, 1), (2, 3), (3, 5)])
def test_any_split_into_batches_gives_what_one_batch_gives(spark, tmp_path, seed, cuts):
    all_ = rows(seed, 60)
    mixed = random.Random(seed).sample(all_, len(all_))
    got = run(spark, tmp_path, [mixed[k * 60 // cuts : (k + 1) * 60 // cuts] for k in range(cuts)])
    kept, conflicts = settle_turns(spark.createDataFrame(all_, SCHEMA), counter())
    assert by_text(got.where("what = 'kept'").select(*COLUMNS).collect()) == by_text(kept.collect())
    told = conflicts.select(*COLUMNS, F.to_json(F.struct(*(f"d_{t}" for t in COMPARED))).alias("details")).collect()
    assert by_text(got.where("what = 'conflict'").drop("what").collect()) == by_text(told) and told


def test_a_detail_retracts_the_counter_of_an_earlier_batch(spark, tmp_path):
    one = lambda **k: tuple(({"adapter": "a", "session": "s", "turn_id": "t", "source_path": "p"} | k).get(c) for c in COLUMNS)
    whole = one(source="snapshot_delta", source_subtype="codex_turn_counter", source_offset=0, input_tokens=9)
    detail = one(source="transcript_request", source_offset=1, request_id="r", input_tokens=9)
    net = run(spark, tmp_path, [[whole], [detail], [whole]])
    assert [r["source_offset"] for r in net.collect()] == [1]
    changes = spark.read.schema(turns.CHANGE).parquet(str(tmp_path / "out/rows")).orderBy("source_offset", "sign").collect()
    assert [(r["source_offset"], r["sign"]) for r in changes] == [(0, -1), (0, 1), (1, 1)]


class Calls:
    """A value or map state that counts how often it is called."""

    def __init__(self):
        self.n, self.value, self.map = 0, None, {}

    def get(self):
        self.n += 1
        return self.value

    def update(self, value):
        self.n += 1
        self.value = value

    def containsKey(self, key):
        self.n += 1
        return key in self.map

    def getValue(self, key):
        self.n += 1
        return self.map[key]

    def updateValue(self, key, value):
        self.n += 1
        self.map[key] = value

    def iterator(self):
        self.n += 1
        return iter(self.map.items())


class Handle:
    def __init__(self):
        self.states = {}

    def getValueState(self, name, schema, ttl):
        return self.states.setdefault(name, Calls())

    def getMapState(self, name, key, value, ttl):
        return self.states.setdefault(name, Calls())


def stood(handle, few, parts):
    """What stands after parts of one turn, and how often state was called."""
    made = turns.Covered(60, few)
    made.init(handle)
    total = Counter()
    for part in parts:
        told = [Row(*COLUMNS, "_rank", "_measured", "_counter", "_hash")(*r, 3, True, r[2] is not None, r[5] or "c") for r in part]
        for c in made.handleInputRows(("s", "t"), iter(told), None):
            total[tuple(c)[0], tuple(c)[2:]] += c.sign
    return +total, sum(s.n for s in handle.states.values())


def test_a_turn_of_few_records_is_read_and_written_once_a_batch():
    mine = [(*r[:4], "s", r[5], "t", *r[7:]) for r in rows(7, 60)]
    parts = [mine[:20], mine[20:40], mine[40:]]
    few, calls = stood(Handle(), 64, parts)
    assert calls == 2 * len(parts)
    many, _ = stood(Handle(), 1, parts)
    assert few == many and few
