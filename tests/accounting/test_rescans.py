import random

import pytest
from pyspark.sql import functions as F

from costgrain.functions.vocabulary import TOKENS
from costgrain.operators import deltas
from costgrain.streaming.rescans import Rescans
from costgrain.streaming.repairs import Repairs

SCHEMA = "row_key string, n long, " + ", ".join(f"{t} long" for t in TOKENS) + ", cost_micros long"


def snapshots(seed, keys=6, n=60):
    draw = random.Random(seed)
    held = {}
    out = []
    for k in range(n):
        key = f"k{draw.randrange(keys)}"
        now = [max(0, x + draw.choice([0, 0, 1, 5, -2])) for x in held.get(key, [3] * 5)]
        held[key] = now
        out.append((key, k, *[x if draw.random() < 0.9 else None for x in now], draw.choice([None, 10 * k, 10 * k, 5])))
    return out


def plain(rows):
    """What a loop over the rows makes of them: records, anomalies and the last checkpoint of each key."""
    held, made, odd = {}, [], []
    for key, n, *counts, cost in rows:
        cur = [x or 0 for x in counts]
        if key not in held:
            held[key] = [cur, cost, cost is not None, 0, 0, 0, 0]
            made.append((key, n, None, *counts, cost))
            continue
        was, known, there, te, ts, ce, cs = held[key]
        if any(a < b for a, b in zip(cur, was, strict=True)):
            te, ts, step, grew = te + 1, 0, [0] * 5, False
            odd.append((key, n, "token_category_regression"))
        else:
            step = [a - b for a, b in zip(cur, was, strict=True)]
            grew = sum(step) > 0
            ts += grew
        more, dearer = None, False
        if cost is None:
            if there:
                odd.append((key, n, "provider_cost_missing"))
        elif known is None or cost > known:
            more, dearer, cs, known = cost - (known or 0), True, cs + 1, cost
        elif cost < known:
            ce, cs, known = ce + 1, 0, cost
            odd.append((key, n, "provider_cost_regression"))
        held[key] = [cur, known, cost is not None, te, ts, ce, cs]
        if grew or dearer:
            made.append((key, n, f"{key}:delta:te{te}ts{ts}:ce{ce}cs{cs}", *step, more))
    return made, odd, {(k, *v[0], v[1], *v[3:], v[2]) for k, v in held.items()}


@pytest.mark.parametrize("seed,scans", [(1, 1), (2, 3), (3, 6)])
def test_scans_in_any_number_of_runs_are_one_loop(spark, tmp_path, seed, scans):
    rows = snapshots(seed)
    made, odd, held = plain(rows)
    for k in range(scans):
        some = rows[k * len(rows) // scans : (k + 1) * len(rows) // scans]
        for _ in range(2 if k == 1 else 1):  # the second comes twice
            Rescans(spark, str(tmp_path / "r"), "n long", ["n"], digits=1).scan(spark.createDataFrame(some, SCHEMA), k)
    r = Rescans(spark, str(tmp_path / "r"), "n long", ["n"], digits=1)
    text = lambda x: sorted(map(str, x))
    assert text(tuple(x) for x in r.deltas().select("row_key", "n", "source_event_id", *TOKENS, "cost_micros").collect()) == text(made)
    assert text(tuple(x) for x in r.anomalies().select("row_key", "n", "type").collect()) == text(odd)
    assert text(tuple(x) for x in r.checkpoints().select("row_key", *TOKENS, "cost_micros", "token_epoch", "token_sequence", "cost_epoch", "cost_sequence", "cost_available").collect()) == text(held)
    over_all = deltas.epoch_deltas(spark.createDataFrame(rows, SCHEMA), ["row_key"], ["n"]).select("n", "token_epoch", "cost_epoch").collect()
    epochs = {x.n: (x.token_epoch, x.cost_epoch) for x in over_all}
    assert all(epochs[x.n] == (x.token_epoch, x.cost_epoch) for x in r.deltas().collect())


def test_a_scan_opens_and_rewrites_only_its_buckets(spark, tmp_path):
    r = Rescans(spark, str(tmp_path / "r"), "n long", ["n"], digits=1)
    r.scan(spark.createDataFrame([(f"k{k}", k, *[1] * 5, 1) for k in range(200)], SCHEMA), 0)
    before = r.store.snapshot()["tables"]["checkpoints"]
    r.scan(spark.createDataFrame([("k7", 300, *[2] * 5, 2)], SCHEMA), 1)
    after = r.store.snapshot()["tables"]["checkpoints"]
    assert sum(before[b] != after[b] for b in before) == 1 and r.checkpoints().count() == 200


EVENTS = "id string, session string, observed_at string, source_offset long, source_kind string, " + ", ".join(f"{t} long" for t in TOKENS)


def test_repairs_are_applied_once_and_taken_back(spark, tmp_path):
    draw = random.Random(5)
    rows = [(f"e{k}", f"s{k % 4}" if k % 9 else None, f"2026-01-01T00:00:{k % 60:02d}Z", k, "snapshot_delta" if k % 3 else "other", *[draw.choice([None, k, k + 3, 5]) for _ in TOKENS]) for k in range(80)]
    table = spark.createDataFrame(rows, EVENTS)
    r = Repairs(spark, str(tmp_path / "r"), EVENTS, digits=1)
    r.load(table)
    text = lambda df: sorted(str(tuple(x)) for x in df.collect())
    run = r.apply(F.col("source_kind") == "snapshot_delta")
    plan = {x.id: x for x in deltas.repair_snapshots(table.where("source_kind = 'snapshot_delta'")).collect()}
    want = [tuple(plan[x[0]][f"new_{t}"] for t in TOKENS) if x[0] in plan else tuple(x[5:]) for x in rows]
    got = {x.id: tuple(x[t] for t in TOKENS) for x in r.events().collect()}
    assert run and [got[x[0]] for x in rows] == want and r.log().first()["rows"] == len(plan)
    assert {x.event_id for x in r.anomalies().collect()} == {k for k, x in plan.items() if x.action == "backward"}
    once = text(r.events())
    assert r.apply(F.col("source_kind") == "snapshot_delta") is None and text(r.events()) == once
    assert r.restore() == run and text(r.events()) == text(table)
    assert r.log().count() == r.anomalies().count() == 0 and r.restore() is None
    assert r.apply(F.col("source_kind") == "snapshot_delta") == run and text(r.events()) == once  # the same plan, the same name


def test_nothing_to_repair(spark, tmp_path):
    r = Repairs(spark, str(tmp_path / "r"), EVENTS)
    assert r.apply(F.lit(True)) is None
    r.load(spark.createDataFrame([("e", "s", "t", 0, "other", *[1] * 5)], EVENTS))
    assert r.apply(F.lit(False)) is None and r.events().count() == 1
