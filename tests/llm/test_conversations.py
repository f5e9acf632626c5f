import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import numpy as np

from costgrain.llm import conversations as c

TARGET = re.compile(r"(s?(ua)+)?")
NAMES = {"s": "system", "u": "user", "a": "assistant"}


def all_edits(rows):
    """(cost, audit, lines) of the cheapest edits of (role, text, fault) by trying all of them."""
    best = None
    fills = ["", "u", "a", "ua", "au"]
    for gaps in itertools.product(fills, repeat=len(rows) + 1):
        for own in itertools.product("DKua", repeat=len(rows)):
            cost, audit, lines = 0, "", []
            for k in range(len(rows) + 1):
                cost += 5 * len(gaps[k])
                audit += "I" * len(gaps[k])
                lines += [(g, f"{NAMES[g]}:") for g in gaps[k]]
                if k == len(rows):
                    break
                (role, text, fault), e = rows[k], own[k]
                audit += "R" if e in "ua" else e
                if e == "D":
                    cost += 2
                    continue
                cost += (1 if e in "ua" else 0) + (5 if fault == "truncated" else 0) + (10_000 if fault in ("blank", "duplicate") else 0)
                lines.append((e, f"{NAMES[e]}:{text}") if e in "ua" else (role[:1], f"{role}:{text}"))
            if TARGET.fullmatch("".join(x for x, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, [x for _, x in lines])
    return best


def cheapest(rows):
    """The same by recursion over rows and what the roles so far end with."""

    def after(end, role):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((end, role))

    @cache
    def go(k, end, put):
        found = [(0, "", ())] if k == len(rows) and end in ("", "a") else []
        if put < 2:
            for role in "ua":
                if after(end, role):
                    cost, audit, lines = go(k, after(end, role), put + 1)
                    found.append((cost + 5, "I" + audit, (f"{NAMES[role]}:", *lines)))
        if k < len(rows):
            role, text, fault = rows[k]
            cost, audit, lines = go(k + 1, end, 0)
            found.append((cost + 2, "D" + audit, lines))
            more = 5 if fault == "truncated" else 0
            if fault not in ("blank", "duplicate"):
                if after(end, role[:1]):
                    cost, audit, lines = go(k + 1, after(end, role[:1]), 0)
                    found.append((cost + more, "K" + audit, (f"{role}:{text}", *lines)))
                for new in "ua":
                    if after(end, new):
                        cost, audit, lines = go(k + 1, after(end, new), 0)
                        found.append((cost + 1 + more, "R" + audit, (f"{NAMES[new]}:{text}", *lines)))
        return min(found, key=lambda f: f[:2], default=(10**9, "", ()))

    return go(0, "", 0)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        tail = text.rstrip(" \t\n\x0b\f\r")
        out.append("blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def expected(table, damage=True):
    groups = {}
    for conv, turn, role, text in table:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, rows in groups.items():
        after = []
        for turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
            fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            after += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        fault = faults([r[1:] for r in after])
        cost, audit, lines = cheapest([(r[1], r[2], f) for r, f in zip(after, fault, strict=True)])
        turns = [r[0] for r in after if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(after))
        yield (conv, gaps, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


SCHEMA = "conv_id long, turn long, role string, text string"
TEXTS = ["Yes.", "No!", "Is it?", "well", "", " \t", "A. b. c", "Ok. \n", None]


def made(seed, conversations, longest=14, first=0):
    draw, out = random.Random(seed), []
    for conv in range(first, first + conversations):
        roles = draw.choice([["user", "assistant"], ["system", "user", "assistant", "user", "assistant"], ["user", "user", "tool", None, "assistant", "", "system"]])
        for k in range(draw.randint(1, longest)):
            turn = draw.choice([k, k, k, 2 * k, k - 1, None]) if conv % 3 == 0 else k
            out.append((conv, turn, roles[k % len(roles)], draw.choice(TEXTS)))
    return out


def test_recursion_finds_what_trying_all_edits_finds():
    draw = random.Random(4)
    for _ in range(12):
        rows = [(draw.choice(["system", "user", "assistant", "tool"]), "t", draw.choice(["", "", "truncated", "duplicate"])) for _ in range(draw.randint(0, 3))]
        assert all_edits(rows)[:2] == cheapest(rows)[:2] and tuple(all_edits(rows)[2]) == cheapest(rows)[2]


def coded(rows):
    return np.array([c.CLASSES.get(r[:1], 3) + 4 * ["", "blank", "duplicate", "truncated"].index(f) for r, _, f in rows], np.uint8)


def test_tensors_trace_the_cheapest_edits_also_in_stretches():
    draw = random.Random(5)
    many = [[(draw.choice(["system", "user", "user", "assistant", "assistant", "tool"]), str(k), draw.choice(["", "", "", "truncated", "duplicate", "blank"])) for k in range(draw.randint(0, 40))] for _ in range(150)]
    sizes = np.array([len(m) for m in many])
    cost, letters, roles = c.edits(np.concatenate([coded(m) for m in many]).astype(np.uint8), sizes)
    at = 0
    for m, got in zip(many, cost.tolist(), strict=True):
        n = len(m) + 1
        want = cheapest(m)
        lines = c.repaired(letters[at : at + n].tolist(), roles[at : at + n].tolist(), [r for r, _, _ in m] + [""], [t for _, t, _ in m] + [""])
        assert (got, c.audit_of(letters[at : at + n], np.zeros(n, int)).decode(), tuple(lines)) == want
        one = c.edits_of_one(coded(m), stretch=4, together=3)
        assert one[0] == got and (one[1] == letters[at : at + n]).all() and (one[2] * (one[1] > 0) == roles[at : at + n] * (letters[at : at + n] > 0)).all()
        at += n


def test_damaged_conversations_are_those_of_brute_force(spark):
    rows = made(6, 300)
    rows += [rows[5], rows[5], rows[40]]  # repeated rows
    gone = next(k for k in range(5_000, 9_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "Hi."), (None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (None, None, None, None)]
    got = c.repair(*c.damaged(spark.createDataFrame(rows, SCHEMA).repartition(5))).collect()
    assert in_order(got) == in_order(expected(rows))
    assert next(r for r in got if r.conv_id == gone).repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert all(any(letter in r.audit for r in got) for letter in "DKR")  # deleting is always cheaper than inserting


def test_long_conversations_go_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(c, "LONG", 6)
    monkeypatch.setattr(c, "STRETCH", 4)
    rows = made(7, 60, 30) + [(900, k, "user", "same.") for k in range(40)] + [(901, 3, "user", "one row.")] * 30 + [(902, None, "user", "No."), (902, None, "system", "No.")]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert in_order(c.repair(*c.damaged(table)).collect()) == in_order(expected(rows))
    assert in_order(c.repair(table).collect()) == in_order(expected(rows, damage=False))


def test_batches_carry_conversations_over(spark, monkeypatch):
    monkeypatch.setattr(c, "TOGETHER", 5)
    rows = made(8, 40, 12)
    import pyarrow as pa

    cells = sorted(((" " if v is None else str(v), t, " " if r is None else r, " " if x is None else x, 1) for v, t, r, x in rows), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], r[3]))
    batch = pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*cells, strict=True), [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()], strict=True)], ["key", "turn", "role", "text", "times"])
    got = [tuple(r.values()) for b in c._by_conversation(iter([batch.slice(0, 13), batch.slice(13, 0), batch.slice(13)])) for r in b.to_pylist()]
    assert in_order((int(r[0]), *r[1:]) for r in got) == in_order(expected(rows, damage=False))


def test_no_rows_and_columns_with_clashing_names(spark):
    assert c.repair(*c.damaged(spark.createDataFrame([], SCHEMA))).collect() == []
    from pyspark.sql import functions as F

    rows = made(9, 20)
    odd = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in ("key", "times", "place", "piece", "audit", "gaps", "_times", "count")})
    assert in_order(c.repair(*c.damaged(odd)).collect()) == in_order(expected(rows))
