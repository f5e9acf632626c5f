import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from costgrain.llm import simhash
from costgrain.llm.components import components


def plain_fingerprint(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_fingerprints_and_components(docs, rows):
    out = simhash.near_duplicates(docs).toPandas()
    assert len(out) == len(rows)
    known = {r[0]: plain_fingerprint(r[1] or "") for r in rows if r[0] is not None}
    ids = sorted(known)
    root = roots(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (known[ids[a]] ^ known[ids[b]]).bit_count() <= 4])
    for r in out.dropna(subset="doc_id").itertuples():
        assert r.fp % 2**64 == known[int(r.doc_id)]
        assert r.component_id == ids[root[ids.index(int(r.doc_id))]]
    assert len(out[out["doc_id"].isna()]) == 2


def test_no_pair_within_reach_is_missed(spark):
    draw = random.Random(3)
    fps = set()
    for _ in range(60):
        base = draw.getrandbits(64)
        fps.add(base)
        for _ in range(8):
            x = base
            for b in draw.sample(range(64), draw.randint(0, 6)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f, k) for k, f in enumerate(signed)], "fp long, node long")
    got = roots(len(fps), [tuple(r) for r in simhash.links(df).collect()])
    want = roots(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert got == want


def test_large_sets_are_split_exactly(monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", 16)
    draw = random.Random(4)
    fps = list({sum(1 << b for b in draw.sample(range(40), draw.randint(0, 5))) for _ in range(300)})
    links = simhash.star_links(np.array(fps, np.uint64), np.arange(len(fps)))
    want = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    assert roots(len(fps), links) == roots(len(fps), want)
    assert all((fps[a] ^ fps[b]).bit_count() <= 64 for a, b in links)


def test_components_of_long_chains(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 102), (102, 101), (7, 7), (None, 3), (102, 100)]
    out = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, out)) == [(k, 0) for k in range(1, 61)] + [(101, 100), (102, 100)]


def test_keep_first(docs, rows):
    kept = simhash.keep_first(docs)
    assert kept.schema == docs.schema
    ids = [r[0] for r in kept.collect()]
    labels = dict(simhash.near_duplicates(docs).where("doc_id is not null").select("doc_id", "component_id").collect())
    assert sorted(i for i in ids if i is not None) == sorted({i for i, c in labels.items() if i == c})
    assert ids.count(None) == 2


def test_no_documents(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_first(empty).count() == 0


def test_spark_hashes_alike(spark):
    row = spark.createDataFrame([("a b c dé",)], "s string").select(F.xxhash64("s")).first()[0]
    assert row % 2**64 == xxhash.xxh64_intdigest("a b c dé".encode(), 42)


def planted(draw, bases, around):
    fps = set()
    for _ in range(bases):
        base = draw.getrandbits(64)
        fps.add(base)
        for _ in range(around):
            x = base
            for b in draw.sample(range(64), draw.randint(0, 6)):
                x ^= 1 << b
            fps.add(x)
    return sorted(fps)


def held_to_brute_force(spark, fps):
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, k) for k, f in enumerate(fps)], "fp long, node long")
    got = roots(len(fps), [tuple(r) for r in simhash.links(df).collect()])
    assert got == roots(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])


def test_long_keys_miss_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LONG_KEYS", 10)
    assert len(simhash._free(7)) == 4 and len(simhash._free(11)) == 22
    held_to_brute_force(spark, planted(random.Random(4), 30, 8))


def test_a_key_with_too_many_is_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST", 40)
    held_to_brute_force(spark, planted(random.Random(5), 2, 400))


def test_runs_over_several_batches():
    """However the rows are cut into batches, the links connect the same."""
    fps = planted(random.Random(6), 3, 40)
    rows = sorted((f % 5, 0, f - 2**64 if f >= 2**63 else f, k) for k, f in enumerate(fps))
    batch = lambda some: simhash.pa.RecordBatch.from_arrays([simhash.pa.array(c, t) for c, t in zip(zip(*some, strict=True), (simhash.pa.int64(), simhash.pa.int32(), simhash.pa.int64(), simhash.pa.int64()), strict=True)], names=["key", "start", "fp", "node"])
    seen = set()
    for size in (1, 2, 7, len(rows)):
        found = [r for b in simhash._of_runs(batch(rows[k : k + size]) for k in range(0, len(rows), size)) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        seen.add(tuple(roots(len(fps), found)))
    assert len(seen) == 1


def test_runs_come_in_batches_without_rows(spark):
    import pyarrow as pa

    schema = pa.schema([("key", pa.int64()), ("start", pa.int32()), ("fp", pa.int64()), ("node", pa.int64())])
    batch = lambda *rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)
    rows = [(1, 0, 1 << k, 10 + k) for k in range(62)] + [(2, 0, 9, 99)]
    want = [r for b in simhash._of_runs(iter([batch(*rows)])) for r in b.to_pylist()]
    got = [r for b in simhash._of_runs(iter([batch(), batch(*rows[:30]), batch(), batch(*rows[30:]), batch()])) for r in b.to_pylist()]
    assert got == want and len(want) > 0
    assert list(simhash._of_runs(iter([batch()]))) == []


def test_texts_alike_in_their_shingles_are_near_duplicates_too(spark):
    """Near copies with a few words changed: nine of ten go by sketches, and nothing else does."""
    import random

    from costgrain.llm import minhash

    draw = random.Random(7)
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    rows, k = [], 0
    for _ in range(60):
        text = [word() for _ in range(200)]
        rows.append((k, " ".join(text)))
        for _ in range(3):
            copy = list(text)
            for at in draw.sample(range(200), 2):
                copy[at] = word()
            k += 1
            rows.append((k, " ".join(copy)))
        k += 1
    passage = " ".join(word() for _ in range(60))
    rows += [(1000 + n, passage + " " + " ".join(word() for _ in range(140))) for n in range(20)]  # a passage that many share
    rows += [(2000, None), (2001, " "), (None, "x y"), (2002, "short text"), (2003, "short text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_first(docs, minhash.alike).collect()}
    assert set(range(0, 240, 4)) <= kept and {1000 + n for n in range(20)} <= kept and {2000, 2002, None} <= kept
    assert sum(n is not None and n < 240 and n % 4 > 0 for n in kept) <= 18 and 2001 not in kept and 2003 not in kept
