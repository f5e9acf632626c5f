from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from costgrain.llm import mixing


def test_targets():
    assert mixing.targets([10, 10, 10], [5, 2, 1]) == [Fraction(75, 4), Fraction(15, 2), Fraction(15, 4)]
    aims = mixing.targets([1, 100, 0], [5, 2, 1])  # the first stops at three times its size
    assert aims == [3, 98, 0]
    assert mixing.targets([], []) == []


def test_permutations_are_permutations():
    for n in (1, 2, 3, 10, 1000, 4097):
        full = np.full(n, n)
        a, b = (mixing.permuted(np.arange(n), full, np.full(n, k)) for k in (1, 2))
        assert sorted(a) == list(range(n))
        assert n < 100 or (a != b).any()


def test_draws_add_up():
    out = mixing.draws([1000, 10, 0, 333], 8)
    assert out.sum(axis=0).tolist() == [1000, 10, 0, 333]
    assert set(out.sum(axis=1).tolist()) <= {167, 168}


@pytest.fixture(scope="module")
def mixed(docs):
    return mixing.mix(docs.select("doc_id", "text", "source"), 16)


def test_the_mix_meets_its_targets(mixed, rows):
    mix, located, sources = mixed
    out = mixing.taken(mix, located).toPandas()
    assert len(out) == len(rows)
    assert (out["taken"] <= 3 * out["_size"]).all()
    assert sources[-1]["name"] is None
    for k, s in enumerate(sources):
        assert abs(out[out["src"] == k]["taken"].sum() - s["target"]) <= 32
    assert out["_size"].sum() == sum(len((r[1] or "").split()) for r in rows)


def test_blocks_are_whole(mixed):
    mix, _, sources = mixed
    for (_, _, src, turn, block), b in mix.toPandas().groupby(["shard", "place", "src", "pass", "block"]):
        last = block == sources[src]["blocks"] - 1
        assert b["words"].sum() == (16 if not last else sources[src]["size"] - 16 * block)
        assert turn < 3


def test_mixed_documents_are_stretches_of_documents(docs, rows):
    out = mixing.mixed_documents(docs, 64)
    assert out.dtypes == docs.dtypes
    words = Counter()
    whole = {r[0]: " ".join((r[1] or "").split()) for r in rows}
    for r in out.collect():
        assert r["text"] in whole[r["doc_id"]] or r["doc_id"] is None
        assert r["n_chars"] == len(r["text"])
        words[r["doc_id"]] += len(r["text"].split())
    total = sum(len((r[1] or "").split()) for r in rows)
    assert abs(sum(words.values()) - total) < 64 * 10


def test_reruns_agree(docs):
    a, b = (sorted(map(str, mixing.mixed_documents(docs, 64).collect())) for _ in range(2))
    assert a == b


def test_no_documents(empty):
    assert mixing.mixed_documents(empty).count() == 0
    mix, located, sources = mixing.mix(empty)
    assert mixing.taken(mix, located).count() == 0 and sources == []


def test_taken_is_what_the_slots_take(spark, docs):
    """The words of every source laid out one after the other on the driver, and each slot's block counted off."""
    mixed, rows, sources = mixing.mix(docs, block=16)
    placed = rows.select("src", "_at", "_size").toPandas()
    words = {k: np.full(s["size"], -1) for k, s in enumerate(sources)}
    for r in placed.itertuples():
        words[r.src][r._2 : r._2 + r._3] = r.Index
    assert all((w >= 0).all() for w in words.values())  # no gap and no overlap
    want = np.zeros(len(placed), int)
    for r in mixing.slots(spark, sources).collect():
        np.add.at(want, words[r["src"]][r["block"] * 16 : (r["block"] + 1) * 16], 1)
    got = mixing.taken(mixed, rows).select("src", "_at", "_size", "taken").toPandas()
    assert (got[got["_size"] == 0]["taken"] == 0).all()
    key = lambda d, n: sorted((*map(int, x),) for x in zip(d["src"], d["_at"].fillna(-1), d["_size"], n, strict=True) if x[2])
    assert key(got, got["taken"]) == key(placed, want)


def test_draws_from_very_many_slots():
    rng = np.random.default_rng(1)
    got = np.array([mixing._hypergeometric(rng, 3 * 10**11, 10**11, 10**9) for _ in range(400)])
    sd = (10**9 * 0.75 * 0.25 * (1 - 10**9 / (4 * 10**11))) ** 0.5
    assert abs(got.mean() - 0.75 * 10**9) < 5 * sd / 20 and 0.85 < got.std() / sd < 1.15
    assert mixing._hypergeometric(rng, 10**10, 5, 10**10) in range(10**10 - 5, 10**10 + 1)
    assert mixing._hypergeometric(rng, 10**10, 5, 10**10 + 5) == 10**10
