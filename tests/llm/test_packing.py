import itertools

import numpy as np

from costgrain.llm.packing import BUCKETS, bounds, op1, pack


def test_bounds_are_of_least_padding():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = np.sort(rng.choice(60, 8, replace=False)) + 1
        rows = rng.integers(1, 9, 8)
        for buckets in (1, 2, 3):
            chosen = bounds(lengths, rows, lengths * rows, buckets)
            cost = lambda bs: sum(r * (min(b for b in bs if b >= n) - n) for n, r in zip(lengths, rows, strict=True))  # noqa: B023, E731
            best = min(cost([*some, lengths[-1]]) for k in range(buckets) for some in itertools.combinations(lengths[:-1], k))
            assert cost(chosen) == best and chosen[-1] == lengths[-1]


def test_every_row_is_packed_within_the_budget(docs, rows):
    out = pack(docs, buckets=4, budget=500).toPandas()
    assert len(out) == len(rows)
    words = sorted(len((r[1] or "").split()) for r in rows)
    assert sorted(out["n_tokens"]) == words
    assert (out["n_tokens"] <= out["bucket_tokens"]).all()
    batches = out.groupby(["bucket", "batch"])
    for (_, _), b in batches:
        assert len(b) == 1 or len(b) * b["bucket_tokens"].iloc[0] <= 500
        assert sorted(b["slot"]) == list(range(len(b)))
    for _, b in out.groupby("bucket"):  # all batches but the last are full
        sizes = b.groupby("batch").size()
        assert (sizes.iloc[:-1] == b["batch_rows_most"].iloc[0]).all()


def test_no_documents(empty):
    assert pack(empty).count() == 0


def plain_padding(lengths, rows, buckets):
    """Least padding by trying every last bucket, one length after the other."""
    best = [0] + [float("inf")] * len(lengths)
    for _ in range(buckets):
        best = [0] + [min(best[i] + sum(rows[k] * (lengths[j - 1] - lengths[k]) for k in range(i, j)) for i in range(j)) for j in range(1, len(lengths) + 1)]
    return best[-1]


def test_many_lengths_as_by_trying_all():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 40):
        lengths, rows = np.sort(rng.choice(5000, n, replace=False)), rng.integers(1, 50, n)
        for buckets in (1, 2, 5, 60):
            chosen = bounds(lengths, rows, lengths * rows, buckets)
            padding = sum(r * (min(b for b in chosen if b >= x) - x) for x, r in zip(lengths, rows, strict=True))
            assert padding == plain_padding(lengths.tolist(), rows.tolist(), buckets)


def test_padding_of_a_whole_table_is_the_least(spark):
    out = op1(spark, "/root/testdata/sf0.001").toPandas()
    sizes = out.groupby("n_tokens").size()
    assert (out["bucket_tokens"] - out["n_tokens"]).sum() == plain_padding(sizes.index.tolist(), sizes.tolist(), BUCKETS)
