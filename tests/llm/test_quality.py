import numpy as np
import pytest

from costgrain.llm import quality
from costgrain.llm.common import in_training, table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_ranking_separates_and_cuts_at_the_quantile():
    rng = np.random.default_rng(1)
    y = (rng.random(600) < 0.8).astype(int)
    x = rng.normal(size=(600, 5)) + 3 * y[:, None] * np.array([1, 0, 0, -1, 0])
    model = quality.rank(x, y)
    predicted = model.score(x) >= quality.CUT
    assert abs(predicted.sum() - y.sum()) <= 1 and (predicted == y).mean() > 0.97


def test_one_kind_of_label_ranks_nothing():
    x = np.zeros((3, len(quality.features(b""))))
    assert (quality.rank(x, np.ones(3)).score(x) >= quality.CUT).all()
    assert (quality.rank(x, np.zeros(3)).score(x) < quality.CUT).all()
    assert (quality.rank(np.empty((0, x.shape[1])), np.empty(0)).score(x) >= quality.CUT).all()


def test_held_out_accuracy(spark):
    out = quality.op5(spark, SF)
    met = out.join(table(spark, SF, "labels"), "doc_id").where("held_out").toPandas()
    assert len(met) > 50 and (met["predicted"] == met["quality"]).mean() > 0.97
    assert out.where((F.col("score") >= 0.7) != (F.col("predicted") == 1)).count() == 0


def test_odd_rows(spark, docs, rows, empty):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (4, None, None), (None, 1, 1), (8, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, labels)
    out = quality.score(docs, model).toPandas()
    assert len(out) == len(rows) and out["score"].between(0, 1).all()
    assert quality.score(empty, model).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.schema == docs.schema
    assert kept.count() == int(out["predicted"].sum())
    assert quality.keep_good(empty, labels.limit(0)).count() == 0


@pytest.mark.parametrize("text", [b"", b" \n", b"a", b"\n\n\n.", "É".encode() * 10, b"x" * 100_000])
def test_features_of_any_text(text):
    f = quality.features(text)
    assert len(f) == len(quality.features(b"a b")) and np.isfinite(f).all()


def test_the_fit_is_near_that_of_all_pairs():
    """Plain gradient descent over every pair of a good and a bad document gives nearly the same ranking and loss."""
    rng = np.random.default_rng(9)
    y = (rng.random(160) < 0.7).astype(int)
    x = rng.normal(size=(160, 4)) * np.array([1, 2, 0.5, 3]) + y[:, None] * np.array([1.0, -1.0, 0.2, 0])
    model = quality.rank(x, y)
    z = np.clip((x - model.centre) / model.scale, -8, 8)
    gaps = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 4)
    loss = lambda w: np.logaddexp(0, -gaps @ w).mean() + 0.5e-3 * (w @ w)
    w = np.zeros(4)
    for _ in range(3_000):
        w -= 0.5 * (-(gaps * (1 / (1 + np.exp(gaps @ w)))[:, None]).mean(0) + 1e-3 * w)
    assert loss(model.weights) < loss(w) * 1.03
    assert model.weights @ w / np.linalg.norm(model.weights) / np.linalg.norm(w) > 0.98
    wins = lambda v: (gaps @ v > 0).mean()
    assert abs(wins(model.weights) - wins(w)) < 0.02


def test_the_weights_minimise_the_loss_of_the_drawn_pairs(monkeypatch):
    rng = np.random.default_rng(10)
    y = (rng.random(200) < 0.8).astype(int)
    x = rng.normal(size=(200, 3)) + y[:, None]
    seen = []
    fit = quality.logistic
    monkeypatch.setattr(quality, "logistic", lambda a, b, ridge: seen.append((a, b, ridge)) or fit(a, b, ridge=ridge))
    w = quality.rank(x, y).weights
    a, b, ridge = seen[0]
    bad, good = (y == 0).sum(), (y == 1).sum()
    assert len(a) == bad * quality.PARTNERS + good
    loss = lambda v: np.mean(np.logaddexp(0, np.where(b == 1, -1, 1) * (a @ v))) + ridge / 2 * v @ v
    for step in np.concatenate((np.eye(3), -np.eye(3))) * 1e-2:
        assert loss(w) <= loss(w + step)
