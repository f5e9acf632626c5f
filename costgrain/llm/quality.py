"""Operator 5: quality by Bradley-Terry ranking.

A document's strength is a weighted sum of its features. For a good and a bad
document the model says that the good one wins with probability
sigmoid(strength difference), and the weights minimise the logistic loss of
such pairs: a logistic regression on feature differences. The cut between good
and bad is the quantile of the labelled strengths that leaves the labelled
share of bad documents below; the score maps it to ``CUT``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costgrain.llm.common import batch_of, in_training, small, table, text_bytes
from costgrain.llm.labelled import logistic, sample, sigmoid

CUT = 0.7
#: Good partners that each bad document meets, and the other way round.
PARTNERS = 8

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "wide": range(128, 256), "bang": b"!", "bar": b"|", "mark": b"#$%&*@^~<>{}[]\\/=+_`", "stop": b".,;:?'\"()-"}
_CLASS_OF = np.zeros(256, np.int64)
for _k, _v in enumerate(_CLASSES.values(), 1):
    _CLASS_OF[list(_v)] = _k
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def features(text: bytes) -> list[float]:
    """What the ranking sees of a text: shapes of its bytes, words and lines."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 23 + [1.0]
    raw = np.frombuffer(text, np.uint8)
    counts = np.bincount(_CLASS_OF[raw], minlength=9)
    blank = _BLANK[raw]
    last = _CLASS_OF[raw[~blank & np.append(blank[1:], True)]]
    ends = np.bincount(last, minlength=9) / n
    size = len(raw) - int(blank.sum())
    letters = max(1, int(counts[1] + counts[2]))
    lines = [x for x in text.split(b"\n") if x]
    shares = [
        counts[1] / letters, counts[3] / size, counts[4] / size, counts[5] / size, counts[6] / size, counts[7] / size, counts[8] / size,
        ends[5], ends[7], sum(map(eq, words, words[1:])) / n, 1 - len(set(lines)) / max(1, len(lines)),
    ]
    distinct = len(set(words))
    return [*shares, *(float(np.tanh(20 * s)) for s in shares[:1] + shares[3:6] + shares[7:]), float(np.log(n)), distinct / n, float(np.log(distinct) / np.log(n + 1)), min(size / n, 40.0) / 10, 0.0]


@dataclass(frozen=True)
class Ranking:
    """Weights on standardised features, the cut between good and bad, and the slope of the score."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * (self.strength(x) - self.cut) + np.log(CUT / (1 - CUT)))


def rank(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Ranking:
    """Fit the ranking to features ``x`` with labels ``y``.

    Without documents of both labels nothing can be ranked: then all score 1
    if there is no bad one, else 0.
    """
    width = x.shape[1] if x.ndim == 2 else len(features(b""))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), -1.0 if not len(bad) else 1.0, 30.0)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - centre) / scale, -8, 8)
    draw = np.random.default_rng(seed)
    win = np.concatenate((draw.choice(good, len(bad) * PARTNERS), np.repeat(good, 1)))
    lose = np.concatenate((np.repeat(bad, PARTNERS), draw.choice(bad, len(good))))
    gap = z[win] - z[lose]
    flip = draw.random(len(gap)) < 0.5
    weights = logistic(np.where(flip[:, None], -gap, gap), (~flip).astype(float), ridge=1e-3)
    strength = np.sort(z @ weights)
    cut = float((strength[len(bad) - 1] + strength[len(bad)]) / 2)
    slopes = np.geomspace(0.1, 10, 25)
    at = (z @ weights - cut)[None, :] * slopes[:, None] + np.log(CUT / (1 - CUT))
    loss = np.where(y == 1, np.logaddexp(0, -at), np.logaddexp(0, at)).mean(axis=1)
    return Ranking(centre, scale, weights, cut, float(slopes[loss.argmin()]))


def learn(docs: DataFrame, labels: DataFrame) -> Ranking:
    """Fit on at most ``labelled.SAMPLE`` labelled documents; their features, not texts, reach the driver."""
    width = len(features(b""))
    schema = pa.schema([("label", pa.int32()), ("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield batch_of(schema, b.column(0), b.column(1), [features(t) for t in text_bytes(b.column(2))])

    rows = sample(docs, labels, "quality").mapInArrow(scan, "label int, doc_id long, x array<double>").toPandas()
    rows = rows.sort_values(["doc_id", "label"], kind="stable")
    return rank(np.array(rows["x"].tolist(), float).reshape(-1, width), rows["label"].to_numpy())


def _scores(model: Ranking, texts: list[bytes]) -> np.ndarray:
    return model.score(np.array([features(t) for t in texts], float)) if texts else np.empty(0)


def score(docs: DataFrame, model: Ranking) -> DataFrame:
    """(doc_id, score, predicted) of every document; needs doc_id and text.

    Null texts count as empty. Repeated rows score alike; null ids are allowed;
    other columns are ignored; an empty table gives an empty one.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield batch_of(schema, b.column(0), _scores(model, text_bytes(b.column(1))))

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(scan, "doc_id long, score double").withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are predicted good, as they are."""
    model, where = learn(docs, labels), docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield b.filter(pa.array(_scores(model, text_bytes(b.column(where))) >= CUT, pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)


def op5(spark, sf_dir: str) -> DataFrame:
    """The digest of the operator over all documents."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (~in_training(F.col("doc_id"), 4, 2)).alias("held_out"), "score", "predicted")
