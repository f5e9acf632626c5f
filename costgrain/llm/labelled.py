"""Bounded samples of labelled documents, and small logistic fits on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costgrain.llm.common import cut, in_training

#: At most so many labelled documents teach a classifier; all documents are scored.
SAMPLE = 16_000


def chosen(docs: DataFrame, labels: DataFrame, label: str, modulus: int = 4, held_out: int = 2, size: int = SAMPLE) -> DataFrame:
    """(doc_id, label) of at most ``size`` labels of documents outside the held-out rows.

    The labels with the least hashes are taken, so reruns agree. Labels that are
    neither 0 nor 1 teach nothing; a document with two labels counts twice.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    there = known.where(in_training(F.col("doc_id"), modulus, held_out)).join(docs.select(F.col("doc_id").cast("long")), "doc_id", "left_semi")
    return there.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(size)


def sample(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(label, doc_id, text) of the documents of the chosen labels."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    some = cut(chosen(docs, labels, label))
    return texts.join(F.broadcast(some), "doc_id").select("label", "doc_id", "text")  # SAMPLE rows of two numbers at most


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 40) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, as many as columns."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) / len(y) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
