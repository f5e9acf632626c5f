"""Operator 13: language identification by error-correcting output codes.

Each language has a codeword of bits. For every bit a logistic classifier over
hashed letter n-grams (one to three letters, lower case, what is no letter is a
gap) tells which half of the languages a text belongs to. Decoding weighs each
bit's loss by how well its classifier knows the language in question, takes the
language of least loss and flags a text as ambiguous where the second comes close.

The classifiers learn from at most ``SAMPLE`` documents, dealt evenly to the
languages; whole texts are read, in training and in scoring. Null texts and texts
without a letter are ``und`` with a score of 0; so is everything where there is
nothing to learn from. Repeated rows give a row each; languages of equal loss
go to the first in alphabetical order; very long texts are counted in pieces.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from costgrain.llm.common import batch_of, cut, in_training, small, table
from costgrain.llm.labelled import sigmoid

#: At most so many documents teach the classifiers; with more languages than that, those with most documents.
SAMPLE = 4_096
#: Buckets that n-grams are hashed to, and positions counted at a time.
BUCKETS, PIECE = 1 << 12, 1 << 18
#: A text is ambiguous where the score of its language isn't this much above the next one's.
CLEAR = 0.2

SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_()), ("distance", pa.int64())])
KINDS = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean, distance long"


@functools.cache
def _letters() -> np.ndarray:
    """For every code point that of its lower case if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def codes_of(text: str | None) -> np.ndarray:
    """The letters of a text in lower case with one 0 for each gap, one before and one after."""
    raw = _letters()[np.frombuffer((text or "").encode("utf-32-le"), np.uint32)]
    all_ = np.concatenate(([0], raw, [0]))
    return all_[np.concatenate(([True], (all_[1:] > 0) | (all_[:-1] > 0)))]


def grams(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(where they end, bucket) of all n-grams but single gaps, a piece at a time."""
    wide = codes.astype(np.uint64)
    mix = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    for a in range(0, len(wide), PIECE):
        z = min(a + PIECE, len(wide))
        for n in (1, 2, 3):
            at = np.arange(max(a, n - 1), z)
            if not len(at):
                continue
            h = np.full(len(at), n, np.uint64)
            for k in range(n):
                h = (h ^ wide[at - k]) * mix[k]
                h ^= h >> np.uint64(29)
            h *= mix[0]
            # Two gaps in a row stand only between two texts, which no n-gram spans.
            none = wide[at] == 0 if n == 1 else (wide[at] == 0) & (wide[at - 1] == 0)
            if n == 3:
                none |= (wide[at - 1] == 0) & (wide[at - 2] == 0)
            yield at[~none], (h >> shift).astype(np.int64)[~none]


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, share of all n-grams) of a text, the buckets that it has."""
    total = np.zeros(BUCKETS)
    for _, bucket in grams(codes_of(text)):
        total += np.bincount(bucket, minlength=BUCKETS)
    some = np.flatnonzero(total)
    return some, total[some] / max(1.0, total.sum())


def codewords(languages: int, seed: int = 13) -> np.ndarray:
    """A codeword of -1 and 1 for each language. Up to six languages have every split in
    two; more have the best of 64 drawn codes: of the greatest least distance."""
    if languages < 2:
        return np.ones((languages, 1), np.int8)
    if languages <= 6:
        splits = np.arange(1, 1 << (languages - 1))
        return np.where((splits[None, :] >> np.arange(languages)[:, None]) & 1, 1, -1).astype(np.int8)
    draw, best, far = np.random.default_rng(seed), None, -1.0
    bits = int(np.ceil(10 * np.log2(languages)))
    for _ in range(64):
        code = draw.choice(np.array([-1, 1], np.int8), (languages, bits))
        code[0] = 1  # no bit is the same for all
        flat = np.abs(code.sum(0, dtype=np.int64)) == languages
        code[draw.integers(1, languages, flat.sum()), np.flatnonzero(flat)] *= -1
        near = (bits - (code.astype(np.float32) @ code.T.astype(np.float32))) / 2
        np.fill_diagonal(near, bits)
        if near.min() > far:
            best, far = code, near.min()
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a logistic classifier for each column of ``y`` (-1 or 1) by accelerated gradient steps."""
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (np.linalg.norm(x @ v) ** 2 / 4 / len(x) + ridge)
    ahead, t = w, 1.0
    for _ in range(rounds):
        slope = -x.T @ (y * sigmoid(-y * (x @ ahead))) / len(x) + ridge * ahead
        new = (ahead - step * slope).astype(np.float32)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = (new + np.float32((before - 1) / t) * (new - w)).astype(np.float32), new
    return w


class Model:
    """Languages with their codewords, the bits' classifiers and how far to trust them."""

    def __init__(self, languages: list[str], rows: list[tuple[int, np.ndarray, np.ndarray]]):
        """``rows`` are (number of the language, buckets, shares) of each training document."""
        self.languages, self.code = languages, codewords(len(languages))
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for k, (_, bucket, share) in enumerate(rows):
            x[k, bucket] = share
        scale = 1 / np.sqrt(x.mean(0) + 1 / BUCKETS / 8)
        of = np.array([r[0] for r in rows])
        whole = np.concatenate([x * scale, np.ones((len(rows), 1), np.float32)], 1)
        w = fit(whole, self.code[of].astype(np.float32))
        self.weights, self.bias = (w[:-1] * scale[:, None]).astype(np.float32), w[-1].astype(np.float64)
        right = (whole @ w * self.code[of] > 0).astype(float)
        trust = np.stack([right[of == k].mean(0) if (of == k).any() else np.ones(right.shape[1]) for k in range(len(languages))])
        trust = np.maximum(trust, 1e-3)
        self.trust = trust / trust.sum(1, keepdims=True)

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """Each bit's margin for each text, the mean over all its n-grams."""
        codes = [codes_of(t) for t in texts]
        ends = np.cumsum([len(c) for c in codes])
        sums, n = np.zeros((len(texts), self.weights.shape[1])), np.zeros(len(texts))
        for at, bucket in grams(np.concatenate(codes)):
            of = np.searchsorted(ends, at, "right")
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
            if len(first):
                sums[of[first]] += np.add.reduceat(self.weights[bucket], first, axis=0)
                n[of[first]] += np.diff(np.append(first, len(of)))
        return sums / np.maximum(n, 1)[:, None] + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, ambiguous, bits that differ from its codeword) of each row of margins."""
        loss = np.stack([np.logaddexp(0, -margins * c) @ t for c, t in zip(self.code, self.trust, strict=True)], 1)
        likely = np.exp((loss.min(1, keepdims=True) - loss) * self.code.shape[1])
        likely /= likely.sum(1, keepdims=True)
        best = loss.argmin(1)
        score = likely[np.arange(len(best)), best]
        second = np.sort(likely, 1)[:, -2] if len(self.languages) > 1 else np.zeros(len(best))
        return best, score, score - second < CLEAR, ((margins * self.code[best]) <= 0).sum(1)


def training_sample(docs: DataFrame, modulus: int, held_out: int, size: int = SAMPLE) -> DataFrame:
    """(lang, text) of at most ``size`` documents that may teach, evenly from all languages.

    Of a language with many documents those with the least hashes of id and text are taken.
    """
    known = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where(F.col("lang").isNotNull() & F.regexp_like("text", F.lit(r"\p{L}")) & in_training(F.col("doc_id"), modulus, held_out))
    hashed = known.withColumn("_h", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)))
    sizes = cut(known.groupBy("lang").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "lang").limit(size))
    share = max(1, size // max(1, sizes.count()))
    # Twice the share by hash first, so that no language comes to one task whole.
    some = hashed.join(F.broadcast(sizes), "lang").where(F.col("_h") * F.col("_n") < F.lit(float(2 * share + 64)) * (1 << 40))
    nth = F.row_number().over(W.partitionBy("lang").orderBy("_h", "doc_id"))
    return some.withColumn("_nth", nth).where(F.col("_nth") <= share).select("lang", "text")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("buckets", pa.binary()), ("shares", pa.binary())])
    for b in batches:
        each = [counts(t) for t in b.column(1).to_pylist()]
        yield batch_of(schema, b.column(0).cast(pa.string()), [k.astype(np.int16).tobytes() for k, _ in each], [s.astype(np.float32).tobytes() for _, s in each])


def learn(docs: DataFrame, modulus: int = 5, held_out: int = 0) -> Model | None:
    """A model of the documents outside the held-out rows; None where none has a language and letters."""
    rows = training_sample(docs, modulus, held_out).mapInArrow(_counted, "lang string, buckets binary, shares binary").collect()  # SAMPLE rows of at most BUCKETS counts
    if not rows:
        return None
    rows.sort(key=lambda r: (r.lang, bytes(r.buckets), bytes(r.shares)))  # in whatever order they come, the model is the same
    languages = sorted({r.lang for r in rows})
    number = {x: k for k, x in enumerate(languages)}
    return Model(languages, [(number[r.lang], np.frombuffer(r.buckets, np.int16).astype(np.int64), np.frombuffer(r.shares, np.float32)) for r in rows])


def identify(docs: DataFrame, model: Model | None, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """The language of every whole text with its score, whether it is ambiguous, and by how many bits its codeword was missed."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights a bit

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in small(batches, 200):
            texts, lettered = b.column(2).to_pylist(), np.array(b.column(3).to_pylist(), bool)
            if m is None or not lettered.any():
                best, p, vague, off = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool), np.zeros(len(texts), int)
            else:
                best, p, vague, off = m.decode(m.margins(texts))
            sure = lettered & (m is not None)
            names = [m.languages[k] if s else "und" for k, s in zip(best.tolist(), sure.tolist(), strict=True)]
            yield batch_of(SCHEMA, b.column(0), b.column(1), names, np.where(sure, p, 0.0), np.where(sure, vague, True), np.where(sure, off, 0))

    lettered = F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~in_training(F.col("doc_id"), modulus, held_out)).alias("held_out"), F.col("text").cast("string").alias("text")).withColumn("lettered", lettered)
    return rows.mapInArrow(score, KINDS)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those whose checksum modulo 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
