"""Operator 1: length buckets of least padding, and batches under a token budget.

An exact histogram of token counts over all documents is made; dynamic programming
over its lengths chooses the bucket bounds so that padding every document to the
bound of its bucket wastes the fewest tokens. Inside a bucket, as many documents
share a batch as fit the token budget when padded; a longer document is a batch
of its own, whole.

The histogram reaches the driver: k different lengths take k * k / 2 tokens at least,
so that even 2 * 10**13 tokens have no more than 6 million of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costgrain.llm.common import chunks_for, cut, table, with_offsets, word_count

BUCKETS = 12
BUDGET = 16_384


def bounds(lengths: np.ndarray, rows: np.ndarray, tokens: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Bucket bounds of least padding for a histogram, ascending.

    ``lengths`` ascend; ``rows`` documents of each length hold ``tokens``.
    best[j] is the least padding of the j shortest lengths in the buckets so far; the
    last of these covers i+1..j and pads to lengths[j-1]. The best i never falls
    as j grows, so that each is sought between those of its neighbours: first for every
    2**k-th j, then for those halfway, and so on.
    """
    n, lengths = len(lengths), np.append(0, lengths).astype(np.int64)
    many, sums = np.append(0, np.cumsum(rows)), np.append(0, np.cumsum(tokens))
    best = np.full(n + 1, 1 << 62)
    best[0] = 0
    choice = []
    for _ in range(min(buckets, n)):
        now, took = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        step = 1 << n.bit_length()
        while step := step >> 1:
            j = np.arange(step, n + 1, 2 * step)
            least, most = took[j - step], np.minimum(j - 1, np.where(j + step <= n, took[np.minimum(j + step, n)], n))
            width = most - least + 1
            ends = np.cumsum(width)
            i = np.arange(ends[-1]) + np.repeat(least - ends + width, width)
            jj = np.repeat(j, width)
            cost = best[i] + lengths[jj] * (many[jj] - many[i]) - (sums[jj] - sums[i])
            now[j] = np.minimum.reduceat(cost, ends - width)
            hit = np.flatnonzero(cost == np.repeat(now[j], width))
            took[j] = i[hit[np.unique(jj[hit], return_index=True)[1]]]
        best = now
        choice.append(took)
    out, j = [], n
    for took in reversed(choice):
        if j == 0:
            break
        out.append(int(lengths[j]))
        j = int(took[j])
    return out[::-1]


def pack(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_tokens, batch, slot, batch_rows_most) of every document.

    ``length`` is the token count (words of ``text`` if none is given). ``bucket``
    numbers the bounds from 0, ``batch`` the batches of a bucket, ``slot`` the
    documents of a batch. Null and blank texts have no token and take the
    shortest bucket. Rows that repeat a doc_id are packed each; null ids are kept;
    an empty table gives an empty one.
    """
    length = word_count(F.col("text").cast("string")) if length is None else length
    tie = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("_tie")  # many rows without an id are dealt too
    plain = cut(docs.select(F.col("doc_id").cast("long"), length.cast("long").alias("n_tokens"), tie))
    histogram = plain.groupBy("n_tokens").agg(F.count("*")).orderBy("n_tokens").collect()
    lengths, many = (np.array([r[k] for r in histogram], dtype=np.int64) for k in range(2))
    chosen, rows = bounds(lengths, many, lengths * many, buckets), int(many.sum())
    bucket = F.lit(max(0, len(chosen) - 1))
    for k in range(len(chosen) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= chosen[k], k).otherwise(bucket)
    bound = F.get(F.array(*(F.lit(b).cast("long") for b in chosen)) if chosen else F.array(F.lit(0).cast("long")), F.col("bucket"))
    placed = plain.select("doc_id", "n_tokens", "_tie", bucket.cast("int").alias("bucket")).withColumn("bucket_tokens", bound)
    most = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("bucket_tokens"), F.lit(1))))
    numbered = with_offsets(placed, ["bucket"], ["doc_id", "n_tokens", "_tie"], {"nth": F.lit(1).cast("long")}, chunks_for(rows))
    return numbered.select(
        "doc_id", "n_tokens", "bucket", "bucket_tokens", F.floor(F.col("nth") / most).cast("long").alias("batch"), (F.col("nth") % most).cast("long").alias("slot"), most.cast("long").alias("batch_rows_most")
    )


def op1(spark, sf_dir: str) -> DataFrame:
    """The operator over all documents."""
    return pack(table(spark, sf_dir, "documents"))
