"""Operator 9: SimHash near-dedup with pigeonring candidates.

A fingerprint has 64 bits; two link when at most ``REACH`` bits differ. Laid as
a ring of 16 segments of four bits, the pigeonring principle says that two
linked fingerprints have a start from which the differences over the next l
segments stay within l * 4 / 16 for every l: none in three segments, at most
one in seven, two in eleven. Each fingerprint is filed, for each of the 16 starts,
under the first segments without those that may differ: 64 keys of 24 bits, or in
a table of very many fingerprints 352 keys of 36 bits. Two that share a key are
held to the budgets of the chain, segment after segment, and then to the full
distance. No pair within reach is missed.

Only distinct fingerprints are filed, so exact copies cost one row however many
there are. A key with more than ``MOST`` of them is dealt again by parts of their
bits, and a large set inside a task likewise; each set gives the links of a
spanning star, never all pairs.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from costgrain.llm.common import apart, batch_of, cut, runs, small, table, text_bytes
from costgrain.llm.components import components

SHINGLE = 4
SEED = 42
REACH = 4
SEGMENTS = 16
#: Sets up to this size are compared in one matrix, and as many of a key in one task.
DENSE, MOST = 1024, 1 << 16
#: From so many fingerprints on, keys take in eleven segments; up to it, seven.
LONG_KEYS = 1 << 27

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = np.arange(8) * 256


def fingerprint(text: bytes) -> int:
    """SimHash of the word shingles of a UTF-8 text, as a signed 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [digest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: 1 - SHINGLE]
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]
    lanes = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8) + _LANES
    ones = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    majority = np.packbits(2 * ones.ravel() > len(hashes), bitorder="little")
    return int(majority.view("<i8")[0])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every document; null and blank texts have zero."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield batch_of(schema, b.column(0), [fingerprint(t) for t in text_bytes(b.column(1))])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, "doc_id long, fp long")


def _free(chain: int) -> list[tuple[int, ...]]:
    """The sets of segments in which the first ``chain`` ones may differ within their budgets."""
    most = chain * REACH // SEGMENTS
    fits = lambda some: all(sum(x < n for x in some) <= n * REACH // SEGMENTS for n in range(1, chain + 1))
    return [some for some in itertools.combinations(range(chain), most) if fits(some)]


def _keys(fp: F.Column, chain: int) -> F.Column:
    """The keys of a fingerprint: number of the key above, chain below."""
    free, out = _free(chain), []
    for start in range(SEGMENTS):
        turn = 4 * start
        ring = F.shiftrightunsigned(fp, turn).bitwiseOR(F.shiftleft(fp, 64 - turn)) if turn else fp
        for k, some in enumerate(free):
            mask = (1 << 4 * chain) - 1
            for segment in some:
                mask &= ~(15 << (4 * segment))
            out.append(ring.bitwiseAND(F.lit(mask).cast("long")).bitwiseOR(F.lit((start * len(free) + k) << (4 * chain)).cast("long")))
    return F.array(*out)


def _in_chain(apart_by: np.ndarray, start: int) -> np.ndarray:
    """Which differences of two fingerprints keep to every budget of the chain from ``start``, the last being the full distance."""
    turn = np.uint64(4 * start)
    ring = (apart_by >> turn) | (apart_by << (np.uint64(64) - turn)) if start else apart_by
    left = np.arange(len(ring))
    for n in (3, 7, 11, 15, 16):  # the budgets rise after these
        mask = np.uint64((1 << 4 * n) - 1)
        left = left[np.bitwise_count(ring[left] & mask) <= n * REACH // SEGMENTS]
    return left


def _stars(near: np.ndarray) -> list[tuple[int, int]]:
    """Links of each member to the first of its component in a small matrix."""
    left, out = np.ones(len(near), bool), []
    for first in range(len(near)):
        if not left[first]:
            continue
        left[first] = False
        front = np.array([first])
        while front.size:
            front = np.flatnonzero(near[front].any(axis=0) & left)
            left[front] = False
            out += [(int(m), first) for m in front]
    return out


def star_links(fps: np.ndarray, nodes: np.ndarray, start: int | None = None) -> list[tuple[int, int]]:
    """Links that connect exactly what pairs of ``fps`` (distinct) within reach, and in a chain from ``start`` if given, connect."""
    if len(fps) < 2:
        return []
    if len(fps) <= DENSE:
        i, j = np.triu_indices(len(fps), 1)
        gaps = fps[i] ^ fps[j]
        held = np.flatnonzero(np.bitwise_count(gaps) <= REACH) if start is None else _in_chain(gaps, start)
        if len(held) < 2:
            return [(int(nodes[i[k]]), int(nodes[j[k]])) for k in held]
        near = np.zeros((len(fps), len(fps)), bool)
        near[i[held], j[held]] = near[j[held], i[held]] = True
        return [(int(nodes[x]), int(nodes[y])) for x, y in _stars(near)]
    # Of five groups of the bits that vary, a pair within four bits agrees on one.
    varying = np.bitwise_or.reduce(fps ^ fps[0])
    bits = [b for b in range(64) if (int(varying) >> b) & 1]
    out = []
    for part in range(REACH + 1):
        mask = np.uint64(sum(1 << b for b in bits[part :: REACH + 1]))
        order = np.argsort(fps & mask, kind="stable")
        cut_at = np.flatnonzero(np.diff(fps[order] & mask)) + 1
        for some in np.split(order, cut_at):
            if len(some) > 1:
                out += star_links(fps[some], nodes[some], start)
    return list(dict.fromkeys(out))


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("fp", pa.int64())])


def _of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of the runs of rows key, start, fp, node that come sorted by key.

    A run of more than MOST goes on as it is, as rows a (node), key, start, fp without b."""

    def linked(keys, starts, fps, nodes) -> pa.RecordBatch:
        fps, out = fps.view(np.uint64), []
        for x, y in runs(keys):
            out += star_links(fps[x:y], nodes[x:y], int(starts[x]))
        more = (pa.nulls(len(out), f.type) for f in list(_FOUND)[2:])
        return batch_of(_FOUND, [x for x, _ in out], [y for _, y in out], *more)

    def passed_on(keys, starts, fps, nodes) -> pa.RecordBatch:
        return batch_of(_FOUND, nodes, pa.nulls(len(nodes), pa.int64()), keys, starts, fps)

    held, large = [], None  # rows of the run that is going on; the key of one that is passed on
    for b in batches:
        if not b.num_rows:
            continue
        new = [c.to_numpy() for c in b.columns]
        if large is not None:
            n = int(np.searchsorted(new[0], large, side="right"))
            if n:
                yield passed_on(*(c[:n] for c in new))
            if n == len(new[0]):
                continue
            new, large = [c[n:] for c in new], None
        last = int(np.searchsorted(new[0], new[0][-1]))
        if held and new[0][0] != held[0][0][0]:
            yield linked(*map(np.concatenate, zip(*held, strict=True)))
            held = []
        if last:  # the run that was held ends in this batch
            yield linked(*map(np.concatenate, zip(*held, [c[:last] for c in new], strict=True)))
            held = []
        held.append([c[last:] for c in new])
        if sum(len(h[0]) for h in held) > MOST:
            large = int(held[0][0][0])
            yield passed_on(*map(np.concatenate, zip(*held, strict=True)))
            held = []
    if held:
        yield linked(*map(np.concatenate, zip(*held, strict=True)))


def _dealt(filed: DataFrame) -> DataFrame:
    some = filed.select("key", "start", "fp", "node").repartition("key").sortWithinPartitions("key")
    return cut(some.mapInArrow(_of_runs, "a long, b long, key long, start int, fp long"))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) links that connect the fingerprints (fp, node; one row each) in reach."""
    chain = 7 if distinct.count() <= LONG_KEYS else 11
    each = len(_free(chain))
    filed = distinct.select(F.explode(_keys(F.col("fp"), chain)).alias("key"), "fp", "node")
    found = _dealt(filed.withColumn("start", F.floor(F.shiftrightunsigned("key", 4 * chain) / each).cast("int")))
    out, level = found.where("b is not null").select("a", "b"), 0
    while (rest := found.where("b is null")).take(1):
        # Of five parts of the bits, another five each time, a pair within four bits agrees on one.
        level, bits = level + 1, list(range(64))
        random.Random(level).shuffle(bits)
        masks = [sum(1 << b for b in bits[k :: REACH + 1]) for k in range(REACH + 1)]
        parts = F.array(*(F.xxhash64("key", F.lit(k), F.col("fp").bitwiseAND(F.lit(m - (m >> 63 << 64)).cast("long"))) for k, m in enumerate(masks)))
        found = _dealt(rest.select(F.explode(parts).alias("key"), "start", "fp", F.col("a").alias("node")))
        out = out.unionByName(found.where("b is not null").select("a", "b"))
    return out


def near_duplicates(docs: DataFrame, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of every document; ``docs`` needs doc_id and text.

    component_id is the smallest doc_id that a document reaches over links.
    Null and blank texts have fingerprint zero and link like any other. Repeated
    rows stay; they share all. A document without an id joins nothing: its
    component is that of the documents with its very fingerprint, or null. An
    empty table gives an empty one. Other columns are ignored. ``more`` may tell further links (a, b) among documents,
    of which it gets one for each fingerprint.
    """
    prints = cut(with_fingerprints(docs))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = links(distinct.where("node is not null"))
    if more is not None:
        one = distinct.where("node is not null").select(F.col("node").alias("doc_id"))
        found = found.unionByName(more(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(one, "doc_id", "left_semi")))
    roots = components(found.distinct())
    labelled = distinct.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(apart(labelled, "fp"), "fp").select("doc_id", "fp", "component_id")


def op9(spark, sf_dir: str) -> DataFrame:
    """The digest of the operator over all documents."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest
    doc_id. Of rows that repeat a doc_id one stays; rows without one all stay. ``more`` tells further
    links, as for ``near_duplicates``.
    Null and blank texts are one group; an empty table gives an empty one; all columns are kept.
    """
    first = near_duplicates(docs, more).where("doc_id = component_id").select("doc_id").distinct()
    same = W.partitionBy("doc_id").orderBy("text")
    plain = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kept = plain.join(first, "doc_id", "left_semi").withColumn("nth", F.row_number().over(same)).where("nth = 1")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns)).unionByName(docs.where("doc_id is null"))
