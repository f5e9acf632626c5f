"""Operator 11: periodic runs of words, found by the runs theorem.

Every maximal repetition has a Lyndon root that is the longest Lyndon word at its
place under the order of words or under the reversed one. Those words end where
the next smaller (or greater) value of the inverse suffix array stands; a root is
extended to its run by longest common extensions, from the LCP array and a sparse
table of range minima, to the right in the text and to the left in its reverse.

Texts are worked on many at a time as NumPy arrays. Suffixes are only compared
inside their own text, so what texts share costs nothing. Null and empty texts
have no words and no runs; repeated rows give a row each; an empty table gives
none. One text is worked on whole: memory grows with n log n of the longest text.
Of runs with one exponent the first counts, then that of the least period.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costgrain.llm.common import batch_of, small, table, text_bytes

#: A run has this many words and this many periods at least.
WORDS, PERIODS = 6, 4
#: Texts are worked on together up to so many words.
TOGETHER = 200_000

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
KINDS = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Suffixes:
    """Suffix order inside each of several texts that stand one after another.

    ``words`` holds word numbers, ``ends[i]`` where the text of position i ends.
    ``place`` is the inverse suffix array, grouped by text; ``lce`` the longest
    common extension of two positions of one text.
    """

    def __init__(self, words: np.ndarray, ends: np.ndarray):
        n = len(words)
        self.ends = ends
        levels = [self._first(words, ends)]
        h = 1
        while True:
            rank = levels[-1].copy()
            size = np.bincount(rank, minlength=n)
            act = np.flatnonzero(size[rank] > 1)
            if not len(act):
                break
            next_ = act + h
            inside = next_ < ends[act]
            second = np.zeros(len(act), np.int64)
            second[inside] = rank[next_[inside]] + 1
            key = rank[act] * np.int64(n + 1) + second
            order = np.argsort(key, kind="stable")
            act, key = act[order], key[order]
            at = np.arange(len(act))
            new = np.concatenate(([True], key[1:] != key[:-1]))
            group = np.concatenate(([True], rank[act[1:]] != rank[act[:-1]]))
            first_new = np.maximum.accumulate(np.where(new, at, 0))
            first_group = np.maximum.accumulate(np.where(group, at, 0))
            rank[act] += (first_new - first_group).astype(rank.dtype)
            levels.append(rank)
            h *= 2
        self.place = levels[-1]
        self.order = np.empty(n, np.int64)
        self.order[self.place] = np.arange(n)
        self.minima = sparse(self._lcp(levels))

    @staticmethod
    def _first(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rank by text, then first word: how many positions come before the group."""
        order = np.lexsort((words, ends))
        w, e = words[order], ends[order]
        new = np.concatenate(([True], (w[1:] != w[:-1]) | (e[1:] != e[:-1])))
        rank = np.empty(len(words), np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(words)), 0))
        return rank

    def _lcp(self, levels: list[np.ndarray]) -> np.ndarray:
        """Common words of each suffix with the one before it in order; 0 across texts."""
        a, b = self.order[:-1], self.order[1:]
        out = np.zeros(len(self.order), np.int32)
        same = np.flatnonzero(levels[0][a] == levels[0][b])
        a, b, long = a[same], b[same], np.zeros(len(same), np.int64)
        for k in range(len(levels) - 2, -1, -1):
            x, y = a + long, b + long
            ok = np.flatnonzero((x < self.ends[a]) & (y < self.ends[b]))
            ok = ok[levels[k][x[ok]] == levels[k][y[ok]]]
            long[ok] += 1 << k
        out[same + 1] = long
        return out

    def lce(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common words from the positions ``a`` and ``b`` on; a pair is of one text and not one position."""
        x, y = self.place[a], self.place[b]
        lo, hi = np.minimum(x, y) + 1, np.maximum(x, y)
        k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            row = self.minima[level]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << int(level)) + 1])
        return out


def sparse(values: np.ndarray, longest: int | None = None) -> list[np.ndarray]:
    """Minima of all stretches of 1, 2, 4, ... values (of at most ``longest``), by where they begin."""
    rows, h = [values], 1
    while 2 * h <= min(len(values), longest or len(values)):
        rows.append(np.minimum(rows[-1][:-h], rows[-1][h:]))
        h *= 2
    return rows


def next_smaller(values: np.ndarray, ends: np.ndarray, longest: int) -> np.ndarray:
    """For each position the next of its text with a smaller value, or the text's end; no value comes twice."""
    at = np.arange(1, len(values) + 1)
    rows = sparse(values, longest)
    for k in range(len(rows) - 1, -1, -1):
        may = np.flatnonzero(at + (1 << k) <= ends)
        may = may[rows[k][at[may]] > values[may]]
        at[may] += 1 << k
    return at


def runs(words: np.ndarray, ends: np.ndarray, words_least: int = WORDS, periods: int = PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs with the least words and periods, by start, then period.

    ``periods`` is 3 at least: a run then holds a root after its first word that
    is followed by ``periods - 2`` periods that repeat it, so that roots with
    shorter extensions are dropped before they are extended to the left.
    """
    none = np.zeros(0, np.int64)
    if len(words) < 2:
        return none, none, none
    forth = Suffixes(words, ends)
    starts = np.concatenate(([0], np.flatnonzero(ends[1:] != ends[:-1]) + 1))
    longest = int((ends[starts] - starts).max())
    place = forth.place.astype(np.int64)
    here = np.arange(len(words))
    found = []
    for values in (place, -place):
        after = next_smaller(values, ends, longest)
        at = np.flatnonzero(after < ends)
        right = forth.lce(at, after[at])
        keep = right >= (periods - 2) * (after[at] - at)
        found.append((at[keep], after[at][keep], right[keep]))
    a, b, right = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(a):
        return none, none, none
    # The texts with roots once more, backwards: position i of a text from s to e stands at s + e - 1 - i.
    begin = starts[np.searchsorted(starts, here, "right") - 1]
    mark = np.zeros(len(words) + 1, np.int64)
    mark[np.unique(begin[a])] = 1
    kept = np.flatnonzero(mark[begin] == 1)
    moved = np.cumsum(mark[begin] == 1) - 1
    new_end = moved[ends[kept] - 1] + 1
    back = Suffixes(words[(begin + ends - 1 - here)[kept]], new_end)
    mirror = moved[begin + ends - 1 - here]
    left = np.zeros(len(a), np.int64)
    more = np.flatnonzero(a > begin[a])
    left[more] = back.lce(mirror[a[more] - 1], mirror[b[more] - 1])
    period, start = b - a, a - left
    length = b + right - start
    good = length >= np.maximum(words_least, periods * period)
    each = np.unique(np.stack([start[good], period[good], length[good]], 1), axis=0)
    return each[:, 0], each[:, 2], each[:, 1]


def rewritten(n: int, h: int) -> np.ndarray:
    """Which original word stands at each place of a text whose id has the checksum ``h``."""
    at = np.arange(n)
    if h % 10 or not n:
        return at
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at[a:] = a + (at[a:] - a) % p
    return at


def _rows(ids: list[int | None], texts: list[list[bytes]], sums: list[int | None]) -> pa.RecordBatch:
    numbers: dict[bytes, int] = {}
    coded, plain = [], []
    for words, h in zip(texts, sums, strict=True):
        if h is not None and h % 10 == 0:
            words = [words[k] for k in rewritten(len(words), h).tolist()]
        plain.append(words)
        coded.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
    sizes = np.array([len(c) for c in coded])
    ends = np.cumsum(sizes)
    start, length, period = runs(np.concatenate(coded) if coded else np.zeros(0, np.int64), np.repeat(ends, sizes))
    first, last = np.searchsorted(start, ends - sizes), np.searchsorted(start, ends)
    out = []
    for doc, words, lo, hi, base in zip(ids, plain, first.tolist(), last.tolist(), (ends - sizes).tolist(), strict=True):
        mine = list(zip((start[lo:hi] - base).tolist(), length[lo:hi].tolist(), period[lo:hi].tolist(), strict=True))
        best = (None, None, None)
        for s, n, q in mine:  # by start, then period: an equal exponent that comes later is none better
            if best[0] is None or n * best[2] > best[1] * q:
                best = (s, n, q)
        if mine:
            gone = np.zeros(len(words) + 1, np.int64)
            for s, n, q in mine:
                gone[s + q] += 1
                gone[s + n] -= 1
            words = [w for w, k in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not k]
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in mine)
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        out.append((doc, len(plain[len(out)]), len(mine), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()))
    return batch_of(SCHEMA, *(zip(*out, strict=True) if out else [[] for _ in SCHEMA]))


def _of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, texts, sums, held = [], [], [], 0
    for b in small(batches, 500):
        for doc, text, h in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
            words = text.split()  # bytes are split at blanks and tab to carriage return, and nowhere else
            if ids and held + len(words) > TOGETHER:
                yield _rows(ids, texts, sums)
                ids, texts, sums, held = [], [], [], 0
            ids.append(doc)
            texts.append(words)
            sums.append(h)
            held += len(words)
    if ids:
        yield _rows(ids, texts, sums)


def periodic_runs(docs: DataFrame, checksum: Column | None = None) -> DataFrame:
    """Runs of each document: their number, the one of the greatest exponent, digests of all
    runs and of the text with every run cut to its first period.

    ``checksum`` (long) plants periods as ``rewritten`` says where it is a multiple of ten;
    null, the default, leaves a text as it is. No shuffle: each text is one row's work.
    """
    h = F.lit(None).cast("long") if checksum is None else checksum
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.cast("long").alias("h"))
    return rows.mapInArrow(_of_batches, KINDS)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, with periods planted by the checksum of doc_id; a null id plants none."""
    return periodic_runs(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")))
