"""Operator 8: class-based n-gram scoring with Brown's exchange clustering.

The documents that teach give a count to every word. Words fall into types: all
that are seen ``LEAST`` times stand for themselves, rarer ones share a type with
the rare words of the same ending. Exchange clustering moves types to the class
that raises the likelihood of the class bigrams most: the commonest one at a time,
then all in rounds, until a round gains next to nothing. A text's probability is
the product over its tokens of P(class | class before) and P(word | class), both
smoothed so that nothing is impossible.

Texts are read once. The documents that come along in a task, up to
``SHARE_TOKENS`` tokens, make a share: one row with their tokens as numbers, and
a row for each of its different words with the count. Counts are added up by
word and sent back, packed, to the shares that hold the word. All else is array work on
numbers: a round of exchange counts, in each share, the classes before and after
each type where one has moved, and only these counts are shuffled, packed by buckets
of types. Scores are worked out where the shares lie. Nothing large is broadcast.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costgrain.llm.common import batch_of, forget, in_training, release, small, stored, table

MODULUS, HELD_OUT = 7, 2
#: Words that teach so often are types of their own; rarer ones share a type by their last letters.
LEAST, ENDING = 20, 3
CLASSES = 32
#: The commonest types that are clustered first, on the driver.
HEAD = 382
#: Natural logarithm of the likelihood, for each token, below which a half-round is quiet; after so many quiet ones the exchange ends.
LEAST_GAIN, QUIET = 1e-3, 2
#: Up to so many types meet their classes by a broadcast.
FEW_TYPES = 500_000
#: Tokens from which on a share is full.
SHARE_TOKENS = 1_000_000
#: Class bigrams added to each row, for each class, in the proportion of the classes; and
#: words that a class is held to have beyond those seen.
TRANSITION, UNSEEN = 0.1, 1.0
#: In so many parts counts of class bigrams are added up.
PARTS = 32
#: Among what is counted for a type: how often it follows itself.
_OWN = 2 * CLASSES


def _type(word: Column, count: Column) -> Column:
    """The type of a word by its count: a hash of the word itself, or of its ending where it is rare."""
    return F.when(count >= LEAST, F.xxhash64(F.lit(1), word)).otherwise(F.xxhash64(F.lit(0), F.right(word.cast("string"), F.lit(ENDING))))


_SHARES = pa.schema(
    [("share", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("learn", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("ids", pa.binary()), ("k", pa.int32()), ("word", pa.binary()), ("n", pa.int64())]
)


def _packed(numbers: np.ndarray, kind: str = "<u4", gaps: bool = False) -> bytes:
    """Whole numbers as compressed bytes, all lowest bytes first, then the next ones, as high ones are mostly alike; with
    ``gaps`` as differences. Their count comes first. Places are below 2**32, counts ("<i8") may be below nought."""
    if not len(numbers):
        return b""
    raw = (np.diff(numbers, prepend=0) if gaps else numbers).astype(kind).view(np.uint8).reshape(len(numbers), -1).T.tobytes()
    return (len(numbers) | gaps << 63).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(packed: bytes, kind: str = "<u4") -> np.ndarray:
    if not packed:
        return np.zeros(0, np.int64)
    head, size = int.from_bytes(packed[:8], "little"), np.dtype(kind).itemsize
    many = head & ~(1 << 63)
    raw = np.frombuffer(pa.decompress(packed[8:], decompressed_size=size * many, codec="zstd", asbytes=True), np.uint8)
    out = np.ascontiguousarray(raw.reshape(size, many).T).view(kind).ravel().astype(np.int64)
    return np.cumsum(out) if head >> 63 else out


def _tokens(texts: pa.Array) -> pa.Array:
    """The words of each text with a-z for A-Z, then the end; null is empty. The end is what splitting leaves after a last blank."""
    own = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())  # ascii_lower gives wrong letters for a slice
    plain = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(own, "")))
    nothing, blank = (pa.scalar(x, plain.type) for x in ("", " "))
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(plain, nothing), plain, pc.binary_join_element_wise(plain, nothing, blank)))


def _by_frequency(ids: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers below ``many`` in the order of how often they are in ``ids``, and ``ids`` as places there: small where common, which packs well."""
    order = np.argsort(-np.bincount(ids, minlength=many), kind="stable")
    place = np.empty(many, np.int64)
    place[order] = np.arange(many)
    return order, place[ids]


def encoded(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents as shares, and the words of the shares.

    A share is a row: share, doc_ids, learn (whether each teaches), sizes (tokens
    of each) and ids (all tokens as numbers of the share). Its words are rows: share,
    k (number), word and n (how often it teaches there; 0 if only held-out texts have it).
    """

    def rows(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc_ids, learn, found = (pa.chunked_array(x).combine_chunks() for x in zip(*held, strict=True))
        sizes, coded = found.value_lengths().to_numpy().astype(np.int64), found.flatten().dictionary_encode()
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        ids, number = coded.indices.to_numpy(), int.from_bytes(os.urandom(8), "little") >> 1  # what is written once keeps it
        order, ids = _by_frequency(ids, len(coded.dictionary))
        words = coded.dictionary.take(pa.array(order)).cast(pa.large_binary()).cast(pa.binary())
        n = np.bincount(ids[np.repeat(learn.to_numpy(zero_copy_only=False), sizes)], minlength=len(words))
        nothing = lambda many: (pa.nulls(many, f.type) for f in _SHARES)
        own = dict(zip(_SHARES.names, nothing(1), strict=True))
        own |= {"share": [number], "doc_ids": whole(doc_ids), "learn": whole(learn), "sizes": [sizes], "ids": [_packed(ids)]}
        yield batch_of(_SHARES, *own.values())
        for a in range(0, len(words), 100_000):
            some = words[a : a + 100_000]
            own = dict(zip(_SHARES.names, nothing(len(some)), strict=True))
            own |= {"share": np.full(len(some), number), "k": np.arange(a, a + len(some)), "word": some, "n": n[a : a + len(some)]}
            yield batch_of(_SHARES, *own.values())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, full = [], SHARE_TOKENS
        for b in small(batches, 100):
            found = _tokens(b.column(2))
            ends, a = np.cumsum(found.value_lengths().to_numpy()), 0
            while a < b.num_rows:  # up to the text that fills the share
                before = ends[a - 1] if a else 0
                z = min(int(np.searchsorted(ends, before + full)) + 1, b.num_rows)
                held.append((b.column(0)[a:z], b.column(1)[a:z], found[a:z]))
                a, full = z, full - int(ends[z - 1] - before)
                if full <= 0:
                    yield from rows(held)
                    held, full = [], SHARE_TOKENS
        if held:
            yield from rows(held)

    plain = docs.select(F.col("doc_id").cast("long"), in_training(F.col("doc_id"), MODULUS, HELD_OUT).alias("learn"), F.col("text").cast("string"))
    both = stored(plain.mapInArrow(scan, "share long, doc_ids array<long>, learn array<boolean>, sizes array<long>, ids binary, k int, word binary, n long"))
    shares = both.where("k is null").select("share", "doc_ids", "learn", "sizes", "ids")
    shares._stored_at = both._stored_at  # to forget both
    return shares, both.where("k is not null").select("share", "k", "word", "n")


def _flat(lists: pa.ChunkedArray) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False)


#: Words of shares that are packed, or whose counts are added up, in one piece.
_WORDS = 1_000_000


def counted(vocabularies: DataFrame) -> DataFrame:
    """(share, k, c, t, word) of the words of shares: c (how often the word teaches in all), its type, and the word
    itself in one of its rows, null in the others; stored. Words are dealt by hash to as many tasks as keep each at about _WORDS rows."""
    names = ["share", "k", "c", "t", "word"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := list(batches)):
            return
        all_ = pa.Table.from_batches(held)
        coded = all_.column("word").combine_chunks().dictionary_encode()
        at, n = coded.indices.to_numpy(), all_.column("n").to_numpy()
        c = np.bincount(at, weights=n, minlength=len(coded.dictionary)).astype(np.int64)[at]  # exact below 2**53
        again = np.ones(len(at), bool)
        again[np.unique(at, return_index=True)[1]] = False
        t = np.where(c >= LEAST, all_.column("own").to_numpy(), all_.column("rare").to_numpy())
        once = pc.if_else(pa.array(again), pa.scalar(None, coded.dictionary.type), all_.column("word").combine_chunks())
        out = pa.table([all_.column("share"), all_.column("k"), c, t, once], names)
        yield from out.to_batches(max_chunksize=100_000)

    spark = vocabularies.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vocabularies.count() // _WORDS))
    own, rare = (_type(F.col("word"), F.lit(n)) for n in (LEAST, 0))
    dealt = vocabularies.repartition(tasks, "word").select("share", "k", "n", "word", own.alias("own"), rare.alias("rare"))
    return stored(dealt.mapInArrow(add, "share long, k int, c long, t long, word binary"))


def _packed_words(placed: DataFrame) -> DataFrame:
    """(share, k, c, t) with packed numbers: a task's words of a share in one row or a few."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            columns = (pa.chunked_array(x).to_numpy() for x in zip(*(b.columns for b in held), strict=True))
            share, k, c, t = columns
            order = np.lexsort((k, share))
            share, k, c, t = share[order], k[order], c[order], t[order]
            cuts = np.flatnonzero(np.append(True, share[1:] != share[:-1]))
            parts = [slice(a, z) for a, z in zip(cuts, np.append(cuts[1:], len(share)), strict=True)]
            return pa.RecordBatch.from_pydict(
                {"share": share[cuts], "k": [_packed(k[p], gaps=True) for p in parts], "c": [_packed(c[p], "<i8") for p in parts], "t": [t[p].tobytes() for p in parts]}
            )

        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held, n = [*held, b], n + b.num_rows
            if n >= _WORDS:
                yield rows(held)
                held, n = [], 0
        if held:
            yield rows(held)

    return placed.select("share", "k", "c", "t").mapInArrow(pack, "share long, k binary, c binary, t binary")


_LONGS = pa.list_(pa.int64())
_TEXTS = pa.schema(
    [("share", pa.int64()), ("types", _LONGS), ("seq", pa.binary()), ("starts", pa.binary()), ("extra", _LONGS), ("held", pa.binary()), ("doc_ids", _LONGS), ("learn", pa.list_(pa.bool_())), ("sizes", _LONGS), ("known", _LONGS), ("logs", pa.list_(pa.float64()))]
)
_TEXTS_SQL = "share long, types array<long>, seq binary, starts binary, extra array<long>, held binary, doc_ids array<long>, learn array<boolean>, sizes array<long>, known array<long>, logs array<double>"


def sequences(shares: DataFrame, placed: DataFrame) -> DataFrame:
    """Shares with types in place of words, a row each; stored.

    types are the different types of what teaches in a share, seq its tokens as numbers of these, and starts the
    places where texts start; held are the tokens of the held-out texts, as numbers of types and then of extra, which has what
    only they have. For each document: doc_ids, learn, sizes, known (tokens that teach) and logs (log10(c + 1) of its tokens added up).
    """

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _TEXTS.empty_table()
        sizes, learn = _flat(left.column("sizes")), _flat(left.column("learn")).astype(bool)
        ids, teaches = _unpacked(left.column("ids")[0].as_py()), np.repeat(learn, sizes)
        k = np.concatenate([_unpacked(x) for x in right.column("k").to_pylist()])
        of_word, c = np.empty(len(k), np.int64), np.empty(len(k), np.int64)
        of_word[k] = np.concatenate([np.frombuffer(x, np.int64) for x in right.column("t").to_pylist()])
        c[k] = np.concatenate([_unpacked(x, "<i8") for x in right.column("c").to_pylist()])
        first = np.cumsum(sizes) - sizes
        added = lambda x: np.add.reduceat(x[ids], first)  # noqa: E731  # every text has a token
        used = np.zeros(len(k), bool)
        used[ids[teaches]] = True
        types = np.unique(of_word[used])
        extra = np.setdiff1d(of_word, types)
        number = np.where(used, np.searchsorted(types, of_word), 0)
        order, seq = _by_frequency(number[ids[teaches]], len(types))
        types = types[order]
        known_types = np.append(types, extra)
        sorter = np.argsort(known_types)
        held = sorter[np.searchsorted(known_types, of_word, sorter=sorter)][ids[~teaches]]
        starts = np.cumsum(sizes[learn]) - sizes[learn]
        own = {"types": [types], "seq": [_packed(seq)], "starts": [_packed(starts, gaps=True)], "extra": [extra], "held": [_packed(held)]}
        own |= {c: left.column(c) for c in ("doc_ids", "learn", "sizes")}
        return pa.table({"share": left.column("share")} | own | {"known": [added((c > 0).astype(np.int64))], "logs": [added(np.log10(c + 1.0))]})

    met = shares.groupBy("share").cogroup(_packed_words(placed).groupBy("share"))
    return stored(met.applyInArrow(one, _TEXTS_SQL))


def _teaching(text: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of what teaches in a share, and whether a text starts there."""
    seq = _unpacked(text.column("seq")[0].as_py())
    start = np.zeros(len(seq), bool)
    start[_unpacked(text.column("starts")[0].as_py())] = True
    return seq, start


def _scanned(texts: DataFrame, classes: DataFrame, many: int, schema: str, count) -> tuple[DataFrame, Callable[[], None]]:
    """What ``count`` gives for each share from its row, and for each number the type and, for every column of ``classes``
    (t, then one or more), its class (-1: none yet); and what to call once that is stored.

    Up to FEW_TYPES types go to the tasks as arrays; more meet the shares by a join."""
    names = [c for c in classes.columns if c != "t"]

    if many <= FEW_TYPES:
        rows = classes.select("t", *names).toPandas().sort_values("t")
        known = texts.sparkSession.sparkContext.broadcast((rows["t"].to_numpy(np.int64), [rows[c].to_numpy(np.int32) for c in names]))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t, given = known.value
            for batch in batches:
                for k in range(batch.num_rows):
                    one = pa.Table.from_batches([batch.slice(k, 1)])
                    kinds = _flat(one.column("types"))
                    at = np.minimum(np.searchsorted(t, kinds), max(0, len(t) - 1))
                    of = [np.where(t[at] == kinds, c[at], -1).astype(np.int32) if len(t) else np.full(len(kinds), -1, np.int32) for c in given]
                    yield from count(one, kinds, *of).to_batches(max_chunksize=100_000)

        return texts.mapInArrow(scan, schema), known.unpersist

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        k = right.column("k").to_numpy()
        kinds, of = np.empty(len(k), np.int64), [np.empty(len(k), np.int64) for _ in names]
        kinds[k] = right.column("t").to_numpy()
        for c, name in zip(of, names, strict=True):
            c[k] = right.column(name).fill_null(-1).to_numpy()
        return count(left, kinds, *of)

    inside = texts.select(F.col("share").alias("part"), F.posexplode("types").alias("k", "t"))
    met = inside.join(classes, "t", "left").select("part", "k", "t", *names)
    return texts.drop("types").groupBy("share").cogroup(met.groupBy("part")).applyInArrow(one, schema), lambda: None


_COUNTED = pa.schema([("t", pa.int64()), ("slot", pa.int32()), ("n", pa.int64())])


def _head_pairs(texts: DataFrame, heads: DataFrame, many: int) -> np.ndarray:
    """How often each of a few types (t, c: its number) follows each other one."""

    def count(text, kinds, of) -> pa.Table:
        seq, start = _teaching(text)
        c = of[seq]
        met = (c[:-1] >= 0) & (c[1:] >= 0) & ~start[1:]
        n = np.bincount(c[:-1][met] * many + c[1:][met], minlength=many * many)
        some = np.flatnonzero(n)
        return pa.Table.from_batches([batch_of(_COUNTED, some // many, some % many, n[some])])

    out = np.zeros((many, many))
    pairs, done = _scanned(texts.select("share", "types", "seq", "starts"), heads, many, "t long, slot int, n long", count)
    for a, b, n in pairs.groupBy("t", "slot").agg(F.sum("n")).collect():  # the square of HEAD
        out[a, b] = n
    done()
    return out


def buckets_for(types: int, each: int = 5_000) -> int:
    """How many buckets, a power of two, hold about ``each`` types or fewer."""
    return max(32, 1 << (-(-types // each) - 1).bit_length())


def _bucket(t: Column, buckets: int) -> Column:
    """Bucket of a type; types are hashes, so their last bits deal them evenly."""
    return t.bitwiseAND(F.lit(buckets - 1).cast("long")).cast("int")


#: A bucket's types with what is counted for them: places in a table of types by slots, and how often.
_PACKED = pa.schema([("bucket", pa.int32()), ("types", pa.binary()), ("cells", pa.binary()), ("n", pa.binary())])
_PACKED_SQL = "bucket int, types binary, cells binary, n binary"


#: Places that are sorted at a time when they are counted.
_CELLS = 4_000_000


def _summed(places: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Different places in ascending order, and how often each is there with sign 1 less how often with -1, where that isn't nought."""
    parts = []
    for at, sign in places:
        for a in range(0, len(at), _CELLS):
            some, n = np.unique(at[a : a + _CELLS], return_counts=True)
            parts.append((some, sign * n))
    if len(parts) < 2:
        return parts[0] if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    some, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(some, kind="stable")  # sorted runs, which it merges
    some, n = some[order], n[order]
    first = np.flatnonzero(np.append(True, some[1:] != some[:-1]))
    some, n = some[first], np.add.reduceat(n, first)
    return some[n != 0], n[n != 0]


def _counted(kinds: np.ndarray, buckets: int, width: int, seen: Callable[[np.ndarray], list[tuple]]) -> list[tuple]:
    """A share's rows, one a bucket: its types, and the cells of them that ``seen`` counts.

    ``seen`` gets the place of every number in the order of buckets and gives parts (places, slots, sign) of what is counted.
    """
    dealt = (kinds & (buckets - 1)).astype(np.int64)
    order = np.argsort(dealt, kind="stable")
    small = len(kinds) * width < 1 << 31
    place = np.empty(len(kinds), np.int32 if small else np.int64)
    place[order] = np.arange(len(kinds))
    some, n = _summed([(at * place.dtype.type(width) + slot, sign) for at, slot, sign in seen(place)])
    if not len(some):
        return []
    at = some // width
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    used, rank = at[first], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
    edges = np.searchsorted(dealt[order[used]], np.arange(buckets + 1))
    cuts, types, cells, rows = np.append(first, len(at))[edges], kinds[order[used]], rank * width + (some - at * width), []
    for k in np.flatnonzero(np.diff(cuts)):
        here = slice(cuts[k], cuts[k + 1])
        rows.append((k, types[edges[k] : edges[k + 1]].tobytes(), _packed(cells[here] - edges[k] * width, gaps=True), _packed(n[here], "<i8")))
    return rows


def _bigrams(part: int, parts: list[tuple[np.ndarray, np.ndarray, int]]) -> list[tuple]:
    """A share's part of the counts of class bigrams, under a bucket below 0: parts (class before, class, sign), of which those below 0 have none."""
    out = np.zeros((CLASSES + 1) * CLASSES, np.int64)
    for before, c, sign in parts:
        seen = (before >= 0) & (c >= 0)
        out += sign * np.bincount(before[seen] * CLASSES + c[seen], minlength=len(out))
    return [(-1 - part % PARTS, b"", _packed(np.flatnonzero(out), gaps=True), _packed(out[out != 0], "<i8"))] if out.any() else []


def _rows_of(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([batch_of(_PACKED, *(zip(*rows, strict=True) if rows else ([],) * 4))])


def _added(counted: DataFrame) -> DataFrame:
    """Packed counts added up, a row for each bucket; stored. They are added up as they
    stream by, so that a task holds the table of one bucket and never its group."""
    width = _OWN + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, types, cells = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def row() -> pa.RecordBatch:
            some = np.flatnonzero(cells)
            return batch_of(_PACKED, [bucket], [types.tobytes()], [_packed(some, gaps=True)], [_packed(cells[some], "<i8")])

        for batch in batches:
            for b, t, at, n in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if b != bucket:
                    if bucket is not None:
                        yield row()
                    bucket, types, cells = b, np.zeros(0, np.int64), np.zeros((CLASSES + 1) * CLASSES if b < 0 else 0, np.int64)
                at, n, mine = _unpacked(at), _unpacked(n, "<i8"), np.frombuffer(t, np.int64)
                if b >= 0:
                    place = np.searchsorted(types, mine)
                    if not len(types) or (types[np.minimum(place, len(types) - 1)] != mine).any():  # the table grows to the bucket's types
                        all_types = np.union1d(types, mine)
                        grown = np.zeros((len(all_types), width), np.int64)
                        grown[np.searchsorted(all_types, types)] = cells.reshape(-1, width)
                        types, cells = all_types, grown.ravel()
                        place = np.searchsorted(types, mine)
                    mine_at = at // width
                    at = (place[mine_at] - mine_at) * width + at
                cells[at] += n  # a share names each cell once
        if bucket is not None:
            yield row()

    return stored(counted.repartition("bucket").sortWithinPartitions("bucket", F.desc(F.length("types"))).mapInArrow(add, _PACKED_SQL))  # the fullest row first: the table grows seldom


def _contexts(texts: DataFrame, classes: DataFrame, many: int, buckets: int) -> DataFrame:
    """What is counted around every type, stored, with a row for each bucket of types: how often
    each class follows a type (slots from 0) and stands before it (from CLASSES), other than by
    its own next to it (slot _OWN). Buckets below 0 hold parts of the counts of class bigrams;
    there, row CLASSES counts the classes that texts start with.
    """
    width = _OWN + 1

    def count(text, kinds, of) -> pa.Table:
        seq, start = _teaching(text)
        c = of[seq]

        def seen(place: np.ndarray) -> list[tuple]:
            p = place[seq]
            a, b, linked = p[:-1], p[1:], ~start[1:]
            own, after, before = linked & (a == b), linked & (a != b) & (c[1:] >= 0), linked & (a != b) & (c[:-1] >= 0)
            return [(a[after], c[1:][after], 1), (b[before], CLASSES + c[:-1][before], 1), (a[own], _OWN, 1)]

        return _rows_of(_counted(kinds, buckets, width, seen) + _bigrams(len(seq), [(np.where(start, CLASSES, np.append(-1, c[:-1])), c, 1)] if len(seq) else []))

    around, done = _scanned(texts.select("share", "types", "seq", "starts"), classes, many, _PACKED_SQL, count)
    out = _added(around)
    done()
    release(texts.sparkSession)
    return out


def _moved_contexts(texts: DataFrame, counts: DataFrame, tried: DataFrame, many: int, buckets: int) -> DataFrame:
    """``counts`` after types have moved from class ``was`` to ``c`` (t, c, was): the same as ``_contexts`` of the new classes.

    Shares count and send only what differs: for a type beside one that has moved, one less by its old class and one
    more by its new one, and of class bigrams likewise. The later the round, the fewer move, and the less is counted and sent.
    """
    width = _OWN + 1

    def count(text, kinds, now, was) -> pa.Table:
        seq, start = _teaching(text)
        moved = (now != was)[seq]
        at = np.flatnonzero((moved[1:] | moved[:-1]) & ~start[1:])  # a pair of which one has moved begins here
        x, y, first = seq[at], seq[at + 1], seq[moved & start]

        def seen(place: np.ndarray) -> list[tuple]:
            after, before = moved[at + 1] & (x != y), moved[at] & (x != y)
            follows, leads, then, last = place[x[after]], place[y[before]], y[after], x[before]
            return [(follows, now[then], 1), (follows, was[then], -1), (leads, CLASSES + now[last], 1), (leads, CLASSES + was[last], -1)]

        begun = np.full(len(first), CLASSES)
        pairs = [(now[x], now[y], 1), (was[x], was[y], -1), (begun, now[first], 1), (begun, was[first], -1)]
        return _rows_of(_counted(kinds, buckets, width, seen) + _bigrams(len(seq), pairs) if moved.any() else [])

    changes, done = _scanned(texts.select("share", "types", "seq", "starts"), tried.select("t", "c", "was"), many, _PACKED_SQL, count)
    out = _added(counts.unionByName(changes))
    done()
    release(texts.sparkSession)
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_moves(table: np.ndarray, row: np.ndarray, column: np.ndarray, own: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best class of each of many types, the others staying, and what the likelihood gains.

    ``table`` counts class bigrams; ``row`` and ``column`` how often classes come after
    and before each type, ``own`` how often it follows itself. A home below 0: in no class yet.
    """
    classes, out, gains, whole = len(table), np.zeros(len(home), np.int64), np.zeros(len(home)), _xlogx(table.astype(float))
    for at in range(0, len(home), 64):  # whose tables stay in a processor's cache
        here = slice(at, at + 64)
        h, o, many = home[here], own[here].astype(float), np.arange(len(home[here]))
        r, c, settled = row[here].astype(float), column[here].astype(float), h >= 0
        k, g = many[settled], h[settled]
        r[k, g] -= o[k]
        c[k, g] -= o[k]
        rest = np.repeat(table[None].astype(float), len(h), axis=0)
        rest[k, g] -= r[k]
        rest[k, :, g] -= c[k]
        rest[k, g, g] -= o[k]
        before, d = np.repeat(whole[None], len(h), axis=0), np.arange(classes)
        before[k, g], before[k, :, g] = _xlogx(rest[k, g]), _xlogx(rest[k, :, g])
        after, below = np.zeros(rest.shape), np.zeros(rest.shape)  # nothing changes beside classes that don't come after or before
        i, j = np.nonzero(r)
        after[i, :, j] = _xlogx(rest[i, :, j] + r[i, j][:, None]) - before[i, :, j]
        i, j = np.nonzero(c)
        below[i, j] = _xlogx(rest[i, j] + c[i, j][:, None]) - before[i, j]
        value = after.sum(axis=2) - after[:, d, d] + below.sum(axis=1) - below[:, d, d]
        value += _xlogx(rest[:, d, d] + r + c + o[:, None]) - before[:, d, d]
        rows, columns = rest.sum(axis=2) + c, rest.sum(axis=1) + r
        value -= _xlogx(rows + (r.sum(axis=1) + o)[:, None]) - _xlogx(rows) + _xlogx(columns + (c.sum(axis=1) + o)[:, None]) - _xlogx(columns)
        best = value.argmax(axis=1)
        out[here] = best
        gains[here] = value[many, best] - np.where(settled, value[many, np.maximum(h, 0)], -np.inf)
    return out, gains


def _likelihood(table: np.ndarray) -> float:
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())


def exchange(pairs: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class of each type: exchange clustering of a square table of adjacent types.

    The likelihood of class bigrams is, up to what doesn't change, the sum of
    n log n over class bigrams less that over classes before and after. Types
    begin dealt by frequency; each in turn moves to the class that raises it most,
    until none moves.
    """
    size, pairs = len(pairs), pairs.astype(float)
    order = np.argsort(-pairs.sum(axis=0), kind="stable")
    of = np.empty(size, int)
    of[order] = np.arange(size) % classes
    member = np.eye(classes)[of]
    table, moved = member.T @ pairs @ member, True
    while moved:  # each move raises the likelihood, so it ends
        moved = False
        for t in order:
            row, column = pairs[t] @ member, pairs[:, t] @ member
            best, gain = best_moves(table, row[None], column[None], pairs[t : t + 1, t], of[t : t + 1])
            if gain[0] > 1e-6:
                of[t], moved = int(best[0]), True
                member[t] = np.eye(classes)[of[t]]
                table = member.T @ pairs @ member
    return of


def _few(classes: DataFrame, types: int) -> DataFrame:
    return F.broadcast(classes) if types <= FEW_TYPES else classes


def _class_table(counts: DataFrame) -> np.ndarray:
    """Counts of class bigrams among the types that have a class; last row: at the start."""
    out = np.zeros((CLASSES + 1) * CLASSES)
    for cells, n in counts.where("bucket < 0").select("cells", "n").collect():  # PARTS squares of the classes
        out[_unpacked(bytes(cells))] += _unpacked(bytes(n), "<i8")
    return out.reshape(CLASSES + 1, CLASSES)


_PROPOSED = pa.schema([("t", pa.int64()), ("home", pa.int32()), ("best", pa.int32()), ("gain", pa.float64())])


def _proposed(counts: DataFrame, homes: DataFrame, table: np.ndarray, buckets: int) -> DataFrame:
    """(t, home, best, gain) of every type of ``homes`` (t, c; c below 0: none yet), by the classes around it."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        t, home = right.column("t").to_numpy(), right.column("c").to_numpy().astype(np.int64)
        cells = np.zeros((len(t), _OWN + 1))
        if left.num_rows and len(t):
            types = np.frombuffer(left.column("types")[0].as_py(), np.int64)
            full = np.zeros(len(types) * (_OWN + 1))
            full[_unpacked(left.column("cells")[0].as_py())] = _unpacked(left.column("n")[0].as_py(), "<i8")
            at = np.minimum(np.searchsorted(types, t), len(types) - 1)
            cells = full.reshape(-1, _OWN + 1)[at] * (types[at] == t)[:, None]
        self_ = cells[:, _OWN]
        row, column, k = cells[:, :CLASSES].copy(), cells[:, CLASSES:_OWN].copy(), np.flatnonzero(home >= 0)
        row[k, home[k]] += self_[k]
        column[k, home[k]] += self_[k]
        best, gain = best_moves(table, row, column, self_, home)
        return pa.Table.from_batches([batch_of(_PROPOSED, t, home.astype(np.int32), best.astype(np.int32), gain)])

    dealt = homes.select(_bucket(F.col("t"), buckets).alias("dealt"), "t", "c")
    met = counts.where("bucket >= 0").groupBy("bucket").cogroup(dealt.groupBy("dealt"))
    return met.applyInArrow(one, "t long, home int, best int, gain double")


def cluster(texts: DataFrame, types: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(t, c) of all types (t, n), and the counts of class bigrams; ``texts`` are sequences.

    The commonest HEAD types are clustered on the driver, the others join the class that
    suits them best among these. Then rounds move half of all types, each to
    the class that is best while the others stay. A round that lowers the likelihood is
    undone and the next moves a part a quarter as large; one that raises it doubles the part again. It ends when rounds
    that make up QUIET half-rounds have gained less than LEAST_GAIN a token for each of these, which
    they must, as the likelihood is bounded.
    """
    spark = texts.sparkSession
    heads = [r[0] for r in types.orderBy(F.desc("n"), "t").limit(HEAD).collect()]
    seats = lambda of: spark.createDataFrame(list(zip(heads, map(int, of), strict=True)), "t long, c int")  # noqa: E731  # HEAD rows
    among = _head_pairs(texts, seats(range(len(heads))), len(heads))
    of = exchange(among)
    count, member = types.count(), np.eye(CLASSES)[of]
    buckets = buckets_for(count)
    rest = types.join(F.broadcast(seats(of)), "t", "left_anti").select("t", F.lit(-1).alias("c"))
    around = _contexts(texts, seats(of), len(heads), buckets)
    joined = _proposed(around, rest, member.T @ among @ member, buckets)
    classes = stored(seats(of).unionByName(joined.select("t", F.col("best").alias("c"))))
    forget(around)
    counts = _contexts(texts, classes, count, buckets)
    pairs = _class_table(counts)
    value, part, nth, quiet, all_tokens = _likelihood(pairs[:-1]), 2, 0, 0, max(1.0, pairs.sum())
    while True:
        turn = F.pmod(F.xxhash64("t", F.lit(nth)), F.lit(part)) == 0
        moves = _proposed(counts, classes.where(turn), pairs[:-1], buckets)
        moved = moves.select("t", F.when(F.col("gain") > 1e-6, F.col("best")).otherwise(F.col("home")).alias("c"), F.col("home").alias("was"))
        tried = stored(moved.unionByName(classes.where(~turn).select("t", "c", F.col("c").alias("was"))))
        counts_tried = _moved_contexts(texts, counts, tried, count, buckets)
        pairs_tried = _class_table(counts_tried)
        gained, nth = _likelihood(pairs_tried[:-1]) - value, nth + 1
        if gained > 0:
            forget(classes, counts)
            classes, counts, pairs, value = tried, counts_tried, pairs_tried, value + gained
        else:
            forget(tried, counts_tried)
        quiet = quiet + 2 / part if gained < LEAST_GAIN * all_tokens * 2 / part else 0
        part = max(2, part // 2) if gained > 0 else min(32, part * 4)
        if quiet >= QUIET:
            forget(counts)
            return classes.select("t", "c"), pairs


@dataclass(frozen=True)
class ClassModel:
    """What scoring needs beside the counts of words; logarithms are to base 10."""

    classes: DataFrame | None  # (t, c): class of each type; stays with Spark
    types: int  # how many these are
    spare: int  # class of words whose ending was never seen
    follow: np.ndarray  # log P(class | class before); last row: at the start
    weight: np.ndarray  # log of what a class's counts add up to, smoothed
    total: int  # tokens that teach
    different: int  # different ones

    def __getstate__(self):
        return self.__dict__ | {"classes": None}

    def emitted(self, where: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 P(word | class), and base log probability of words of these classes and counts."""
        return np.log10(counts + 1.0) - self.weight[where], np.log10((counts + 1.0) / (self.total + self.different + 1.0))

    def known(self, words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, log10 P(word | class), and base log probability of a few words."""
        rows = [(k, bytearray(w), int(n)) for k, (w, n) in enumerate(zip(words, counts, strict=True))]
        asked = self.classes.sparkSession.createDataFrame(rows, "k int, word binary, n long").withColumn("t", _type(F.col("word"), F.col("n")))
        where = np.array([r[1] for r in sorted(map(tuple, asked.join(self.classes, "t", "left").select("k", F.coalesce("c", F.lit(self.spare))).collect()))], int)
        return where, *self.emitted(where, counts)


@dataclass(frozen=True)
class Learned:
    """A model, the counts of words (word, c) and the texts as types."""

    model: ClassModel
    words: DataFrame
    texts: DataFrame


def learn(docs: DataFrame) -> Learned:
    """Count, cluster and estimate on the documents that teach; all tables are stored."""
    shares, vocabularies = encoded(docs)
    placed = counted(vocabularies)
    words = placed.where("word is not null").select("word", "c")
    types = stored(placed.where("word is not null and c > 0").groupBy("t").agg(F.sum("c").alias("n"), F.count("*").alias("kinds")))
    release(docs.sparkSession)
    texts = sequences(shares, placed)
    forget(shares)
    release(docs.sparkSession)
    classes, pairs = cluster(texts, types)
    seen, more = np.zeros(CLASSES), np.zeros(CLASSES)
    for c, n, kinds in types.join(classes, "t").groupBy("c").agg(F.sum("n"), F.sum("kinds")).collect():  # one row a class
        seen[c], more[c] = n, kinds
    # Add-one smoothing gives each class as much more as it has different words, here and in what follows what.
    mass = seen + more + 1e-9
    pairs = pairs * (mass / np.maximum(seen, 1)) + TRANSITION * CLASSES * mass / mass.sum()
    model = ClassModel(classes, types.count(), int(more.argmax()), np.log10(pairs / pairs.sum(axis=1, keepdims=True)), np.log10(seen + more + UNSEEN), int(seen.sum()), int(more.sum()))
    release(docs.sparkSession)
    return Learned(model, words, texts)


_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)


def score(docs: DataFrame) -> DataFrame:
    """Score every document under a model of those that teach; needs doc_id and text.

    Gives doc_id, held_out, n_tokens, n_known (tokens that teach), train_tokens,
    base_score (add-one unigram) and score (the class model's log10 probability).
    Null texts are empty and have one token, the end. Repeated rows score alike
    and each teaches; null ids count as '' for holding out; a text of any length is
    scored whole, in one share; types of equal count are told apart by their hash,
    classes that suit a type alike by their number; other columns are
    ignored; an empty table gives an empty one.
    """
    learned = learn(docs)
    model = learned.model

    def one(text: pa.Table, kinds: np.ndarray, where: np.ndarray) -> pa.Table:
        where = np.where(where < 0, model.spare, where)
        sizes, learn, known, logs = (_flat(text.column(c)) for c in ("sizes", "learn", "known", "logs"))
        learn, scores = learn.astype(bool), np.empty(len(sizes))
        for some, numbers in ((learn, "seq"), (~learn, "held")):
            if some.any():
                c = where[_unpacked(text.column(numbers)[0].as_py())]
                starts = np.cumsum(sizes[some]) - sizes[some]
                before = np.append(CLASSES, c[:-1])
                before[starts] = CLASSES
                scores[some] = np.add.reduceat(model.follow[before, c] - model.weight[c], starts)  # every text has a token
        base = logs - sizes * np.log10(model.total + model.different + 1.0)
        columns = [text.column("doc_ids").combine_chunks().flatten(), ~learn, sizes, known, np.full(len(sizes), model.total), base, logs + scores]
        return pa.Table.from_batches([batch_of(_RESULT, *columns)])

    whole = learned.texts.select("share", F.concat("types", "extra").alias("types"), "seq", "held", "doc_ids", "learn", "sizes", "known", "logs")
    return _scanned(whole, model.classes, model.types, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", one)[0]


def op8(spark, sf_dir: str) -> DataFrame:
    """The digest of the operator over all documents."""
    return score(table(spark, sf_dir, "documents"))
