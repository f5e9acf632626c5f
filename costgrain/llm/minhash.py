"""Operator 10: document fingerprints by one-permutation MinHash, all in Spark expressions.

Every shingle of five words is hashed once; the leading bits of the hash choose
one of ``BINS`` bins, and a bin keeps its least hash. Bins that stay empty take
the value of a filled one by optimal densification: bin i tries bins hash(i, t)
for t = 0, 1, ... until one is filled. Of a hash of each bin's number and value
the low ``BITS`` bits are stored, so that bins with one value agree by chance apart. Two unlike bins agree on them by chance with probability 2**-BITS, so
the share E of equal bins is corrected to (E - 2**-BITS) / (1 - 2**-BITS).
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from costgrain.llm.common import SPACE, apart, cut, stored, table

SHINGLE = 5
BINS = 128
BITS = 4
#: Bands of bins by which alike sketches meet.
BANDS = 16
#: Tries of the densification before it goes over all filled bins by priority.
TRIES = 8
#: Documents a bucket of the ordered table holds, and how many buckets there are at most.
PER_BUCKET = 500
MOST_BUCKETS = 8_192
QUANTILES = 64

_SHIFT = 64 - (BINS - 1).bit_length()


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often it is used."""
    return F.transform(F.array(value), body)[0]


def _tries() -> list[Column]:
    """For each try, the bin that each bin looks at."""
    draw = random.Random(20)
    return [F.array(*(F.lit(draw.randrange(BINS)) for _ in range(BINS))) for _ in range(TRIES)]


def _bin(h: Column) -> Column:
    return (F.shiftright(h, _SHIFT) + BINS // 2).cast("int")


def _hashes(words: Column) -> Column:
    n = F.size(words)
    rolling = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))
    return F.when(n >= SHINGLE, rolling).otherwise(F.array(F.xxhash64(F.concat_ws(" ", words))))


def _densified(least: Column) -> Column:
    """Low bits of a hash of each bin and its value, from the least hashes of the filled bins."""

    def spread(by_bin: Column) -> Column:
        filled = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.try_element_at(by_bin, i))

        def fill(v: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                tried = [F.get(v, F.get(t, i)) for t in _tries()]
                rest = F.array_min(F.transform(least, lambda h: F.struct(F.xxhash64(i, _bin(h)).alias("p"), F.get(v, _bin(h)).alias("v"))))
                return F.xxhash64(i, F.coalesce(x, *tried, rest["v"])).bitwiseAND(F.lit(2**BITS - 1).cast("long")).cast("byte")

            return F.transform(v, one)

        return let(filled, fill)

    return let(F.map_from_arrays(F.transform(least, _bin), least), spread)


def sketch(text: Column) -> Column:
    """Array of ``BINS`` values of ``BITS`` bits; null for a text without words."""
    clean = F.lower(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")))

    def least(hashes: Column) -> Column:
        return F.filter(hashes, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(hashes, i - 1))))

    def of_words(words: Column) -> Column:
        return let(let(F.sort_array(_hashes(words)), least), _densified)

    return F.when(F.length(clean) > 0, let(F.split(clean, f"{SPACE}+"), of_words))


def packed(sketched: Column) -> Column:
    """The bits of a sketch as hex digits; all zero for none."""
    digits = F.array_join(F.transform(sketched, lambda x: F.substring(F.lower(F.hex(x.cast("long"))), -1, 1)), "")
    return F.coalesce(digits, F.lit("0" * BINS))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts from their sketches, 0 to 1.

    Two texts without words are alike, one without and one with are not."""
    equal = F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: p["a"] == p["b"])) / BINS
    chance = 2.0**-BITS
    estimate = F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(estimate)


def alike(docs: DataFrame, at_least: float = 0.8) -> DataFrame:
    """(a, b) links of documents (doc_id, text) whose sketches are alike by ``at_least`` or more.

    Sketches meet by ``BANDS`` bands of bins: of two texts that are alike by 0.8, 0.97 of all pairs share a band. In each
    band all go to one of them, another one in every band, so that a group of any size makes as many links as it has
    documents, and every link is then held against both sketches. Documents without an id or without words have none.
    """
    width = BINS // BANDS
    sketched = stored(docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), sketch(F.col("text").cast("string")).alias("s")).where("s is not null"))
    keys = F.array(*(F.xxhash64(F.lit(k), F.slice("s", k * width + 1, width)) for k in range(BANDS)))
    filed = sketched.select("doc_id", F.explode(keys).alias("key"))
    centre = filed.groupBy("key").agg(F.min_by("doc_id", F.xxhash64("doc_id", "key")).alias("b"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key", "b")
    edges = cut(filed.join(apart(centre, "key"), "key").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct())
    own = sketched.groupBy("doc_id").agg(F.min("s").alias("s"))
    met = edges.join(apart(own, "doc_id").toDF("a", "s"), "a").join(apart(own, "doc_id").toDF("b", "t"), "b")
    return met.where(likeness(F.col("s"), F.col("t")) >= at_least).select("a", "b")


def _tree(value: Column, leaves: list[tuple[int, Column]]) -> Column:
    """The leaf with the greatest bound that is not above ``value``."""
    if len(leaves) == 1:
        return leaves[0][1]
    half = len(leaves) // 2
    return F.when(value < leaves[half][0], _tree(value, leaves[:half])).otherwise(_tree(value, leaves[half:]))


def _bucketed(docs: DataFrame) -> tuple[DataFrame, list[tuple[int, int | None]]]:
    """``docs`` with a bucket that rises with doc_id, and (bucket, least id) of each.

    Quantiles cut the ids, and even steps cut each quantile, so that a bucket has
    about ``PER_BUCKET`` documents, or more where there would be over
    ``MOST_BUCKETS``. Rows without an id come first, dealt by their text.
    """
    at = [k / QUANTILES for k in range(QUANTILES)]
    row = docs.agg(F.count("*"), F.count("doc_id"), F.expr(f"percentile_approx(doc_id, array({','.join(map(str, at))}), 1000)")).first()
    rows, with_id, bounds = row[0], row[1], sorted(set(row[2] or [0]))
    quantile = _tree(F.col("doc_id"), [(b, F.lit(k)) for k, b in enumerate(bounds)])
    parts = docs.where("doc_id is not null").groupBy(quantile.alias("q")).agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).collect()
    per = max(PER_BUCKET, -(-rows // (MOST_BUCKETS - QUANTILES - 1)))
    first = max(1, -(-(rows - with_id) // per))
    leaves, nxt = [], first
    for _, n, low, high in sorted(parts):
        count = max(1, min(n // per, high - low + 1))
        width = (high - low) // count + 1
        leaves.append((low, F.lit(nxt) + F.floor((F.col("doc_id") - low) / width).cast("int")))
        nxt += count
    without = F.pmod(F.xxhash64("text"), F.lit(first)).cast("int")
    ranked = _tree(F.col("doc_id"), leaves) if leaves else F.lit(0)
    placed = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), without).otherwise(ranked))
    return placed, [(b, low) for b, low in sorted(map(tuple, placed.groupBy("bucket").agg(F.min("doc_id")).collect()))]


def _with_first_of_next(docs: DataFrame) -> DataFrame:
    """``docs`` in buckets, and at the end of each bucket a copy (edge = 1) of the
    first document of the next one; the last one is followed by the first."""
    placed, buckets = _bucketed(docs)
    placed = placed.withColumn("edge", F.lit(0))
    if not buckets:
        return placed
    before = {b: buckets[k - 1][0] for k, (b, _) in enumerate(buckets)}
    ids = [low for _, low in buckets if low is not None]
    maybe = placed.where(F.col("doc_id").isNull() | F.col("doc_id").isin(ids))
    firsts = maybe.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("x"))
    to = docs.sparkSession.createDataFrame(list(before.items()), "bucket int, before int")  # MOST_BUCKETS rows at most
    edges = firsts.join(F.broadcast(to), "bucket").select("x.doc_id", "x.text", F.col("before").alias("bucket"), F.lit(1).alias("edge"))
    return placed.unionByName(edges)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text; needs doc_id, text.

    In the edited text the last quarter of the code points is replaced by the
    first as many (or all) of the next document by ascending doc_id; the last is
    followed by the first. Null texts are empty. Rows with equal ids follow
    each other by text; rows without an id come before all others, in a fixed
    order. Columns other than these two are ignored; an empty table gives none.
    """
    plain = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    in_order = W.partitionBy("bucket").orderBy("edge", "doc_id", "text")
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    left = lambda text, n: F.substring(text, F.lit(1), n)
    paired = _with_first_of_next(plain).select(
        "bucket", "doc_id", "edge", "text", F.length("text").alias("n_chars"), F.row_number().over(in_order).alias("nth"), F.lead("text", 1, "").over(in_order).alias("then")
    )
    edited = F.concat(left(F.col("text"), F.col("n_chars") - quarter), left(F.col("then"), quarter))
    drawn = paired.withColumn("edited", edited).select(
        "bucket", "doc_id", "edge", "nth", F.col("n_chars").cast("long"), F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("text")).alias("own"), sketch(F.col("edited")).alias("other")
    )
    both = drawn.withColumn("next", F.lead("own").over(W.partitionBy("bucket").orderBy("nth"))).where("edge = 0")
    return both.select(
        "doc_id", "n_chars", "edited_sha256", packed(F.col("own")).alias("fingerprint"), packed(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def op10(spark, sf_dir: str) -> DataFrame:
    """The digest of the operator over all documents."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))
