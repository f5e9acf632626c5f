"""Operator 4: mix sources to target weights by blocks.

The words of a source, document after document in a fixed scattered order, are
packed into blocks of ``BLOCK`` words. A source gets as many slots of the mix as
come nearest its target; the slots are dealt to the output shards by multinomial
draws on condition of these totals. Slot j of a source takes block perm(j) of
it, where perm is a pseudorandom permutation of its block numbers, a new one for
each pass, and slots and blocks are joined by number. So a pass takes every
block once, and no block comes more than ``PASSES`` times.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costgrain.llm.common import SPACE, batch_of, chunks_for, cut, table, with_offsets, word_count

BLOCK = 128
PASSES = 3
SHARDS = 64
SEED = 4
#: Weights of sources by code point, null last, over and over.
WEIGHTS = (5, 2, 1)
#: Up to so many sources documents meet their numbers by a broadcast.
FEW_SOURCES = 10_000
#: Slots that one row of the plan gives at a time.
STRETCH = 4096


def targets(sizes: list[int], weights: list[int], most: int = PASSES) -> list[Fraction]:
    """Shares of the sum of sizes by weight; none above ``most`` times its size.

    What is above goes to the others by weight, until none is."""
    total, out = sum(sizes), [Fraction(0)] * len(sizes)
    free = [k for k in range(len(sizes)) if sizes[k]]
    left = Fraction(total)
    while free:
        weight = sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] / weight > most * sizes[k]]
        if not over:
            for k in free:
                out[k] = left * weights[k] / weight
            break
        for k in over:
            out[k] = Fraction(most * sizes[k])
        left -= sum(out[k] for k in over)
        free = [k for k in free if k not in over]
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Where pseudorandom permutations of 0..size-1 send the indices; a permutation for each key.

    A Feistel network over the next even power of two; what falls beyond the size goes round again."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64).copy(), np.arange(len(index))
    key = key.astype(np.uint64)
    size = size.astype(np.uint64)
    while todo.size:
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(rounds):
            x = (right + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64((r + 1) * 0xD1B54A32D192ED03 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            x = (x * np.uint64(0x94D049BB133111EB)) ^ (x >> np.uint64(32))
            left, right = right, left ^ ((x >> np.uint64(17)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def draws(slots: list[int], shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """Slots of each source in each shard: multinomial draws that add up to ``slots``.

    Given the totals, multinomial counts of a shard are multivariate
    hypergeometric in what is left."""
    left, rng = np.array(slots, np.int64), np.random.default_rng(seed)
    out = np.zeros((shards, len(slots)), np.int64)
    for k in range(shards):
        room, left_all = int(left.sum()) // (shards - k), int(left.sum())
        for s in range(len(slots)):  # one colour at a time: numpy's joint draw is limited in size
            good, bad = int(left[s]), left_all - int(left[s])
            out[k, s] = 0 if not room or not good else room if not bad else _hypergeometric(rng, good, bad, room)
            left_all -= good
            room -= int(out[k, s])
        left -= out[k]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One hypergeometric draw. numpy's stops at 10**9 in all; beyond, the distribution function
    is worked out over forty standard deviations to either side, outside of which lies less than a double can tell."""
    every = good + bad
    if every < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    mean = n * (good / every)
    wide = 40 * ((mean * (bad / every) * (1 - n / every)) ** 0.5 + 1)
    first, last = max(0, n - bad, int(mean - wide)), min(good, n, int(mean + wide) + 1)
    k = np.arange(first, last, dtype=float)
    logs = np.cumsum(np.append(0.0, np.log((good - k) / (k + 1)) + np.log((n - k) / (bad - n + k + 1))))
    below = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(below, rng.random() * below[-1]))


def with_sizes(docs: DataFrame) -> DataFrame:
    """``docs`` with the number of words and a hash of each text."""
    return docs.withColumns({"_size": word_count(F.col("text").cast("string")), "_hash": F.xxhash64("text")})


def located(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, list[dict]]:
    """doc_id, source, text (and _row) of ``docs`` with src (number of the source),
    _size (words), _hash (of the text) and _at (words of the source before it);
    and what is known of each source: name, size, number of blocks, target, slots."""
    sized = docs if {"_size", "_hash"} <= {*docs.columns} else with_sizes(docs)
    sized = sized.select(*(c for c in ("doc_id", "source", "text", "_row", "_size", "_hash") if c in sized.columns))
    found = sized.groupBy(F.col("source").cast("string")).agg(F.sum("_size"), F.count("*")).collect()  # one row a source
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [int(r[1]) for r in found]
    aims = targets(sizes, [WEIGHTS[k % len(WEIGHTS)] for k in range(len(found))])
    sources = []
    for r, size, aim in zip(found, sizes, aims, strict=True):
        blocks = -(-size // block)
        slots = min(PASSES * blocks, int(aim * blocks / size + Fraction(1, 2))) if size else 0
        sources.append({"name": r[0], "size": size, "blocks": blocks, "target": float(aim), "slots": slots})
    number = [(s["name"], k) for k, s in enumerate(sources) if s["name"] is not None]
    known = docs.sparkSession.createDataFrame(number, "_name string, src int")
    known = F.broadcast(known) if len(number) <= FEW_SOURCES else known
    with_src = sized.join(known, F.col("source").cast("string") == F.col("_name"), "left").drop("_name")
    with_src = with_src.withColumn("src", F.coalesce("src", F.lit(max(0, len(sources) - 1))))
    count = sum(r[2] for r in found)
    return with_offsets(with_src, ["src"], ["doc_id", "_size", "_hash"], {"_at": F.col("_size")}, chunks_for(count)), sources


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(src, at, block, begin, words): the stretch of each document in each block."""
    some = rows.where("_size > 0").select("src", "_at", "_size", F.explode(F.sequence(F.expr(f"_at div {block}"), F.expr(f"(_at + _size - 1) div {block}"))).alias("block"))
    first, last = F.greatest("_at", F.col("block") * block), F.least(F.col("_at") + F.col("_size"), (F.col("block") + 1) * block)
    return some.select("src", "_at", "block", (first - F.col("_at")).alias("begin"), (last - first).alias("words"))


def slots(spark, sources: list[dict], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(shard, place, src, pass, block) of every slot of the mix."""
    counts = draws([s["slots"] for s in sources], shards, seed)
    begin, plan = np.zeros(len(sources), np.int64), []
    for k in range(shards):
        before = 0
        for s, n in enumerate(counts[k].tolist()):
            if n:
                plan.append((k, s, int(begin[s]), n, before, int(counts[k].sum()), sources[s]["blocks"]))
            before += n
        begin += counts[k]
    names = "shard int, src int, start long, n long, before long, room long, blocks long"
    rows = spark.createDataFrame(plan, names)  # a row for each shard and source
    parts = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(STRETCH).cast("long"))).alias("skip")).repartition("shard", "src", "skip")
    schema = pa.schema([("shard", pa.int32()), ("place", pa.int64()), ("src", pa.int32()), ("pass", pa.int32()), ("block", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                i = np.arange(r["skip"], min(r["skip"] + STRETCH, r["n"]))
                j = r["start"] + i
                turn, full = j // r["blocks"], np.full(len(i), r["blocks"])
                block = permuted(j % r["blocks"], full, seed + 1_000_003 * (r["src"] + 1) + turn)
                place = permuted(r["before"] + i, np.full(len(i), r["room"]), np.full(len(i), seed + 7_919 * (r["shard"] + 1)))
                yield batch_of(schema, np.full(len(i), r["shard"]), place, np.full(len(i), r["src"]), turn, block)

    return parts.mapInArrow(scan, "shard int, place long, src int, pass int, block long")


def mix(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, list[dict]]:
    """The mix, the located documents, and the sources.

    The mix has a row for each stretch of a document in each slot: shard, place
    (in the shard), src, pass, block, _at, begin and words. Null and blank texts
    have no words and are in no block. Repeated rows each have their words;
    null sources are one source, the last. An empty table gives an empty mix.
    """
    rows, sources = located(docs, block)
    # The slots grow with the input, but Spark takes them for as few as the rows of the plan: they are not to be broadcast.
    drawn = slots(docs.sparkSession, sources).hint("merge")
    return drawn.join(pieces(rows, block), ["src", "block"]), rows, sources


def taken(mixed: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with the number of their words in the mix."""
    sums = mixed.groupBy("src", "_at").agg(F.sum("words").alias("taken"))
    own = rows.withColumn("_at", F.when(F.col("_size") > 0, F.col("_at")))
    return own.join(sums, ["src", "_at"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))


def op4(spark, sf_dir: str) -> DataFrame:
    """The digest of the operator over all documents."""
    docs = cut(with_sizes(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("long"), "source", "_size", "_hash"))
    mixed, rows, sources = mix(docs)
    known = spark.createDataFrame([(k, s["size"], s["target"]) for k, s in enumerate(sources)], "src int, source_size long, target double")
    return taken(mixed, rows).join(known, "src").select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken", "source")


def mixed_documents(docs: DataFrame, block: int = 1024) -> DataFrame:
    """The mix as documents: a row for each stretch of a document in each slot,
    with the columns of ``docs``; its text is the words of the stretch, and
    n_chars, where there is such a column, their code points.

    Null and blank texts have no words and give no row; null ids, null sources and
    repeated rows are mixed like any other; an empty table gives an empty one.
    Blocks are larger than the digest's, so that documents are cut less often: each
    source may miss its target by half a block."""
    rest = [c for c in docs.columns if c != "text"]
    plain = docs.select(F.struct(*rest).alias("_row"), F.col("doc_id").cast("long"), "source", F.col("text").cast("string"))
    mixed, rows, _ = mix(plain, block)
    stretches = mixed.groupBy("src", "_at").agg(F.collect_list(F.struct("shard", "place", "begin", "words")).alias("_parts"))  # as many as the document has blocks, PASSES times at most
    whole = rows.where("_size > 0").join(stretches, ["src", "_at"])
    split = whole.select("_row", "_parts", F.split(F.regexp_replace("text", rf"^{SPACE}+|{SPACE}+$", ""), f"{SPACE}+").alias("_words"))
    each = split.select("_row", "_words", F.explode("_parts").alias("_part"))
    text = F.array_join(F.slice("_words", (F.col("_part.begin") + 1).cast("int"), F.col("_part.words").cast("int")), " ")
    drawn = each.select("_row", text.alias("_text"))
    made = {"text": F.col("_text").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return drawn.select(*(made[c].alias(c) if c in made else F.col("_row")[c].alias(c) for c in docs.columns))
