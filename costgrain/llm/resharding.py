"""Operator 3: resharding by minimum-cost flow.

Old shards have sizes, new shards capacities. What stays in a shard of the same
number costs nothing, a byte that moves costs one; a minimum-cost flow from old
to new shards says how many bytes of each old shard go where. Rows of an old
shard lie in one fixed order with running byte counts, and each row follows the
stretch of that order which holds its middle. Only the files of shards that lose
or gain rows are written again.

The flow has an arc for each pair of shards, so it is small whatever the rows
hold; rows are placed by Spark. Equal texts lie side by side in the order, so a
group is parted only where it is larger than a chunk or a stretch ends in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costgrain.llm.common import chunks_for, cut, table, with_offsets

#: Shards of the layout that the query starts from, and of the one it makes.
OLD, NEW = 16, 24
#: A text with more than one of these parts of all rows is dealt over chunks.
COMMON = 512


def transfers(sizes: list[int], capacities: list[int]) -> list[tuple[int, int, int]]:
    """(old, new, bytes) of a flow that moves the fewest bytes and fills no shard
    beyond its capacity. Capacities have to hold all sizes.

    Successive shortest augmenting paths: source, old shards, new shards, sink.
    """
    if sum(capacities) < sum(sizes):
        raise ValueError("capacities hold less than the shards do")
    n, m = len(sizes), len(capacities)
    sink = n + m + 1
    arcs: list[list[int]] = []  # to, left, cost; an arc and its reverse are neighbours
    out: list[list[int]] = [[] for _ in range(sink + 1)]

    def add(a: int, b: int, room: int, cost: int) -> None:
        out[a].append(len(arcs))
        arcs.append([b, room, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])

    for i, size in enumerate(sizes):
        add(0, 1 + i, size, 0)
        for j in range(m):
            add(1 + i, 1 + n + j, size, int(i != j))
    for j, room in enumerate(capacities):
        add(1 + n + j, sink, room, 0)
    while True:
        far = {0: 0}
        via: dict[int, int] = {}
        queue = [0]
        while queue:
            a = queue.pop(0)
            for e in out[a]:
                b, room, cost = arcs[e]
                if room and far[a] + cost < far.get(b, 1 << 60):
                    far[b], via[b] = far[a] + cost, e
                    queue.append(b)
        if sink not in via:
            break
        path, b = [], sink
        while b:
            path.append(via[b])
            b = arcs[via[b] ^ 1][0]
        amount = min(arcs[e][1] for e in path)
        for e in path:
            arcs[e][1] -= amount
            arcs[e ^ 1][1] += amount
    return [(i, j, arcs[e ^ 1][1]) for i in range(n) for e in out[1 + i] if (j := arcs[e][0] - 1 - n) >= 0 and arcs[e ^ 1][1]]


def even_capacities(total: int, shards: int) -> list[int]:
    """The total dealt out evenly, the first ones a byte larger."""
    return [total // shards + (k < total % shards) for k in range(shards)]


def reshard(rows: DataFrame, old_shards: int, new_shards: int) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Place rows (doc_id, text_crc32, size, old, maybe more) into shards of near equal bytes.

    Gives the rows with ``shard`` and ``slot`` (gapless from 0 in each shard), and
    the transfers. ``rows`` is read several times and should be cut off before.
    """
    sizes = dict(map(tuple, rows.groupBy("old").agg(F.sum("size")).collect()))  # one row a shard
    count = rows.count()
    by_old = [int(sizes.get(k, 0)) for k in range(old_shards)]
    moves = transfers(by_old, even_capacities(sum(by_old), new_shards))

    # At most COMMON texts hold more than that part of all rows each.
    common = rows.groupBy("text_crc32").count().where(F.col("count") > max(64, count // COMMON))
    hot = [r[0] for r in common.select("text_crc32").limit(COMMON).collect()]
    salt = F.when(F.col("text_crc32").isin(hot), F.pmod(F.xxhash64("doc_id"), F.lit(1024))) if hot else F.lit(None).cast("long")
    ordered = rows.withColumn("_salt", F.coalesce(salt, F.lit(-1).cast("long")))
    chunks = chunks_for(count)
    # Large rows come first, where a shard keeps what it has; stretches then end among small ones.
    mean = max(1, sum(by_old) // max(1, count))
    eighth = chunks // 8
    dealt = F.xxhash64("text_crc32", "_salt")
    chunk = F.lit(0)
    for first, many, above in ((4, 4, 0), (2, 2, mean), (1, 1, 2 * mean), (0, 1, 4 * mean)):
        own = first * eighth + F.pmod(dealt, F.lit(many * eighth))
        chunk = F.when(F.col("size") > above, own).otherwise(chunk)
    placed = with_offsets(ordered, ["old"], ["text_crc32", "_salt", "doc_id", "size"], {"_at": F.col("size")}, chunks, chunk)

    stretches = []
    for k in range(old_shards):
        end, ends, to = 0, [], []
        for _, new, amount in sorted((m for m in moves if m[0] == k), key=lambda m: (m[1] != k, m[1])):
            end += amount
            ends.append(end)
            to.append(new)
        stretches.append((k, ends[:-1], to))
    where = rows.sparkSession.createDataFrame(stretches, "old int, _ends array<bigint>, _to array<int>")  # one row a shard
    middle = F.col("_at") + F.floor(F.col("size") / 2)
    joined = placed.join(F.broadcast(where), "old")
    shard = F.get("_to", F.size(F.filter("_ends", lambda e: e <= middle)))
    sharded = joined.select(*rows.columns, shard.alias("shard"))
    return with_offsets(sharded, ["shard"], ["doc_id", "text_crc32", "size"], {"slot": F.lit(1).cast("long")}, chunks), moves


def rewrite(placed: DataFrame, moves: list[tuple[int, int, int]], folder: str) -> list[int]:
    """Write the files of the shards that lose or gain rows; returns their numbers.

    ``placed`` is what ``reshard`` gives, with all columns to be written. Shards
    without a move keep their files in ``folder``; those that no row is left in lose theirs.
    """
    spark = placed.sparkSession
    changed = sorted({k for old, new, _ in moves if old != new for k in (old, new)})
    some = placed.where(F.col("shard").isin(changed))
    filled = {r[0] for r in some.select("shard").distinct().collect()}  # one row a shard; before files change that may be read
    some.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(folder)
    for k in set(changed) - filled:  # a dynamic overwrite leaves partitions without rows as they were
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/shard={k}")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(path) and not files.delete(path, True):
            raise OSError(f"{path} holds rows that were moved, and can't be removed")
    return changed


def sized(docs: DataFrame, old_shards: int = OLD, whole: bool = False) -> DataFrame:
    """(doc_id, text_crc32, size, old) of documents; null texts have no bytes.

    Size is the bytes of the text and 8. The old layout deals texts by checksum.
    ``whole`` adds the document itself as ``row``, to be written later."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(F.col("doc_id").cast("long"), F.crc32(text.cast("binary")).alias("text_crc32"), (F.octet_length(text) + 8).cast("long").alias("size"), *([F.struct(*docs.columns).alias("row")] if whole else []))
    return out.withColumn("old", (F.col("text_crc32") % old_shards).cast("int"))


def op3(spark, sf_dir: str) -> DataFrame:
    """The digest of the operator over all documents: the law is near equal bytes.

    Every row is placed, repeated ones too; a null id is kept; an empty table
    gives an empty one."""
    placed, _ = reshard(cut(sized(table(spark, sf_dir, "documents"))), OLD, NEW)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))
