import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from costgrain.llm.common import cut
from costgrain.llm.resharding import even_capacities, reshard, rewrite, sized, transfers


def test_flow_moves_the_fewest():
    for sizes in itertools.product([0, 3, 10], repeat=3):
        caps = even_capacities(sum(sizes), 4)
        flow = transfers(list(sizes), caps)
        stays = sum(a for i, j, a in flow if i == j)
        assert stays == sum(min(s, c) for s, c in zip(sizes, caps, strict=False))
        assert [sum(a for i, _, a in flow if i == k) for k in range(3)] == list(sizes)
        assert all(sum(a for _, j, a in flow if j == k) <= caps[k] for k in range(4))
    with pytest.raises(ValueError):
        transfers([5], [4])


def test_rows_are_placed_evenly(docs, rows):
    placed, moves = reshard(cut(sized(docs.where("doc_id not in (304, 305) or doc_id is null"), 3)), 3, 5)
    out = placed.toPandas()
    assert len(out) == len(rows) - 2
    size = out.groupby("shard")["size"].sum()
    assert len(size) == 5 and size.max() - size.min() < 2 * out["size"].max()
    for _, s in out.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    text = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    for r in out.dropna(subset="doc_id").itertuples():
        assert r.size == len(text[int(r.doc_id)].encode()) + 8 and r.text_crc32 == zlib.crc32(text[int(r.doc_id)].encode())
    assert sum(a for *_, a in moves) == out["size"].sum()


def test_a_hot_text_is_spread(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    placed, _ = reshard(cut(sized(df)), 16, 24)
    size = placed.groupBy("shard").agg(F.sum("size")).toPandas()["sum(size)"]
    assert size.max() / size.mean() < 1.05 and size.min() / size.mean() > 0.95


def test_only_affected_shards_are_written(docs, tmp_path):
    placed, moves = reshard(cut(sized(docs, 3, whole=True)), 3, 5)
    changed = rewrite(placed, moves, str(tmp_path / "out"))
    back = docs.sparkSession.read.parquet(str(tmp_path / "out"))
    assert {r[0] for r in back.select("shard").distinct().collect()} <= set(changed)
    assert back.count() == placed.where(F.col("shard").isin(changed)).count()


def test_no_documents(empty):
    placed, moves = reshard(cut(sized(empty)), 16, 24)
    assert placed.count() == 0 and moves == []


def test_shrinking_leaves_every_row_once(docs, rows, tmp_path):
    folder = str(tmp_path / "out")
    before = cut(sized(docs, 5, whole=True))
    before.withColumn("shard", F.col("old")).write.partitionBy("shard").parquet(folder)
    placed, moves = reshard(before, 5, 3)
    placed = cut(placed.select(*before.columns, "shard"))
    changed = rewrite(placed, moves, folder)
    assert {3, 4} <= set(changed)
    key = lambda df: sorted(map(str, df.select("shard", "text_crc32", "row").collect()))
    back = docs.sparkSession.read.schema(placed.schema).parquet(folder)
    assert back.count() == len(rows) and key(back) == key(placed)
