import zlib

import pytest
from pyspark.sql import functions as F

from costgrain.llm.common import chunks_for, in_training, table, with_offsets, word_count, words_of
from costgrain.llm import queries

TEXTS = [None, "", " \t\n", "one", " a  b\x0bc\x0c", "é x y", "a\x1cb c"]


def test_words(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select(words_of(F.col("t")), word_count(F.col("t"))).collect()
    want = [[w.decode() for w in (t or "").encode().split()] for t in TEXTS]
    assert [r[0] for r in rows] == want and [r[1] for r in rows] == [len(w) for w in want]


def test_training_rows(spark):
    df = spark.createDataFrame([(k,) for k in range(50)] + [(None,)], "i long").select("i", in_training(F.col("i"), 4, 2))
    assert all(t == (zlib.crc32(("" if i is None else str(i)).encode()) % 4 != 2) for i, t in df.collect())


@pytest.mark.parametrize("chunks", [1, 7, 256])
def test_offsets_tile_each_group(spark, chunks):
    df = spark.range(500).select((F.col("id") % 3 * (F.col("id") % 2)).cast("int").alias("g"), "id", (F.col("id") % 11).alias("n"))
    out = with_offsets(df, ["g"], ["id"], {"at": F.col("n"), "nth": F.lit(1).cast("long")}, chunks).toPandas()
    assert len(out) == 500
    for _, g in out.groupby("g"):
        g = g.sort_values("nth")
        assert g["nth"].tolist() == list(range(len(g)))
        assert g["at"].tolist() == (g["n"].cumsum() - g["n"]).tolist()


def test_chunks_follow_the_rows():
    assert chunks_for(0) == 256 and chunks_for(10**9) == 50_000


def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_search_oracle(spark):
    import duckdb

    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    for name, sql in queries.ORACLES.items():
        got = sorted(map(tuple, queries.QUERIES[name](spark, sf).select("query_id", "rank", "vec_id", "score").collect()))
        assert got == sorted(con.sql(sql).select("query_id, rank, vec_id, score").fetchall())
    assert table(spark, sf, "embeddings").count() == 500
