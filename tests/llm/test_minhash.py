import hashlib

import pytest
from pyspark.sql import functions as F

from costgrain.llm import minhash


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def out(docs):
    return minhash.edited_fingerprints(docs).toPandas()


def in_order(rows):
    known = sorted(((r[0], r[1] or "") for r in rows if r[0] is not None))
    return known


def test_edited_texts_and_estimates(spark, rows):
    plain = in_order([r for r in rows if r[0] not in (304,)])
    df = spark.createDataFrame([(i, t, "x") for i, t in plain], "doc_id long, text string, bucket string")
    out = minhash.edited_fingerprints(df).toPandas().sort_values(["doc_id", "fingerprint"], kind="stable")
    assert len(out) == len(plain)
    errors = []
    for k, r in enumerate(out.itertuples()):
        text, after = plain[k][1], plain[(k + 1) % len(plain)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        errors += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, after)]
    assert max(map(abs, errors)) < 0.25 and abs(sum(errors) / len(errors)) < 0.02


def test_equal_texts_have_equal_fingerprints(out, rows):
    by_text = {}
    text = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    for r in out.dropna(subset="doc_id").itertuples():
        by_text.setdefault(text[int(r.doc_id)], set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    assert len({next(iter(f)) for t, f in by_text.items() if t.split()}) > 50
    assert len(out) == len(rows) and (out["fingerprint"].str.len() == minhash.BINS).all()


def test_buckets_keep_the_order(spark, monkeypatch):
    """Many small buckets give what one bucket gives."""
    df = spark.range(0, 400).select((F.col("id") * F.col("id")).alias("doc_id"), F.concat(F.lit("some words of text number "), F.col("id"), F.lit(" and more words")).alias("text"))
    one = minhash.edited_fingerprints(df).orderBy("doc_id").collect()
    monkeypatch.setattr(minhash, "PER_BUCKET", 3)
    assert minhash.edited_fingerprints(df).orderBy("doc_id").collect() == one


def test_one_document_follows_itself(spark):
    df = spark.createDataFrame([(5, "one two three four five six seven eight")], "doc_id long, text string")
    r = minhash.edited_fingerprints(df).first()
    text = "one two three four five six seven eight"
    cut = len(text) // 4
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256((text[:-cut] + text[:cut]).encode()).hexdigest()


def test_no_documents(empty):
    assert minhash.edited_fingerprints(empty).count() == 0


def test_plan_is_native(docs):
    plan = minhash.edited_fingerprints(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_short_texts_are_told_apart(spark):
    """All pairs of texts with one to four shingles are as alike as they are, within six standard errors."""
    texts = [f"word{k}" for k in range(24)] + [" ".join(f"w{(k // 4) * 3 + j}" for j in range(5 + k % 4)) for k in range(24)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", "text", minhash.sketch(F.col("text")).alias("s"))
    df = spark.createDataFrame(df.collect(), df.schema)
    pairs = df.toDF("i", "x", "a").crossJoin(df.toDF("j", "y", "b")).where("i < j").select("x", "y", minhash.likeness(F.col("a"), F.col("b")).alias("like")).collect()
    assert len(pairs) == 48 * 47 // 2
    for x, y, like in pairs:
        if jaccard(x, y) == 0:
            assert like < 0.25, (x, y)
    assert df.select(minhash.packed(F.col("s"))).distinct().count() == len(set(texts))
