import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from costgrain.llm import brown


def likelihood(pairs, of, classes):
    member = np.eye(classes)[of]
    t = member.T @ pairs @ member
    f = lambda x: float(sum(v * math.log(v) for v in x.ravel() if v > 0))
    return f(t) - f(t.sum(axis=0)) - f(t.sum(axis=1))


def test_exchange_ends_where_no_move_helps():
    rng = np.random.default_rng(1)
    pairs = rng.poisson(2, (9, 9)) * (1 + 5 * ((np.arange(9)[:, None] + np.arange(9)) % 3 == 0))
    of = brown.exchange(pairs, 3)
    best = likelihood(pairs, of, 3)
    for t, c in itertools.product(range(9), range(3)):
        moved = of.copy()
        moved[t] = c
        assert likelihood(pairs, moved, 3) <= best + 1e-6


def test_base_score_counts_and_probability(spark, docs, rows):
    out = brown.score(docs).toPandas()
    assert len(out) == len(rows)
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for r in rows if not held(r[0]) for w in tokens(r[1]))
    total, different = sum(counts.values()), len(counts)
    want = sorted((-1 if r[0] is None else r[0], held(r[0]), len(tokens(r[1])), sum(counts[w] > 0 for w in tokens(r[1])), round(sum(math.log10((counts[w] + 1) / (total + different + 1)) for w in tokens(r[1])), 6)) for r in rows)
    got = sorted((-1 if r.doc_id is None or r.doc_id != r.doc_id else int(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out.itertuples())
    assert got == want
    assert (out["train_tokens"] == total).all() and (out["score"] < 0).all() and np.isfinite(out["score"]).all()


def test_the_class_model_is_no_more_than_a_distribution(spark):
    """Over all words of a closed vocabulary and every class before, probabilities add up to at most 1."""
    docs = spark.createDataFrame([(k, f"the cat {w} the dog") for k, w in enumerate(["sat", "saw", "bit", "ate", "ran"] * 8)], "doc_id long, text string")
    learned = brown.learn(docs)
    model, words = learned.model, learned.words.where("c > 0")
    rows = words.collect()
    where, emit, _ = model.known([bytes(r[0]) for r in rows], np.array([r[1] for r in rows], float))
    for before in range(brown.CLASSES + 1):
        assert 0.5 < (10 ** (emit + model.follow[before][where])).sum() <= 1 + 1e-9
    assert np.allclose((10**model.follow).sum(axis=1), 1)


def test_no_documents(empty):
    assert brown.score(empty).count() == 0


def test_best_moves_are_the_exchange_criterion():
    rng = np.random.default_rng(2)
    pairs = rng.poisson(3, (12, 12)).astype(float)
    of = rng.integers(0, 4, 12)
    member = np.eye(4)[of]
    best, gain = brown.best_moves(member.T @ pairs @ member, pairs @ member, (member.T @ pairs).T, np.diag(pairs), of)
    now = likelihood(pairs, of, 4)
    for t in range(12):
        tried = [likelihood(pairs, np.where(np.arange(12) == t, c, of), 4) for c in range(4)]
        assert math.isclose(max(tried) - now, gain[t], abs_tol=1e-6) and math.isclose(tried[best[t]], max(tried))


def test_words_beyond_the_commonest_are_clustered_on_their_own(spark):
    """500 words of two kinds that share every ending: what stands around them parts them, however many there are."""
    docs = spark.createDataFrame([(k, f"the a{k // 2 % 250}xyz runs home" if k % 2 else f"gold b{k // 2 % 250}xyz of old wine") for k in range(20_000)], "doc_id long, text string")
    learned = brown.learn(docs)
    model, words = learned.model, learned.words.where("c > 0")
    rows = [(bytes(r[0]), r[1]) for r in words.collect()]
    assert len({r[0] for r in model.classes.select("t").collect()}) == len(rows) == 508
    where = dict(zip((w for w, _ in rows), model.known([w for w, _ in rows], np.array([n for _, n in rows], float))[0], strict=True))
    of = lambda first: {c for w, c in where.items() if w.startswith(first) and w.endswith(b"xyz")}
    assert not of(b"a") & of(b"b")


def test_endings_are_letters_and_not_hashed_together(spark):
    words = spark.createDataFrame([(bytearray(w.encode()), 1) for w in ("xéàü", "yéàü", "xéàö")], "word binary, n long")
    a, b, c = (r[0] for r in words.select(brown._type(words["word"], words["n"])).collect())
    assert a == b != c


def test_score_is_that_of_a_plain_model(spark, docs, rows):
    """The class model worked out again without Spark from the classes that were found."""
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    model = brown.learn(docs).model
    teach = [tokens(r[1]) for r in rows if not held(r[0])]
    counts = Counter(w for t in teach for w in t)
    words = sorted({w for r in rows for w in tokens(r[1])})
    where = dict(zip(words, model.known(words, np.array([counts[w] for w in words]))[0].tolist(), strict=True))
    n = brown.CLASSES
    mass = [sum(c for w, c in counts.items() if where[w] == k) for k in range(n)]
    kinds = [sum(where[w] == k for w in counts) for k in range(n)]
    pairs = Counter((n if k == 0 else where[t[k - 1]], where[w]) for t in teach for k, w in enumerate(t))
    all_mass = sum(mass) + sum(kinds)
    grown = lambda a, b: pairs[a, b] * (mass[b] + kinds[b]) / max(1, mass[b]) + brown.TRANSITION * n * (mass[b] + kinds[b]) / all_mass
    below = [sum(grown(a, b) for b in range(n)) for a in range(n + 1)]

    def plain(t):
        c = [n, *(where[w] for w in t)]
        follow = sum(math.log10(grown(a, b) / below[a]) for a, b in itertools.pairwise(c))
        return follow + sum(math.log10((counts[w] + 1) / (mass[where[w]] + kinds[where[w]] + brown.UNSEEN)) for w in t)

    want = sorted((len(tokens(r[1])), round(plain(tokens(r[1])), 3)) for r in rows)
    assert sorted((r[0], round(r[1], 3)) for r in brown.score(docs).select("n_tokens", "score").collect()) == want


def test_numbers_are_packed_and_unpacked():
    some = np.array([0, 5, 2**32 - 1, 7])
    assert brown._unpacked(brown._packed(some)).tolist() == some.tolist() and not len(brown._unpacked(brown._packed(some[:0])))


def test_a_share_that_is_full_is_followed_by_another(spark, docs, monkeypatch):
    monkeypatch.setattr(brown, "SHARE_TOKENS", 100)
    shares, vocabularies = brown.encoded(docs)
    assert shares.count() > 10 and vocabularies.select("share").distinct().count() == shares.count()
    assert sorted(map(tuple, brown.score(docs).select("n_tokens", "n_known").collect())) == sorted(map(tuple, brown.score(docs.coalesce(1)).select("n_tokens", "n_known").collect()))


def unpacked(row):
    """(type, slot, n) of a bucket's row; parts of the class bigrams have no types."""
    types, cells, n = np.frombuffer(row.types, np.int64).tolist(), brown._unpacked(bytes(row.cells)).tolist(), brown._unpacked(bytes(row.n), "<i8").tolist()
    width = brown._OWN + 1
    return [(types[at // width], at % width, k) if types else (row.bucket, at, k) for at, k in zip(cells, n, strict=True)]


def test_contexts_are_what_stands_around_each_type(spark, docs, monkeypatch):
    """Every cell and every class bigram counted again in a plain way, over several shares."""
    monkeypatch.setattr(brown, "SHARE_TOKENS", 100)
    shares, vocabularies = brown.encoded(docs)
    words = vocabularies.groupBy("word").agg({"n": "sum"}).toDF("word", "c")
    placed = brown.stored(vocabularies.join(words, "word").select("share", "k", "c", brown._type(words["word"], words["c"]).alias("t")))
    texts = brown.sequences(shares, placed)
    classes = texts.selectExpr("explode(types) as t").distinct().selectExpr("t", "cast(pmod(t, 5) as int) as c").where("c < 4")
    of = {r[0]: r[1] for r in classes.collect()}
    around, pairs = Counter(), Counter()
    for r in texts.collect():
        seq, starts = [r.types[k] for k in brown._unpacked(bytes(r.seq))], set(brown._unpacked(bytes(r.starts)).tolist())
        for k, t in enumerate(seq):
            if k in starts:
                pairs[brown.CLASSES, of.get(t)] += 1
                continue
            last = seq[k - 1]
            pairs[of.get(last), of.get(t)] += 1
            if last == t:
                around[t, brown._OWN] += 1
                continue
            around[last, of.get(t)] += 1
            around[t, brown.CLASSES + of[last] if last in of else None] += 1
    counts = brown._contexts(texts, classes, 10, 32)
    assert sorted(x for r in counts.where("bucket >= 0").collect() for x in unpacked(r)) == sorted((t, slot, n) for (t, slot), n in around.items() if slot is not None)
    table = brown._class_table(counts)
    assert table.sum() > 100 and {(int(a), int(b)): table[a, b] for a, b in zip(*table.nonzero(), strict=True)} == {k: n for k, n in pairs.items() if None not in k}


def _texts(spark, docs, monkeypatch, tokens=100):
    monkeypatch.setattr(brown, "SHARE_TOKENS", tokens)
    shares, vocabularies = brown.encoded(docs)
    words = vocabularies.groupBy("word").agg({"n": "sum"}).toDF("word", "c")
    placed = brown.stored(vocabularies.join(words, "word").select("share", "k", "c", brown._type(words["word"], words["c"]).alias("t")))
    return brown.sequences(shares, placed)


def test_changes_make_the_contexts_of_the_new_classes(spark, docs, monkeypatch):
    """Counts after moves, from what differs, are those of counting anew; also when cells are counted in blocks."""
    texts = _texts(spark, docs, monkeypatch)
    classes = texts.selectExpr("explode(types) as t").distinct().selectExpr("t", "cast(pmod(t, 5) as int) as c")
    before = brown._contexts(texts, classes, 10, 32)
    read = lambda counts: sorted(x for r in counts.collect() for x in unpacked(r) if x[0] >= 0 or r.bucket >= 0)
    for part in ("pmod(t, 7) = 0", "true", "false"):
        tried = classes.selectExpr("t", f"if({part}, cast(pmod(c + 1, 5) as int), c) as c", "c as was")
        for cells in (1_000, 4_000_000):
            monkeypatch.setattr(brown, "_CELLS", cells)
            got, want = brown._moved_contexts(texts, before, tried, 10, 32), brown._contexts(texts, tried.select("t", "c"), 10, 32)
            assert read(got) == read(want) and (brown._class_table(got) == brown._class_table(want)).all()


def test_clustering_ends_where_no_half_round_helps(spark, docs, monkeypatch):
    """From where it ends, moving half of the types once more gains less than LEAST_GAIN a token."""
    texts = _texts(spark, docs, monkeypatch, 10**6)
    types = brown.stored(texts.selectExpr("explode(types) as t").groupBy("t").agg({"t": "count"}).toDF("t", "n"))
    monkeypatch.setattr(brown, "HEAD", 40)
    classes, pairs = brown.cluster(texts, types)
    counts = brown._contexts(texts, classes, types.count(), 32)
    assert (brown._class_table(counts) == pairs).all()
    moves = {r.t: r for r in brown._proposed(counts, classes, pairs[:-1], 32).collect()}
    for odd in (0, 1):
        half = classes.sparkSession.createDataFrame([(t, r.best if r.gain > 1e-6 and t % 2 == odd else r.home) for t, r in moves.items()], "t long, c int")
        again = brown._class_table(brown._contexts(texts, half, len(moves), 32))
        assert brown._likelihood(again[:-1]) - brown._likelihood(pairs[:-1]) < 4 * brown.LEAST_GAIN * pairs.sum()


def test_classes_meet_shares_by_a_join_as_by_arrays(spark, docs, monkeypatch):
    shares, vocabularies = brown.encoded(docs)
    words = vocabularies.groupBy("word").agg({"n": "sum"}).toDF("word", "c")
    placed = brown.stored(vocabularies.join(words, "word").select("share", "k", "c", brown._type(words["word"], words["c"]).alias("t")))
    texts = brown.sequences(shares, placed)
    classes = texts.selectExpr("explode(types) as t").distinct().selectExpr("t", "cast(pmod(t, 5) as int) as c").where("c < 4")
    found = []
    for few in (10**6, 0):
        monkeypatch.setattr(brown, "FEW_TYPES", few)
        counts = brown._contexts(texts, classes, 10, 32)
        assert counts.select("bucket").distinct().count() == counts.count()
        found.append(sorted(x for r in counts.collect() for x in unpacked(r)))
    assert found[0] == found[1] and len(found[0]) > 100


def test_tokens_are_those_of_plain_splitting_also_of_slices():
    odd = ["The Cat", "", None, " \t\x0b a\x0cB\r\nc\x1c\x1d d e É\x85 ", " ", "İKK ÀB", "a\x00b \x00", "\n\n", "End "] * 30
    for at in range(0, len(odd), 7):
        some = pa.array(odd).slice(at, 7)
        got = brown._tokens(some).cast(pa.list_(pa.large_binary())).to_pylist()
        assert got == [[*(t or "").encode().lower().split(), b""] for t in some.to_pylist()]


def test_numbers_that_rise_are_packed_as_gaps():
    rising = np.cumsum(np.random.default_rng(3).integers(1, 9, 100_000))
    assert brown._unpacked(brown._packed(rising, gaps=True)).tolist() == rising.tolist()
    assert len(brown._packed(rising, gaps=True)) < 60_000 < len(brown._packed(rising)) and not brown._packed(rising[:0], gaps=True)


def test_scoring_shuffles_nothing(spark, docs):
    """Words meet the shares once, before the exchange; the scores are worked out where the shares lie."""
    assert "Exchange" not in brown.score(docs)._jdf.queryExecution().executedPlan().toString()


def test_a_round_in_which_nothing_moves_sends_nothing(spark, docs, monkeypatch):
    texts = _texts(spark, docs, monkeypatch, 1_000)
    classes = texts.selectExpr("explode(types) as t").distinct().selectExpr("t", "cast(pmod(t, 5) as int) as c", "cast(pmod(t, 5) as int) as was")
    sent = []
    monkeypatch.setattr(brown, "_added", lambda rows: sent.append(rows.count()) or rows)
    before = brown._contexts(texts, classes.select("t", "c"), 10, 32)
    brown._moved_contexts(texts, before.limit(0), classes, 10, 32)
    assert sent[0] > 100 and sent[1] == 0
