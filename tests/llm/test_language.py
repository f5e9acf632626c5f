import random
import zlib

import numpy as np
import pytest

from costgrain.llm import language
from costgrain.llm.common import table

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["ßen", "sch", "ung", "über"], "cc": ["ción", "osa", "ñar", "ida"], "dd": ["ть", "но", "да", "пре"]}


def text_of(lang, seed, words=40):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices(SYLLABLES[lang], k=draw.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="module")
def spoken(spark):
    rows = [(k, text_of(lang, k), lang, "s") for k in range(400) for lang in [list(SYLLABLES)[k % 4]]]
    rows += [(1000 + k, text_of("aa", k), "aa", None) for k in range(600)]  # one language has most rows
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)


def test_grams_are_all_of_one_to_three_letters():
    seen = {}
    for at, bucket in language.grams(language.codes_of("Ab, cd")):
        seen |= {(a, b): None for a, b in zip(at.tolist(), bucket.tolist(), strict=True)}
    # _ab_cd_: letters 4, pairs 6, triples 5
    assert len(seen) == 15
    a, _ = language.counts("ab cd")
    b, _ = language.counts("...AB;;cd!!")
    assert a.tolist() == b.tolist()
    assert len(language.counts(None)[0]) == len(language.counts("12 ..")[0]) == 0


def test_pieces_add_up(monkeypatch):
    whole = language.counts(text_of("bb", 1, 300))
    monkeypatch.setattr(language, "PIECE", 7)
    pieces = language.counts(text_of("bb", 1, 300))
    assert whole[0].tolist() == pieces[0].tolist() and np.allclose(whole[1], pieces[1])


@pytest.mark.parametrize("languages", [1, 2, 3, 4, 6, 7, 30])
def test_codewords_differ_and_no_bit_is_the_same_for_all(languages):
    code = language.codewords(languages)
    assert len({tuple(c) for c in code.tolist()}) == languages
    if languages > 1:
        assert (np.abs(code.sum(0, dtype=int)) < languages).all()
    if 3 <= languages <= 6:
        assert min((a != b).sum() for k, a in enumerate(code) for b in code[:k]) == 2 ** (languages - 2)


def test_margins_and_decoding_are_those_of_plain_loops(spoken):
    model = language.learn(spoken)
    texts = [text_of("cc", 5), "", None, text_of("dd", 6, 900), "x", "1 2 3"]
    got = model.margins(texts)
    for t, m in zip(texts, got, strict=True):
        bucket, share = language.counts(t)
        assert np.allclose(m, share @ model.weights[bucket].astype(float) + model.bias, atol=1e-4)
    best, score, vague, off = model.decode(got)
    for k, m in enumerate(got):
        loss = [sum(t * np.log1p(np.exp(-x * c)) for x, c, t in zip(m, code, trust, strict=True)) for code, trust in zip(model.code, model.trust, strict=True)]
        likely = np.exp(-np.array(loss) * model.code.shape[1])
        assert best[k] == int(np.argmin(loss)) and abs(score[k] - likely[best[k]] / likely.sum()) < 1e-9
        assert off[k] == sum(x * c <= 0 for x, c in zip(m, model.code[best[k]], strict=True))
        assert vague[k] == (score[k] - sorted(likely / likely.sum())[-2] < language.CLEAR)


def test_held_out_texts_get_their_language(spoken):
    rows = language.identify(spoken, language.learn(spoken)).collect()
    truth = {r.doc_id: r.lang for r in spoken.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.lang_pred == truth[r.doc_id] and 0 <= r.score <= 1 and not r.ambiguous for r in rows) and len(rows) == 1000


def test_the_sample_is_even_and_bounded(spoken):
    sizes = {r.lang: r["count"] for r in language.training_sample(spoken, 5, 0, 200).groupBy("lang").count().collect()}
    assert sizes == {"aa": 50, "bb": 50, "cc": 50, "dd": 50}


def test_nothing_of_a_row_but_its_text_counts(spoken, spark):
    from pyspark.sql import functions as F

    model = language.learn(spoken)
    again = spoken.withColumns({"lang": F.lit("zz"), "source": F.lit("q"), "doc_id": F.col("doc_id") + 7})
    one = {r.doc_id + 7: (r.lang_pred, r.score) for r in language.identify(spoken, model).collect()}
    assert one == {r.doc_id: (r.lang_pred, r.score) for r in language.identify(again, model).collect()}


def test_odd_rows(docs, rows, empty):
    got = language.identify(docs, language.learn(docs)).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} <= {"en", "fr", "und"}
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (300, 301, 302)) and all(r.lang_pred != "und" for r in got if r.doc_id == 303)
    assert language.learn(empty) is None and language.identify(empty, None).collect() == []
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}


def test_held_out_accuracy_on_the_test_tables(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in language.identify(docs, language.learn(docs)).collect() if r.held_out and truth[r.doc_id] is not None]
    assert len(held) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.97
