import numpy as np
import pytest

from costgrain.llm import toxicity
from costgrain.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def decoder(spark):
    text = "what an idiot you are said the moron to the other stupid clown and it is disgusting to be a loser in the sun with all of them " * 30
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    return toxicity.Decoder(toxicity.language_model(toxicity.trigram_counts(docs)))


@pytest.mark.parametrize(
    ("shown", "meant"),
    [("1d10t", "idiot"), ("id!ot", "idiot"), ("m0r0n", "moron"), ("idiiiot", "idiot"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("$tup1d", "stupid"), ("cl0wnnn", "clown"), ("st-u-p-i-d", "stupid")],
)
def test_disguises_are_undone(decoder, shown, meant):
    assert meant in decoder.restore(f"you {shown} there")


@pytest.mark.parametrize(("shown", "meant"), [("!diot", "idiot"), ("idio7", "idiot"), ("(mor0n)", "moron"), ("clow4", "clowa"), ("loser$", "losers"), ("stup1d!!", "stupid")])
def test_signs_at_both_ends_are_letters(decoder, shown, meant):
    """They are read both ways: as letters, and as signs that belong to no word."""
    assert meant in decoder.restore(f"you {shown} there")
    assert meant in toxicity.finds(f"you {shown} there", decoder)
    assert "loser" in toxicity.finds("a loser$ b", decoder) and "idiot" in toxicity.finds("an idiot7", decoder)


def test_what_mostly_is_no_disguise_counts_only_for_words_of_the_lexicon(decoder):
    model = toxicity.Toxicity(decoder, {"idiot": (5.0, True), "stupid": (4.0, True), "bad": (3.0, False)}, np.zeros(toxicity.WIDTH))
    top = lambda text: model.features(text)[1]
    assert [top(f"you {x} there") for x in ("iddiot", "s.tupid", "b a d", "b-ad", "stuppid")] == [5.0, 4.0, 3.0, 3.0, 4.0]
    assert top("a better letter. Next word, b e d, well-known o.k.") == 0.0


def test_plain_text_stays(decoder):
    plain = "the year 2024 was, as they say, good: see §3 (page 12) — naïve"
    assert decoder.restore(plain) == plain
    assert decoder.restore("") == ""


def test_long_spans_are_decoded_whole(decoder):
    long = "1d10t" * 400
    assert decoder.decode(long).count("idiot") > 390
    assert decoder.restore(f"you {long} there").count("idiot") > 390


def test_viterbi_finds_the_likeliest(decoder):
    """What is found is among the best of every way through the lattice of a span."""
    m = decoder.model

    def every(span):
        ways = [((), 0.0, "")]
        for r, repeat in zip(span, decoder._repeats(span), strict=True):
            means = [(r, 0.0)] if r.isalpha() else [(x, toxicity.SIGN_COST) for x in toxicity.SIGNS.get(r, "")]
            new = [(w, v + toxicity.GAP_COST, last) for w, v, last in ways if r in toxicity.GAPS or not means]
            for x, cost in means:
                new += [((*w, x), v + cost, x) for w, v, last in ways]
                new += [(w, v + cost + repeat, last) for w, v, last in ways if last == x]
            ways = new
        value = {}
        for w, v, _ in ways:
            c = [0, 0, *(toxicity.code(x) for x in w), 0]
            v += sum(m[a, b, d] for a, b, d in zip(c, c[1:], c[2:], strict=False))
            value["".join(w)] = max(v, value.get("".join(w), -1e9))
        return value

    for span in ("1d10t", "m00n", "aabb1", "s-t", "l11l", "a||b", "he110"):
        value = every(span)
        assert value[decoder._search(span)] == pytest.approx(max(value.values()))


def test_held_out_accuracy(spark):
    out = toxicity.op7(spark, SF)
    met = out.join(table(spark, SF, "labels"), "doc_id").where("held_out").toPandas()
    assert len(met) > 50 and (met["predicted"] == met["toxic"]).mean() > 0.9
    assert out.count() == table(spark, SF, "documents").count()


def test_odd_rows(spark, docs, rows, empty):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (4, None, None), (None, 1, 1), (8, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    out = toxicity.score(docs, model).toPandas()
    assert len(out) == len(rows) and out["score"].between(0, 1).all()
    kept = toxicity.keep_clean(docs, labels)
    assert kept.schema == docs.schema and kept.count() == int((out["predicted"] == 0).sum())
    assert toxicity.keep_clean(empty, labels.limit(0)).count() == 0


def test_model_is_a_distribution(decoder):
    assert np.allclose(np.exp(decoder.model).sum(axis=2), 1)


@pytest.mark.parametrize(
    "shown",
    ["i . d . i . o . t", "i- d- i- o- t", "i--d--i--o--t", "s t u p i d.", "s t u p i d!", "s t u p 1 d", "i.d.1.o.t", "a s t u p i d", "i d i o t   s t u p i d", "m o r o n i d i o t"],
)
def test_letters_set_apart_are_found(decoder, shown):
    meant = {w for w in ("idiot", "stupid", "moron") if w in "".join(x for x in shown.replace("1", "i") if x.isalpha())}
    assert meant and meant <= toxicity.finds(f"you {shown} there", decoder)
    assert meant <= set(decoder.restore(f"you {shown} there").split())


def test_tripled_letters_of_any_alphabet_are_decoded(decoder):
    alone = toxicity.finds("quel crééétin ici", decoder)
    assert "crééétin" not in alone and set(decoder.restore("crééétin").split()) <= alone
    assert alone - {"quel", "ici"} <= toxicity.finds("quel crééétin ici nooo", decoder)


def test_held_out_toxic_documents_are_found(spark):
    """Of the held-out ones labelled toxic nine in ten, of the clean ones next to none."""
    sf = "/root/testdata/sf0.1"
    met = toxicity.op7(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    toxic, clean = met[met["toxic"] == 1], met[met["toxic"] == 0]
    assert len(toxic) > 100 and toxic["predicted"].mean() >= 0.9 and clean["predicted"].mean() < 0.02


def test_trigrams_are_of_characters_and_not_of_bytes(spark):
    docs = spark.createDataFrame([(1, "é"), (2, "")], "doc_id long, text string")
    cube = toxicity.trigram_counts(docs)
    assert cube[0, 0, 27] == cube[0, 27, 0] == 1 and not cube[27, 27].any()
