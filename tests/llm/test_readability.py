"""Reading levels: accuracy on left-out samples, and defined results for odd texts."""

import pytest

from landweave.llm.readability import boost, features, is_english, reading_levels, sentences, train

PLAIN = "The dog ran to the barn. You get a card in the mail. Put it by the door. We will go on Friday. The rent is due now. It is a hot day. He saw a cow. "
HARD = "Notwithstanding any provision to the contrary, the extinguishment of previously promulgated delineations shall not prejudice subsequent alienation, provided further that the petitioner certifies without reservation the impracticability of literal compliance with contemporaneous determinations. "
DOCS, SAMPLES = "doc_id bigint, text string, lang string, band string, grade string", "sample_id bigint, text string, band int"


def test_two_levels(spark):
    samples = [(i, PLAIN * 3, 1) for i in range(8)] + [(10 + i, HARD * 3, 4) for i in range(8)] + [(90, None, 1), (91, "x y", None)]
    rows = [(1, PLAIN * 4, "es"), (2, HARD * 4, "en"), (3, None, "en"), (4, "", "en"), (5, "  \n ", "en"), (6, "short text", "en"), (7, "el perro de la casa que los niños y las casas en la calle por el camino " * 5, "en"), (8, PLAIN * 3000, "en"), (9, "<p>" + PLAIN.replace("e", "é") * 4 + "</p>", "en"), (10, "x " * 60, "en"), (2, HARD * 4, "en"), (None, PLAIN * 4, "en"), (11, "0 1 2 " * 40, "en")]
    df = spark.createDataFrame([(*r, "b", "g") for r in rows], DOCS)
    got = reading_levels(df, spark.createDataFrame(samples, SAMPLES)).collect()
    assert len(got) == len(rows)
    bands = {r.doc_id: r.band for r in got}
    assert {k: v for k, v in bands.items() if v is not None} == {1: 1, 2: 4, 8: 1, 9: 1, None: 1}
    assert {r.doc_id: r.n_words for r in got if r.doc_id in (3, 4, 5, 6)} == {3: 0, 4: 0, 5: 0, 6: 2}
    assert reading_levels(df.limit(0), spark.createDataFrame(samples, SAMPLES)).count() == 0
    assert {r.band for r in reading_levels(df, spark.createDataFrame([], SAMPLES)).collect()} == {None}


def test_left_out_accuracy(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/reading_samples.parquet").orderBy("sample_id").collect()
    _, accuracy = train([(r["text"], r["band"]) for r in rows])
    assert accuracy > 0.9


def test_sentences_and_language():
    assert sentences("1. One two.\n2. Three four five.\nPage 3 of 9\na\tb\t1\n") == [["one", "two"], ["three", "four", "five"]]
    assert is_english("the dog and the cat".split()) and not is_english("el perro y la casa".split())
    assert len(features("a.", [["a"]])) == len(features(HARD, sentences(HARD)))


def test_boosting_fits():
    import numpy as np

    x = np.random.default_rng(0).normal(size=(200, 6))
    y = (x[:, 0] > 0) * 2.0 + x[:, 1]
    m = boost(x, y, rounds=120)
    assert np.abs(m.grade(x) - y).mean() < 0.35
    assert m.grade(x[:1]).shape == (1,)


@pytest.mark.parametrize("n", [1, 2])
def test_few_samples(n):
    model, _ = train([(PLAIN * 3, 1)] * n)
    assert model.band(__import__("numpy").array([features(PLAIN, sentences(PLAIN))]))[0] in (1, 2)
