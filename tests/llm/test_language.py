"""The field against brute force over all label paths, and held-out accuracy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import language as L

PARTS = {
    "en": ["The tutor explained the exercise to the class.", "Some answers stop early and have to be asked again.", "Nobody noticed that the coins were counted twice."],
    "de": ["Die meisten schreiben die Zahl auf, bevor sie weiter rechnen.", "Niemand bemerkte, dass die Münzen doppelt gezählt wurden.", "Später kamen die Karten in eine Schublade neben der Tür."],
    "ru": ["Позже все карандаши убрали в бочку у двери.", "Никто не заметил, что монеты посчитали дважды.", "Вторая строка только повторяет вопрос."],
}


@pytest.fixture(scope="module")
def field():
    samples = [(" ".join(p), y) for y, ps in PARTS.items() for p in itertools.permutations(ps)]
    return L.fit([*samples, (PARTS["de"][0], "en")], list(PARTS))


def test_forward_backward_is_brute_force():
    rng = np.random.default_rng(0)
    k, t = 3, 5
    e, a, b = rng.normal(size=(1, t, k)), rng.normal(size=(k, k)), rng.normal(size=(k, k))
    begins = np.array([[True, False, True, False, False]])
    got, (inside, between) = L.forward_backward(e, begins, a, b, np.array([t]), pairs=True)
    want, pairs = np.zeros((t, k)), np.zeros((2, k, k))
    for path in itertools.product(range(k), repeat=t):
        w = np.exp(sum(e[0, i, y] for i, y in enumerate(path)) + sum((b if begins[0, i] else a)[path[i - 1], path[i]] for i in range(1, t)))
        for i, y in enumerate(path):
            want[i, y] += w
            if i:
                pairs[int(begins[0, i]), path[i - 1], y] += w
    z = want[0].sum()
    assert np.allclose(got[0], want / z) and np.allclose(inside, pairs[0] / z) and np.allclose(between, pairs[1] / z)


def test_padding_changes_nothing():
    rng = np.random.default_rng(1)
    e, begins = rng.normal(size=(2, 6, 2)), np.zeros((2, 6), bool)
    a, b = rng.normal(size=(2, 2)), rng.normal(size=(2, 2))
    both = L.forward_backward(e, begins, a, b, np.array([6, 3]))
    alone = L.forward_backward(e[1:, :3], begins[1:, :3], a, b, np.array([3]))
    assert np.allclose(both[1, :3], alone[0])


def test_mixed_text(field):
    text = f"{PARTS['de'][1]} {PARTS['en'][2]} {PARTS['en'][0]}\n{PARTS['ru'][0]}"
    [(found, stretches)] = L.Tagger(field).texts([text])
    assert {x[0] for x in found} == {"en", "de", "ru"} and found[0][0] == "en"
    assert [x[2] for x in stretches] == ["de", "en", "ru"] and all(0 < x[3] <= 1 for x in stretches)
    assert text[stretches[1][0] : stretches[1][1]].startswith("Nobody") and text[stretches[1][0] : stretches[1][1]].endswith("class")


def test_rows(spark, field):
    rows = [(1, None, "en", "k"), (1, "", None, "k"), (2, "12 + 3 = 15", "en", "k"), (3, PARTS["ru"][1], "English", "k"), (4, PARTS["en"][1], "en_GB", "k"), (5, PARTS["de"][2], "??", "k"),
            (6, " ".join(PARTS["en"]) + " " + " ".join(PARTS["de"]), "en", "k"), (7, " ".join(PARTS["de"] * 3000), "DEU", "k")]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, segments string")
    detected = L.detect(df, "doc_id", "text", field, "lang")
    assert detected.count() == 8
    got = sorted((r.doc_id, r.lang) for r in L.mislabelled(detected, "doc_id", "lang").collect())
    assert got == [(3, "ru"), (5, "de"), (6, "de"), (6, "en")]
    assert L.detect(df.limit(0), "doc_id", "text", field, "lang").count() == 0


def test_labels(spark):
    cases = {None: "", "": "", "??": "", "und": "", " EN-us ": "en", "Français": "fr", "ger": "de", "pt_BR": "pt", "it": "it", "Русский": "ru"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "l string, want string")
    assert df.where(L.normal_label(F.col("l")) != F.col("want")).count() == 0


def test_held_out(spark, sf):
    questions = spark.read.parquet(f"{sf}/eval_items.parquet").collect()
    documents = spark.read.parquet(f"{sf.rpartition('/')[0]}/sf0.01/documents.parquet")
    tagger = L.Tagger(L.fit_documents(documents))
    texts = [r.question + " " + r.reference_solution for r in questions]
    found = [f for f, _ in tagger.texts(texts)]
    assert sum([x[0] for x in f] == [r.lang] for f, r in zip(found, questions)) >= 0.97 * len(questions)


def test_empty_sample():
    assert L.Tagger(L.fit([])).texts(["some words here", "nine words of which nobody has seen any before"])[0][0][0][2] == 3


@pytest.fixture(scope="module")
def whole(spark, sf):
    return L.fit_documents(spark.read.parquet(f"{sf.rpartition('/')[0]}/sf0.1/documents.parquet"))


SWITCHED = [
    ("We add the first two numbers and write the total, und dann teilen wir alles durch die Anzahl der Kinder.", ["en", "de"]),
    ("Als Erstes zählen wir die Karten in der Schublade, and after that the remaining pencils are counted twice.", ["de", "en"]),
    ("First the whole box is counted again. Luego sumamos los dos números y escribimos el resultado al final.", ["en", "es"]),
    ("Nobody noticed that Wolfgang and Jürgen counted the coins twice before lunch.", ["en"]),
]


@pytest.mark.parametrize("text, want", SWITCHED)
def test_stretches_inside_sentences(whole, text, want):
    [(_, stretches)] = L.Tagger(whole).texts([text])
    assert [s[2] for s in stretches] == want
    assert stretches[0][0] == 0 and all(a[1] <= b[0] for a, b in zip(stretches, stretches[1:]))


def test_languages_that_the_field_does_not_know(whole):
    texts = ["Następnie dodajemy obie liczby i zapisujemy wynik na końcu zeszytu, żeby nikt go nie zgubił.", "Seuraavaksi laskemme molemmat luvut yhteen ja kirjoitamme tuloksen vihkon loppuun.",
             "Sonra iki sayıyı toplarız ve sonucu defterin sonuna yazarız, böylece kimse unutmaz."]
    assert [f[0][0] for f, _ in L.Tagger(whole).texts(texts)] == ["other"] * 3


def test_a_hot_key_does_not_starve_the_sample(spark):
    """A key that holds a third of the rows, most of them one text, stands beside all the others."""
    rows = [(0, "same text again" if i % 2 else f"text number {i}", "en") for i in range(300)] + [(i, f"text of key {i}", "en") for i in range(1, 600)]
    df = spark.createDataFrame(rows, "k int, t string, l string")
    sample = L.labelled_sample(df, "k", "t", F.col("l"), 100)
    assert len(sample) == len(set(sample)) == 100 and sum("key" in t for t, _ in sample) > 40
    assert sorted(sample) == sorted(L.labelled_sample(df.repartition(7), "k", "t", F.col("l"), 100))
    assert L.labelled_sample(df.limit(0), "k", "t", F.col("l")) == []
