"""Rejection: gibberish and unknown scripts go, texts of a learned language stay."""

import random

import pytest

pytest.importorskip("tablelens.llm")

from tablelens.llm import langid  # noqa: E402

SYLLABLES = {
    "a": ["ka", "lo", "mi", "ren", "tu", "sol"],
    "b": ["schwe", "ing", "ach", "ter", "und", "ver"],
    "c": ["eau", "oux", "ille", "que", "ant", "ez"],
    "d": ["ción", "ado", "llo", "est", "por", "rra"],
}


def text(rng, language, words):
    return " ".join("".join(rng.choices(SYLLABLES[language], k=rng.randint(1, 3))) for _ in range(words))


def model_of(languages, per=150, seed=1):
    rng = random.Random(seed)
    return langid.train([s for x in languages for _ in range(per) for s in langid.samples_of(x, text(rng, x, rng.randint(5, 60)))])


def gibberish(rng):
    return " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=rng.randint(2, 9))) for _ in range(rng.randint(4, 30)))


def han(rng):
    return "".join(chr(rng.randint(0x4E00, 0x9F00)) for _ in range(40))


@pytest.mark.parametrize("languages", ["a", "ab", "abcd"])
def test_rejects_gibberish_and_keeps_texts(languages):
    model, rng = model_of(languages), random.Random(2)
    table = model.word_table()
    judge = lambda make, n=100: [model.predict(make(), table) for _ in range(n)]
    assert sum(r for *_, r in judge(lambda: gibberish(rng))) >= 95
    assert sum(r for *_, r in judge(lambda: han(rng))) >= 95
    for x in languages:
        found = judge(lambda x=x: text(rng, x, rng.randint(6, 40)))
        assert sum(lang == x for lang, *_ in found) >= 98 and sum(r for *_, r in found) <= 2
    for x in set(SYLLABLES) - set(languages):  # a language that it doesn't know
        assert sum(r for *_, r in judge(lambda x=x: text(rng, x, 20))) >= 90


def test_rejects_on_whole_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit_languages(docs)
    assert 0.01 < model.temperature < 100 and len(model.languages) == 4
    rng = random.Random(3)
    n = docs.count()
    assert langid.keep_identified(docs, model).count() >= 0.99 * n
    strange = spark.createDataFrame([(k, (gibberish if k % 2 else han)(rng)) for k in range(200)], "doc_id long, text string")
    assert langid.keep_identified(strange, model).count() <= 10


def test_pieces_of_a_text_stay_on_its_side():
    rng = random.Random(4)
    for _ in range(200):
        found = langid.samples_of("a", text(rng, "a", 30))
        assert len({s.kept_out for s in found}) == 1
        assert len(found) == (4 if found[0].kept_out else 2)
        assert [s.language for s in found[2:]] == [None] * (len(found) - 2)


def test_letters_are_those_of_unicode():
    assert langid.words_of("½ ² ① ⅷ 12 _") == [] and langid.words_of("Été, naïve_x 漢字3") == ["été", "naïve", "x", "漢字"]
    model = model_of("ab")
    assert model.predict("½ ² ①", model.word_table()) == ("und", 0.0, True)


def test_faultless_classes_get_a_temperature_inside_the_search():
    model = model_of("abcd")
    assert 0.01 < model.temperature < 100
    table = model.word_table()
    rng = random.Random(5)
    sure = [model.predict(text(rng, "a", 40), table)[1] for _ in range(50)]
    mixed = [model.predict(text(rng, "a", 5) + " " + text(rng, "b", 5), table)[1] for _ in range(50)]
    assert min(sure) > 0.8 > sum(mixed) / 50


def test_word_table_gives_the_same_at_any_size():
    model, rng = model_of("ab"), random.Random(6)
    small, large = model.word_table(), model.word_table()
    small.limit, small.PART = 10, 7
    for _ in range(20):
        t = text(rng, "ab"[rng.random() < 0.5], 50)
        x, y = model.predict(t, small), model.predict(t, large)
        assert x[0] == y[0] and x[1] == pytest.approx(y[1], abs=1e-12) and x[2] == y[2]
