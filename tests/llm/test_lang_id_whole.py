"""Texts without spaces are read whole, and every language is learned."""

import random

from pyspark.sql import functions as F

from millrace.llm import lang_id

LETTERS = {"ja": "あいうえおかきくけこさしすせそ", "zh": "的一是不了人我在有他这为之大来"}


def line(rng, lang, n):
    return "".join(rng.choice(LETTERS[lang]) for _ in range(n))


def test_the_inside_of_a_long_word_counts():
    rng = random.Random(1)
    model = lang_id.fit([(line(rng, lang, 300), lang) for _ in range(30) for lang in LETTERS])
    ends = line(rng, "zh", 8)
    assert lang_id.Labeller(model).documents([ends + line(rng, "ja", 2000) + ends])[0][0] == "ja"


def test_pieces():
    assert lang_id.words_of("ab  " + "x" * 35 + "\n" + "İ" * 12) == ["ab", "x" * 16, "x" * 16, "xxx", "İ" * 8, "İ" * 4]
    assert max(len(w.lower()) for w in lang_id.words_of("İ" * 100 + "x" * 100)) <= lang_id.WIDE


def test_more_than_64_languages(docs_of):
    rows = [(k, f"word{k % 70} other{k % 70}", f"l{k % 70:02}") for k in range(140)]
    assert len(lang_id.train(docs_of(rows), F.lit(True)).labels) == 70
