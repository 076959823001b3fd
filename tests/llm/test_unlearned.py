"""Texts in no learned language."""

import random

from quarryline.llm import language


def test_unlearned_languages_and_junk_are_rejected(spark):
    rng = random.Random(3)
    vocab = {"en": "the of and with this that water house".split(), "de": "der die und nicht wasser haus über".split(), "fr": "le la et avec eau maison été".split(), "es": "el los y con agua casa niño".split()}
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(vocab[lang], rng.randrange(5, 80)), lang) for i in range(600) for lang in [("en", "de", "fr", "es")[i % 4]]]
    letters = lambda of: " ".join("".join(rng.choice(of) for _ in range(rng.randrange(2, 9))) for _ in range(40))
    odd = [letters("абвгдежзийклмнопрст"), letters("漢字測試文章語言"), letters("abcdefghijklmnopqrstuvwxyz"), "x" * 300]
    docs = spark.createDataFrame(rows + [(1000 + i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in language.accepted(docs, language.fit(docs)).select("doc_id").collect()}
    assert kept == {r[0] for r in rows}
