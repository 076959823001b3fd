"""Operator 5 against a plain loop over families, duels and votes."""

import math
import random

from quarryline.llm import features, language

LETTERS = {"de": "aeinrstuß", "en": "aehotwy", "nl": "aeijknv", "es": "aeosñl", "fr": "aeéuxl", "it": "aeiozc", "qq": "xyz"}


def texts(seed, n):
    rng = random.Random(seed)
    return [(lang, " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(1, 30)))) for lang, letters in LETTERS.items() for _ in range(n)]


def plain(model, text):
    """The language and score of one text, number by number."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    x = [*map(float, features.unit(features.gram_counts([text], language.BINS))[0]), 1.0]
    dot = lambda w: sum(a * float(b) for a, b in zip(x, w) if a)
    logits = [dot(model.family[:, f]) for f in range(len(model.families))]
    top = max(logits)
    chances = [math.exp(v - top) for v in logits]
    family = max(range(len(logits)), key=lambda f: logits[f])
    chance = chances[family] / sum(chances)
    members = [v for v in model.langs if language.family_of(v) == model.families[family]]
    best = None
    for a in members:
        votes, margins = 0, []
        for b in members:
            if a != b:
                i, j = sorted((model.langs.index(a), model.langs.index(b)))
                margin = dot(model.duels[i, j]) * (1 if model.langs[i] == a else -1)
                votes += margin > 0
                margins.append(margin)
        sure = sum(1 / (1 + math.exp(-2 * m)) for m in margins) / len(margins) if margins else 1.0
        best = min(filter(None, (best, (-votes, -sum(margins), a, sure))))
    return best[2], min(1.0, chance * best[3])


def test_votes_equal_a_plain_loop(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate(texts(1, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert len(model.families) == 3 and len(model.duels) == 6  # three duels in each family of three, none in the family of one
    asked = [t for _, t in texts(2, 6)] + [None, "", "12 34", "aß", "é"]
    frame = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(frame, model).collect()}
    for i, t in enumerate(asked):
        lang, score = plain(model, t)
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-4
    assert len({v for v, _ in got.values()}) >= 7
