"""Languages are learned from all rows that may be learned from."""

from pyspark.sql import functions as F

from quarryline.llm import features, language


def rows_of(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "de").otherwise("en").alias("lang"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("der hund und die katze gehen "), F.col("id").cast("string"))).otherwise(F.concat(F.lit("the dog and that cat went "), F.col("id").cast("string"))).alias("text"))


def test_every_row_is_in_a_part_with_all_languages(spark):
    docs = rows_of(spark, 300)
    placed, n = language.parts(docs, {"en": 270, "de": 30}, 100, 5)
    found = placed.collect()
    assert n == 6 and {r.doc_id for r in found} == set(range(300))
    assert all({r.lang for r in found if r.part == k} == {"en", "de"} for k in range(n))
    # a rare one is dealt to several parts, others to one
    assert sum(r.lang == "de" for r in found) == 30 * 3 and sum(r.lang == "en" for r in found) == 270


def test_rows_beyond_a_part_change_the_model_and_the_spread(spark, monkeypatch):
    docs = rows_of(spark, 200)
    monkeypatch.setattr(features, "bounded_sample", None)
    some = language.fit(docs, most=40)
    # all learning rows of one language are alike, so the mean of the parts' models tells them apart as one model does
    assert some.predict(["der hund und die katze", "the dog and that cat"])[0] == language.fit(docs).predict(["der hund und die katze", "the dog and that cat"])[0] == ["de", "en"]
    known = language.familiarity(docs)
    held = [r.text for r in docs.where(features.held_out()).collect()]
    n, score = known.scores(held)
    import numpy as np

    own = np.array([known.langs.index("de" if t.startswith("der") else "en") for t in held])
    mine = score[np.arange(len(held)), own]
    assert np.allclose(known.middle, [np.median(mine[own == k]) for k in range(len(known.langs))])
    squares, long = (mine - known.middle[own]) ** 2, n >= np.median(n)
    assert np.isclose(known.fixed, np.quantile(squares[long], 0.995) / 9)
    shares = [language._letter_grams([r.text for r in docs.where(features.learning() & (F.col("lang") == v)).collect()]) for v in known.langs]
    want = np.array([(x / x.sum(1, keepdims=True)).mean(0) for x in shares])
    assert np.allclose(known.logs, np.log((1 - language.SMOOTH) * want.T + language.SMOOTH / language.BINS))
