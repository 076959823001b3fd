"""Token sets compared in blocks: no pair at the bound is lost, and words are not exchanged."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.operators import blocks, similarity


def packed(sets):
    """As pack() makes them: ids, n, held, marks of (id, tokens, mark of each token)."""
    own = [sorted({mark for _, mark in tokens}) for _, tokens in sets]
    raw = b"".join(m.to_bytes(blocks.BITS // 8, "big") for x in own for m in x)
    return np.array([i for i, _ in sets], np.int64).tobytes(), np.array([len(t) for _, t in sets], np.int32).tobytes(), np.array([len(x) for x in own], np.int32).tobytes(), raw


@pytest.mark.parametrize("least", [0.05, 0.31, 0.8, 1.0])
@pytest.mark.parametrize("several", [1, 3])
def test_tokens_with_one_mark_hide_no_pair(least, several, monkeypatch):
    monkeypatch.setattr(blocks, "AT_ONCE", 50)
    r = random.Random(several)
    sets = [set(r.sample(range(40), r.randint(1, 14))) for _ in range(80)]
    sets += [s ^ {r.randrange(40)} for s in sets[:40]]
    sets = [s for s in {frozenset(s) for s in sets} if s]
    rows = [(i, [(t, t // several * 977) for t in s]) for i, s in enumerate(sets)]
    half = len(rows) // 2
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(a & b) >= least * len(a | b) - 1e-12}
    got = {}
    for x, y, same in ((rows[:half], rows[:half], True), (rows[half:], rows[half:], True), (rows[:half], rows[half:], False)):
        for i, j, most in blocks.compare(packed(x), packed(y), least, same):
            got |= {(min(p), max(p)): m for p, m in zip(zip(i.tolist(), j.tolist()), most.tolist())}
    assert want <= set(got)
    assert all(got[i, j] >= len(sets[i] & sets[j]) / len(sets[i] | sets[j]) - 1e-12 for i, j in want)
    if several == 1:
        assert want == set(got)


def test_kinds_are_found_without_an_exchange_of_words(spark, monkeypatch):
    monkeypatch.setattr(similarity, "class_pairs", None)  # it writes a row for each word of a prefix, and pairs for each word that two sets share
    r = random.Random(3)
    words = [f"word{k}" for k in range(25)]
    texts = [" ".join(r.sample(words, r.randint(2, 12))) for _ in range(60)]
    rows = [(i, f"title {i % 4}", t) for i, t in enumerate(texts + texts[:9])] + [(90, "", ""), (91, "", None)]
    issues = spark.createDataFrame(rows, "number long, title string, body string").withColumn("ord", F.col("number"))
    text = F.coalesce("body", F.lit(""))
    sets = issues.select(F.col("number").alias("set_id"), F.lit(1).alias("n"), blocks.marks(F.array("title")).alias("marks"))
    assert "hashpartitioning" not in blocks.likely_pairs(sets, 0.3)._jdf.queryExecution().executedPlan().toString()
    got = {(x.left_number, x.right_number): (x.similarity, x.reverse_similarity, x.left_members, x.right_members) for x in similarity.duplicate_kinds(issues, text=text).collect()}
    kinds = {}
    for i, title, t in rows:
        if t:
            kinds.setdefault((frozenset(t.split()), title), []).append(i)
    want = {}
    for (a, x), p in kinds.items():
        for (b, y), q in kinds.items():
            if p[0] < q[0] or (p == q and len(p) > 1):
                blend = lambda u, v: round(0.65 * (len(a & b) / len(a | b)) + 0.35 * difflib.SequenceMatcher(None, u, v).ratio(), 4)  # noqa: B023, E731
                if max(blend(x, y), blend(y, x)) >= 0.55:
                    want[p[0], q[0]] = (blend(x, y), blend(y, x), len(p), len(q))
    assert set(got) == set(want) and len(want) > 20
    assert all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)
