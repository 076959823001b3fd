"""The pipeline's near copies against all pairs."""

import random

from quarryline.llm import nearcopies


def test_near_copies_beyond_two_bits_go_and_one_row_of_each_group_stays(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(300)]
    rows = [(10, " ".join(base))]
    for i in range(11, 51):  # three to six words changed: Jaccard of 0.82 to 0.91 with the first, less with each other
        text = base[:]
        for at in rng.sample(range(0, 300, 6), rng.randrange(3, 7)):
            text[at] = word()
        rows.append((i, " ".join(text)))
    far = base[:]
    for at in range(0, 300, 12):
        far[at] = word()
    rows += [(60, " ".join(far)), (None, " ".join(base).upper()), (None, "alone one two three four"), (70, "twice is here"), (70, "twice is here"), (80, "short"), (81, "Short"), (90, None), (91, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [None, 10, 60, 70, 80, 90]
    got = sorted((r.doc_id for r in nearcopies.first_of_each(docs).collect()), key=lambda x: -1 if x is None else x)
    assert got == want


def test_groups_equal_all_pairs(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([6, 30, 120]))]
        for _ in range(8):
            text = base[:]
            for _ in range(rng.randrange(0, 5)):
                text[rng.randrange(len(text))] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(text))
    sets = [set(nearcopies.shingles(nearcopies.words_of(t)).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    want = {min(k for k, r in enumerate(root) if r == g) for g in set(root)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in nearcopies.first_of_each(docs).collect()} == want
