"""Operator 13 against brute force: every pair of words, one by one."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarryline.llm import erratatrie

SCHEMA = "doc_id long, text string, word string, n long, form string, wid string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "clash", -1, "clash", "clash") for d, t in rows], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def counted(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def edits(word, letters):
    out = set()
    for i in range(len(word) + 1):
        out |= {word[:i] + c + word[i:] for c in letters}
        if i < len(word):
            out |= {word[:i] + word[i + 1 :]} | {word[:i] + c + word[i + 1 :] for c in letters}
    return out - {word}


def brute(rows):
    n = counted(rows)
    letters, form, near = {c for w in n for c in w}, {}, {}
    for w in n:
        found = [x for x in edits(w, letters) if x in n]
        near[w] = len(found)
        top = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = top if top and n[top] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], near[w], n[form[w]] if form[w] else None) for w in n)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def noisy(seed, alphabet, sizes, n_docs=120):
    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.choice(sizes))) for _ in range(40)]
    rows = []
    for d in range(n_docs):
        words = []
        for _ in range(80):
            w = base[min(int(rng.expovariate(0.15)), 39)]
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(alphabet) + w[at:], w[:at] + rng.choice(alphabet) + w[at + 1 :]])
            words.append(w)
        rows.append((d, rng.choice([" ", ", ", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize(("seed", "alphabet", "sizes"), [(1, "ab", (6, 7, 8, 9)), (2, "abcdefghijéÀß", (7, 8, 12)), (3, "aAé", (7, 10))])
def test_words_and_forms_equal_brute_force(spark, seed, alphabet, sizes):
    rows = noisy(seed, alphabet, sizes)
    rows += [(None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1]), (500, None), (501, ""), (502, "x" * 5000 + " " + "x" * 4999), (503, "x" * 5000 + " " + "x" * 4999 + "y"), (504, "wordsto×join× wordsto×join× ćwordsto")]
    assert got(erratatrie.variants(frame(spark, rows))) == brute(rows)


def test_chains_of_forms_end_at_the_most_frequent(spark):
    texts = [("straight ", 3000), ("straiight ", 200), ("straiiight ", 12), ("sstraiiight ", 2)]
    rows = [(0, "".join(w * k for w, k in texts))]
    found = {r.word: r.root for r in erratatrie.variants(frame(spark, rows)).collect()}
    assert got(erratatrie.variants(frame(spark, rows))) == brute(rows) and len(set(found.values())) < len(found)
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(9)], "word string, form string")
    assert {r.root for r in erratatrie.last_forms(chain).collect()} == {"9"}


def test_light_places_are_few(spark):
    words = spark.range(2000).select(F.col("id").alias("wid"), F.conv(F.hex(F.xxhash64("id")), 16, 26).alias("word"), F.lit(2).alias("n"))
    places = erratatrie.light_places(words).groupBy("word").count()
    assert places.agg(F.max("count")).first()[0] <= 11  # log2(2000)


def test_empty_table(spark):
    assert erratatrie.variants(frame(spark, [])).count() == 0
