"""Operator 12 against brute force: the first document of every string of 50 bytes."""

import hashlib
import random

import numpy as np
import pytest

from quarryline.llm import prefixfree

SCHEMA = "doc_id long, text string, piece long, ids string, spans string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(d, t, -1, "clash", "clash") for d, t in rows], SCHEMA).repartition(parts)


def brute(rows, width=50):
    first = {}
    for d, t in rows:
        data = (t or "").encode()
        for i in range(len(data) - width + 1):
            if d is not None:
                s = data[i : i + width]
                first[s] = min(d, first.get(s, d))
    out = []
    for d, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - width + 1):
            if d is not None and first[data[i : i + width]] < d:
                gone[i : i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def corpus(seed, alphabet="abcdeé ", n=60):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    passages = [text(rng.choice([30, 49, 50, 51, 60, 120, 900, 3000])) for _ in range(14)]
    rows = []
    for d in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.6 else text(rng.randrange(0, 200)) for _ in range(rng.randrange(0, 8))]
        rows.append((rng.randrange(1000) if d % 9 else d, "".join(parts)))
    whole = passages[-1] + text(700) + passages[-2]
    for d in range(5):  # near copies
        at = rng.randrange(len(whole))
        rows.append((2000 + d, whole[:at] + "X" + whole[at + 1 :]))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_removed_bytes_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(prefixfree, "PIECE", 20_000)
    rows = corpus(seed)
    rows += [(None, rows[5][1]), (None, None), (1, None), (3, ""), (4, "z" * 49), (5, "z" * 50), (6, "z" * 51), (7, rows[8][1] + rows[8][1]), (rows[9][0], rows[9][1]), (rows[9][0], rows[9][1])]
    rows += [(3000, "ab" * 400), (3001, "ba" * 300), (3002, "\0" * 120), (3003, "q\0" + "\0" * 119)]
    assert got(prefixfree.repeated_passages(frame(spark, rows))) == brute(rows)


def test_blocks_and_chunks_make_no_difference(spark, monkeypatch):
    rows = corpus(4, "ab ", 40)
    for name, value in (("BLOCK", 500), ("CHUNK", 700), ("TRIGGER", 40), ("PIECE", 4000), ("SPREAD", 2)):
        monkeypatch.setattr(prefixfree, name, value)
    monkeypatch.setattr(prefixfree, "_powers", [])
    assert got(prefixfree.repeated_passages(frame(spark, rows))) == brute(rows)


def test_spans_lie_where_bytes_are_removed(spark):
    rows = [(1, "a quick brown fox jumps over the lazy dog and runs away from here"), (2, "Look: a quick brown fox jumps over the lazy dog and runs away from there")]
    spans = {r.doc_id: r.spans for r in prefixfree.repeated_passages(frame(spark, rows)).collect()}
    assert spans == {1: [], 2: [[6, 67]]} and got(prefixfree.repeated_passages(frame(spark, rows))) == brute(rows)


def test_least_grams_are_those_of_each_string():
    rng = np.random.default_rng(1)
    t = rng.integers(97, 100, 5000).astype(np.uint8)
    _, starts, grams = prefixfree.triggers_and_leasts(t)
    by_string = {}
    for k, s in enumerate(starts):
        for p in range(s, starts[k + 1] if k + 1 < len(starts) else len(t) - 49):
            assert by_string.setdefault(t[p : p + 50].tobytes(), grams[k]) == grams[k]


def test_empty_tables(spark):
    assert prefixfree.repeated_passages(frame(spark, [])).count() == 0
    assert got(prefixfree.repeated_passages(frame(spark, [(None, None)]))) == brute([(None, None)])
