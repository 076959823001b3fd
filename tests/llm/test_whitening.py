"""Operator 11 against whole numbers and a plain decomposition."""

import math
import random

import numpy as np
import pytest

from quarryline.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n long, component string, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, -1, "clash", "clash") for i, v in rows], SCHEMA)


def brute(rows, k=16):
    """vec_id, length -> deviation, coordinates, explained, n by Python integers."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for d in {len(x) for _, x in kept}:
        fit = sorted({tuple(x) for _, x in kept if len(x) == d})
        n, sums = len(fit), [sum(x[i] for x in fit) for i in range(d)]
        v = np.array([[sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit) / n**3 for j in range(d)] for i in range(d)])
        e, u = np.linalg.eigh(v)
        e, u = e[::-1], u[:, ::-1]
        for i, x in kept:
            if len(x) == d:
                y = [n * a - s for a, s in zip(x, sums)]
                for c in range(min(k, d)):
                    if e[c] > 1e-9 * max(e[0], 1e-300):
                        out.append((i, c + 1, n, sum(a * a for a in y), float(np.dot(np.array(y) / n, u[:, c]) / np.sqrt(e[c])), e[c] / sum(e)))
    return out


def test_rows_match_whole_number_arithmetic(spark):
    rng = random.Random(5)
    vectors = [[rng.gauss(0, 1 + j) for j in range(20)] for _ in range(300)]
    rows = list(enumerate(vectors)) + [(500 + i, vectors[0]) for i in range(40)]  # a hot vector counts once
    rows += [(None, vectors[1]), (7, vectors[2]), (900, None), (901, []), (902, [None] * 20), (903, [float("nan")] + [0.0] * 19), (904, [float("inf")] + [0.0] * 19), (905, [1e300] + [0.0] * 19)]
    rows += [(1000 + i, [rng.random(), rng.random()]) for i in range(9)]
    got = sorted(((r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained) for r in whitening.whiten(frame(spark, rows)).collect()), key=lambda r: (str(r[0]), r[2], r[1], r[3]))
    want = sorted(brute([r for r in rows if r[0] != 905]), key=lambda r: (str(r[0]), r[2], r[1], r[3]))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    signs = {}
    for g, w in zip(got, want):
        if abs(w[4]) > 1e-3:
            sign = signs.setdefault((w[2], w[1]), np.sign(g[4] * w[4]))
            assert g[4] * sign == pytest.approx(w[4], abs=1e-8)
        assert g[5] == pytest.approx(w[5], rel=1e-9)


def test_covariance_is_the_identity_where_means_are_far_off(spark):
    rng = random.Random(6)
    rows = [(i, [1e9 + rng.gauss(0, 5), -3e9 + rng.gauss(0, 0.5), rng.gauss(0, 1)]) for i in range(200)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 600 and max(r.identity_error for r in got) < 1e-9
    exact = {(r[0], r[1]): r[3] for r in brute(rows)}
    assert all(int(r.deviation) == exact[r.vec_id, r.component] for r in got)
    w = {c: np.array([r.whitened for r in sorted(got, key=lambda r: r.vec_id) if r.component == c]) for c in (1, 2, 3)}
    for a in w:
        for b in w:
            assert np.mean((w[a] - w[a].mean()) * (w[b] - w[b].mean())) == pytest.approx(float(a == b), abs=1e-9)


def test_sums_of_long_entries_are_exact(spark):
    rng = random.Random(7)
    x = [[rng.randrange(-(1 << 61), 1 << 61) for _ in range(3)] for _ in range(50)]
    fit = spark.createDataFrame([(v,) for v in x], "x array<long>")
    n, sums, exact = whitening.scatter(fit, 0)[3]
    assert n == 50 and sums == [sum(v[i] for v in x) for i in range(3)]
    for i in range(3):
        for j in range(3):
            assert exact[i, j] == n * sum(v[i] * v[j] for v in x) - sums[i] * sums[j]


def test_no_rows_without_variance(spark):
    assert whitening.whiten(frame(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).count() == 0
    assert whitening.whiten(frame(spark, [])).count() == 0
    line = whitening.whiten(frame(spark, [(i, [float(i), 2.0 * i]) for i in range(5)])).collect()
    assert {r.component for r in line} == {1} and line[0].explained == pytest.approx(1.0)
