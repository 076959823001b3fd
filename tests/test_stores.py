"""Guarded transitions, walks of answers along their schema, plans, and duplicates at thresholds that titles alone reach."""

import datetime
import difflib
import itertools
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.operators import audit, planning, runs, similarity
from quarryline.sources import readers

NOW = datetime.datetime(2024, 5, 1)


def test_one_of_two_reviewers_fails(spark, tmp_path, monkeypatch):
    store = runs.RunStore(spark, f"file://{tmp_path}/s")
    store.save_run("a/1", "awaiting_review", "{}", NOW)
    seen = store.run("a/1")
    monkeypatch.setattr(store, "run", lambda run_id: seen)  # both have read the run before either decides

    def decide(decision):
        try:
            store.review("a/1", decision, "", NOW)
        except ValueError:
            return None
        return decision

    with ThreadPoolExecutor(2) as pool:
        done = [d for d in pool.map(decide, ("approved", "rejected")) if d]
    assert len(done) == 1
    monkeypatch.undo()
    assert store.run("a/1").status == done[0]
    with pytest.raises(ValueError):
        store.review("a/1", "approved", "", NOW)
    store.save_run("a/1", "awaiting_review", "{}", NOW)  # a new version can be reviewed again
    store.review("a/1", "approved", "", NOW)


SCHEMA = T.StructType([
    T.StructField("summary", T.StringType(), False),
    T.StructField("score", T.DoubleType(), True),
    T.StructField("items", T.ArrayType(T.StructType([T.StructField("id", T.StringType(), False), T.StructField("n", T.LongType(), False)])), False),
])


def test_answers_are_walked_along_their_schema(spark):
    cases = {
        1: '{"summary": "s", "score": 1, "items": [{"id": "a", "n": 1}]}',
        2: '{"summary": "s", "items": [], "more": {"x": 1}}',
        3: '{"summary": 5, "score": "high", "items": [{"id": "a", "n": 1}, {"id": "b", "m": 2.5}, 7]}',
        4: '{"summary": null, "score": null, "items": {}}',
        5: "not json",
        6: "[]",
        7: '{"summary": "s", "score": 0.5, "items": [' + ", ".join(["{}"] * 4) + "]}",
        8: None,
    }
    rows = spark.createDataFrame(list(cases.items()), "id long, payload string")
    found = {(r.id, r.path, r.problem) for r in runs.schema_problems(rows, SCHEMA).collect()}
    assert found == {
        (2, "more", "extra_forbidden"), (2, "score", "missing"),
        (3, "summary", "type_error"), (3, "score", "type_error"), (3, "items.1.m", "extra_forbidden"), (3, "items.1.n", "missing"), (3, "items.2", "type_error"),
        (4, "summary", "type_error"), (4, "items", "type_error"), (5, "", "invalid_json"), (6, "", "type_error"), (8, "", "invalid_json"),
        *[(7, f"items.{i}.{k}", "missing") for i in range(4) for k in ("id", "n")],
    }
    detail = {r.id: r for r in runs.validation_detail(rows, SCHEMA).collect()}
    assert 1 not in detail and detail[7].problems == 8 and detail[7].fields == ["items.0.id", "items.0.n", "items.1.id", "items.1.n", "items.2.id"] and detail[3].classes == ["extra_forbidden", "missing", "type_error"]


def brute_plan(tables, size, multi, reserve):
    least = None
    for choice in itertools.product(*tables):
        if sum(c[0] for c in choice) == size and sum(c[1] for c in choice) >= multi and sum(c[2] for c in choice) >= reserve and (size < len(tables) or all(c[0] for c in choice)):
            cost = sum(c[3] for c in choice)
            least = cost if least is None or cost < least else least
    return least


def test_plans_cost_the_least_of_all_combinations():
    rng = random.Random(4)
    for n in range(40):
        tables = []
        for r in range(rng.randrange(1, 5)):
            own = [(0, 0, rng.randrange(4), 0, "")]
            for k in range(rng.randrange(0, 5)):
                cases = rng.randrange(1, 4)
                own.append((cases, rng.randrange(cases + 1), rng.randrange(5), rng.randrange(30), ",".join(f"{r}-{k}-{i}" for i in range(cases))))
            tables.append(own)
        size, multi, reserve = rng.randrange(1, 8), rng.randrange(3), rng.randrange(6)
        want = brute_plan(tables, size, multi, reserve)
        named = [(str(r), t) for r, t in enumerate(tables)]
        if want is None:
            with pytest.raises(ValueError):
                planning.plan(named, len(tables), size, multi, reserve)
            continue
        cost, ids = planning.plan(named, len(tables), size, multi, reserve)
        assert cost == want and len(ids) == size
        of = {o[4]: o for t in tables for o in t if o[4]}
        taken = {"-".join(i.split("-")[:2]) for i in ids}
        assert sum(o[3] for o in of.values() if "-".join(o[4].split(",")[0].split("-")[:2]) in taken) == cost


@pytest.mark.parametrize("threshold", [0.35, 0.3, 0.12])
def test_low_thresholds_find_all_pairs_without_comparing_all(spark, threshold):
    rng = random.Random(8)
    titles = ["", "", "crash on save", "crash on load", "Crash On Save", "evas no hsarc", "table view", "xx"]
    rows = [(n, rng.choice(titles), " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "zeta", "eta"]) for _ in range(rng.randrange(4)))) for n in range(60)]
    issues = spark.createDataFrame([(n, t, b, n) for n, t, b in rows], "number long, title string, body string, ord long")
    found = similarity.detect_duplicates(issues, threshold, F.concat_ws(" ", "title", "body"))
    words = lambda t, b: {w for w in f"{t} {b}".lower().split() if len(w) >= 3} - set(similarity.STOPWORDS)
    want = set()
    for (i, t, b), (j, u, c) in itertools.combinations(rows, 2):
        x, y = words(t, b), words(u, c)
        s = round(0.65 * (len(x & y) / len(x | y) if x | y else 0.0) + 0.35 * difflib.SequenceMatcher(None, t.lower(), u.lower()).ratio(), 4)
        if s >= threshold:
            want.add((i, j, s))
    assert {(r.issue_number, r.candidate_issue_number, r.similarity) for r in found.collect()} == want and want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_a_manifest_grows_to_its_next_version(spark, tmp_path):
    file = tmp_path / "s.json"
    file.write_text('{"name": "pick", "version": 1, "manifest_name": "next", "selections": [{"candidate_id": "k1", "case_id": "new-1", "tier": null, "review_notes": "ok", "expected_symbols": [{"file": "a.py", "symbol": "f"}]}]}')
    picked = readers.read_selection(spark, f"file://{file}")
    assert picked.first().expected_symbols[0].symbol == "f"
    base = spark.createDataFrame([("m", 4, "c1", "easy", "Own/R", 1, 10, "a", ["x"])], "manifest string, version int, case_id string, tier string, repository string, issue_number long, pr_number long, pre_fix_sha string, expected_files array<string>")
    pool = spark.createDataFrame([("k1", "own/r", 2, 20, "b", ["y"], "hard", []), ("k2", "own/R", 1, 30, "b", ["y"], "hard", [])], "candidate_id string, repository string, issue_number long, pr_number long, pre_fix_sha string, expected_files array<string>, suggested_tier string, failed_checks array<string>")
    got = {(r.manifest, r.version, r.case_id, r.tier) for r in audit.expanded(base, picked, pool, "next").collect()}
    assert got == {("next", 5, "c1", "easy"), ("next", 5, "new-1", "hard")}
    with pytest.raises(ValueError, match="k2: issue exists"):
        audit.expanded(base, spark.createDataFrame([("k2", "new-2", None)], "candidate_id string, case_id string, tier string"), pool)
    file.write_text('{"name": "pick", "version": 1, "selections": [{"case_id": "new-1"}]}')
    with pytest.raises(Exception, match="candidate_id"):
        readers.read_selection(spark, f"file://{file}").collect()
