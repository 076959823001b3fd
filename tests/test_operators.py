"""Scoring, similarity, audit, runs, evidence, sources and streaming on small inputs."""

import datetime as dt
import difflib
import itertools
import json
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from quarryline.operators import audit, evidence, planning, runs, scoring, similarity
from quarryline.sources import readers, rest
from quarryline.streaming import scoring as streaming

NOW = "2024-03-01"
ISSUE = "number long, title string, body string, labels array<string>, comments_count int, updated_at timestamp, ord long"


def issues(spark, rows):
    at = dt.datetime(2024, 2, 1)
    return spark.createDataFrame([(i, t, b, labels, n, at, i) for i, (t, b, labels, n) in enumerate(rows)], ISSUE)


def test_priorities(spark):
    rows = issues(spark, [
        ("Data loss on save", "Steps to reproduce: save twice", ["bug"], 3),
        ("Typo", "in the source", [], 0),
        ("Release blocker", "workaround known " * 10, ["Bug"], 12),
        ("Odd", "", [], 0),
    ])
    got = {r.number: r for r in scoring.score_issues(rows, NOW).collect()}
    assert got[0].priority == "P0" and got[0].priority_score >= 90 and not got[0].needs_information
    assert got[1].severity == "CRITICAL"  # 'rce' in 'source'
    assert got[2].priority == "P1" and got[2].urgency == "HIGH" and got[2].severity == "MEDIUM"
    assert got[3].needs_information and got[3].priority == "P3"
    ranked = [r.number for r in scoring.rank_issues(rows, NOW).collect()]
    assert ranked[0] == 0 and scoring.top_k(scoring.score_issues(rows, NOW), 2).count() == 2


def brute_pairs(rows, threshold):
    out = {}
    for (i, (t, b, labels, _)), (j, (u, c, others, _)) in itertools.combinations(enumerate(rows), 2):
        words = lambda *x: {w for w in __import__("re").findall("[a-zA-Z0-9_./-]{3,}", " ".join(x).lower()) if w not in similarity.STOPWORDS}
        a, d = words(t, b, *labels), words(u, c, *others)
        jac = len(a & d) / len(a | d) if a | d else 0
        score = round(0.65 * jac + 0.35 * difflib.SequenceMatcher(None, t.lower(), u.lower()).ratio(), 4)
        if score >= threshold:
            out[i, j] = score
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.55, 0.9])
def test_duplicates_equal_all_pairs(spark, threshold):
    words = "login page crash token fails network retry cache parser index".split()
    rows = [(" ".join(words[i % 7 : i % 7 + 3]), " ".join(words[: i % 9]), ["bug"] * (i % 2), 0) for i in range(25)] + [("", "", [], 0), ("", "", [], 0)]
    got = similarity.detect_duplicates(issues(spark, rows), threshold)
    assert {(r.issue_number, r.candidate_issue_number): r.similarity for r in got.collect()} == pytest.approx(brute_pairs(rows, threshold), abs=1e-4)
    if threshold == 0.55:
        assert "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()


def test_matching_is_maximum():
    edges = [(1, "a"), (1, "b"), (2, "a"), (3, "b"), (3, "c"), (4, "c")]
    got = audit.kuhn(edges, [1, 2, 3, 4])
    assert len(got) == 3 and len(set(got.values())) == 3
    chain = [(i, i) for i in range(3000)] + [(i, i + 1) for i in range(3000)]
    assert len(audit.kuhn(sorted(chain, key=lambda e: (e[0], -e[1])), list(range(3000)))) == 3000


@pytest.mark.parametrize("reserve", [0, 2, 12])
def test_options_are_the_cheapest_choices(reserve):

    rng = random.Random(reserve)
    for _ in range(12):
        n = rng.randrange(1, 16)
        pairs = rng.sample([(i, p) for i in range(6) for p in range(100, 106)], n)
        edges = [(i, p, rng.random() < 0.4, rank, f"c{rng.randrange(1000)}-{rank}") for rank, (i, p) in enumerate(pairs)]
        want = {}
        for k in range(4):
            for chosen in itertools.combinations(edges, k):
                if len({c[0] for c in chosen}) < k or len({c[1] for c in chosen}) < k:
                    continue
                rest = [e for e in edges if e[0] not in {c[0] for c in chosen} and e[1] not in {c[1] for c in chosen}]
                key = (k, sum(c[2] for c in chosen), min(reserve, planning.matching_size(rest)))
                value = (sum(c[3] for c in chosen), tuple(c[4] for c in chosen))
                want[key] = min(want.get(key, value), value)
        # without those that cost more than one of more capacity
        assert planning.options(edges, 3, reserve) == {k: v for k, v in want.items() if not any(o[:2] == k[:2] and o[2] > k[2] and w[0] < v[0] for o, w in want.items())}


def test_options_of_many_edges_need_few_of_them():
    rng = random.Random(4)
    pairs = rng.sample([(i, p) for i in range(300) for p in range(1000, 1300)], 4000)
    edges = [(i, p, rng.random() < 0.3, rank, str(rank)) for rank, (i, p) in enumerate(pairs)]
    got = planning.options(edges, 5, 30)
    assert set(got) == {(k, m, 30) for k in range(6) for m in range(k + 1)}

    for k in (1, 2):  # brute force over the first ones, which hold the cheapest
        for m in range(k + 1):
            pick = min((sum(c[3] for c in x), tuple(c[4] for c in x)) for x in itertools.combinations(edges[:60], k) if len({c[0] for c in x}) == k == len({c[1] for c in x}) and sum(c[2] for c in x) == m)
            assert got[k, m, 30] == pick


def test_queue_has_primary_cases_and_reserves(spark):
    rows = [("Org/A", i, 100 + (i * 7 + d) % 40, i % 3 == 0, f"a{i}-{d}") for i in range(30) for d in range(2)] + [("org/b", i, 200 + i, i % 2 == 0, f"b{i}") for i in range(12)]
    edges = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "repository string, issue_number long, pr_number long, multi_file boolean, candidate_id string, rank long")
    got = planning.review_queue(edges, 10, 1, total=16, reserve=5, most=4, share=0.25).collect()
    assert [r.review_order for r in got] == list(range(1, 12)) and [r.priority for r in got] == ["primary"] * 6 + ["reserve"] * 5
    by_id = {r[4]: r for r in rows}
    chosen = [by_id[r.candidate_id] for r in got]
    assert len({(c[0].lower(), c[1]) for c in chosen}) == 11 and len({(c[0].lower(), c[2]) for c in chosen}) == 11
    assert sum(c[3] for c in chosen[:6]) >= 3 and {c[0] for c in chosen[:6]} == {"Org/A", "org/b"}
    with pytest.raises(ValueError, match="different cases"):
        planning.review_queue(edges, 10, 1, total=110, reserve=5)
    with pytest.raises(ValueError, match="plan"):
        planning.review_queue(edges, 10, 1, total=20, reserve=5, most=4)


def test_selection_and_curation(spark):
    options = [("a", [(1, 0, 2, 5, "a1"), (2, 1, 1, 7, "a1,a2")]), ("b", [(1, 1, 1, 3, "b1")]), ("c", [(0, 0, 3, 0, ""), (1, 0, 2, 9, "c1")])]
    assert planning.plan(options, 3, 3, 1, 4) == (17, ("a1", "b1", "c1"))  # as many cases as repositories: each gives one
    assert planning.plan(options, 4, 3, 1, 4) == (10, ("a1", "a2", "b1"))
    with pytest.raises(ValueError):
        planning.plan(options, 3, 9, 0, 0)
    manifest = spark.createDataFrame([("c1", "r", 1, 1)], "case_id string, repository string, issue_number long, pr_number long")
    pool = spark.createDataFrame([("x", "r", 2, 2), ("y", "r", 1, 3)], "candidate_id string, repository string, issue_number long, pr_number long")
    pick = lambda *x: spark.createDataFrame([(i, f"new-{i}") for i in x], "candidate_id string, case_id string")
    assert audit.curate(manifest, pick("x"), pool).count() == 2
    for bad in (pick("z"), pick("x", "x"), pick("y")):
        with pytest.raises(ValueError):
            audit.curate(manifest, bad, pool)


def test_budget_strips_and_charges_what_stays(spark):
    rows = spark.createDataFrame([(1, 1, "abcd"), (1, 2, "ef    gh"), (1, 3, "ij"), (2, 1, "")], "g long, p long, c string")
    got = evidence.budgeted(rows, "g", "p", "c", 8).collect()
    assert [(e.id, e.place, e.content) for e in got[0].evidence] == [("E1", 1, "abcd"), ("E2", 2, "ef"), ("E3", 3, "ij")] and len(got) == 1


def test_evidence_windows(spark):
    sources = spark.createDataFrame([("a.py", "\n".join(f"l{i}" for i in range(1, 31))), (".env", "secret"), ("../x.py", "x")], "path string, content string")
    asked = spark.createDataFrame([(1, 1, "a.py", "10-11"), (1, 2, ".env", None), (1, 3, "../x.py", None)], "issue_id long, rank long, path string, lines string")
    got = evidence.collect_evidence(asked, sources, context=2).first()
    assert [e.content for e in got.evidence] == ["\n".join(f"{i}: l{i}" for i in range(8, 14))]
    with pytest.raises(ValueError):
        evidence.collect_evidence(asked, sources, budget=0)


def test_run_store_and_retries(spark, tmp_path):
    store, clock = runs.RunStore(spark, f"file://{tmp_path}/runs"), iter(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i) for i in range(1000)).__next__
    slept, fails = [], iter([runs.Retryable("busy"), runs.Retryable("later", 9.0)])

    def flaky(state):
        for f in fails:
            raise f
        return {"x": [1, 2]}

    out = runs.run_workflow(store, "r1", [("one", flaky), ("two", lambda s: {"y": len(s["x"])})], {}, clock, sleep=slept.append)
    assert out["y"] == 2 and slept == [1.0, 9.0]
    assert [(r.node_name, r.attempt, r.status) for r in store.traces("r1").collect()] == [("one", 1, "failed"), ("one", 2, "failed"), ("one", 3, "completed"), ("two", 1, "completed")]
    assert store.run("r1").status == "awaiting_review" and store.snapshots("r1").count() == 2
    store.review("r1", "approved", "fine", clock())
    assert store.run("r1").status == "approved" and store.run("r1").created_at == dt.datetime(2024, 1, 1)
    with pytest.raises(ValueError):
        store.review("r1", "approved", "", clock())
    with pytest.raises(KeyError):
        store.run("none")
    with pytest.raises(RuntimeError):
        runs.run_workflow(store, "r2", [("bad", lambda s: (_ for _ in ()).throw(RuntimeError("no")))], {}, clock)
    assert store.run("r2").status == "failed"


def test_answers(spark):
    rows = spark.createDataFrame([("{}",), ("nope",), ('{"summary":"s","issue_type":"bug","observations":[],"hypothesis":{},"extra":1}',), ('{"summary":"s","issue_type":"bug","observations":[],"hypothesis":{"statement":"h"}}',)], "a string")
    assert [r.p for r in rows.select(runs.parse_answer(F.col("a")).problem.alias("p")).collect()] == ["missing: hypothesis,issue_type,observations,summary", "not a JSON object", "unknown: extra", None]


def test_readers(spark, tmp_path):
    file = tmp_path / "issues.json"
    file.write_text(json.dumps([{"number": 2, "title": "b", "created_at": "2024-01-01T00:00:00Z"}, {"number": 1, "title": "a", "body": "x", "labels": ["bug"]}]))
    got = readers.read_issues(spark, f"file://{file}").orderBy("ord").collect()
    assert [(r.number, r.body, r.labels) for r in got] == [(2, "", []), (1, "x", ["bug"])]
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "src/a.py").write_text("x = 1\n")
    (root / "node_modules").mkdir()
    (root / "node_modules/b.js").write_text("")
    assert [(r.path, r.content) for r in readers.read_source_files(spark, f"file://{root}").collect()] == [("src/a.py", "x = 1\n")]
    with pytest.raises(ValueError):
        readers.read_source_files(spark, f"file://{root}", spark.createDataFrame([("../a",)], "path string"))
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "src/a.py")
    run("commit", "-qm", "one")
    assert [r.path for r in readers.tracked_files(spark, str(root)).collect()] == ["src/a.py"]
    commits = readers.commit_table(spark, str(root)).collect()
    assert [(r.commit_ord, r.path) for r in commits] == [(0, "src/a.py")]
    assert readers.blame_table(spark, str(root), [("src/a.py", 1, 9)]).first().sha == commits[0].sha
    assert readers.revision_table(spark, str(root), [(commits[0].sha, "src/a.py"), ("none", "x")]).count() == 1
    manifest = tmp_path / "m.json"
    manifest.write_text(json.dumps({"name": "n", "version": 2, "cases": [{"id": "c", "repository": "bad", "pre_fix_sha": "a" * 40, "expected_files": ["x"], "expected_symbols": [{"file": "y", "symbol": "s"}]}]}))
    cases = readers.read_manifest(spark, f"file://{manifest}")
    assert {r.problem for r in readers.manifest_problems(cases).collect()} == {"repository is not owner/name", "symbol outside expected files"}
    for name, shape in (("a", [{"id": 1}]), ("b", {"candidates": [{"id": 2, "x": 1}]}), ("c", {"repositories": [{"candidates": [{"id": 3}]}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(shape))
    assert sorted(r.id for r in readers.read_candidates(spark, [f"file://{tmp_path}/{n}.json" for n in "abc"]).collect()) == [1, 2, 3]


def test_paging(monkeypatch):
    asked = []

    def get(url):
        asked.append(url)
        page = int(url.rpartition("=")[2])
        return [{"number": page * 100 + i, **({"pull_request": {"url": "x"}} if i % 2 else {})} for i in range(100 if page < 3 else 7 * (page == 3))]

    assert len(rest.open_issues(get, "u", 60)) == 60 and len(asked) == 2
    assert [p for p, _ in rest.pages(get, "u?x=1")] == [1, 2, 3]
    reader = rest.PagedSource({"url": "u", "readers": "2"}).reader(None)
    assert [(p.first, p.step, p.last) for p in reader.partitions()] == [(1, 2, None), (2, 2, None)]
    monkeypatch.setattr(rest, "http_get", lambda url, token: get(url))
    read = [page for p in reader.partitions() for page, _ in reader.read(p)]
    assert sorted(set(read)) == [1, 2, 3] and len(read) == 207


def test_single_objects_and_their_lists():
    sha = "a" * 40
    answers = {
        "b/repos/o/r/issues/7": {"number": 7},
        "b/repos/o/r/issues/8": {"number": 8, "pull_request": {}},
        "b/repos/o/r/pulls/9": {"number": 10},
        f"b/repos/o/r/commits/{sha}": {"sha": sha},
    }
    assert rest.lookup(answers.get, "b", "o/r", "issue", 7) == {"number": 7}
    assert rest.lookup(answers.get, "b", "o/r", "commit", sha)["sha"] == sha
    for kind, key in (("issue", 8), ("pull", 9), ("commit", "xyz"), ("issue", 0)):
        with pytest.raises(ValueError):
            rest.lookup(answers.get, "b", "o/r", kind, key)
    with pytest.raises(ValueError):
        rest.lookup(answers.get, "b", "o", "issue", 7)
    paged = lambda url: [{"n": i} for i in range(100 if url.endswith("page=1") and "files" in url else 3)]
    assert len(rest.children(paged, "b", "o/r", "files", 9)) == 103 and len(rest.children(paged, "b", "o/r", "timeline", 7)) == 3
    search = lambda url: {"items": [{"number": i, **({"pull_request": {}} if i % 2 else {})} for i in range(100 if url.endswith("page=1") else 8)]}
    assert len(rest.linked_closed_issues(search, "b", "o/r", 53)) == 53 and len(rest.linked_closed_issues(search, "b", "o/r", 10)) == 10


def test_stream_scores_like_the_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"number": 1, "title": "Crash", "body": "b", "comments_count": 0, "updated_at": "2024-02-01T00:00:00Z"}\n')
    scored = streaming.score_stream(streaming.issue_stream(spark, f"file://{folder}"), NOW)
    streaming.write_scores(scored, f"file://{tmp_path}/out", f"file://{tmp_path}/check", once=True).awaitTermination()
    assert [(r.number, r.severity) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == [(1, "HIGH")]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from quarryline import __main__ as cli

    monkeypatch.setattr(cli, "session", lambda: spark)
    file = tmp_path / "i.json"
    file.write_text(json.dumps([{"number": 1, "title": "Crash in parser", "body": "see `parse_all()` in src/parser.py", "comments_count": 1, "updated_at": "2024-02-01T00:00:00Z"}, {"number": 2, "title": "Typo", "body": "", "comments_count": 0, "updated_at": "2024-02-01T00:00:00Z"}]))
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "src/parser.py").write_text("def parse_all():\n    pass\n")
    assert cli.main(["rank", f"file://{file}", "--output", f"file://{tmp_path}/ranked", "--now", "2024-03-01"]) == 0
    assert cli.main(["duplicates", f"file://{file}", "--threshold", "0.9"]) == 0
    assert cli.main(["index", f"file://{root}", "--output", f"file://{tmp_path}/index"]) == 0
    assert readers.read_index(spark, f"file://{tmp_path}/index")["symbols"].count() == 1
    assert cli.main(["investigate", f"file://{file}", "1", f"file://{root}"]) == 0
    assert "src/parser.py" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["investigate", f"file://{file}", "9", f"file://{root}"])
