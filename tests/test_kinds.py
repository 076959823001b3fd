"""Files of one kind are scored once, and the first of them by path stand for the others."""

import random

from pyspark.sql import functions as F

from quarryline.operators import content, locate


def test_kinds_score_as_their_files_do(spark):
    r = random.Random(3)
    keys = {"exact": 2, "identifiers": 4, "words": 4, "title": 2, "imports": 3, "names": 6, "content": 9, "symbols": 3}
    some = [(part, f"{part}{k}") for part, n in keys.items() for k in range(n)]
    paths = [f"f{i:03d}.py" for i in range(120)]
    lists = [r.sample(some, r.choice((0, 1, 2, 5, 20))) for _ in range(25)]
    held = [(p, *x) for p in paths for x in lists[r.randrange(25)]]
    files = spark.createDataFrame([("r" if i % 5 else "s", p) for i, p in enumerate(paths)], "repository string, path string")
    marked = spark.createDataFrame([(p, i % 7 == 0) for i, p in enumerate(paths)], "path string, auxiliary boolean")
    issues = [(1, "r"), (2, "r"), (3, "s")]
    # two spellings of an identifier are one
    asked = [(i, rep, part, key, f"id{int(key[-1]) // 2}" if part == "identifiers" else key) for i, rep in issues for part, key in some if part != "symbols" and r.random() < 0.7]
    asked = spark.createDataFrame(asked, "issue_id long, repository string, part string, key string, value string")
    shaped = spark.createDataFrame([(i, rep, f"symbols{k}", k == 0, k < 2, ["a"] * k) for i, rep in issues for k in range(3) if (i + k) % 4], "issue_id long, repository string, key string, primary_match boolean, local_match boolean, local_overlap array<string>")
    spoken = spark.createDataFrame([(p, key, i % 9 + 1) for i, (p, part, key) in enumerate(held) if part == "names"], "path string, key string, line int")
    filed = locate.kinds_of(spark.createDataFrame(held, "path string, part string, key string"), files, marked).cache()
    scored = locate.scored_kinds(asked, filed.groupBy("kind").agg(*[F.first(c).alias(c) for c in ("repository", "auxiliary", "facts")]), shaped).cache()
    pairs = spark.createDataFrame([(i, p) for i, _ in issues for p in paths], "issue_id long, file_id string")
    whole = locate.scores_of(pairs, asked, filed, shaped, spoken).collect()
    score = {(x.issue_id, x.file_id): (x.score, x.auxiliary, x.protected and not x.auxiliary) for x in whole}
    by_kind = {(x.issue_id, x.path): (x.score, x.auxiliary, x.guarded) for x in scored.join(filed.select("path", "kind"), "kind").collect()}
    assert by_kind == score and len(score) > 100 and filed.select("kind").distinct().count() < 100
    for most in (3, 8):
        first = {(x.issue_id, x.file_id) for x in locate.first_of_kinds(scored, filed, most).collect()}
        for i, _ in issues:
            order = sorted((-s[0], s[1], p) for (j, p), s in score.items() if j == i)
            guarded = [x for x in order if score[i, x[2]][2]]
            assert {p for j, p in first if j == i} == {p for _, _, p in order[:most] + guarded[:most]}


def test_sources_give_a_row_for_a_file_and_not_for_each_issue(spark):
    files = spark.createDataFrame([("r", f"f{i}.py", "def use(y):\n    return y") for i in range(9)], "repository string, path string, content string")
    issues = spark.createDataFrame([(i, "r", ["use"], [], []) for i in range(20)], "issue_id long, repository string, identifiers array<string>, explicit_identifiers array<string>, content_terms array<string>")
    assert content.found(issues, files).count() == 9 and content.content_hits(issues, files).count() == 180


def test_paths_end_alike(spark):
    references = ["a/b.py", "b.py", "x/y/src/a/b.py", "B.PY", "/src/a/b.py", "c.py", "/b.py", "a.c"]
    paths = ["src/a/b.py", "src/aa/b.py", "b.py", "src/lib.py", "a.c", "q/a.c"]
    found = locate.ending_alike(spark.createDataFrame([(x,) for x in references], "reference string"), spark.createDataFrame([(x,) for x in paths], "path string"))
    plain = lambda x: x.lower().lstrip("./")
    ends = lambda a, b: a.endswith(b) and (len(b) >= 4 or a == b)
    assert {tuple(x) for x in found.collect()} == {(a, b) for a in references for b in paths if ends(plain(a), plain(b)) or ends(plain(b), plain(a))}


def test_asked_for_words_travel_without_their_issues(spark):
    files = spark.createDataFrame([("r", "a.py", "use part_1 here"), ("s", "a.py", "apart été.part_1")], "repository string, path string, content string")
    issues = spark.createDataFrame([(i, "r" if i % 2 else "s", ["part_1"], [], ["part", "here"]) for i in range(6)], "issue_id long, repository string, identifiers array<string>, explicit_identifiers array<string>, content_terms array<string>")
    assert {tuple(x) for x in content.found(issues, files).collect()} == {("r", "a.py", "part_1", 1), ("r", "a.py", "part", None), ("r", "a.py", "here", None), ("s", "a.py", "part_1", 1), ("s", "a.py", "part", None)}
    got = {x.issue_id: (x.identifiers, x.words, x.line) for x in content.content_hits(issues, files).collect()}
    assert got == {i: (["part_1"], ["here", "part"], 1) if i % 2 else (["part_1"], ["part"], 1) for i in range(6)}
