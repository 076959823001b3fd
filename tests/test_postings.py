"""Names and words of sources meet what issues ask for without an exchange of postings."""

from quarryline.operators import content


def test_postings_are_not_exchanged(spark):
    files = spark.createDataFrame([("r", "a.py", "use part_1 here\nthen mod.load and part_1"), ("r", "b.ts", "nothing$ apart"), ("s", "a.py", "part_1"), ("r", "c.py", None)], "repository string, path string, content string")
    issues = spark.createDataFrame([(1, "r", ["part_1", "mod.load"], [], ["part", "then"]), (2, "r", ["part_1"], [], []), (3, "s", ["part_1"], [], ["absent"])], "issue_id long, repository string, identifiers array<string>, explicit_identifiers array<string>, content_terms array<string>")
    found = content.content_hits(issues, files)
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [x.split("hashpartitioning(")[1].split(")")[0] for x in plan.splitlines() if "hashpartitioning(" in x]
    assert dealt and not [x for x in dealt if "token" in x or "run" in x or "issue_id" in x]
    got = {(r.issue_id, r.path): (r.identifiers, r.words, r.line) for r in found.collect()}
    assert got == {(1, "a.py"): (["mod.load", "part_1"], ["part", "then"], 1), (1, "b.ts"): ([], ["part"], None), (2, "a.py"): (["part_1"], [], 1), (3, "a.py"): (["part_1"], [], 1)}


def test_long_lists_of_names_and_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(content, "FEW", 0)
    files = spark.createDataFrame([("r", "a.py", "use part_1")], "repository string, path string, content string")
    issues = spark.createDataFrame([(1, "r", ["part_1"], [], ["part"])], "issue_id long, repository string, identifiers array<string>, explicit_identifiers array<string>, content_terms array<string>")
    assert [(r.issue_id, r.path, r.identifiers, r.words, r.line) for r in content.content_hits(issues, files).collect()] == [(1, "a.py", ["part_1"], ["part"], 1)]
