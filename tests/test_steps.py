"""Steps of location are stored one by one, so that the driver plans no more than one of them at a time."""

from quarryline.operators import codeindex, paths


def test_relations_of_each_kind_are_planned_apart(spark):
    files = spark.createDataFrame([("src/a.py", "from b import fn\ndef use(y):\n    return fn(y)\n"), ("src/b.py", "def fn(x):\n    return x\n")], "path string, content string")
    index = codeindex.repository_map(files)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan(index["modules"])
    seeds = spark.createDataFrame([(1, "src/a.py", 1)], "issue_id long, file_id string, seed int")
    issues = spark.createDataFrame([(1, [], [], [], [])], "issue_id long, primary_terms array<string>, title_text_terms array<string>, explicit_identifiers array<string>, primary_identifiers array<string>")
    referenced = spark.createDataFrame([(1, "src/a.py")], "issue_id long, path string")
    found = paths.relations(seeds, issues, index, paths.marks(index["files"]), referenced)
    assert "Join" not in plan(found)
    assert [(r.issue_id, r.file_id, r.kind, r.via) for r in found.collect()] == [(1, "src/b.py", "call", "fn")]
