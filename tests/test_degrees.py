"""Similar-issue counts of the ranking against all pairs."""

import random

from quarryline.operators import scoring, similarity
from quarryline.plans import triage


def test_degrees_equal_all_pairs(spark):
    rng = random.Random(4)
    titles = ["Crash in parser", "parser crash in", "Crash in the parser", "Wrong total", "tide", "diet", ""]
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(i, rng.choice(titles), " ".join(rng.sample(words, rng.randrange(0, 8))), ["bug"] if i % 2 else [], i) for i in range(120)]
    issues = spark.createDataFrame(rows, "number long, title string, body string, labels array<string>, ord long")
    want = {r.number: r.degree for r in scoring.duplicate_degree(similarity.detect_duplicates(issues)).collect()}
    got = {r.number: r.degree for r in similarity.duplicate_degrees(issues).collect() if r.degree}
    assert got == want and len(want) > 50


def test_kinds_stand_for_all_pairs(spark):
    rng = random.Random(5)
    titles = ["Crash in parser", "parser crash in", "Crash in the parser", "tide", "diet"]
    words = "alpha beta gamma delta epsilon zeta".split()
    rows = [(i, rng.choice(titles), " ".join(rng.sample(words, rng.randrange(0, 6))), [], i) for i in range(100)]
    issues = spark.createDataFrame(rows, "number long, title string, body string, labels array<string>, ord long")
    kind = {r.number: (r.title.lower(), tuple(r.tokens)) for r in issues.withColumn("tokens", similarity.tokens(scoring.issue_text())).collect()}
    first = {}
    for n in sorted(kind):
        first.setdefault(kind[n], n)
    want = {}
    for r in similarity.detect_duplicates(issues).collect():
        a, b = first[kind[r.issue_number]], first[kind[r.candidate_issue_number]]
        want.setdefault((min(a, b), max(a, b)), set()).add(r.similarity)
    got = {(r.left_number, r.right_number): r for r in similarity.duplicate_kinds(issues).collect()}
    assert set(got) == set(want) and len(want) > 30
    sizes = {n: sum(first[k] == n for k in kind.values()) for n in first.values()}
    for pair, r in got.items():
        assert (r.left_members, r.right_members) == tuple(sizes[n] for n in pair) and want[pair] <= {r.similarity, r.reverse_similarity}


def test_ranking_counts_similar_issues(spark, tmp_path):
    rows = [(i, "2-HIGH" if i < 3 else "5-LOW", "F", 1, 0) for i in range(1, 6)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderpriority string, o_orderstatus string, o_custkey long, d int").selectExpr("*", "timestamp '2001-01-01' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    ranked = {r.number: r.factors.duplicate_count for r in triage.ranked(spark, str(tmp_path)).collect()}
    alone = {r.number: r.priority_score for r in triage.priority_score(spark, str(tmp_path)).collect()}
    assert all(x > 0 for x in ranked.values()) and len(ranked) == 5
    assert all(r.priority_score > alone[r.number] for r in triage.priority_rank(spark, str(tmp_path)).collect())
