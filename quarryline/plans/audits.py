"""Queries: auditing, queues, matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.operators import audit as A
from quarryline.operators import planning
from quarryline.plans.adapters import VIEWS, adapter, with_views

VIEWS["candidates"] = """
SELECT repository, CASE WHEN issue_number % 17 = 0 THEN 'other/repo' ELSE upper(repository) END AS base_repository, issue_number, pr_number,
  CASE WHEN issue_number % 3 = 0 THEN 'App crash on start' ELSE 'Unclear output' END AS issue_title,
  CASE WHEN issue_number % 4 = 0 THEN 'Steps to repeat are below, with the expected behavior spelled out' ELSE 'short' END AS issue_body,
  CASE WHEN issue_number % 5 = 0 THEN 'type: Bug' ELSE 'question' END AS label, issue_created_at,
  CASE WHEN merged THEN issue_created_at + CASE WHEN pr_number % 6 = 0 THEN INTERVAL '-1' DAY ELSE INTERVAL '9' DAY END END AS merged_at,
  CASE WHEN pr_number % 7 <> 0 THEN concat('sha', CAST(pr_number % 5 AS VARCHAR(9))) END AS pre_fix_sha, concat('sha', CAST(pr_number % 9 AS VARCHAR(9))) AS commit_sha, n_source_files,
  concat(CASE WHEN pr_number % 2 = 0 THEN 'Fixes #' ELSE 'About #' END, CAST(issue_number AS VARCHAR(20))) AS pr_text
FROM (SELECT DISTINCT concat('owner/project-', CAST(c.c_nationkey AS VARCHAR(20))) AS repository, l.l_orderkey AS issue_number, l.l_partkey AS pr_number,
       o.o_orderstatus <> 'P' AS merged, o.o_orderdate AS issue_created_at, o.o_custkey % 4 AS n_source_files
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey) q"""


def audited(spark, sf_dir):
    return A.audit(adapter(spark, sf_dir, "candidates").withColumns({"labels": F.array("label"), "commit_shas": F.array("commit_sha")}))


KEY = ("repository", "issue_number", "pr_number")


def audit_checks(spark, sf_dir):
    return audited(spark, sf_dir).select(*KEY, F.array_join(A.codes(True, True), ",").alias("passed_blocking"), F.array_join(A.codes(True, False), ",").alias("passed_advisory"))


def audit_status(spark, sf_dir):
    return audited(spark, sf_dir).groupBy("repository", "status").agg(F.count("*").alias("n"))


def advisory_score(spark, sf_dir):
    return audited(spark, sf_dir).select(*KEY, A.advisory_score().alias("score"))


def blocking_failures(spark, sf_dir):
    return audited(spark, sf_dir).select(*KEY, F.array_join(A.blocking_failures(), ",").alias("failures"))


def existing(spark, sf_dir):
    return adapter(spark, sf_dir, "audit_edges").where("n_source_files = 3").select(*KEY)


def edges(spark, sf_dir):
    return A.reviewable_edges(audited(spark, sf_dir), existing(spark, sf_dir))


def reviewable_edges(spark, sf_dir):
    return edges(spark, sf_dir).select(*KEY)


def discovery_early_stop(spark, sf_dir):
    return A.early_stop(audited(spark, sf_dir), 5, ["issue_number", "pr_number"]).select(*KEY, "status")


def repeated_pull_requests(spark, sf_dir):
    return A.repeated_pull_requests(audited(spark, sf_dir), ["issue_number"]).select(*KEY, "unique_pr")


def review_queue_entry(spark, sf_dir):
    return A.queue_entries(audited(spark, sf_dir).where("status = 'needs_review'"))


def curate_manifest(spark, sf_dir):
    base = adapter(spark, sf_dir, "audit_edges").where("merged").select(F.concat_ws("-", *KEY).alias("case_id"), *KEY)
    pool = adapter(spark, sf_dir, "audit_edges").where("NOT merged").select(F.concat_ws("/", *KEY).alias("candidate_id"), *KEY)
    return A.curate(base, pool.select("candidate_id", F.concat(F.lit("new-"), "candidate_id").alias("case_id")), pool)


def classified_files(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ("modified", "added", "renamed", "copied"))), (F.col("weight") % 4 + 1).cast("int"))
    return A.classify_files(adapter(spark, sf_dir, "files").select("path", status.alias("status")))


def linked_pull_requests(spark, sf_dir):
    """Events with a pull request or an issue as their source, addresses of this and of another repository, and pages of the web site, which name no repository in that form."""
    n = F.col("pr_number")
    api = lambda repository, kind, number: F.concat(F.lit("https://api.host/repos/"), repository, F.lit(f"/{kind}/"), number.cast("string"))
    events = adapter(spark, sf_dir, "audit_edges").select(
        F.col("issue_number").alias("issue_key"), "repository", (n % 4 != 0).alias("source_is_pull"),
        F.concat(F.lit("https://api.host/repos/"), F.when(n % 3 == 0, F.upper("repository")).otherwise(F.lit("other/repo"))).alias("source_repository_url"), F.when(n % 2 == 0, n).alias("source_number"),
        F.when(n % 7 == 0, api(F.col("repository"), "pulls", n + 1)).alias("subject_url"),
        F.when(n % 11 == 0, F.concat(F.lit("https://host/owner/any/pull/"), (n + 2).cast("string"), F.lit("?x=1"))).alias("subject_html_url"),
        api(F.when(n % 5 == 0, F.lit("other/repo")).otherwise(F.col("repository")), "pulls", n + 3).alias("event_url"),
    )
    return A.linked_pull_requests(events).withColumn("pull_requests", F.array_join("pull_requests", ","))


def pre_fix_source(spark, sf_dir):
    n = F.col("pr_number")
    sha = lambda c: F.concat(F.lit("s"), c.cast("string"))
    parents = F.when(n % 4 == 0, F.array(sha(n), sha(n + 1))).when(n % 4 == 1, F.array(sha(n))).otherwise(F.array().cast("array<string>"))
    found = A.pre_fix(F.when(n % 5 == 0, sha(n % 11)).otherwise(""), parents, sha(n + n % 3), sha(n), sha(n + n % 2), n % 3)
    return adapter(spark, sf_dir, "audit_edges").select(*KEY, found.alias("f")).select(*KEY, "f.sha", "f.source")


def ranked_edges(spark, sf_dir):
    """Reviewable edges with their rank among all, and an id."""
    rows = edges(spark, sf_dir).select(*KEY, "issue_created_at", "n_source_files", "passed", (F.col("n_source_files") > 1).alias("multi_file"), F.concat_ws("/", *KEY).alias("candidate_id"))
    return planning.ranked(rows, A.review_order()).select(*KEY, "multi_file", "candidate_id", "rank")


def edge_ranks(spark, sf_dir):
    return ranked_edges(spark, sf_dir)


def max_matching(spark, sf_dir):
    return A.maximum_matching(ranked_edges(spark, sf_dir).withColumn("place", F.col("rank")))


def primary_options(spark, sf_dir):
    """The cheapest choices of up to two cases of each repository."""
    return planning.repository_options(ranked_edges(spark, sf_dir), 2, 30)


def primary_selection(spark, sf_dir):
    """The plan for 60 cases, five of a repository at most, of which 10 have several files, with 30 in reserve."""
    cost, ids = planning.select_primary(ranked_edges(spark, sf_dir), 60, 10, 5, 30)
    return spark.createDataFrame([(cost, i) for i in ids], "cost long, candidate_id string")


def review_queue(spark, sf_dir):
    """A queue that brings a manifest of 140 cases, 50 of them of several files, to 200, with 30 in reserve."""
    return planning.review_queue(ranked_edges(spark, sf_dir), 140, 50)


VIEWS["manifest_cases"] = "SELECT concat('case-', CAST(o_orderkey AS VARCHAR(20))) AS case_id, concat('Own/R', CAST(o_custkey % 50 AS VARCHAR(9))) AS repository, o_orderkey AS issue_number, o_orderkey + 7 AS pr_number FROM orders WHERE o_orderkey % 5 = 0"
VIEWS["pool"] = """
SELECT concat('k', CAST(o_orderkey AS VARCHAR(20))) AS candidate_id, concat('own/r', CAST(o_custkey % 50 AS VARCHAR(9))) AS repository, CASE WHEN o_custkey % 6 = 0 THEN 1 ELSE o_orderkey END AS issue_number, o_orderkey + 7 AS pr_number,
       CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE 'a' END AS pre_fix_sha, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE 'x' END AS file, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE 'easy' END AS suggested_tier, o_custkey % 8 AS f, o_orderkey AS o FROM orders"""
VIEWS["chosen"] = """
SELECT concat('k', CAST(CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey * 1000000 ELSE o_orderkey END AS VARCHAR(30))) AS candidate_id, concat('case-', CAST(CASE WHEN o_orderkey % 9 = 0 THEN 3 ELSE o_orderkey END AS VARCHAR(20))) AS case_id, CASE WHEN o_orderkey % 2 = 0 THEN 'hard' ELSE NULL END AS tier FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT concat('k', CAST(o_orderkey AS VARCHAR(20))), concat('again-', CAST(o_orderkey AS VARCHAR(20))), 'hard' FROM orders WHERE o_orderkey % 33 = 0"""


def selection_problems(spark, sf_dir):
    pool = adapter(spark, sf_dir, "pool").withColumns({"expected_files": F.when(F.col("file").isNotNull(), F.array("file")), "failed_checks": F.when(F.col("f") == 0, F.array(F.lit("closes"), F.lit("merged"))).otherwise(F.array().cast("array<string>"))})
    return A.selection_problems(adapter(spark, sf_dir, "manifest_cases"), adapter(spark, sf_dir, "chosen"), pool)


QUERIES = {f.__name__: f for f in (audit_checks, audit_status, advisory_score, blocking_failures, reviewable_edges, discovery_early_stop, repeated_pull_requests, review_queue_entry, curate_manifest, classified_files, linked_pull_requests, pre_fix_source, edge_ranks, max_matching, primary_options, primary_selection, review_queue, selection_problems)}

_C = """c AS (SELECT *, lower(issue_title || chr(10) || issue_body) AS t FROM candidates),
k AS (SELECT *, lower(base_repository) = lower(repository) AS same_repository, merged_at IS NOT NULL AS merged_pull_request, coalesce(issue_created_at <= merged_at, false) AS issue_precedes_fix, pre_fix_sha IS NOT NULL AS pre_fix_sha_identified, true AS pull_commit_history,
  coalesce(pre_fix_sha <> commit_sha, false) AS pre_fix_outside_pull_commits, n_source_files > 0 AS production_source_files, n_source_files BETWEEN 1 AND 5 AS bounded_source_files,
  length(trim(issue_body)) >= 40 AS issue_has_body, regexp_matches(t || ' ' || lower(label), 'bug|regression|crash|incorrect|error|broken') AS bug_signal, regexp_matches(t, 'actual behavior|expected behavior|exception|reproduce|reproduction|steps|traceback') AS diagnostic_signal,
  pr_text = 'Fixes #' || issue_number AS closing_reference FROM c),
a AS (SELECT *, list_filter(['bounded_source_files','issue_precedes_fix','merged_pull_request','pre_fix_outside_pull_commits','pre_fix_sha_identified','production_source_files','pull_commit_history','same_repository'], lambda x, i: [bounded_source_files, issue_precedes_fix, merged_pull_request, pre_fix_outside_pull_commits, pre_fix_sha_identified, production_source_files, pull_commit_history, same_repository][i]) AS pb,
  list_filter(['bug_signal','closing_reference','diagnostic_signal','issue_has_body'], lambda x, i: [bug_signal, closing_reference, diagnostic_signal, issue_has_body][i]) AS pa,
  list_filter(['bug_signal','closing_reference','diagnostic_signal','issue_has_body'], lambda x, i: NOT [bug_signal, closing_reference, diagnostic_signal, issue_has_body][i]) AS fa,
  2 * bug_signal::INT + 3 * closing_reference::INT + 2 * diagnostic_signal::INT + issue_has_body::INT AS score FROM k),
b AS (SELECT *, CASE WHEN len(pb) = 8 THEN 'needs_review' ELSE 'rejected' END AS status FROM a)"""
_K = "repository, issue_number, pr_number"
_Q = lambda tail, *more: with_views(f"WITH {_C} {tail}", "candidates", *more)
_EX = ", ex AS (SELECT * FROM audit_edges WHERE n_source_files = 3), ed AS (SELECT * FROM b WHERE status = 'needs_review' AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.repository = b.repository AND ex.issue_number = b.issue_number) AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.repository = b.repository AND ex.pr_number = b.pr_number))"

_RANKED = _EX + """, ranked AS (SELECT repository, issue_number, pr_number, n_source_files > 1 AS multi_file, concat_ws('/', repository, issue_number, pr_number) AS candidate_id,
  row_number() OVER (ORDER BY score DESC, NOT closing_reference, NOT diagnostic_signal, n_source_files = 1, issue_created_at, repository, issue_number, pr_number) - 1 AS rank FROM ed)"""

ORACLE = {
    "audit_checks": _Q(f"SELECT {_K}, array_to_string(pb, ',') AS passed_blocking, array_to_string(pa, ',') AS passed_advisory FROM b"),
    "audit_status": _Q("SELECT repository, status, count(*) AS n FROM b GROUP BY ALL"),
    "advisory_score": _Q(f"SELECT {_K}, score FROM b"),
    "blocking_failures": _Q(f"SELECT {_K}, array_to_string(list_filter(['bounded_source_files','issue_precedes_fix','merged_pull_request','pre_fix_outside_pull_commits','pre_fix_sha_identified','production_source_files','pull_commit_history','same_repository'], lambda x: NOT list_contains(pb, x)), ',') AS failures FROM b"),
    "reviewable_edges": _Q(f"{_EX} SELECT {_K} FROM ed", "audit_edges"),
    "edge_ranks": _Q(f"{_RANKED} SELECT {_K}, multi_file, candidate_id, rank FROM ranked", "audit_edges"),
    # all repositories can spare two cases, so their capacity is the whole reserve
    "primary_options": _Q(f"""{_RANKED},
      pairs AS (SELECT repository, 0 AS cases, 0 AS multi, 0 AS cost, '' AS ids FROM (SELECT DISTINCT repository FROM ranked)
        UNION ALL SELECT repository, 1, multi_file::INT, rank, candidate_id FROM ranked
        UNION ALL SELECT x.repository, 2, x.multi_file::INT + y.multi_file::INT, x.rank + y.rank, x.candidate_id || ',' || y.candidate_id FROM ranked x JOIN ranked y ON x.repository = y.repository AND x.rank < y.rank AND x.issue_number <> y.issue_number AND x.pr_number <> y.pr_number)
      SELECT repository, cases::BIGINT AS cases, multi::BIGINT AS multi, 30::BIGINT AS capacity, min(cost)::BIGINT AS cost, arg_min(ids, (cost, ids)) AS ids FROM pairs GROUP BY repository, cases, multi""", "audit_edges"),
    "discovery_early_stop": _Q(f"SELECT {_K}, status FROM b QUALIFY coalesce(sum((status = 'needs_review')::INT) OVER (PARTITION BY repository ORDER BY issue_number, pr_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 5"),
    "repeated_pull_requests": _Q(f"SELECT {_K}, row_number() OVER (PARTITION BY repository, pr_number ORDER BY issue_number) = 1 AS unique_pr FROM b"),
    "review_queue_entry": _Q(f"SELECT {_K}, replace(repository, '/', '-') || '-issue-' || issue_number AS suggested_case_id, n_source_files > 1 AS multi_file, score AS advisory_score, array_to_string(pa, ',') AS passed_advisory_checks, array_to_string(list_transform(fa, lambda x: 'failed:' || x), ',') AS review_flags FROM b WHERE status = 'needs_review'"),
    "curate_manifest": with_views(f"SELECT repository || '-' || issue_number || '-' || pr_number AS case_id, {_K} FROM audit_edges WHERE merged UNION ALL SELECT 'new-' || repository || '/' || issue_number || '/' || pr_number, {_K} FROM audit_edges WHERE NOT merged", "audit_edges"),
    "classified_files": with_views("""WITH s AS (SELECT path, ['modified', 'added', 'renamed', 'copied'][weight % 4 + 1] AS status, weight, CASE WHEN starts_with(path, 'tests/') OR starts_with(path, 'docs/') THEN 'test, documentation, example, generated, or vendored path' WHEN path LIKE '%.md' THEN 'unsupported source suffix' END AS r FROM files)
      SELECT path, status, coalesce(r, [NULL, 'file does not exist at the pre-fix commit', 'renamed file requires manual ground-truth review', 'unsupported pull-request file status: copied'][weight % 4 + 1]) AS reason, coalesce(r, [NULL, 'file does not exist at the pre-fix commit', 'renamed file requires manual ground-truth review', 'unsupported pull-request file status: copied'][weight % 4 + 1]) IS NULL AS eligible FROM s""", "files"),
    "linked_pull_requests": with_views("""WITH p AS (SELECT issue_number AS k, pr_number AS n FROM audit_edges),
      f AS (SELECT k, n FROM p WHERE n % 3 = 0 AND n % 2 = 0 AND n % 4 <> 0 UNION SELECT k, n + 1 FROM p WHERE n % 7 = 0 UNION SELECT k, n + 2 FROM p WHERE n % 11 = 0 UNION SELECT k, n + 3 FROM p WHERE n % 5 <> 0)
      SELECT i.k AS issue_key, coalesce(string_agg(CAST(f.n AS VARCHAR), ',' ORDER BY f.n), '') AS pull_requests FROM (SELECT DISTINCT k FROM p) i LEFT JOIN f ON f.k = i.k GROUP BY i.k""", "audit_edges"),
    "pre_fix_source": with_views(f"""SELECT {_K}, CASE WHEN pr_number % 5 = 0 THEN 's' || pr_number % 11 WHEN pr_number % 4 = 0 AND pr_number % 3 <= 1 THEN 's' || (pr_number + pr_number % 3) WHEN pr_number % 4 = 1 AND (pr_number % 3 = 1 OR pr_number % 2 = 1) THEN 's' || pr_number END AS sha,
      CASE WHEN pr_number % 5 = 0 THEN 'first_pull_commit_parent' WHEN pr_number % 4 = 0 AND pr_number % 3 <= 1 THEN 'merge_base_parent' WHEN pr_number % 4 = 1 AND pr_number % 3 = 1 THEN 'single_commit_parent' WHEN pr_number % 4 = 1 AND pr_number % 2 = 1 THEN 'squash_commit_parent' END AS source FROM audit_edges""", "audit_edges"),
    "selection_problems": with_views("""WITH s AS (SELECT *, count(*) OVER (PARTITION BY candidate_id) AS a, count(*) OVER (PARTITION BY case_id) AS b FROM chosen),
      r AS (SELECT s.*, p.* EXCLUDE (candidate_id), p.candidate_id IS NOT NULL AS known, (SELECT count(*) FROM chosen x JOIN pool y USING (candidate_id) WHERE y.repository = p.repository AND y.issue_number = p.issue_number) AS ni FROM s LEFT JOIN pool p USING (candidate_id)),
      m AS (SELECT lower(repository) AS repository, issue_number, pr_number, case_id FROM manifest_cases),
      q AS (SELECT r.*, (repository, issue_number) IN (SELECT (repository, issue_number) FROM m) AS mi, (repository, pr_number) IN (SELECT (repository, pr_number) FROM m) AS mp FROM r)
      SELECT DISTINCT candidate_id, case_id, unnest(list_filter([CASE WHEN a > 1 THEN 'selected twice' END, CASE WHEN b > 1 THEN 'case id repeats' END, CASE WHEN NOT known THEN 'unknown candidate' END, CASE WHEN known AND f = 0 THEN 'failed checks: closes, merged' END,
        CASE WHEN known AND (pre_fix_sha IS NULL OR file IS NULL) THEN 'no ground truth' END, CASE WHEN known AND coalesce(tier, suggested_tier) IS NULL THEN 'no tier' END, CASE WHEN case_id IN (SELECT case_id FROM manifest_cases) THEN 'case exists' END,
        CASE WHEN known AND (mi OR (ni > 1 AND a = 1)) THEN 'issue exists' END, CASE WHEN known AND mp THEN 'pull request exists' END], lambda x: x IS NOT NULL)) AS problem FROM q""", "manifest_cases", "pool", "chosen"),
}
