"""Auditing and selecting evaluation cases: pull-request discovery, changed files, checks, ranks, queues, matching and planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import api_repository, closing_reference, excluded_path_reason, pull_number

# Fixed values of the audit rules.
REQUIRED = ("bounded_source_files", "issue_precedes_fix", "merged_pull_request", "pre_fix_outside_pull_commits", "pre_fix_sha_identified", "production_source_files", "pull_commit_history", "same_repository")
ADVISORY_WEIGHTS = {"issue_has_body": 1, "bug_signal": 2, "diagnostic_signal": 2, "closing_reference": 3}
BUG_TERMS = ("bug", "regression", "crash", "incorrect", "error", "broken")
DIAGNOSTIC_TERMS = ("actual behavior", "expected behavior", "exception", "reproduce", "reproduction", "steps", "traceback")


def linked_pull_requests(events: DataFrame) -> DataFrame:
    """issue_key, pull_requests: distinct numbers of the same repository that timeline events name, sorted.

    events: issue_key, repository, of the issue that an event comes from source_is_pull, source_repository_url and source_number, and the addresses subject_url, subject_html_url and event_url.
    A source counts if it is a pull request of the repository; a number in an address unless that names another repository.
    """
    here = F.lower("repository")
    source = F.when(F.col("source_is_pull") & (F.lower(api_repository(F.col("source_repository_url"))) == here) & (F.col("source_number") > 0), F.col("source_number"))
    named = [F.when(F.coalesce(F.lower(api_repository(F.col(c))), here) == here, pull_number(F.col(c))) for c in ("subject_url", "subject_html_url", "event_url")]
    return events.select("issue_key", F.explode_outer(F.array(source, *named)).alias("n")).groupBy("issue_key").agg(F.array_sort(F.collect_set("n")).alias("pull_requests"))


def classify_files(files: DataFrame) -> DataFrame:
    """files (path, status) with eligible and reason: the path's, else the status's."""
    status = (
        F.when(F.col("status") == "added", "file does not exist at the pre-fix commit")
        .when(F.col("status") == "renamed", "renamed file requires manual ground-truth review")
        .when(~F.coalesce(F.col("status").isin("modified", "removed"), F.lit(False)), F.concat(F.lit("unsupported pull-request file status: "), F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("missing"))))
    )
    return files.withColumn("reason", F.coalesce(excluded_path_reason(F.col("path")), status)).withColumn("eligible", F.col("reason").isNull())


def pre_fix(first_parent: Column, merge_parents: Column, base_sha: Column, merge_sha: Column, head_sha: Column, commits: Column) -> Column:
    """struct(sha, source): from the parent of the first commit, the base among merge parents, or a single or squashed commit's parent."""
    row = lambda sha, source: F.struct(sha.alias("sha"), F.lit(source).alias("source"))
    only = F.get(merge_parents, F.lit(0))
    n = F.coalesce(F.size(merge_parents), F.lit(0))
    return (
        F.when(first_parent != "", row(first_parent, "first_pull_commit_parent"))
        .when((n >= 2) & F.array_contains(merge_parents, base_sha), row(base_sha, "merge_base_parent"))
        .when((n == 1) & (only != "") & (commits == 1), row(only, "single_commit_parent"))
        .when((n == 1) & (only != "") & (merge_sha != head_sha), row(only, "squash_commit_parent"))
    )


def audit(candidates: DataFrame, max_source_files: int = 5) -> DataFrame:
    """candidates with passed (a struct of twelve booleans), checks (the same as an array of struct) and status.

    Columns used: repository, base_repository, issue_number, issue_title, issue_body, labels, issue_created_at, merged_at, pre_fix_sha, commit_shas, n_source_files, pr_text.
    """
    text = F.lower(F.concat_ws("\n", "issue_title", "issue_body"))
    any_of = lambda t, terms: t.rlike("|".join(terms))
    results = {
        "same_repository": F.lower("base_repository") == F.lower("repository"),
        "merged_pull_request": F.col("merged_at").isNotNull(),
        "issue_precedes_fix": F.col("issue_created_at") <= F.col("merged_at"),
        "pre_fix_sha_identified": F.col("pre_fix_sha").isNotNull(),
        "pull_commit_history": F.size("commit_shas") > 0,
        "pre_fix_outside_pull_commits": ~F.array_contains("commit_shas", F.col("pre_fix_sha")),
        "production_source_files": F.col("n_source_files") > 0,
        "bounded_source_files": F.col("n_source_files").between(1, max_source_files),
        "issue_has_body": F.length(F.btrim(F.col("issue_body"))) >= 40,
        "bug_signal": any_of(text, BUG_TERMS) | any_of(F.lower(F.array_join("labels", "\n")), BUG_TERMS),
        "diagnostic_signal": any_of(text, DIAGNOSTIC_TERMS) | ((F.length("issue_body") >= 200) & F.col("issue_body").contains("```")),
        "closing_reference": closing_reference(F.col("pr_text"), F.col("issue_number")),
    }
    sure = {code: F.coalesce(r, F.lit(False)) for code, r in results.items()}
    rejected = F.lit(False)
    for code in REQUIRED:
        rejected = rejected | ~F.col(f"passed.{code}")
    checks = F.array(*[F.struct(F.lit(code).alias("code"), F.col(f"passed.{code}").alias("passed"), F.lit(code in REQUIRED).alias("blocking")) for code in sure])
    rows = candidates.withColumn("passed", F.struct(*[r.alias(code) for code, r in sure.items()]))
    return rows.withColumns({"checks": checks, "status": F.when(rejected, "rejected").otherwise("needs_review")})


def codes(passed: bool, blocking: bool, checks: str = "checks") -> Column:
    return F.array_sort(F.transform(F.filter(checks, lambda c: (c.passed == F.lit(passed)) & (c.blocking == F.lit(blocking))), lambda c: c.code))


def advisory_score(checks: str = "checks") -> Column:
    weights = F.create_map(*[F.lit(x) for kv in ADVISORY_WEIGHTS.items() for x in kv])
    return F.aggregate(codes(True, False, checks), F.lit(0), lambda a, c: a + F.coalesce(weights[c], F.lit(0)))


def blocking_failures(checks: str = "checks") -> Column:
    """Required codes that don't appear just once, blocking and passed, and other blocking ones that failed; sorted."""
    bad = F.filter(F.array(*map(F.lit, REQUIRED)), lambda code: (F.size(F.filter(checks, lambda c: c.code == code)) != 1) | ~F.exists(checks, lambda c: (c.code == code) & c.blocking & c.passed))
    return F.array_sort(F.array_union(bad, codes(False, True, checks)))


def passed_score() -> Column:
    """advisory_score() from the booleans of passed: plain arithmetic."""
    score = F.lit(0)
    for code, weight in ADVISORY_WEIGHTS.items():
        score = score + F.when(F.col(f"passed.{code}"), weight).otherwise(0)
    return score


def review_order() -> list[Column]:
    """Candidates of audit() from the best; ends in unique keys."""
    return [F.desc(passed_score()), ~F.col("passed.closing_reference"), ~F.col("passed.diagnostic_signal"), F.col("n_source_files") == 1, F.col("issue_created_at"), F.lower("repository"), F.col("issue_number"), F.col("pr_number")]


def reviewable_edges(audited: DataFrame, existing: DataFrame) -> DataFrame:
    """Reviewable candidates of audit() whose issue and pull request aren't in existing (repository, issue_number, pr_number), the best of each edge, with advisory_score.

    What the rows are chosen by are plain booleans; checks, which only the result needs, are not carried through the joins but made again from them.
    """
    # audit() gives each required code once, so no blocking failure is the same as its status
    good = audited.where("status = 'needs_review' AND pre_fix_sha IS NOT NULL AND n_source_files > 0").drop("checks", "status")
    good = good.withColumns({"_repo": F.lower("repository"), "advisory_score": passed_score().cast("long")})
    known = existing.select(F.lower("repository").alias("_repo"), "issue_number", "pr_number")
    fresh = good.join(known.select("_repo", "issue_number").distinct(), ["_repo", "issue_number"], "left_anti").join(known.select("_repo", "pr_number").distinct(), ["_repo", "pr_number"], "left_anti")
    best = F.row_number().over(Window.partitionBy("_repo", "issue_number", "pr_number").orderBy(*review_order()))
    return fresh.withColumn("_n", best).where("_n = 1").drop("_n", "_repo")


def early_stop(audited: DataFrame, target: int, order: list[str]) -> DataFrame:
    """Candidates inspected before a repository has target reviewable ones, and the one that completes them; order is the order of inspection."""
    seen = F.coalesce(F.sum(F.when(F.col("status") == "needs_review", 1).otherwise(0)).over(Window.partitionBy("repository").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return audited.withColumn("_seen", seen).where(F.col("_seen") < target).drop("_seen")


def repeated_pull_requests(audited: DataFrame, order: list[str]) -> DataFrame:
    """audited with unique_pr: whether no earlier candidate has the same pull request."""
    return audited.withColumn("unique_pr", F.row_number().over(Window.partitionBy(F.lower("repository"), "pr_number").orderBy(*order)) == 1)


def queue_entries(audited: DataFrame) -> DataFrame:
    """The projection a reviewer sees."""
    slug = F.btrim(F.regexp_replace(F.lower("repository"), "[^a-z0-9]+", "-"), F.lit("-"))
    return audited.select(
        "repository",
        "issue_number",
        "pr_number",
        F.concat(slug, F.lit("-issue-"), F.col("issue_number").cast("string")).alias("suggested_case_id"),
        (F.col("n_source_files") > 1).alias("multi_file"),
        advisory_score().alias("advisory_score"),
        F.array_join(codes(True, False), ",").alias("passed_advisory_checks"),
        F.array_join(F.transform(codes(False, False), lambda c: F.concat(F.lit("failed:"), c)), ",").alias("review_flags"),
    )


def curate(manifest: DataFrame, selections: DataFrame, candidates: DataFrame) -> DataFrame:
    """The manifest with the selected candidates added; fails if a selection is unknown, repeated or already there.

    manifest: (case_id, repository, issue_number, pr_number); selections: (candidate_id, case_id); candidates: (candidate_id, repository, issue_number, pr_number).
    """
    unknown = selections.join(candidates, "candidate_id", "left_anti")
    twice = selections.groupBy("candidate_id").count().where("count > 1")
    added = selections.join(candidates, "candidate_id").select("case_id", "repository", "issue_number", "pr_number")
    clash = added.join(manifest, ["repository", "issue_number"], "left_semi").unionByName(added.join(manifest, "case_id", "left_semi"))
    problems = unknown.select(F.lit("unknown candidate").alias("p")).unionByName(twice.select(F.lit("repeated selection").alias("p"))).unionByName(clash.select(F.lit("case exists").alias("p")))
    if found := problems.first():
        raise ValueError(found["p"])
    return manifest.unionByName(added)


def selection_problems(cases: DataFrame, selections: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidate_id, case_id, problem: everything that keeps selections from becoming cases, all rows at once.

    cases: (case_id, repository, issue_number, pr_number); selections: (candidate_id, case_id, tier); candidates: (candidate_id, repository, issue_number, pr_number, pre_fix_sha, expected_files,
    suggested_tier, failed_checks). Repositories are compared in lower case; an issue or pull request may be in the manifest once, and among the selected once.
    """
    low = F.lower("repository").alias("repository")
    times = lambda rows, *keys: F.count("*").over(Window.partitionBy(*keys))
    asked = selections.withColumns({"_chosen": times(selections, "candidate_id"), "_named": times(selections, "case_id")})
    known = candidates.select("candidate_id", low, "issue_number", "pr_number", "pre_fix_sha", "expected_files", "suggested_tier", "failed_checks")
    known = known.withColumn("_same", times(known, "candidate_id")).dropDuplicates(["candidate_id"])
    rows = asked.join(known.withColumn("_known", F.lit(True)), "candidate_id", "left")
    there = lambda name, *keys: cases.select("case_id", low, "issue_number", "pr_number").select(*keys).distinct().withColumn(name, F.lit(True))
    rows = rows.join(there("_case", "case_id"), "case_id", "left").join(there("_issue", "repository", "issue_number"), ["repository", "issue_number"], "left").join(there("_pull", "repository", "pr_number"), ["repository", "pr_number"], "left")
    # unknown candidates have no repository and are each alone
    rows = rows.withColumn("_place", F.coalesce("repository", "candidate_id"))
    rows = rows.withColumns({"_issues": times(rows, "_place", "issue_number"), "_pulls": times(rows, "_place", "pr_number")})
    known_ = F.coalesce("_known", F.lit(False))
    rules = F.array_compact(F.array(
        F.when(F.col("_chosen") > 1, "selected twice"),
        F.when(F.col("_named") > 1, "case id repeats"),
        F.when(~known_, "unknown candidate"),
        F.when(F.col("_same") > 1, "candidate id repeats"),
        F.when(F.size("failed_checks") > 0, F.concat(F.lit("failed checks: "), F.array_join("failed_checks", ", "))),
        F.when(known_ & (F.col("pre_fix_sha").isNull() | (F.coalesce(F.size("expected_files"), F.lit(0)) < 1)), "no ground truth"),
        F.when(known_ & F.coalesce("tier", "suggested_tier").isNull(), "no tier"),
        F.when(F.col("_case"), "case exists"),
        F.when(F.col("_issue") | (known_ & (F.col("_issues") > 1) & (F.col("_chosen") == 1)), "issue exists"),
        F.when(F.col("_pull") | (known_ & (F.col("_pulls") > 1) & (F.col("_chosen") == 1)), "pull request exists"),
    ))
    return rows.select("candidate_id", "case_id", F.explode(rules).alias("problem")).distinct()


def expanded(manifest: DataFrame, selections: DataFrame, candidates: DataFrame, name: str | None = None) -> DataFrame:
    """The next version of a manifest (manifest, version, case_id, tier, repository, issue_number, pr_number, pre_fix_sha, expected_files), with the selected candidates as cases; fails with the first of selection_problems(), by candidate."""
    if found := selection_problems(manifest, selections, candidates).orderBy("candidate_id", "problem").first():
        raise ValueError(f"{found.candidate_id}: {found.problem}")
    added = selections.join(candidates, "candidate_id").select("case_id", F.coalesce("tier", "suggested_tier").alias("tier"), "repository", "issue_number", "pr_number", "pre_fix_sha", "expected_files")
    every = manifest.select(*added.columns).unionByName(added)
    head = manifest.agg(F.max("manifest").alias("manifest"), (F.max("version") + 1).alias("version"))  # one row
    return every.join(F.broadcast(head), F.lit(True)).select(F.lit(name).alias("manifest") if name else "manifest", "version", *added.columns)


def kuhn(edges: list[tuple], order: list) -> dict:
    """Maximum matching right -> left of edges (left, right) tried in order; lefts are tried in order."""
    options: dict = {}
    for left, right in edges:
        options.setdefault(left, []).append(right)
    matched: dict = {}
    for start in order:
        # an explicit stack: paths may be long
        seen, stack = set(), [(start, iter(options.get(start, ())))]
        path: list = []
        while stack:
            left, rest = stack[-1]
            right = next((r for r in rest if r not in seen), None)
            if right is None:
                stack.pop()
                if path:
                    path.pop()
                continue
            seen.add(right)
            path.append((left, right))
            if right not in matched:
                for a, b in path:
                    matched[b] = a
                break
            stack.append((matched[right], iter(options.get(matched[right], ()))))
    return matched


def maximum_matching(edges: DataFrame) -> DataFrame:
    """repository, issue_number, pr_number of a maximum matching for each repository: edges (…, place), best place first. Components never cross repositories."""
    import pandas as pd

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["place", "issue_number", "pr_number"])
        pairs = list(zip(group.issue_number, group.pr_number))
        matched = kuhn(pairs, list(dict.fromkeys(group.issue_number)))
        return pd.DataFrame({"repository": group.repository.iloc[0], "issue_number": list(matched.values()), "pr_number": list(matched.keys())})

    return edges.select("repository", "issue_number", "pr_number", "place").groupBy("repository").applyInPandas(one, "repository string, issue_number long, pr_number long")
