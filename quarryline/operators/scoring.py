"""Issue scoring and ranking: rule-based factors, weights, priority overrides and reasons.

Issues are rows (number, title, body, labels array<string>, comments_count, updated_at, ord). Terms are tested as
substrings of the lower-cased title, body and labels, so 'rce' fires inside 'source' as intended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Vocabularies and weights of the scoring rules.
CRITICAL = ("account takeover", "corruption", "credential leak", "data loss", "rce", "remote code execution")
HIGH = ("crash", "deadlock", "production down", "regression", "security", "service unavailable", "vulnerability")
RELEASE = ("blocks release", "milestone blocker", "release blocker")
EXPLOIT = ("actively exploited", "in the wild", "poc available", "proof of concept")
REPRODUCTION = ("minimal reproduction", "reproducible", "stack trace", "steps to reproduce")
WORKAROUND = ("temporary fix", "workaround")
AFFECTED = ("all users", "many users", "multiple customers", "production")
BUG_LABELS = ("bug", "type: bug")
WEIGHTS = {"severity": 0.30, "urgency": 0.20, "affected_users": 0.15, "reproducibility": 0.10, "duplicate_count": 0.10, "release_blocking": 0.10, "recency": 0.05}


def issue_text() -> Column:
    """Title, body and labels in one, lower-cased."""
    return F.lower(F.concat_ws(" ", F.col("title"), F.coalesce("body", F.lit("")), F.array_join("labels", " ")))


def hits(text: Column, terms: tuple[str, ...]) -> Column:
    """The terms that text contains, in order."""
    return F.filter(F.array(*map(F.lit, sorted(terms))), lambda t: F.contains(text, t))


def has(text: Column, terms: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | text.contains(t)
    return out


def severity(text: Column) -> Column:
    """struct(name, value, reason)."""
    row = lambda n, v, r: F.struct(F.lit(n).alias("name"), F.lit(v).alias("value"), r.alias("reason"))
    first = lambda terms: F.get(hits(text, terms), F.lit(0))
    labelled = F.exists("labels", lambda x: F.lower(x).isin(*BUG_LABELS))
    return (
        F.when(has(text, CRITICAL), row("CRITICAL", 1.0, F.concat(F.lit("Critical impact signal: "), first(CRITICAL))))
        .when(has(text, HIGH), row("HIGH", 0.78, F.concat(F.lit("High impact signal: "), first(HIGH))))
        .when(labelled, row("MEDIUM", 0.52, F.lit("Issue is labeled as a bug")))
        .otherwise(row("LOW", 0.25, F.lit("No high-impact failure signal was detected")))
    )


def urgency(text: Column) -> Column:
    """struct(name, value, reason)."""
    row = lambda n, v, r: F.struct(F.lit(n).alias("name"), F.lit(v).alias("value"), F.lit(r).alias("reason"))
    return (
        F.when(has(text, EXPLOIT + RELEASE), row("HIGH", 1.0, "Exploit or release-blocking urgency signal detected"))
        .when(has(text, ("latest release", "production")) | (F.col("comments_count") >= 10), row("HIGH", 0.8, "Current production or high-engagement signal detected"))
        .when(has(text, WORKAROUND), row("LOW", 0.25, "A workaround appears to be available"))
        .otherwise(row("MEDIUM", 0.5, "No explicit deadline or workaround was detected"))
    )


def score_issues(issues: DataFrame, now: str, duplicates: str | None = None) -> DataFrame:
    """issues with severity, urgency, priority, priority_score, priority_reasons, factors and needs_information.

    now is the instant ages count from ('2001-09-01'); duplicates names a column with the number of similar issues (0 without).
    """
    n = F.coalesce(F.col(duplicates), F.lit(0)) if duplicates else F.lit(0)
    text = F.col("_text")
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / F.lit(86_400_000_000.0))
    rows = issues.withColumn("_text", issue_text()).withColumns({"_severity": severity(text), "_urgency": urgency(text), "_n": n})
    rows = rows.withColumns({
        "_affected": F.when(has(text, AFFECTED), 0.8).otherwise(F.least(F.lit(0.7), F.col("comments_count") / 20)),
        "_repro": F.when(has(text, REPRODUCTION), 0.8).otherwise(0.2),
        "_dup": F.least(F.lit(1.0), F.log2(F.col("_n") + F.lit(1.0)) / 4),
        "_release": F.when(has(text, RELEASE), 1.0).otherwise(0.0),
        "_recency": F.exp(-age / 30),
    })
    parts = [F.col("_severity.value"), F.col("_urgency.value"), F.col("_affected"), F.col("_repro"), F.col("_dup"), F.col("_release"), F.col("_recency")]
    total = F.lit(0.0)
    for w, p in zip(WEIGHTS.values(), parts):
        total = total + w * p
    urgent = has(text, EXPLOIT) | (has(text, ("data loss", "corruption")) & (F.col("_repro") >= 0.8))
    rows = rows.withColumns({"_score": 100 * total, "_p0": urgent, "needs_information": (F.size(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"(?U)\w+"), F.lit(0))) < 15) & (F.col("_repro") < 0.8)})
    reasons = [
        F.col("_severity.reason"),
        F.col("_urgency.reason"),
        F.when(F.col("_n") > 0, F.format_string("Linked to %d similar issue(s)", F.col("_n").cast("long"))),
        F.when(F.col("_release") > 0, "The issue is a release blocker"),
        F.when(F.col("_repro") >= 0.8, "Reproduction evidence is present"),
        F.when(F.col("needs_information"), "Issue body lacks enough diagnostic detail"),
    ]
    return rows.select(
        *issues.columns,
        F.col("_severity.name").alias("severity"),
        F.col("_urgency.name").alias("urgency"),
        F.when(F.col("_p0"), "P0").when((F.col("_release") > 0) | (F.col("_score") >= 70), "P1").when(F.col("_score") >= 45, "P2").otherwise("P3").alias("priority"),
        F.round(F.when(F.col("_p0"), F.greatest("_score", F.lit(90.0))).otherwise(F.col("_score")), 2).alias("priority_score"),
        F.array_compact(F.array(*reasons)).alias("priority_reasons"),
        F.struct(*[p.alias(n) for n, p in zip(WEIGHTS, parts)]).alias("factors"),
        "needs_information",
    )


def duplicate_degree(pairs: DataFrame) -> DataFrame:
    """number, degree: how many pairs each issue is in."""
    return pairs.select(F.explode(F.array("issue_number", "candidate_issue_number")).alias("number")).groupBy("number").agg(F.count("*").alias("degree"))


def rank_issues(issues: DataFrame, now: str, pairs: DataFrame | None = None, degrees: DataFrame | None = None) -> DataFrame:
    """Scored issues by score descending, ties in input order (ord); similar issues are counted from pairs, or given as degrees (number, degree)."""
    if pairs is not None:
        degrees = duplicate_degree(pairs)
    if degrees is not None:
        issues = issues.join(degrees, "number", "left")
    scored = score_issues(issues, now, "degree" if degrees is not None else None)
    return scored.orderBy(F.desc("priority_score"), "ord")


def top_k(ranked: DataFrame, k: int) -> DataFrame:
    """The first k of a ranking with their places; no full sort."""
    from pyspark.sql import Window

    first = ranked.orderBy(F.desc("priority_score"), "ord").limit(k)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("priority_score"), "ord")).cast("long"))
