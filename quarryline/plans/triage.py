"""Queries: scoring, ranking, duplicates."""

from __future__ import annotations

import difflib

from pyspark.sql import functions as F

from quarryline.operators import scoring, similarity
from quarryline.operators.tables import stored
from quarryline.plans.adapters import adapter, with_views

NOW = "2001-09-01"


def issues(spark, sf_dir):
    rows = adapter(spark, sf_dir, "issues")
    return rows.withColumn("labels", F.array("label")).withColumn("ord", F.col("number"))


def scored(spark, sf_dir):
    return scoring.score_issues(issues(spark, sf_dir), NOW)


def priority_score(spark, sf_dir):
    return scored(spark, sf_dir).select("number", "severity", "urgency", "priority", "priority_score")


def priority_factors(spark, sf_dir):
    f = lambda n: F.round(F.col(f"factors.{n}"), 9).alias(n)
    return scored(spark, sf_dir).select("number", *map(f, scoring.WEIGHTS))


def priority_reasons(spark, sf_dir):
    return scored(spark, sf_dir).select("number", F.array_join("priority_reasons", "|").alias("reasons"))


def needs_information(spark, sf_dir):
    return scored(spark, sf_dir).select("number", "needs_information")


def ranked(spark, sf_dir):
    """All issues in order, scored with their similar-issue counts."""
    rows = issues(spark, sf_dir)
    return scoring.rank_issues(rows, NOW, degrees=similarity.duplicate_degrees(rows))


def priority_rank(spark, sf_dir):
    """All issues in order with their similar-issue counts from kinds of equal tokens and titles (a kind of n gives each n - 1, and similar kinds all their members)."""
    return ranked(spark, sf_dir).select("number", "priority", "priority_score")


def similar_issue_counts(spark, sf_dir):
    """How many issues are similar to each, at the blended score of 0.55."""
    return similarity.duplicate_degrees(issues(spark, sf_dir))


def top_k_issues(spark, sf_dir):
    return scoring.top_k(ranked(spark, sf_dir), 20).select("place", "number", "priority_score")


def doc_rows(spark, sf_dir):
    docs = adapter(spark, sf_dir, "docs")
    return docs.select(F.col("number").alias("ord"), similarity.tokens(F.concat_ws(" ", F.coalesce("body", F.lit("")), "label")).alias("tokens"))


def duplicate_jaccard(spark, sf_dir):
    found = similarity.duplicate_classes(doc_rows(spark, sf_dir), 0.8)
    return found.withColumn("jaccard", F.round("jaccard", 6))


def duplicate_degree(spark, sf_dir):
    """For each document its token class and how many documents have at least a Jaccard of 0.8 with it."""
    rows = doc_rows(spark, sf_dir)
    classes = similarity.token_classes(rows)
    pairs = similarity.duplicate_classes(rows, 0.8, classes)
    ends = pairs.selectExpr("stack(2, left_number, right_members, right_number, left_members) AS (rep, n)").groupBy("rep").agg(F.sum("n").alias("n"))
    keyed = rows.select("ord", F.xxhash64("tokens").alias("set_id")).join(classes.select("set_id", "rep", "members"), "set_id", "left").join(ends, "rep", "left")
    return keyed.select(F.col("ord").alias("number"), F.col("rep").alias("class_id"), (F.coalesce(F.col("members") - 1, F.lit(0)) + F.coalesce("n", F.lit(0))).alias("degree"))


def duplicate_shared_terms(spark, sf_dir):
    rows = doc_rows(spark, sf_dir)
    pairs = stored(similarity.duplicate_classes(rows, 0.8).select("left_number", "right_number"), "pairs")
    rows = similarity.among(rows, stored(pairs.select(F.explode(F.array("left_number", "right_number")).alias("ord")).distinct(), "ends"))
    side = lambda p: rows.select(F.col("ord").alias(f"{p}_number"), F.col("tokens").alias(p))
    both = pairs.join(side("left"), "left_number").join(side("right"), "right_number")
    return both.select("left_number", "right_number", F.array_join(similarity.shared_terms(F.col("left"), F.col("right")), "|").alias("shared_terms"))


def duplicate_pairs(spark, sf_dir):
    """The blended score at 0.55 over all pages: titles are the pages' titles, the text is the title and all words of the page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    rows = pages.select(F.col("page_id").alias("number"), title.alias("title"), F.concat_ws(" ", title, F.regexp_replace("html", "<[^>]*>", " ")).alias("_t"), F.col("page_id").alias("ord"))
    return similarity.duplicate_kinds(rows, text=F.col("_t")).withColumn("shared_terms", F.array_join("shared_terms", "|"))


QUERIES = {f.__name__: f for f in (priority_score, priority_factors, priority_reasons, needs_information, priority_rank, similar_issue_counts, top_k_issues, duplicate_jaccard, duplicate_degree, duplicate_shared_terms, duplicate_pairs)}

_CRIT = "['account takeover','corruption','credential leak','data loss','rce','remote code execution']"
_HIGH = "['crash','deadlock','production down','regression','security','service unavailable','vulnerability']"
_ANY = lambda terms: f"len(list_filter({terms}, lambda w: contains(t, w))) > 0"
_SCORED = f"""
t0 AS (SELECT *, lower(title || ' ' || body || ' ' || label) AS t FROM issues),
t1 AS (SELECT *, list_filter({_CRIT}, lambda w: contains(t, w)) AS crit, list_filter({_HIGH}, lambda w: contains(t, w)) AS high,
  {_ANY("['blocks release','milestone blocker','release blocker']")} AS rel, {_ANY("['actively exploited','in the wild','poc available','proof of concept']")} AS expl,
  {_ANY("['minimal reproduction','reproducible','stack trace','steps to reproduce']")} AS rep, {_ANY("['temporary fix','workaround']")} AS wa, {_ANY("['all users','many users','multiple customers','production']")} AS aff FROM t0),
t2 AS (SELECT *, CASE WHEN len(crit) > 0 THEN 'CRITICAL' WHEN len(high) > 0 THEN 'HIGH' WHEN lower(label) IN ('bug', 'type: bug') THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN expl OR rel THEN 1.0::DOUBLE WHEN contains(t, 'latest release') OR contains(t, 'production') OR comments_count >= 10 THEN 0.8 WHEN wa THEN 0.25 ELSE 0.5 END AS u FROM t1),
t3 AS (SELECT *, CASE severity WHEN 'CRITICAL' THEN 1.0::DOUBLE WHEN 'HIGH' THEN 0.78 WHEN 'MEDIUM' THEN 0.52 ELSE 0.25 END AS s,
  CASE WHEN u >= 0.8 THEN 'HIGH' WHEN u = 0.25 THEN 'LOW' ELSE 'MEDIUM' END AS urgency, CASE WHEN aff THEN 0.8::DOUBLE ELSE least(0.7::DOUBLE, comments_count / 20.0::DOUBLE) END AS a,
  CASE WHEN rep THEN 0.8::DOUBLE ELSE 0.2 END AS r, CASE WHEN rel THEN 1.0::DOUBLE ELSE 0.0 END AS b,
  exp(-greatest(0.0::DOUBLE, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(updated_at)) / 86400000000.0::DOUBLE) / 30) AS c FROM t2),
t4 AS (SELECT *, 100 * (0.30::DOUBLE * s + 0.20::DOUBLE * u + 0.15::DOUBLE * a + 0.10::DOUBLE * r + 0.05::DOUBLE * c + 0.10::DOUBLE * b) AS x, expl OR ((contains(t, 'data loss') OR contains(t, 'corruption')) AND rep) AS p0,
  len(regexp_extract_all(body, '[0-9A-Za-z_]+')) < 15 AND NOT rep AS ni FROM t3),
scored AS (SELECT *, CASE WHEN p0 THEN 'P0' WHEN rel OR x >= 70 THEN 'P1' WHEN x >= 45 THEN 'P2' ELSE 'P3' END AS priority, round(CASE WHEN p0 THEN greatest(x, 90) ELSE x END, 2) AS priority_score FROM t4)"""
_TITLES = ("Data loss in production", "Crash regression", "Wrong source total", "Release blocker in packaging", "Improve documentation")


def _ratios() -> str:
    """The title ratio of the issues view's five titles, both ways: SQL has no function for it."""
    both = [(x.lower(), y.lower()) for x in _TITLES for y in _TITLES]
    return ", ".join(f"('{x}', '{y}', {difflib.SequenceMatcher(None, x, y).ratio()!r}::DOUBLE)" for x, y in both)


#: Scores with similar issues counted. A kind is a text; for each issue and kind, the issues of the kind before and after it count where the pair in that order is similar.
_COUNTED = f"""
ratios(x, y, ratio) AS (VALUES {_ratios()}),
kinds AS (SELECT t, lower(title) AS title, count(*) AS n, list_filter(list_distinct(regexp_extract_all(t, '[a-zA-Z0-9_./-]{{3,}}')), lambda w: w NOT IN {similarity.STOPWORDS}) AS w FROM t0 GROUP BY t, lower(title)),
common AS (SELECT a.t AS ta, b.t AS tb, len(list_intersect(a.w, b.w)) AS c, len(a.w) + len(b.w) AS total, r.ratio FROM kinds a, kinds b, ratios r WHERE r.x = a.title AND r.y = b.title),
likes AS (SELECT ta, tb, round(0.65::DOUBLE * (c::DOUBLE / (total - c)) + 0.35::DOUBLE * ratio, 4) >= 0.55 AS similar FROM common),
placed AS (SELECT i.number, i.t AS own, k.t AS other, k.n, sum(CASE WHEN i.t = k.t THEN 1 ELSE 0 END) OVER (PARTITION BY k.t ORDER BY i.number) AS upto FROM t0 i, kinds k),
degrees AS (SELECT number, CAST(sum(CASE WHEN l.similar THEN n - upto ELSE 0 END + CASE WHEN m.similar THEN upto - CASE WHEN own = other THEN 1 ELSE 0 END ELSE 0 END) AS BIGINT) AS degree
  FROM placed JOIN likes l ON l.ta = own AND l.tb = other JOIN likes m ON m.ta = other AND m.tb = own GROUP BY number),
t5 AS (SELECT t4.* EXCLUDE (x), degree, 100 * (0.30::DOUBLE * s + 0.20::DOUBLE * u + 0.15::DOUBLE * a + 0.10::DOUBLE * r + 0.10::DOUBLE * least(1.0::DOUBLE, log2(degree + 1.0::DOUBLE) / 4) + 0.10::DOUBLE * b + 0.05::DOUBLE * c) AS x FROM t4 JOIN degrees USING (number)),
counted AS (SELECT *, CASE WHEN p0 THEN 'P0' WHEN rel OR x >= 70 THEN 'P1' WHEN x >= 45 THEN 'P2' ELSE 'P3' END AS ranked_priority, round(CASE WHEN p0 THEN greatest(x, 90) ELSE x END, 2) AS ranked_score FROM t5)"""
_R = lambda tail: with_views("WITH " + _SCORED.strip() + "," + _COUNTED + " " + tail, "issues")
_S = lambda tail: with_views("WITH " + _SCORED.strip() + " " + tail, "issues")
_TOK = """tok AS (SELECT number, list_sort(list_filter(list_distinct(regexp_extract_all(lower(concat_ws(' ', coalesce(body, ''), label)), '[a-zA-Z0-9_./-]{3,}')), lambda w: w NOT IN ('the','a','an','and','or','to','of','in','on','is','it','for','with','when'))) AS w FROM docs),
cls AS (SELECT w, min(number) AS rep, count(*) AS n FROM tok WHERE len(w) > 0 GROUP BY w),
wrd AS (SELECT rep, unnest(w) AS k FROM cls),
inter AS (SELECT a.rep AS l, b.rep AS r, count(*) AS c FROM wrd a JOIN wrd b ON a.k = b.k AND a.rep < b.rep GROUP BY a.rep, b.rep),
prs AS (SELECT l, r, x.n AS ln, y.n AS rn, x.w AS lw, y.w AS rw, c / (len(x.w) + len(y.w) - c) AS j FROM inter JOIN cls x ON x.rep = l JOIN cls y ON y.rep = r WHERE c / (len(x.w) + len(y.w) - c) >= 0.8 - 1e-12)"""
_T = lambda tail: with_views("WITH " + _TOK + " " + tail, "docs")

ORACLE = {
    "priority_score": _S("SELECT number, severity, urgency, priority, priority_score FROM scored"),
    "priority_rank": _R("SELECT number, ranked_priority AS priority, ranked_score AS priority_score FROM counted"),
    "priority_factors": _S("SELECT number, s AS severity, u AS urgency, a AS affected_users, r AS reproducibility, 0.0::DOUBLE AS duplicate_count, b AS release_blocking, round(c, 9) AS recency FROM scored"),
    "priority_reasons": _S("""SELECT number, concat_ws('|', CASE severity WHEN 'CRITICAL' THEN 'Critical impact signal: ' || crit[1] WHEN 'HIGH' THEN 'High impact signal: ' || high[1] WHEN 'MEDIUM' THEN 'Issue is labeled as a bug' ELSE 'No high-impact failure signal was detected' END,
      CASE WHEN u = 1.0 THEN 'Exploit or release-blocking urgency signal detected' WHEN u = 0.8 THEN 'Current production or high-engagement signal detected' WHEN u = 0.25 THEN 'A workaround appears to be available' ELSE 'No explicit deadline or workaround was detected' END,
      CASE WHEN rel THEN 'The issue is a release blocker' END, CASE WHEN rep THEN 'Reproduction evidence is present' END, CASE WHEN ni THEN 'Issue body lacks enough diagnostic detail' END) AS reasons FROM scored"""),
    "needs_information": _S("SELECT number, ni AS needs_information FROM scored"),
    "top_k_issues": _R("SELECT row_number() OVER (ORDER BY ranked_score DESC, number) AS place, number, ranked_score AS priority_score FROM counted ORDER BY ranked_score DESC, number LIMIT 20"),
    "similar_issue_counts": _R("SELECT number, degree FROM degrees"),
    "duplicate_jaccard": _T("SELECT l AS left_number, r AS right_number, ln AS left_members, rn AS right_members, round(j, 6) AS jaccard FROM prs"),
    "duplicate_degree": _T("""SELECT tok.number, cls.rep AS class_id, CAST(coalesce(cls.n - 1, 0) + coalesce((SELECT sum(q.n) FROM (SELECT l AS rep, rn AS n FROM prs UNION ALL SELECT r, ln FROM prs) q WHERE q.rep = cls.rep), 0) AS BIGINT) AS degree
      FROM tok LEFT JOIN cls ON cls.w = tok.w"""),
    "duplicate_shared_terms": _T("""SELECT l AS left_number, r AS right_number, (SELECT string_agg(k, '|' ORDER BY length(k) DESC, k) FROM (SELECT k FROM unnest(list_intersect(lw, rw)) AS t(k) ORDER BY length(k) DESC, k LIMIT 8)) AS shared_terms FROM prs"""),
}
