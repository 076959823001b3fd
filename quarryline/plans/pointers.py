"""Queries: choice and explanation of symbols, derived call views, outcomes of cases, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import signals as G
from quarryline.operators import codeindex as C
from quarryline.operators import evaluation, locate
from quarryline.operators import symbols as S
from quarryline.operators.tables import stored
from quarryline.plans import code
from quarryline.plans.adapters import VIEWS, adapter, with_views

VIEWS["title_matches"] = "SELECT DISTINCT l_orderkey AS issue_id, l_partkey AS symbol_id, l_linenumber % 3 AS title_strength FROM lineitem"
VIEWS["external_calls"] = "SELECT l_partkey AS file_id, CASE WHEN l_linenumber % 4 <> 0 THEN concat('fn_', CAST(l_linenumber % 4 AS VARCHAR(9))) END AS caller, concat('t', CAST(l_suppkey % 7 AS VARCHAR(9))) AS target FROM lineitem"
VIEWS["shared_relations"] = "SELECT DISTINCT l_orderkey AS issue_id, l_partkey AS file_id, concat('t', CAST(l_suppkey % 7 AS VARCHAR(9))) AS target FROM lineitem WHERE l_linenumber = 1"
VIEWS["call_uses"] = """
SELECT concat('f', CAST(l_partkey AS VARCHAR(20))) AS path, CASE WHEN l_linenumber % 5 = 0 THEN 'reference' ELSE 'call' END AS kind,
       CASE WHEN l_linenumber % 3 <> 0 THEN l_returnflag END AS caller, concat('c', CAST(l_suppkey % 9 AS VARCHAR(9))) AS local_name, concat('s', CAST(l_suppkey % 4 AS VARCHAR(9))) AS target_symbol FROM lineitem"""
VIEWS["chosen_symbols"] = """
SELECT DISTINCT l_orderkey AS issue_id, l_linenumber AS n, l_partkey % 16 AS a, l_suppkey % 8 AS b,
       concat('Owner', CAST(l_partkey % 5 AS VARCHAR(9)), '.fn_', CAST(l_suppkey % 7 AS VARCHAR(9))) AS label, concat('fn_', CAST(l_suppkey % 7 AS VARCHAR(9))) AS name FROM lineitem"""


def strongest_title_match(spark, sf_dir):
    return S.strongest_titles(adapter(spark, sf_dir, "title_matches"))


def shared_call_caller(spark, sf_dir):
    return S.shared_callers(adapter(spark, sf_dir, "external_calls"), adapter(spark, sf_dir, "shared_relations"))


def symbol_evidence(spark, sf_dir):
    rows = adapter(spark, sf_dir, "chosen_symbols")
    bit = lambda c, k: (F.shiftright(c, k) % 2) == 1
    some = lambda flag: F.when(flag, 1)
    rows = rows.withColumns({
        "overlap": F.filter(F.array(F.when(bit("a", 0), "token"), F.when(bit("a", 1), "parser")), lambda x: x.isNotNull()),
        "qualified_match": bit("a", 2), "exact_match": bit("a", 3), "unscoped_match": bit("b", 0),
        "constructor": some(F.col("n") == 1), "title_match": F.col("n") == 2, "frame": some(F.col("n") == 3), "source_line": some(F.col("n") == 4), "snippet": some(F.col("n") == 5),
        "primary_match": bit("b", 1), "component_match": bit("b", 2), "callers": F.when(F.col("n") > 5, F.array(F.lit("run"), F.lit("main"))).otherwise(F.array().cast("array<string>")),
    })
    return rows.select("issue_id", "n", "label", "a", "b", F.array_join(S.evidence(), "|").alias("evidence"))


def called_names(spark, sf_dir):
    found = C.called_names(adapter(spark, sf_dir, "call_uses"))
    calls = F.array_join(F.transform("symbol_calls", lambda x: F.concat(x.caller, F.lit(":"), F.array_join(x.symbols, ","))), ";")
    return found.select("path", F.array_join("name_calls", ",").alias("name_calls"), calls.alias("symbol_calls"))


def language_summary(spark, sf_dir):
    return C.summary(adapter(spark, sf_dir, "files"))


def _cases(spark, sf_dir):
    return adapter(spark, sf_dir, "cases")


def model_subset_means(spark, sf_dir):
    rows = _cases(spark, sf_dir).withColumn("fallback", F.when(F.col("case_id") % 7 == 0, "timeout"))
    return evaluation.model_means(rows, ["attempts", "latency_ms"], "tier")


def case_outcomes(spark, sf_dir):
    """Cases with their metrics; those without any ranked file count as failed."""
    found = adapter(spark, sf_dir, "ranked").where("case_id % 4 <> 0").groupBy("case_id").agg(F.min("rank").cast("long").alias("best"))
    return evaluation.outcomes(_cases(spark, sf_dir).select("case_id", "tier"), found)


def store_round_trip(spark, sf_dir):
    held = _cases(spark, sf_dir).select("case_id", "tier", "latency_ms", "failure")
    saved = held.where("case_id % 11 <> 0").withColumn("failure", F.when(F.col("case_id") % 13 == 0, "E9").otherwise(F.col("failure")))
    return evaluation.round_trip(held, saved, "case_id")


def report_hypotheses(spark, sf_dir):
    ranked = adapter(spark, sf_dir, "ranked").where("case_id % 5 <> 0")
    found = ranked.select(F.col("case_id").alias("issue_id"), "rank", F.concat(F.lit("src/f"), F.col("file_id").cast("string")).alias("path"), F.when(F.col("file_id") % 2 == 0, F.concat(F.lit("fn_"), (F.col("file_id") % 9).cast("string"))).alias("symbol"), F.round(1 / F.col("rank"), 4).alias("confidence"))
    return locate.investigate(_cases(spark, sf_dir).select(F.col("case_id").alias("issue_id")), found)


def locate_candidates(spark, sf_dir):
    """The first files for one issue of each nation, over generated sources: an issue names a file, a function and words."""
    files = stored(code.sources(spark, sf_dir).withColumn("repository", F.lit("generated")), "sources")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    asked = adapter(spark, sf_dir, "files").where("path LIKE '%.py'").select((F.col("file_id") % 101).alias("n_nationkey"), "file_id", "path")
    named = asked.groupBy("n_nationkey").agg(F.min_by("path", "file_id").alias("path"))
    issues = nation.join(named, "n_nationkey").select(
        F.col("n_nationkey").cast("long").alias("issue_id"), F.lit("generated").alias("repository"), F.concat(F.lit("Crash in `use` for "), F.lower("n_name")).alias("title"),
        F.concat(F.lit("Calling `use(y)` fails, see "), F.col("path"), F.lit("#L5")).alias("body"), F.array(F.lit("bug")).alias("labels"),
    )
    found = locate.locate(G.issue_signals(issues), files, C.repository_map(files.select("path", "content")))
    return found.select("issue_id", "rank", "path", "symbol", "lines", "confidence", F.array_join("evidence", "|").alias("evidence"))


def issue_signals(spark, sf_dir):
    """Signals of the text of every order's issue, with code in spans and fences and frames of its part's file."""
    rows = adapter(spark, sf_dir, "issues").where("number % 3 = 0")
    n = F.col("number").cast("string")
    body = F.concat(F.lit("Call `pkg.run"), n, F.lit("(x)` or `Name"), n, F.lit("`:\n```python\nmod.load"), n, F.lit("(1)\n__all__\n```\n  File \"src/a"), n, F.lit(".py\", line 3, in f\nsee lib/b"), n, F.lit(".py#L7 in mod.g"), n, F.lit("\n"))
    found = G.issue_signals(rows.select(F.col("number").alias("issue_id"), F.lit("r").alias("repository"), "title", body.alias("body"), F.array("label").alias("labels")))
    return found.select("issue_id", F.array_join("explicit_identifiers", ",").alias("explicit"), F.array_join("called_identifiers", ",").alias("called"), F.array_join(F.transform("traceback_frames", lambda x: F.concat_ws(":", x.path, x.symbol)), ",").alias("frames"), F.array_join(F.transform("line_references", lambda x: F.concat_ws(":", x.path, x.line.cast("string"))), ",").alias("lines"), F.array_join("paths", ",").alias("paths"))


QUERIES = {f.__name__: f for f in (strongest_title_match, shared_call_caller, symbol_evidence, called_names, language_summary, model_subset_means, case_outcomes, store_round_trip, report_hypotheses, locate_candidates, issue_signals)}

ORACLE = {
    "strongest_title_match": with_views("WITH m AS (SELECT issue_id, max(title_strength) AS s FROM title_matches WHERE title_strength > 0 GROUP BY issue_id) SELECT t.issue_id, min(symbol_id) AS symbol_id, s AS title_strength FROM title_matches t JOIN m ON m.issue_id = t.issue_id AND m.s = t.title_strength GROUP BY t.issue_id, s HAVING count(DISTINCT symbol_id) = 1", "title_matches"),
    "shared_call_caller": with_views("SELECT r.issue_id, r.file_id, min(caller) AS caller FROM shared_relations r JOIN external_calls e ON e.file_id = r.file_id AND e.target = r.target WHERE caller IS NOT NULL GROUP BY r.issue_id, r.file_id HAVING count(DISTINCT caller) = 1", "shared_relations", "external_calls"),
    "symbol_evidence": with_views("""SELECT issue_id, n, label, a, b, concat_ws('|', CASE a % 4 WHEN 1 THEN 'Symbol ' || label || ' matches: token' WHEN 2 THEN 'Symbol ' || label || ' matches: parser' WHEN 3 THEN 'Symbol ' || label || ' matches: parser, token' END,
      CASE WHEN (a // 4) % 2 = 1 OR ((a // 8) % 2 = 1 AND b % 2 = 0) THEN 'Issue references symbol ' || label END,
      CASE n WHEN 1 THEN 'Issue title and code call constructor ' || label WHEN 2 THEN 'Issue title matches owner and method ' || label WHEN 3 THEN 'Traceback frame points to symbol ' || label WHEN 4 THEN 'Issue source line points to symbol ' || label WHEN 5 THEN 'Issue source snippet matches symbol ' || label END,
      CASE WHEN (b // 2) % 2 = 1 THEN 'Issue title strongly matches symbol ' || label END, CASE WHEN (b // 4) % 2 = 1 THEN 'Issue references owning symbol ' || string_split(label, '.')[1] END,
      CASE WHEN n > 5 THEN 'Issue-matching symbols call ' || name || ': main, run' END) AS evidence FROM chosen_symbols""", "chosen_symbols"),
    "called_names": with_views("""WITH c AS (SELECT * FROM call_uses WHERE kind = 'call'), k AS (SELECT path, caller, string_agg(DISTINCT target_symbol, ',' ORDER BY target_symbol) AS s FROM c WHERE caller IS NOT NULL GROUP BY path, caller),
      q AS (SELECT path, string_agg(caller || ':' || s, ';' ORDER BY caller) AS symbol_calls FROM k GROUP BY path)
      SELECT c.path, string_agg(DISTINCT local_name, ',' ORDER BY local_name) AS name_calls, any_value(symbol_calls) AS symbol_calls FROM c LEFT JOIN q USING (path) GROUP BY c.path""", "call_uses"),
    "language_summary": with_views("WITH l AS (SELECT path, CASE WHEN path LIKE '%.py' THEN 'Python' WHEN path LIKE '%.ts' THEN 'TypeScript' END AS language FROM files) SELECT row_number() OVER (ORDER BY count(*) DESC, min(path)) AS place, language, count(*) AS files FROM l WHERE language IS NOT NULL GROUP BY language", "files"),
    "model_subset_means": with_views("SELECT tier, count(*) FILTER (completed AND case_id % 7 <> 0) AS model_cases, count(*) FILTER (completed AND case_id % 7 = 0) AS fallback_cases, round(avg(attempts) FILTER (completed AND case_id % 7 <> 0), 4) AS model_attempts, round(avg(latency_ms::DOUBLE) FILTER (completed AND case_id % 7 <> 0), 4) AS model_latency_ms FROM cases GROUP BY GROUPING SETS ((tier), ())", "cases"),
    "case_outcomes": with_views("SELECT c.case_id, tier, best, best IS NOT NULL AS completed FROM cases c LEFT JOIN (SELECT case_id, min(rank) AS best FROM ranked WHERE case_id % 4 <> 0 GROUP BY case_id) r USING (case_id)", "cases", "ranked"),
    "store_round_trip": with_views("SELECT case_id, CASE WHEN case_id % 11 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM cases WHERE case_id % 11 = 0 OR case_id % 13 = 0", "cases"),
    "report_hypotheses": with_views("""SELECT case_id AS issue_id, 'H' || rank AS hypothesis, 'The failure path may originate in src/f' || file_id || CASE WHEN file_id % 2 = 0 THEN '::fn_' || file_id % 9 ELSE '' END AS description, round(1 / rank, 4) AS confidence FROM ranked WHERE case_id % 5 <> 0 AND rank <= 3
      UNION ALL SELECT case_id, 'H1', 'The issue does not map strongly to indexed repository symbols', 0.2 FROM cases WHERE case_id % 5 = 0 OR case_id NOT IN (SELECT case_id FROM ranked)""", "ranked", "cases"),
    "issue_signals": with_views("""SELECT number AS issue_id, concat_ws(',', 'Name' || number, '__all__', 'load' || number, 'mod.g' || number, 'mod.load' || number, 'pkg.run' || number, 'run' || number) AS explicit,
      concat_ws(',', 'pkg.run' || number, 'mod.load' || number) AS called, 'src/a' || number || '.py:f' AS frames, 'lib/b' || number || '.py:7' AS lines, concat_ws(',', 'lib/b' || number || '.py', 'src/a' || number || '.py') AS paths FROM issues WHERE number % 3 = 0""", "issues"),
}
