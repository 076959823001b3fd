"""Queries: retrieval metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.operators import evaluation
from quarryline.plans.adapters import adapter, with_views

METRICS = [*[f"recall_at_{k}" for k in evaluation.CUTOFFS], "pool_recall", "reciprocal_rank"]


def metrics(spark, sf_dir):
    return evaluation.case_metrics(adapter(spark, sf_dir, "ranked"), adapter(spark, sf_dir, "expected"))


def recall_at_k(spark, sf_dir):
    return metrics(spark, sf_dir).drop("reciprocal_rank")


def reciprocal_rank(spark, sf_dir):
    return metrics(spark, sf_dir).select("case_id", "reciprocal_rank")


def results(spark, sf_dir):
    return adapter(spark, sf_dir, "cases").join(metrics(spark, sf_dir), "case_id")


def benchmark_overall_by_tier(spark, sf_dir):
    return evaluation.aggregate(results(spark, sf_dir), METRICS, "tier")


def benchmark_overall(spark, sf_dir):
    return evaluation.aggregate(results(spark, sf_dir), METRICS)


def fallback_histogram(spark, sf_dir):
    return evaluation.histogram(adapter(spark, sf_dir, "cases"), "failure")


def workflow_reliability(spark, sf_dir):
    return evaluation.reliability(adapter(spark, sf_dir, "cases"))


def symbol_recall(spark, sf_dir):
    symbol = F.concat(F.lit("Owner."), F.lit("fn_"), (F.col("file_id") % 7).cast("string"))
    candidates = adapter(spark, sf_dir, "ranked").withColumn("symbol", symbol)
    local = F.when(F.col("file_id") % 2 == 0, symbol).otherwise(F.concat(F.lit("fn_"), (F.col("file_id") % 5).cast("string")))
    wanted = adapter(spark, sf_dir, "expected").withColumn("symbol", local)
    return evaluation.symbol_metrics(candidates, wanted, adapter(spark, sf_dir, "cases"))


def reranked_files(spark, sf_dir):
    ranked = adapter(spark, sf_dir, "ranked")
    # a model that turns the first three around
    first = ranked.where("rank <= 3").withColumn("place", -F.col("rank")).select("case_id", "file_id", "place")
    return evaluation.reranked(ranked, first)


def unknown_cases(spark, sf_dir):
    return evaluation.unknown_cases(adapter(spark, sf_dir, "commit_files").select(F.col("file_id").alias("case_id")), adapter(spark, sf_dir, "expected"))


QUERIES = {f.__name__: f for f in (recall_at_k, reciprocal_rank, benchmark_overall_by_tier, benchmark_overall, fallback_histogram, workflow_reliability, symbol_recall, reranked_files, unknown_cases)}

_M = """m AS (SELECT e.case_id, count(*) AS n_expected, round(count(*) FILTER (rank <= 1) / count(*), 4) AS recall_at_1, round(count(*) FILTER (rank <= 5) / count(*), 4) AS recall_at_5,
  round(count(*) FILTER (rank <= 10) / count(*), 4) AS recall_at_10, round(count(*) FILTER (rank <= 20) / count(*), 4) AS recall_at_20, round(count(rank) / count(*), 4) AS pool_recall, round(coalesce(1 / min(rank), 0), 4) AS reciprocal_rank
  FROM expected e LEFT JOIN ranked USING (case_id, file_id) GROUP BY e.case_id)"""
_AVG = ", ".join(f"round(avg({m}) FILTER (completed), 4) AS {m}" for m in METRICS)
_V = ("expected", "ranked")

ORACLE = {
    "recall_at_k": with_views(f"WITH {_M} SELECT * EXCLUDE (reciprocal_rank) FROM m", *_V),
    "reciprocal_rank": with_views(f"WITH {_M} SELECT case_id, reciprocal_rank FROM m", *_V),
    "benchmark_overall_by_tier": with_views(f"WITH {_M} SELECT tier, count(*) AS cases, count(*) FILTER (completed) AS completed_cases, count(*) FILTER (NOT completed) AS failed_cases, {_AVG} FROM m JOIN cases USING (case_id) GROUP BY GROUPING SETS ((tier), ())", *_V, "cases"),
    "benchmark_overall": with_views(f"WITH {_M} SELECT count(*) AS cases, count(*) FILTER (completed) AS completed_cases, count(*) FILTER (NOT completed) AS failed_cases, {_AVG} FROM m JOIN cases USING (case_id)", *_V, "cases"),
    "fallback_histogram": with_views("SELECT failure, count(*) AS n FROM cases WHERE failure IS NOT NULL GROUP BY failure", "cases"),
    "workflow_reliability": with_views("""SELECT count(*) AS cases, round(avg(completed::INT), 4) AS success_rate, round(avg((completed AND attempts = 1)::INT), 4) AS first_attempt_rate,
      round(avg(attempts) FILTER (completed), 4) AS mean_attempts, round(avg(latency_ms) FILTER (completed), 3) AS mean_latency_ms FROM cases""", "cases"),
    "symbol_recall": with_views("""WITH w AS (SELECT case_id, file_id, CASE WHEN file_id % 2 = 0 THEN 'Owner.fn_' || (file_id % 7) ELSE 'fn_' || (file_id % 5) END AS s FROM expected),
      h AS (SELECT w.case_id, rank FROM w LEFT JOIN ranked r ON r.case_id = w.case_id AND r.file_id = w.file_id AND (w.s = 'Owner.fn_' || (r.file_id % 7) OR w.s = 'fn_' || (r.file_id % 7))),
      g AS (SELECT case_id, count(*) AS n, count(*) FILTER (rank <= 1) AS r1, count(*) FILTER (rank <= 5) AS r5, count(*) FILTER (rank <= 10) AS r10, count(*) FILTER (rank <= 20) AS r20, min(rank) AS best FROM h GROUP BY case_id)
      SELECT cases.case_id, coalesce(n, 0) AS n_symbols, round(r1 / n, 4) AS symbol_recall_at_1, round(r5 / n, 4) AS symbol_recall_at_5, round(r10 / n, 4) AS symbol_recall_at_10, round(r20 / n, 4) AS symbol_recall_at_20,
        CASE WHEN n IS NOT NULL THEN round(coalesce(1 / best, 0), 4) END AS symbol_reciprocal_rank FROM cases LEFT JOIN g USING (case_id)""", *_V, "cases"),
    "reranked_files": with_views("SELECT case_id, file_id, row_number() OVER (PARTITION BY case_id ORDER BY CASE WHEN rank <= 3 THEN -rank ELSE rank END) AS rank FROM ranked", "ranked"),
    "unknown_cases": with_views("SELECT DISTINCT file_id AS case_id FROM commit_files WHERE file_id NOT IN (SELECT case_id FROM expected)", "commit_files", "expected"),
}
