"""Retrieval metrics: recall at ranks, reciprocal ranks, symbol metrics and macro averages by group.

ranked: (case_id, file_id, rank from 1); expected: (case_id, file_id). Metrics are rounded to 4 places for each case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTOFFS = (1, 5, 10, 20)


def first_places(ranked: DataFrame) -> DataFrame:
    """Files once for each case, at their best place, places counted anew."""
    from pyspark.sql import Window

    best = ranked.groupBy("case_id", "file_id").agg(F.min("rank").alias("at"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("at", "file_id"))).drop("at")


def case_metrics(ranked: DataFrame, expected: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """case_id, n_expected, recall_at_k, pool_recall and reciprocal_rank for every case with expected files."""
    found = expected.join(ranked, ["case_id", "file_id"], "left")
    n = F.count("*")
    recall = lambda k: F.round(F.count(F.when(F.col("rank") <= k, 1)) / n, 4).alias(f"recall_at_{k}")
    return found.groupBy("case_id").agg(n.alias("n_expected"), *map(recall, cutoffs), F.round(F.count("rank") / n, 4).alias("pool_recall"), F.round(F.coalesce(1 / F.min("rank"), F.lit(0.0)), 4).alias("reciprocal_rank"))


def symbol_metrics(candidates: DataFrame, expected: DataFrame, cases: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """The same over symbols: candidates (case_id, file_id, symbol, rank) may give a qualified name, expected (case_id, file_id, symbol) the qualified
    or the local one. Cases without labels have null metrics."""
    local = F.element_at(F.split("symbol", r"\."), -1)
    want = expected.select("case_id", "file_id", F.col("symbol").alias("want"))
    hits = want.join(candidates.withColumn("local", local), ["case_id", "file_id"], "left").where("want = symbol OR want = local").groupBy("case_id", "file_id", "want").agg(F.min("rank").alias("rank"))
    all_ = want.join(hits, ["case_id", "file_id", "want"], "left").groupBy("case_id")
    n = F.count("*")
    recall = lambda k: F.round(F.count(F.when(F.col("rank") <= k, 1)) / n, 4).alias(f"symbol_recall_at_{k}")
    found = all_.agg(n.alias("n_symbols"), *map(recall, cutoffs), F.round(F.coalesce(1 / F.min("rank"), F.lit(0.0)), 4).alias("symbol_reciprocal_rank"))
    return cases.select("case_id").join(found, "case_id", "left").withColumn("n_symbols", F.coalesce("n_symbols", F.lit(0)))


def mean(column: str, places: int = 4) -> Column:
    """Of completed cases only; null metrics don't count."""
    return F.round(F.avg(F.when(F.col("completed"), F.col(column))), places)


def aggregate(results: DataFrame, metrics: list[str], by: str | None = None) -> DataFrame:
    """Macro means over completed cases, with counts of completed and failed ones; with by, for each value of by and once overall (null)."""
    measures = [F.count("*").alias("cases"), F.count_if("completed").alias("completed_cases"), F.count_if(~F.col("completed")).alias("failed_cases"), *[mean(m).alias(m) for m in metrics]]
    if by is None:
        return results.agg(*measures)
    return results.groupingSets([[by], []], by).agg(*measures)


def model_means(results: DataFrame, metrics: list[str], by: str | None = None) -> DataFrame:
    """Means over the cases in which the model's answer was used (completed without a fallback), how many those are, and how many fell back for each reason's sake.

    results: completed, fallback (a reason, or null) and metrics.
    """
    used = F.col("completed") & F.col("fallback").isNull()
    measures = [F.count_if(used).alias("model_cases"), F.count_if(F.col("completed") & F.col("fallback").isNotNull()).alias("fallback_cases"), *[F.round(F.avg(F.when(used, F.col(m))), 4).alias(f"model_{m}") for m in metrics]]
    return results.agg(*measures) if by is None else results.groupingSets([[by], []], by).agg(*measures)


def outcomes(cases: DataFrame, results: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Every case once, with its result or as a failed one, so that what gave no result stays in the denominator; an error where wanted names a case that isn't there."""
    if wanted is not None:
        if missing := unknown_cases(wanted, cases).first():
            raise ValueError(f"unknown case: {missing['case_id']}")
        cases = cases.join(wanted.select("case_id").distinct(), "case_id", "left_semi")
    joined = cases.join(results.withColumn("_has", F.lit(True)), "case_id", "left")
    done = F.col("completed") if "completed" in results.columns else F.lit(True)
    return joined.withColumn("completed", F.coalesce(F.col("_has") & done, F.lit(False))).drop("_has")


def round_trip(held: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    """key and problem ('missing', 'unexpected' or 'changed') of the rows that a store gave back otherwise than they were: none if persistence is exact."""
    own = [c for c in held.columns if c != key]
    digest = lambda df, name: df.select(key, F.sha2(F.to_json(F.struct(*own), {"ignoreNullFields": "false"}), 256).alias(name))
    both = digest(held, "h").join(digest(saved, "s"), key, "full_outer")
    return both.where("NOT (h <=> s)").select(key, F.expr("CASE WHEN s IS NULL THEN 'missing' WHEN h IS NULL THEN 'unexpected' ELSE 'changed' END").alias("problem"))


def histogram(results: DataFrame, column: str) -> DataFrame:
    """column, n for its values that aren't null."""
    return results.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def reliability(results: DataFrame) -> DataFrame:
    """Success and first-attempt rates over all cases, and means over successful ones, of results (completed, attempts, latency_ms)."""
    ok = F.col("completed")
    return results.agg(
        F.count("*").alias("cases"),
        F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 4).alias("success_rate"),
        F.round(F.avg(F.when(ok & (F.col("attempts") == 1), 1.0).otherwise(0.0)), 4).alias("first_attempt_rate"),
        F.round(F.avg(F.when(ok, F.col("attempts"))), 4).alias("mean_attempts"),
        F.round(F.avg(F.when(ok, F.col("latency_ms"))), 3).alias("mean_latency_ms"),
    )


def unknown_cases(wanted: DataFrame, cases: DataFrame) -> DataFrame:
    """Requested case ids that the manifest doesn't have."""
    return wanted.select("case_id").distinct().join(cases, "case_id", "left_anti")


def reranked(ranked: DataFrame, first: DataFrame) -> DataFrame:
    """A ranking with the files of first (case_id, file_id, place) in front, the others after them in their order."""
    from pyspark.sql import Window

    picked = first.groupBy("case_id", "file_id").agg(F.min("place").alias("place"))
    order = Window.partitionBy("case_id").orderBy(F.col("place").asc_nulls_last(), "rank", "file_id")
    return ranked.join(picked, ["case_id", "file_id"], "left").withColumn("new_rank", F.row_number().over(order).cast("long")).select("case_id", "file_id", F.col("new_rank").alias("rank"))
