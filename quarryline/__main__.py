"""Command line: python -m quarryline <command> …; also the script for spark-submit.

    sync URL --output issues.json [--limit N] [--token T]     issues of a REST list
    rank ISSUES --output DIR [--now T]                        priorities, best first
    duplicates ISSUES [--threshold X]                         similar pairs
    index ROOT --output DIR                                   tables of a repository
    investigate ISSUES NUMBER ROOT [--top-k N] [--git]        candidate files of an issue
    evaluate RANKED EXPECTED [--tiers CASES]                  retrieval metrics (Parquet tables)
    audit CANDIDATES --output DIR                             checks of pull-request candidates (Parquet table)
    plan AUDITED --output DIR                                 a maximum matching of reviewable candidates
    curate MANIFEST SELECTIONS CANDIDATES --output DIR        a manifest with selected candidates (Parquet tables)
    runs STORE RUN_ID                                         state and traces of a run
    review STORE RUN_ID DECISION [--notes TEXT]               the decision on a run
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def session() -> SparkSession:
    spark = SparkSession.builder.appName("quarryline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quarryline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = out.add_subparsers(dest="command", required=True)

    def command(name: str, *places: str, **options) -> None:
        p = sub.add_parser(name)
        for x in places:
            p.add_argument(x)
        for k, v in options.items():
            p.add_argument(f"--{k.replace('_', '-')}", **v)

    need = {"required": True}
    command("sync", "url", output=need, limit={"type": int, "default": 100}, token={})
    command("rank", "issues", output=need, now={})
    command("duplicates", "issues", threshold={"type": float, "default": 0.55}, output={})
    command("index", "root", output=need)
    command("investigate", "issues", "number", "root", top_k={"type": int, "default": 20}, output={}, git={"action": "store_true"})
    command("evaluate", "ranked", "expected", tiers={}, output={})
    command("audit", "candidates", output=need, max_source_files={"type": int, "default": 5})
    command("plan", "audited", output=need)
    command("curate", "manifest", "selections", "candidates", output=need)
    command("runs", "store", "run_id")
    command("review", "store", "run_id", "decision", notes={"default": ""})
    return out


def show(df: DataFrame, output: str | None, n: int = 20) -> None:
    if output:
        df.write.mode("errorifexists").json(output)
        df = df.sparkSession.read.schema(df.schema).json(output)
    df.limit(n).show(n, truncate=100)


def investigate(spark: SparkSession, args) -> DataFrame:
    from quarryline.functions.signals import issue_signals
    from quarryline.operators import codeindex, locate
    from quarryline.sources import readers

    issue = readers.read_issues(spark, args.issues).where(F.col("number") == int(args.number))
    if issue.isEmpty():
        raise SystemExit(f"no issue {args.number} in {args.issues}")
    tracked = readers.tracked_files(spark, args.root) if args.git else None
    files = readers.read_source_files(spark, args.root, tracked).withColumn("repository", F.lit("local"))
    commits = readers.commit_table(spark, args.root).select("commit_ord", F.col("path").alias("file_id")) if args.git else None
    signals = issue_signals(issue.select(F.col("number").alias("issue_id"), F.lit("local").alias("repository"), "title", "body", "labels"))
    return locate.locate(signals, files, codeindex.repository_map(files.select("path", "content")), args.top_k, commits).orderBy("rank")


def main(argv: list[str] | None = None) -> int:
    from quarryline.operators import audit, codeindex, evaluation, runs, scoring, similarity
    from quarryline.sources import readers, rest

    args = parser().parse_args(argv)
    if args.command == "sync":
        found = rest.open_issues(lambda u: rest.http_get(u, args.token), args.url, args.limit)
        with open(args.output, "w", encoding="utf-8") as file:
            json.dump(found, file, indent=2)
        return 0
    spark = session()
    now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    if args.command == "rank":
        issues = readers.read_issues(spark, args.issues).persist()
        show(scoring.rank_issues(issues, args.now or now.isoformat(sep=" "), similarity.detect_duplicates(issues)), args.output)
    elif args.command == "duplicates":
        show(similarity.detect_duplicates(readers.read_issues(spark, args.issues), args.threshold), args.output)
    elif args.command == "index":
        readers.write_index(codeindex.repository_map(readers.read_source_files(spark, args.root)), args.output)
    elif args.command == "investigate":
        show(investigate(spark, args), args.output)
    elif args.command == "evaluate":
        metrics = evaluation.case_metrics(spark.read.parquet(args.ranked), spark.read.parquet(args.expected))
        if args.tiers:
            names = [c for c in metrics.columns if c not in ("case_id", "n_expected")]
            metrics = evaluation.aggregate(spark.read.parquet(args.tiers).join(metrics, "case_id"), names, "tier")
        show(metrics, args.output)
    elif args.command == "audit":
        audit.audit(spark.read.parquet(args.candidates), args.max_source_files).write.parquet(args.output)
    elif args.command == "plan":
        edges = audit.reviewable_edges(spark.read.parquet(args.audited), spark.createDataFrame([], "repository string, issue_number long, pr_number long"))
        placed = edges.withColumn("place", F.row_number().over(Window.partitionBy("repository").orderBy(*audit.review_order())).cast("long"))
        show(audit.maximum_matching(placed), args.output)
    elif args.command == "curate":
        audit.curate(*(spark.read.parquet(p) for p in (args.manifest, args.selections, args.candidates))).write.parquet(args.output)
    elif args.command == "runs":
        store = runs.RunStore(spark, args.store)
        print(store.run(args.run_id).asDict())
        store.traces(args.run_id).show(100, truncate=80)
    elif args.command == "review":
        runs.RunStore(spark, args.store).review(args.run_id, args.decision, args.notes, now)
    return 0


if __name__ == "__main__":
    sys.exit(main())
