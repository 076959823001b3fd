"""Readers: issue files, repositories, manifests, candidate pools, git history; writers: JSON and index tables."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ISSUE = "number long, title string, body string, labels array<string>, comments_count int, created_at timestamp, updated_at timestamp, html_url string, author string"
REST_ISSUE = "number long, title string, body string, labels array<struct<name:string>>, comments int, created_at timestamp, updated_at timestamp, html_url string, user struct<login:string>, pull_request struct<url:string>, repository_url string"
CASE = "id string, tier string, repository string, issue_number long, issue_updated_at timestamp, fix_pr_number long, pre_fix_sha string, expected_files array<string>, expected_symbols array<struct<file:string,symbol:string>>"


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of issues (or one object a line) as ISSUE with ord, the place in the file. Malformed records are an error."""
    rows = spark.read.schema(ISSUE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    # a multi-line file is one task, so ids count up within it
    return rows.withColumn("body", F.coalesce("body", F.lit(""))).withColumn("labels", F.coalesce("labels", F.array().cast("array<string>"))).withColumn("ord", F.monotonically_increasing_id())


def issue_rows(items: DataFrame) -> DataFrame:
    """REST_ISSUE rows that aren't pull requests as ISSUE."""
    return items.where("pull_request IS NULL").select("number", "title", F.coalesce("body", F.lit("")).alias("body"), F.transform("labels", lambda x: x["name"]).alias("labels"), F.coalesce("comments", F.lit(0)).alias("comments_count"), "created_at", "updated_at", "html_url", F.col("user.login").alias("author"))


def read_source_files(spark: SparkSession, root: str, included: DataFrame | None = None) -> DataFrame:
    """path (relative to root) and content of all UTF-8 files under root, without ignored folders; of included (path) alone if given."""
    from quarryline.operators.codeindex import visible

    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    start = F.instr("path", base.removeprefix("file://")) + len(base.removeprefix("file://")) + 1
    rows = visible(raw.select(F.substring("path", start, F.lit(1 << 30)).alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("content")))
    if included is None:
        return rows
    if included.where(F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")).first():
        raise ValueError("included paths must be relative to the root")
    return rows.join(included.select("path").distinct(), "path", "left_semi")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a case of a manifest {name, version, cases: [...]}."""
    rows = spark.read.schema(f"name string, version int, cases array<struct<{', '.join(c.replace(' ', ':', 1) for c in _fields(CASE))}>>").option("multiLine", True).json(path)
    return rows.select(F.col("name").alias("manifest"), "version", F.explode("cases").alias("c")).select("manifest", "version", "c.*")


def _fields(schema: str) -> list[str]:
    out, depth = [""], 0
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return [x.strip() for x in out]


SELECTION = "name string, version int, manifest_name string, selections array<struct<candidate_id:string,case_id:string,tier:string,review_notes:string,expected_symbols:array<struct<file:string,symbol:string>>>>"


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """One row a selection of {name, version, manifest_name, selections: [...]}: name, version, manifest_name and what it says of a candidate. Malformed files, and selections without an id, are an error."""
    rows = spark.read.schema(SELECTION).option("multiLine", True).option("mode", "FAILFAST").json(path)
    flat = rows.select("name", "version", "manifest_name", F.explode("selections").alias("s")).select("name", "version", "manifest_name", "s.*")
    named = lambda c: F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.col(c)).otherwise(F.raise_error(F.lit(f"a selection has no {c}")))
    return flat.withColumns({"candidate_id": named("candidate_id"), "case_id": named("case_id")})


def manifest_problems(cases: DataFrame) -> DataFrame:
    """id and problem of cases that break a rule of the manifest; empty for a good one."""
    symbol_files = F.transform("expected_symbols", lambda s: s.file)
    rules = F.array(
        F.when(~F.col("repository").rlike(r"^[^/\s]+/[^/\s]+$"), "repository is not owner/name"),
        F.when(~F.col("pre_fix_sha").rlike("^[0-9a-f]{40}$"), "pre_fix_sha is not 40 hex digits"),
        F.when(F.size(F.array_distinct("expected_files")) != F.size("expected_files"), "expected files repeat"),
        F.when(F.size("expected_files") == 0, "no expected files"),
        F.when(F.size(F.array_distinct(symbol_files)) != F.size(symbol_files), "two symbols in a file"),
        F.when(F.size(F.array_except(symbol_files, F.col("expected_files"))) > 0, "symbol outside expected files"),
    )
    twice = cases.groupBy("id").count().where("count > 1").select("id", F.lit("id repeats").alias("problem"))
    return cases.select("id", F.explode(F.array_compact(rules)).alias("problem")).unionByName(twice)


def read_candidates(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Candidates of JSON files of three shapes: an array, {candidates: [...]} and {repositories: [{candidates: [...]}]}; columns are united by name."""
    from functools import reduce

    def one(path: str) -> DataFrame:
        rows = spark.read.option("multiLine", True).json(path)
        if "repositories" in rows.columns:
            rows = rows.select(F.explode("repositories").alias("r")).select(F.explode("r.candidates").alias("c")).select("c.*")
        elif "candidates" in rows.columns:
            rows = rows.select(F.explode("candidates").alias("c")).select("c.*")
        return rows

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(one, paths))


def git(root: str, *args: str, timeout: float = 5.0) -> str:
    """What a git command prints; '' if it fails or takes too long."""
    try:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=timeout, check=True).stdout.decode("utf-8", "replace")
    except (subprocess.SubprocessError, OSError):
        return ""


def tracked_files(spark: SparkSession, root: str) -> DataFrame:
    """path of the files git tracks in a local repository. Runs on the driver, where the clone is."""
    return spark.createDataFrame([(p,) for p in git(root, "ls-files", "-z").split("\0") if p], "path string")


def commit_table(spark: SparkSession, root: str, most: int = 50, paths: tuple[str, ...] = ()) -> DataFrame:
    """commit_ord (0 is the latest), sha, path of the last commits that touch paths (all without)."""
    text = git(root, "log", f"-n{most}", "--full-diff", "--name-only", "--pretty=format:\x01%H", "--", *paths)
    rows = [(k, part.split("\n", 1)[0], p) for k, part in enumerate(text.split("\x01")[1:]) for p in part.split("\n")[1:] if p]
    return spark.createDataFrame(rows, "commit_ord long, sha string, path string")


def blame_table(spark: SparkSession, root: str, lines: list[tuple[str, int, int]]) -> DataFrame:
    """path, line, sha of line ranges (five lines at most of each) of a local repository."""
    rows = []
    for path, first, last in lines:
        text = git(root, "blame", "--porcelain", "-L", f"{first},{min(last, first + 4)}", "--", path, timeout=2.0)
        heads = [x.split() for x in text.split("\n") if len(x.split(" ", 1)[0]) == 40]
        rows += [(path, int(h[2]), h[0]) for h in heads]
    return spark.createDataFrame(rows, "path string, line long, sha string")


def revision_table(spark: SparkSession, root: str, wanted: list[tuple[str, str]]) -> DataFrame:
    """revision, path, content of files (revision, path) at a revision."""
    rows = [(r, p, git(root, "show", f"{r}:{p}", timeout=3.0)) for r, p in wanted]
    return spark.createDataFrame([x for x in rows if x[2]], "revision string, path string, content string")


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_index(index: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """The tables of repository_map() as Parquet, one folder each."""
    for name, df in index.items():
        df.write.mode(mode).parquet(f"{folder}/{name}")


def read_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    names = ("files", "symbols", "uses", "external", "imports", "frameworks", "languages", "test_directories", "runtime_files", "entrypoints", "modules", "bound", "names", "imported")
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


