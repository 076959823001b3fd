"""Queries: runs, traces, evidence, model answers, code tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.operators import evidence as E
from quarryline.operators import runs as R
from quarryline.operators import symbols as S
from quarryline.plans.adapters import VIEWS, adapter, with_views

#: Answers with nested unknown, missing and mistyped keys, by what orders say; parts of the JSON are put together by number.
VIEWS["answers"] = """
SELECT o_orderkey AS id, o_custkey % 4 AS a, o_orderkey % 5 AS b, o_custkey % 3 AS c,
       CASE WHEN o_orderkey % 17 = 0 THEN 'no json' ELSE concat('{"summary": ', CASE o_custkey % 4 WHEN 0 THEN '"s"' WHEN 1 THEN '7' WHEN 2 THEN 'null' ELSE '"t"' END,
         CASE o_orderkey % 5 WHEN 0 THEN ', "extra": 1' WHEN 1 THEN ', "score": "x"' WHEN 2 THEN ', "score": 0.5' WHEN 3 THEN ', "score": null' ELSE '' END,
         ', "items": [{"id": "i", "n": 1}, ', CASE o_custkey % 3 WHEN 0 THEN '{"id": 3, "m": 1}' WHEN 1 THEN '[]' ELSE '{"id": "j", "n": 2}' END, ']}') END AS payload FROM orders"""
ANSWER_SCHEMA = T.StructType([
    T.StructField("summary", T.StringType(), False), T.StructField("score", T.DoubleType(), True),
    T.StructField("items", T.ArrayType(T.StructType([T.StructField("id", T.StringType(), False), T.StructField("n", T.LongType(), False)])), False),
])
VIEWS["versions"] = "SELECT user_id AS run_id, event_type AS status, value AS payload, ts AS created_at, ts AS updated_at, event_id AS version FROM events"


def run_latest_state(spark, sf_dir):
    return R.latest(adapter(spark, sf_dir, "versions")).select("run_id", "status", "payload", "created_at", "version")


def trace_summary(spark, sf_dir):
    return R.trace_summary(adapter(spark, sf_dir, "traces"))


def trace_attempts(spark, sf_dir):
    """The longest chain of attempts of each run and how many of its nodes needed more than one."""
    return adapter(spark, sf_dir, "traces").groupBy("run_id").agg(F.max("attempt").cast("long").alias("most_attempts"), F.count_distinct(F.when(F.col("attempt") > 1, F.col("node_name"))).alias("repeated_nodes"))


def snapshot_order(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("id")).cast("long")
    return adapter(spark, sf_dir, "traces").where("status = 'completed'").select("run_id", "id", "node_name", place.alias("place"), F.get_json_object("payload", "$.k").try_cast("long").alias("k"))


def doc_lines(spark, sf_dir):
    return adapter(spark, sf_dir, "docs").where("body <> ''")


def evidence_numbered_lines(spark, sf_dir):
    docs = doc_lines(spark, sf_dir).withColumn("n", F.size(F.split("body", "\n"))).withColumn("w", E.window(F.concat((F.col("number") % 40).cast("string"), F.lit("-"), (F.col("number") % 40 + 3).cast("string")), F.col("n"), 2, 6))
    return docs.select("number", F.col("w.first").alias("first"), F.col("w.last").alias("last"), F.md5(E.numbered(F.col("body"), F.col("w.first"), F.col("w.last")).cast("binary")).alias("md5"))


def evidence_budget(spark, sf_dir):
    """Sixteen documents an issue under a budget of 4000 characters; a cut loses the blanks at its end, which leaves room for what follows."""
    docs = doc_lines(spark, sf_dir).select((F.floor(F.col("number") / 16)).alias("issue_id"), F.col("number").alias("rank"), F.col("body").alias("content"))
    found = E.budgeted(docs, "issue_id", "rank", "content", 4000)
    return found.select("issue_id", F.explode("evidence").alias("e")).select("issue_id", "e.id", F.col("e.place").alias("rank"), F.length("e.content").cast("long").alias("chars"))


def evidence_coverage(spark, sf_dir):
    n = F.col("page_id")
    ids = lambda *x: F.array(*[F.concat(F.lit("E"), y.cast("string")) for y in x])
    seen = F.when(n % 5 == 0, ids(F.lit(1), F.lit(2))).when(n % 5 == 1, ids(F.lit(1), F.lit(2), F.lit(3), F.lit(3))).when(n % 5 == 2, ids(F.lit(3), F.lit(1), F.lit(2))).otherwise(ids(F.lit(1), F.lit(2), n % 7 + 1))
    return adapter(spark, sf_dir, "urls").select("page_id", R.coverage(seen, ids(F.lit(1), F.lit(2), F.lit(3))).alias("problem"))


def alignment_contradictions(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    row = F.struct(F.concat(F.lit("E"), F.col("turn").cast("string")).alias("evidence_id"), F.col("role").alias("observation"), F.when(F.length("text") % 3 == 0, "contradicts_issue").otherwise("supports_issue").alias("alignment"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", row.alias("o")))).alias("x"))
    return grouped.select("conv_id", F.array_join(R.contradictions(F.transform("x", lambda x: x.o)), "|").alias("contradictions"))


def symbols(spark, sf_dir):
    return adapter(spark, sf_dir, "symbols")


def unique_symbol_names(spark, sf_dir):
    named = symbols(spark, sf_dir).withColumn("name", F.concat(F.lit("fn_"), (F.col("symbol_id") * F.col("file_id") % 90_001).cast("string")))
    return S.unique_names(named).select("name")


def enclosing_symbol(spark, sf_dir):
    """Line 20 of every file: the smallest span around it, if there is one smallest."""
    asked = symbols(spark, sf_dir).select("file_id").distinct().withColumn("line", F.lit(20))
    return S.enclosing(asked, symbols(spark, sf_dir)).select("file_id", "symbol_id")


def symbol_argmax(spark, sf_dir):
    return S.best(symbols(spark, sf_dir), ["file_id"], [F.col("end_line") - F.col("line"), -F.col("line"), -F.col("symbol_id")]).select("file_id", "symbol_id")


def related_callers(spark, sf_dir):
    return S.related_callers(adapter(spark, sf_dir, "fcalls").select("file_id", "caller", "target_symbol", (F.col("caller").cast("int") % 3 + 1).alias("overlap")))


def answer_field_paths(spark, sf_dir):
    found = R.validation_detail(adapter(spark, sf_dir, "answers").select("id", "payload"), ANSWER_SCHEMA)
    return found.select("id", "problems", F.array_join("classes", ",").alias("classes"), F.array_join("fields", ",").alias("fields"))


QUERIES = {f.__name__: f for f in (run_latest_state, trace_summary, trace_attempts, snapshot_order, evidence_numbered_lines, evidence_budget, evidence_coverage, alignment_contradictions, unique_symbol_names, enclosing_symbol, symbol_argmax, related_callers, answer_field_paths)}

ORACLE = {
    "run_latest_state": with_views("SELECT run_id, arg_max(status, (updated_at, version)) AS status, arg_max(payload, (updated_at, version)) AS payload, min(created_at) AS created_at, arg_max(version, (updated_at, version)) AS version FROM versions GROUP BY run_id", "versions"),
    "trace_summary": with_views("SELECT run_id, node_name, count(*) AS attempts, count(*) FILTER (status = 'failed') AS failures, bool_or(status = 'completed') AS completed, round(sum(elapsed_ms), 3) AS elapsed_ms FROM traces GROUP BY ALL", "traces"),
    "trace_attempts": with_views("SELECT run_id, max(attempt) AS most_attempts, count(DISTINCT node_name) FILTER (attempt > 1) AS repeated_nodes FROM traces GROUP BY run_id", "traces"),
    "snapshot_order": with_views("SELECT run_id, id, node_name, row_number() OVER (PARTITION BY run_id ORDER BY id) AS place, CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k FROM traces WHERE status = 'completed'", "traces"),
    "evidence_numbered_lines": with_views("""WITH s AS (SELECT number, string_split(body, chr(10)) AS x, number % 40 AS a FROM docs WHERE body <> ''), f AS (SELECT *, least(greatest(1, a - 2), len(x)) AS first FROM s), w AS (SELECT *, least(least(greatest(first, a + 5), len(x)), first + 5) AS last FROM f)
      SELECT number, first, last, md5(array_to_string(list_transform(range(first, last + 1), lambda i: i || ': ' || x[i]), chr(10))) AS md5 FROM w""", "docs"),
    "evidence_budget": "WITH RECURSIVE docs AS (" + VIEWS["docs"] + """), s AS (SELECT number // 16 AS issue_id, row_number() OVER (PARTITION BY number // 16 ORDER BY number) AS k, number AS rank, body AS content FROM docs WHERE body <> ''),
      f AS (SELECT DISTINCT issue_id, 0::BIGINT AS k, 0::BIGINT AS rank, 4000::BIGINT AS room, 0::BIGINT AS used FROM s
        UNION ALL SELECT issue_id, k, rank, room - u, u FROM (SELECT s.issue_id, s.k, s.rank, f.room, CASE WHEN f.room <= 0 THEN 0 WHEN length(content) > f.room THEN length(rtrim(left(content, f.room), chr(32) || chr(9) || chr(13) || chr(10))) ELSE length(content) END::BIGINT AS u FROM f JOIN s ON s.issue_id = f.issue_id AND s.k = f.k + 1) q)
      SELECT issue_id, 'E' || row_number() OVER (PARTITION BY issue_id ORDER BY rank) AS id, rank, used AS chars FROM f WHERE used > 0""",
    "evidence_coverage": with_views("SELECT page_id, CASE WHEN NOT (page_id % 5 = 2 OR (page_id % 5 >= 3 AND page_id % 7 = 2)) THEN 'evidence_observation_coverage' END AS problem FROM urls", "urls"),
    "alignment_contradictions": "SELECT conv_id, coalesce(string_agg('E' || turn || ': ' || role, '|' ORDER BY turn) FILTER (length(text) % 3 = 0), '') AS contradictions FROM conversations GROUP BY conv_id",
    "unique_symbol_names": with_views("SELECT 'fn_' || (symbol_id * file_id % 90001) AS name FROM symbols GROUP BY 1 HAVING count(*) = 1", "symbols"),
    "enclosing_symbol": with_views("WITH e AS (SELECT file_id, symbol_id, end_line - line AS s FROM symbols WHERE 20 BETWEEN line AND end_line), m AS (SELECT file_id, min(s) AS s FROM e GROUP BY file_id) SELECT file_id, min(symbol_id) AS symbol_id FROM e JOIN m USING (file_id, s) GROUP BY file_id HAVING count(*) = 1", "symbols"),
    "symbol_argmax": with_views("SELECT file_id, symbol_id FROM symbols QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY end_line - line DESC, line, symbol_id) = 1", "symbols"),
    "related_callers": with_views("SELECT file_id, target_symbol, count(DISTINCT caller) AS callers, CAST(sum(o) AS BIGINT) AS relation_score FROM (SELECT DISTINCT file_id, caller, target_symbol, CAST(caller AS INT) % 3 + 1 AS o FROM fcalls WHERE caller <> target_symbol AND CAST(caller AS INT) % 3 + 1 >= 2) GROUP BY ALL HAVING count(DISTINCT caller) >= 2", "fcalls"),
    "answer_field_paths": with_views("""WITH p AS (SELECT id, unnest(CASE WHEN id % 17 = 0 THEN [{'f': '', 'k': 'invalid_json'}] ELSE list_filter([
        CASE WHEN a IN (1, 2) THEN {'f': 'summary', 'k': 'type_error'} END, CASE b WHEN 0 THEN {'f': 'extra', 'k': 'extra_forbidden'} WHEN 1 THEN {'f': 'score', 'k': 'type_error'} WHEN 4 THEN {'f': 'score', 'k': 'missing'} END,
        CASE WHEN b = 0 THEN {'f': 'score', 'k': 'missing'} END, CASE c WHEN 0 THEN {'f': 'items.1.id', 'k': 'type_error'} WHEN 1 THEN {'f': 'items.1', 'k': 'type_error'} END,
        CASE WHEN c = 0 THEN {'f': 'items.1.m', 'k': 'extra_forbidden'} END, CASE WHEN c = 0 THEN {'f': 'items.1.n', 'k': 'missing'} END], lambda x: x IS NOT NULL) END) AS x FROM answers)
      SELECT id, count(*) AS problems, string_agg(DISTINCT x.k, ',' ORDER BY x.k) AS classes, array_to_string(list_sort(list(DISTINCT x.f))[:5], ',') AS fields FROM p GROUP BY id""", "answers"),
}
