"""Views that give the driver's tables the schemas of the domain, in SQL that Spark and DuckDB share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "issues": """
SELECT o_orderkey AS number,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Data loss in production' WHEN '2-HIGH' THEN 'Crash regression'
            WHEN '3-MEDIUM' THEN 'Wrong source total' WHEN '4-NOT SPECIFIED' THEN 'Release blocker in packaging'
            ELSE 'Improve documentation' END AS title,
       CASE o_orderstatus WHEN 'F' THEN 'Steps to reproduce are attached with a stack trace'
            WHEN 'O' THEN 'A workaround is available'
            ELSE CASE WHEN o_custkey % 5 = 0 THEN 'Actively exploited in the wild' ELSE 'It fails' END END AS body,
       CASE WHEN o_custkey % 3 = 0 THEN 'bug' ELSE 'triage' END AS label,
       CAST(o_custkey % 25 AS INT) AS comments_count, o_orderdate AS created_at, o_orderdate AS updated_at
FROM orders""",
    "docs": "SELECT doc_id AS number, text AS body, lang AS label, source FROM documents",
    "files": """
SELECT p_partkey AS file_id,
       concat(CASE WHEN p_partkey % 7 = 0 THEN 'tests/' WHEN p_partkey % 11 = 0 THEN 'docs/' ELSE 'src/' END,
              lower(p_type), '/', replace(p_name, ' ', '_'), '_', CAST(p_partkey AS VARCHAR(20)),
              CASE WHEN p_size % 5 = 0 THEN '.ts' WHEN p_size % 9 = 0 THEN '.md' ELSE '.py' END) AS path,
       p_size AS weight
FROM part""",
    "calls": "SELECT DISTINCT l_partkey AS file_id, l_linenumber AS caller, l_suppkey AS target_file_id, l_returnflag AS target_symbol FROM lineitem",
    "symbols": """
SELECT l_partkey AS file_id, l_orderkey AS symbol_id, concat('fn_', CAST(l_orderkey % 500 AS VARCHAR(20))) AS name,
       CAST(min(l_quantity) AS INT) AS line, CAST(min(l_quantity) + 10 * min(l_linenumber) AS INT) AS end_line
FROM lineitem GROUP BY l_partkey, l_orderkey""",
    "commit_files": "SELECT DISTINCT l_orderkey AS commit_id, l_partkey AS file_id FROM lineitem",
    "expected": "SELECT DISTINCT l_orderkey AS case_id, l_partkey AS file_id FROM lineitem WHERE l_returnflag = 'R'",
    "ranked": """
SELECT case_id, file_id, row_number() OVER (PARTITION BY case_id ORDER BY x DESC, file_id) AS rank
FROM (SELECT l_orderkey AS case_id, l_partkey AS file_id, max(l_extendedprice) AS x FROM lineitem GROUP BY l_orderkey, l_partkey) q""",
    "cases": "SELECT o_orderkey AS case_id, o_orderpriority AS tier, o_orderstatus <> 'P' AS completed, CASE o_orderstatus WHEN 'P' THEN concat('E', CAST(o_custkey % 4 AS VARCHAR(9))) END AS failure, CAST(o_custkey % 3 + 1 AS INT) AS attempts, o_totalprice AS latency_ms FROM orders",
    "audit_edges": """
SELECT DISTINCT concat('owner/project-', CAST(c.c_nationkey AS VARCHAR(20))) AS repository, l.l_orderkey AS issue_number, l.l_partkey AS pr_number,
       o.o_orderstatus <> 'P' AS merged, o.o_orderdate AS issue_created_at, o.o_custkey % 4 AS n_source_files
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey""",
    "traces": """
SELECT event_id AS id, user_id AS run_id, event_type AS node_name, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
       row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt, value AS elapsed_ms, ts AS started_at, props AS payload
FROM events""",
    "urls": "SELECT page_id, url FROM pages",
}


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the Parquet tables of sf_dir."""
    from_file = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", rf"\1 parquet.`{sf_dir}/\2.parquet`", VIEWS[name])
    return spark.sql(from_file)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL that may use the named views."""
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {head}{sql[4:].join([', ', '']) if sql.startswith('WITH') else ' ' + sql}"
