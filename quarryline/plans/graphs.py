"""Queries: graph relations and rank fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.operators import graph as G
from quarryline.plans.adapters import VIEWS, adapter, with_views

VIEWS["scored"] = "SELECT l_suppkey AS issue_id, l_partkey AS file_id, max(l_quantity) * 0.4 AS score, l_partkey % 7 = 0 AS auxiliary, l_partkey % 13 = 0 AS protected FROM lineitem GROUP BY l_suppkey, l_partkey"
VIEWS["fcalls"] = "SELECT l_partkey AS file_id, CAST(l_linenumber AS VARCHAR(9)) AS caller, l_suppkey AS target_file_id, CAST(l_linenumber % 4 + 1 AS VARCHAR(9)) AS target_symbol, min(l_linenumber) = 7 AS function_local FROM lineitem GROUP BY l_partkey, l_linenumber, l_suppkey"
VIEWS["extcalls"] = "SELECT DISTINCT l_partkey AS file_id, concat('lib.fn', CAST(l_orderkey AS VARCHAR(20))) AS target FROM lineitem"
VIEWS["commits"] = "SELECT DISTINCT l_orderkey AS commit_ord, l_partkey AS file_id FROM lineitem"
VIEWS["relations"] = """
SELECT DISTINCT l_suppkey AS issue_id, l_partkey AS file_id, CASE l_linenumber WHEN 1 THEN 'call' WHEN 2 THEN 'two_hop' WHEN 3 THEN 'history' WHEN 4 THEN 'shared_call' WHEN 5 THEN 'strong_two_hop' WHEN 6 THEN 'reverse_import' ELSE 'function_local' END AS kind,
  CAST(3 + l_quantity % 7 AS DOUBLE) AS bonus, l_orderkey % 50 AS via FROM lineitem"""
LIMIT = 20


def _v(name):
    return lambda spark, sf_dir: adapter(spark, sf_dir, name)


scores, calls, external, commits, relations = map(_v, ("scored", "fcalls", "extcalls", "commits", "relations"))


def seeds(spark, sf_dir):
    return G.graph_seeds(scores(spark, sf_dir))


def graph_seeds(spark, sf_dir):
    return seeds(spark, sf_dir).select("issue_id", "file_id", "seed")


def one_hop_edges(spark, sf_dir):
    return G.one_hop(seeds(spark, sf_dir), calls(spark, sf_dir), scores(spark, sf_dir))


def two_hop_chain(spark, sf_dir):
    return G.two_hop(seeds(spark, sf_dir), calls(spark, sf_dir), scores(spark, sf_dir))


def shared_call_peers(spark, sf_dir):
    return G.shared_calls(seeds(spark, sf_dir), external(spark, sf_dir), scores(spark, sf_dir))


def reverse_imports(spark, sf_dir):
    """Every file imports the one of half its number, which two files do; each scored file has one to four matching functions."""
    matches = scores(spark, sf_dir).select("issue_id", "file_id", F.expr("1 + file_id % 4").alias("n"))
    imports = external(spark, sf_dir).select("file_id", F.floor(F.col("file_id") / 2).alias("target_file_id"))
    return G.reverse_imports(matches, imports, scores(spark, sf_dir))


def reexport_routes(spark, sf_dir):
    imports = calls(spark, sf_dir).select("file_id", "target_file_id", F.col("target_symbol").alias("name"))
    facades = calls(spark, sf_dir).select("file_id", F.col("caller").alias("name"), F.col("target_file_id").alias("source_file_id"))
    return G.reexports(seeds(spark, sf_dir), imports, facades, scores(spark, sf_dir))


def cochange_history(spark, sf_dir):
    return G.history(seeds(spark, sf_dir), commits(spark, sf_dir), scores(spark, sf_dir))


def blame_cochange(spark, sf_dir):
    lines = seeds(spark, sf_dir).where("seed <= 2").join(commits(spark, sf_dir), "file_id").select("issue_id", "file_id", "commit_ord")
    return G.blame(lines, commits(spark, sf_dir), scores(spark, sf_dir))


def relation_top2_bonus(spark, sf_dir):
    return G.relation_bonus(relations(spark, sf_dir))


def final(spark, sf_dir):
    return G.final_scores(scores(spark, sf_dir), relation_top2_bonus(spark, sf_dir))


def reserve_slot(spark, sf_dir):
    return G.reserved(G.base_order(scores(spark, sf_dir)), LIMIT).select("issue_id", "file_id", "rank")


def shortlist(spark, sf_dir):
    return G.reserved(G.base_order(final(spark, sf_dir)), LIMIT)


def banded_rerank(spark, sf_dir):
    return G.banded(shortlist(spark, sf_dir)).select("issue_id", "file_id", "rank")


def expansion_slots(spark, sf_dir):
    return G.expansions(final(spark, sf_dir), shortlist(spark, sf_dir)).select("issue_id", "file_id", "place")


def tail_merge(spark, sf_dir):
    short = shortlist(spark, sf_dir)
    return G.merged(G.banded(short), G.expansions(final(spark, sf_dir), short), LIMIT)


QUERIES = {f.__name__: f for f in (graph_seeds, one_hop_edges, two_hop_chain, shared_call_peers, reverse_imports, reexport_routes, cochange_history, blame_cochange, relation_top2_bonus, reserve_slot, banded_rerank, expansion_slots, tail_merge)}

_SEED = "sd AS (SELECT issue_id, file_id, seed FROM (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY score DESC, auxiliary, file_id) AS seed FROM scored WHERE score >= 4.0) WHERE seed <= 8)"
_POOL = "(issue_id, file_id) IN (SELECT (issue_id, file_id) FROM scored)"
_BON = """cap AS (SELECT *, CASE kind WHEN 'call' THEN least(bonus, 8) WHEN 'two_hop' THEN least(bonus, 5) WHEN 'strong_two_hop' THEN least(bonus, 8) ELSE 0 END AS rr, CASE kind WHEN 'function_local' THEN 0 ELSE bonus END AS ex FROM relations),
bn AS (SELECT issue_id, file_id, least(10.0::DOUBLE, coalesce(list_sum(list_sort(list(rr) FILTER (rr > 0), 'DESC')[:2]), 0)) AS rerank, CAST(coalesce(list_sum(list_sort(list(ex) FILTER (ex > 0), 'DESC')[:2]), 0) AS DOUBLE) AS expansion, max(bonus) AS best, bool_or(kind = 'strong_two_hop') AS strong, bool_or(kind = 'shared_call') AS shared, bool_or(kind = 'reverse_import') AS reverse FROM cap GROUP BY ALL),
fin AS (SELECT s.*, bn.* EXCLUDE (issue_id, file_id), score + coalesce(rerank, 0) AS final FROM scored s LEFT JOIN bn USING (issue_id, file_id)),
ord AS (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY score DESC, auxiliary, file_id) AS rk, protected AND NOT auxiliary AS g FROM fin),
sw AS (SELECT issue_id, min(rk) FILTER (g AND rk > 20) AS late, max(rk) FILTER (NOT g AND rk <= 20) AS last FROM ord GROUP BY issue_id),
sl AS (SELECT ord.*, CASE WHEN rk = late AND last IS NOT NULL THEN last ELSE rk END AS rank FROM ord JOIN sw USING (issue_id) WHERE (rk <= 20 AND NOT (rk = last AND late IS NOT NULL)) OR (rk = late AND last IS NOT NULL))"""

ORACLE = {
    "graph_seeds": with_views(f"WITH {_SEED} SELECT * FROM sd", "scored"),
    "one_hop_edges": with_views(f"""WITH {_SEED}, e AS (SELECT file_id AS via, target_file_id, count(DISTINCT target_symbol) AS n, bool_and(function_local) AS loc FROM fcalls WHERE file_id <> target_file_id GROUP BY ALL),
      r AS (SELECT sd.issue_id, target_file_id AS file_id, CASE WHEN loc THEN 'function_local' ELSE 'call' END AS kind, CASE WHEN loc THEN 4.5::DOUBLE WHEN n >= 2 THEN 9.0::DOUBLE ELSE 8.0 END AS bonus, via FROM sd JOIN e ON via = sd.file_id) SELECT * FROM r WHERE {_POOL}""", "scored", "fcalls"),
    "two_hop_chain": with_views(f"""WITH {_SEED}, st AS (SELECT * FROM fcalls WHERE NOT function_local AND file_id <> target_file_id),
      r AS (SELECT sd.issue_id, b.target_file_id AS file_id, 'two_hop' AS kind, CASE WHEN count(DISTINCT b.target_symbol) >= 2 THEN 9.0::DOUBLE ELSE 5.0 END AS bonus, a.file_id AS via FROM sd JOIN st a ON a.file_id = sd.file_id JOIN st b ON b.file_id = a.target_file_id AND b.caller = a.target_symbol
        WHERE b.target_file_id <> a.file_id GROUP BY sd.issue_id, b.target_file_id, a.file_id) SELECT * FROM r WHERE {_POOL}""", "scored", "fcalls"),
    "shared_call_peers": with_views(f"""WITH {_SEED}, k AS (SELECT target FROM extcalls GROUP BY target HAVING count(*) IN (2, 3)), x AS (SELECT * FROM extcalls SEMI JOIN k USING (target)),
      r AS (SELECT DISTINCT sd.issue_id, b.file_id, 'shared_call' AS kind, 5.0::DOUBLE AS bonus, a.file_id AS via FROM sd JOIN x a ON a.file_id = sd.file_id JOIN x b ON b.target = a.target AND b.file_id <> a.file_id) SELECT * FROM r WHERE {_POOL}""", "scored", "extcalls"),
    "reverse_imports": with_views(f"""WITH j AS (SELECT DISTINCT file_id, file_id // 2 AS via FROM extcalls WHERE file_id <> file_id // 2),
      r AS (SELECT s.issue_id, j.file_id, 'reverse_import' AS kind, 5 + least(2.0::DOUBLE, 0.5::DOUBLE * (s.file_id % 4 - 1)) AS bonus, j.via FROM scored s JOIN j ON j.via = s.file_id WHERE 1 + s.file_id % 4 >= 2) SELECT * FROM r WHERE {_POOL}""", "scored", "extcalls"),
    "reexport_routes": with_views(f"""WITH {_SEED}, f AS (SELECT file_id AS facade, caller AS name, min(target_file_id) AS src FROM fcalls GROUP BY ALL HAVING count(DISTINCT target_file_id) = 1),
      r AS (SELECT DISTINCT sd.issue_id, src AS file_id, 'reexport' AS kind, 7.0::DOUBLE AS bonus, sd.file_id AS via FROM sd JOIN fcalls c USING (file_id) JOIN f ON facade = c.target_file_id AND f.name = c.target_symbol WHERE src <> sd.file_id) SELECT * FROM r WHERE {_POOL}""", "scored", "fcalls"),
    "cochange_history": with_views(f"""WITH {_SEED}, t AS (SELECT DISTINCT issue_id, commit_ord FROM sd JOIN commits USING (file_id)), l AS (SELECT issue_id, commit_ord FROM t QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY commit_ord) <= 50),
      z AS (SELECT commit_ord FROM commits GROUP BY commit_ord HAVING count(*) <= 50), r AS (SELECT issue_id, c.file_id, 'history' AS kind, least(12.0::DOUBLE, 5.0 + count(*)) AS bonus, min(commit_ord) AS via FROM l SEMI JOIN z USING (commit_ord) JOIN commits c USING (commit_ord) WHERE (issue_id, c.file_id) NOT IN (SELECT (issue_id, file_id) FROM sd) GROUP BY issue_id, c.file_id)
      SELECT * FROM r WHERE {_POOL}""", "scored", "commits"),
    "blame_cochange": with_views(f"""WITH {_SEED}, l AS (SELECT DISTINCT issue_id, file_id AS s, commit_ord FROM sd JOIN commits USING (file_id) WHERE seed <= 2), z AS (SELECT commit_ord FROM commits GROUP BY commit_ord HAVING count(*) <= 20),
      r AS (SELECT issue_id, c.file_id, 'blame' AS kind, 10.0::DOUBLE AS bonus, min(commit_ord) AS via FROM l SEMI JOIN z USING (commit_ord) JOIN commits c USING (commit_ord) WHERE c.file_id <> s GROUP BY issue_id, c.file_id) SELECT * FROM r WHERE {_POOL}""", "scored", "commits"),
    "relation_top2_bonus": with_views(f"WITH {_BON} SELECT * FROM bn", "scored", "relations"),
    "reserve_slot": with_views(f"WITH {_BON} SELECT issue_id, file_id, rank FROM sl", "scored", "relations"),
    "banded_rerank": with_views(f"WITH {_BON} SELECT issue_id, file_id, (rank - 1) // 10 * 10 + row_number() OVER (PARTITION BY issue_id, (rank - 1) // 10 ORDER BY final DESC, auxiliary, file_id) AS rank FROM sl", "scored", "relations"),
    "expansion_slots": with_views(f"WITH {_BON} SELECT issue_id, file_id, place FROM (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY strong DESC, shared DESC, reverse DESC, best DESC, final DESC, auxiliary, file_id) AS place FROM fin WHERE expansion >= 5 AND (issue_id, file_id) NOT IN (SELECT (issue_id, file_id) FROM sl)) WHERE place <= 3", "scored", "relations"),
}
