"""Queries: sources that hold an issue's names and words, typed relations with their gates, and symbols chosen in tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.operators import choice, content, paths
from quarryline.operators import graph as G
from quarryline.plans.adapters import VIEWS, adapter, with_views
from quarryline.plans.graphs import _SEED

VIEWS["source_texts"] = """
SELECT concat('d', CAST(doc_id AS VARCHAR(20)), CASE WHEN doc_id % 3 = 0 THEN '.ts' ELSE '.py' END) AS path,
       concat(text, chr(10), 'use mod', CAST(doc_id % 7 AS VARCHAR(9)), '.load and part_', CAST(doc_id % 11 AS VARCHAR(9)), CASE WHEN doc_id % 4 = 0 THEN '$' WHEN doc_id % 4 = 1 THEN '.' ELSE '' END) AS content
FROM documents"""
VIEWS["item_words"] = "SELECT item_id, lower(text) AS text, length(text) AS n FROM benchmark"
VIEWS["edge_cases"] = "SELECT p_partkey AS id, p_partkey % 13 AS l, p_size % 13 AS r, p_partkey % 2 = 0 AS script FROM part"
VIEWS["tmarks"] = "SELECT concat('f', CAST(p_partkey AS VARCHAR(20))) AS path, p_partkey AS k, p_partkey % 9 = 0 AS test_file, p_partkey % 9 = 0 OR p_partkey % 14 = 0 AS auxiliary, p_partkey % 9 <> 0 AND p_partkey % 14 <> 0 AS production, p_partkey % 9 <> 0 AND p_partkey % 14 <> 0 AND p_partkey % 5 <> 0 AS concrete FROM part"
VIEWS["tuses"] = """
SELECT DISTINCT concat('f', CAST(l_partkey AS VARCHAR(20))) AS path, CASE WHEN l_linenumber % 3 = 0 THEN 'reference' ELSE 'call' END AS kind,
       CASE l_quantity % 5 WHEN 0 THEN 'parse_header' WHEN 1 THEN 'write_block' WHEN 2 THEN 'io_go' WHEN 3 THEN 'scan_tables' ELSE 'Made.__init__' END AS caller,
       concat('f', CAST(l_suppkey AS VARCHAR(20))) AS target_file,
       CASE l_orderkey % 6 WHEN 0 THEN 'parse_header' WHEN 1 THEN 'write_block' WHEN 2 THEN 'io_go' WHEN 3 THEN 'scan_tables' WHEN 4 THEN 'Made' ELSE 'go' END AS target_symbol, l_linenumber % 4 = 0 AS function_local FROM lineitem"""
VIEWS["timports"] = "SELECT DISTINCT concat('f', CAST(l_partkey AS VARCHAR(20))) AS path, concat('f', CAST(l_suppkey AS VARCHAR(20))) AS target_path, l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_partkey <> l_suppkey"
VIEWS["tclasses"] = "SELECT concat('f', CAST(p_partkey AS VARCHAR(20))) AS path, 'Made' AS name, 'Made' AS qualified_name, CASE WHEN p_partkey % 3 = 0 THEN 'function' ELSE 'class' END AS kind FROM part"
VIEWS["tfunctions"] = "SELECT DISTINCT concat('f', CAST(l_partkey AS VARCHAR(20))) AS path, concat('evict', CAST(l_linenumber % 3 AS VARCHAR(9)), '_x', CAST(l_suppkey % 6 AS VARCHAR(9))) AS name FROM lineitem"
VIEWS["tcalls"] = "SELECT DISTINCT concat('f', CAST(l_partkey AS VARCHAR(20))) AS path, l_partkey AS k, CASE WHEN l_linenumber % 4 <> 0 THEN concat('caller_', CAST(l_partkey AS VARCHAR(20))) END AS caller, concat('lib.fn', CAST(l_orderkey AS VARCHAR(20))) AS target, l_orderkey AS o FROM lineitem"
VIEWS["tbound"] = "SELECT DISTINCT concat('f', CAST(l_partkey AS VARCHAR(20))) AS path, concat('p', CAST(l_suppkey % 40 AS VARCHAR(20)), '/__init__.py') AS facade, concat('f', CAST(l_suppkey % 300 AS VARCHAR(20))) AS source, concat('Name', CAST(l_linenumber AS VARCHAR(9))) AS symbol, l_orderkey % 5 <> 0 AS read FROM lineitem"
VIEWS["tmatches"] = """
SELECT l_suppkey AS issue_id, concat('f', CAST(l_partkey AS VARCHAR(20))) AS path, l_orderkey * 8 + l_linenumber AS symbol_id, CASE WHEN l_linenumber % 5 = 0 THEN 'class' ELSE 'function' END AS kind, CAST(l_quantity AS INT) AS line,
       l_orderkey % 17 = 0 AS scoped_match, l_orderkey % 19 = 0 AS qualified_match, l_orderkey % 7 = 0 AS explicit_match, l_orderkey % 5 = 0 AS unscoped_explicit, l_orderkey % 6 = 0 AS unscoped_dotted, l_orderkey % 8 = 0 AS primary_match,
       l_orderkey % 3 = 0 AS local_match, l_orderkey % 4 = 0 AS component_match, l_orderkey % 2 AS mentioned, l_orderkey % 4 AS shared, l_orderkey % 3 AS locals, CAST(l_orderkey % 23 AS INT) AS frame_at, CAST(l_orderkey % 29 AS INT) AS line_at, CAST(l_orderkey % 31 AS INT) AS text_at,
       l_orderkey % 11 AS w, concat(CASE WHEN l_orderkey % 2 = 0 THEN '_' ELSE '' END, 'fn_', CAST(l_orderkey AS VARCHAR(20))) AS name FROM lineitem"""

#: Characters around a name, and whether they go on it in a name and in an ECMAScript name.
AROUND = (("", False, False), (" ", False, False), ("_", True, True), ("$", False, True), (".", False, False), ("\u00e9", True, True), ("7", True, True), ("\u200d", True, True), ("-", False, False), ("\u00b7", True, True), ("\u2e2f", False, False), ("\u309b", False, True), ("\u4e2d", True, True))


def content_hits(spark, sf_dir):
    """Every document as a source, every benchmark item as an issue with a few identifiers and its words."""
    files = adapter(spark, sf_dir, "source_texts").withColumn("repository", F.lit("r"))
    items = adapter(spark, sf_dir, "item_words")
    part, mod = F.concat(F.lit("part_"), (F.col("n") % 11).cast("string")), F.concat(F.lit("mod"), (F.col("n") % 7).cast("string"), F.lit(".load"))
    issues = items.select(F.col("item_id").alias("issue_id"), F.lit("r").alias("repository"), F.array(part, mod).alias("identifiers"), F.array(F.regexp_extract("text", "[a-z]{7,}", 0)).alias("explicit_identifiers"), F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]{4,}"), F.lit(0))).alias("content_terms"))
    return content.content_hits(issues, files).select("issue_id", "path", F.array_join("identifiers", ",").alias("identifiers"), F.array_join("words", ",").alias("words"), "line")


def identifier_boundaries(spark, sf_dir):
    """Names between any two characters, in Python and in TypeScript sources: whether the index finds them."""
    rows = adapter(spark, sf_dir, "edge_cases")
    pick = lambda c: F.element_at(F.array(*[F.lit(x[0]) for x in AROUND]), (F.col(c) + 1).cast("int"))
    path = F.concat(F.lit("e"), F.col("id").cast("string"), F.when(F.col("script"), ".ts").otherwise(".py"))
    files = rows.select("id", "l", "r", "script", path.alias("path"), F.concat(F.lit("x "), pick("l"), F.lit("Some_Name"), pick("r"), F.lit(" y")).alias("content")).withColumn("repository", F.lit("r"))
    issue = spark.range(1).select(F.col("id").alias("issue_id"), F.lit("r").alias("repository"), F.array(F.lit("some_name")).alias("identifiers"), F.array().cast("array<string>").alias("explicit_identifiers"))
    hits = content.identifier_hits(issue, content.name_postings(files)).select("path", F.lit(True).alias("hit"))
    return files.join(hits, "path", "left").select("id", "l", "r", "script", F.coalesce("hit", F.lit(False)).alias("hit"))


def _seeds(spark, sf_dir):
    return G.graph_seeds(adapter(spark, sf_dir, "scored")).select("issue_id", F.concat(F.lit("f"), F.col("file_id").cast("string")).alias("file_id"))


def _issues(seeds):
    kinds = F.array(F.array(F.lit("header")), F.array(F.lit("block"), F.lit("io")), F.array(F.lit("tab")))
    return seeds.select("issue_id").distinct().withColumn("primary_terms", F.get(kinds, (F.col("issue_id") % 3).cast("int")))


def _index(spark, sf_dir):
    return {"uses": adapter(spark, sf_dir, "tuses"), "imports": adapter(spark, sf_dir, "timports"), "symbols": adapter(spark, sf_dir, "tclasses")}


def typed_imports(spark, sf_dir):
    seeds = _seeds(spark, sf_dir)
    return paths.one_step(seeds, _issues(seeds), _index(spark, sf_dir), adapter(spark, sf_dir, "tmarks"))


def typed_chains(spark, sf_dir):
    seeds = _seeds(spark, sf_dir)
    return paths.two_steps(seeds, _issues(seeds), _index(spark, sf_dir), adapter(spark, sf_dir, "tmarks"))


def title_importers(spark, sf_dir):
    """Files have a scope word by their number, titles one of those and a word of functions."""
    word = lambda w, c, k: F.concat(F.lit(w), (F.col(c) % k).cast("string"))
    marked = adapter(spark, sf_dir, "tmarks").withColumn("scope", F.array(word("alpha", "k", 4)))
    issues = adapter(spark, sf_dir, "scored").select("issue_id").distinct().withColumn("title_text_terms", F.array(word("alpha", "issue_id", 4), word("evict", "issue_id", 3)))
    symbols = adapter(spark, sf_dir, "tfunctions").select("path", "name", F.col("name").alias("qualified_name"), F.lit("function").alias("kind"))
    return paths.importers(issues, {"symbols": symbols, "imports": adapter(spark, sf_dir, "timports").where("(a + b) % 151 = 0")}, marked)


def shared_call_gates(spark, sf_dir):
    """Every issue names the calls of even orders that its seeds have, and every other caller."""
    seeds = _seeds(spark, sf_dir)
    calls = adapter(spark, sf_dir, "tcalls")
    met = seeds.join(calls.withColumnRenamed("path", "file_id"), "file_id")
    names = met.where("o % 2 = 0").select("issue_id", F.col("target").alias("name")).unionByName(met.where("(k + issue_id) % 2 = 0 AND caller IS NOT NULL").select("issue_id", F.col("caller").alias("name")))
    issues = names.groupBy("issue_id").agg(F.collect_set("name").alias("explicit_identifiers")).withColumn("primary_identifiers", F.array().cast("array<string>"))
    symbols = calls.where("caller IS NOT NULL AND k % 3 <> 0").select("path", F.col("caller").alias("name"), F.col("caller").alias("qualified_name"), F.lit("function").alias("kind")).distinct()
    return paths.shared_calls(seeds, issues, {"external": calls.select("path", "caller", "target"), "symbols": symbols}, adapter(spark, sf_dir, "tmarks"))


def facade_gates(spark, sf_dir):
    """Files import names from facades, which have them from files; a file's subsystem is its number modulo 3."""
    seeds = _seeds(spark, sf_dir)
    rows = adapter(spark, sf_dir, "tbound")
    marked = adapter(spark, sf_dir, "tmarks").select("path", "auxiliary", F.array((F.col("k") % 3).cast("string")).alias("subsystem"))
    marked = marked.unionByName(rows.select(F.col("facade").alias("path")).distinct().select("path", F.lit(False).alias("auxiliary"), F.array(F.lit("x")).alias("subsystem")))
    own = rows.select("path", F.col("facade").alias("target_path"), "symbol")
    forwarded = rows.where("read").select(F.col("facade").alias("path"), F.col("source").alias("target_path"), "symbol")
    defined = rows.select(F.col("source").alias("path"), F.col("symbol").alias("name"), F.col("symbol").alias("qualified_name")).distinct().where("qualified_name <> 'Name3'").unionByName(rows.select(F.col("facade").alias("path"), F.lit("Name2").alias("name"), F.lit("Name2").alias("qualified_name")).distinct().where("path LIKE 'p1%'"))
    index = {"bound": own.unionByName(forwarded), "symbols": defined, "names": rows.where("read").select("path", F.col("symbol").alias("value"))}
    referenced = seeds.where("issue_id % 4 <> 0").select("issue_id", F.col("file_id").alias("path"))
    return paths.reexports(seeds, referenced, index, marked)


def symbol_tiers(spark, sf_dir):
    """Made-up matches of every kind: which symbol is chosen, and by which tier."""
    rows = adapter(spark, sf_dir, "tmatches")
    some = lambda n: F.transform(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>")), lambda x: x.cast("string"))
    at = lambda c: F.when(F.col(c).between(1, 2), F.col(c))
    rows = rows.withColumns({"overlap": some(F.col("shared")), "local_overlap": some(F.col("locals")), "told": F.filter(F.array(F.concat(F.lit("t"), F.col("w").cast("string"))), lambda x: x != "t0"), "title_strength": F.when(F.col("w") == 7, 0.5).otherwise(0.0), "frame": at("frame_at"), "source_line": at("line_at"), "snippet": at("text_at"), "constructor": F.lit(None).cast("int"), "identity": F.col("name"), "end_line": F.col("line")})
    counts = rows.where("kind = 'function'").select("path", F.explode("told").alias("term")).groupBy("path", "term").agg(F.count("*").alias("n"))
    related = rows.where("w = 9").select("issue_id", "path", "identity").distinct().withColumns({"callers": F.array(F.lit("a"), F.lit("b")), "relation_score": F.lit(4).cast("long")})
    return choice.choose(rows, counts, related).select("issue_id", "path", "symbol_id", "tier")


def range_unique_names(spark, sf_dir):
    """Names borne once among the first files of each case."""
    symbols = adapter(spark, sf_dir, "symbols").select(F.col("file_id").alias("path"), "name", F.lit("function").alias("kind"))
    shown = adapter(spark, sf_dir, "ranked").where("rank <= 3").select(F.col("case_id").alias("issue_id"), F.col("file_id").alias("path"))
    return choice.unique_in_files(symbols, shown)


QUERIES = {f.__name__: f for f in (content_hits, identifier_boundaries, typed_imports, typed_chains, title_importers, shared_call_gates, facade_gates, symbol_tiers, range_unique_names)}

_ENDS = r"[^\p{L}\p{M}\p{N}_]"
_IS = "CASE s WHEN 'parse_header' THEN i % 3 = 0 WHEN 'write_block' THEN i % 3 = 1 WHEN 'io_go' THEN i % 3 = 1 ELSE false END"
_SPECIAL = "CASE s WHEN 'parse_header' THEN i % 3 = 0 WHEN 'write_block' THEN i % 3 = 1 ELSE false END"


def _is(symbol: str, issue: str, rule: str = _IS) -> str:
    return "(" + rule.replace("CASE s", f"CASE {symbol}").replace("i %", f"{issue} %") + ")"


_START = f"{_SEED}, seeds AS (SELECT issue_id, 'f' || file_id AS path FROM sd)"

ORACLE = {
    "content_hits": with_views(rf"""WITH i AS (SELECT item_id, 'part_' || n % 11 AS pn, 'mod' || n % 7 || '.load' AS md, regexp_extract(text, '[a-z]{{7,}}') AS w, list_distinct(regexp_extract_all(text, '[a-z]{{4,}}')) AS words FROM item_words),
      names AS (SELECT item_id, pn AS id, pn AS token, false AS dotted FROM i UNION SELECT item_id, pn, 'part', false FROM i UNION SELECT item_id, md, md, true FROM i UNION SELECT item_id, w, w, false FROM i WHERE length(w) > 0),
      l AS (SELECT path, path LIKE '%.ts' AS ts, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM source_texts WHERE content IS NOT NULL),
      k AS (SELECT path, pos, false AS dotted, unnest(CASE WHEN ts THEN regexp_extract_all(lower(line), '[$_\p{{L}}\p{{M}}\p{{N}}]+') ELSE regexp_extract_all(lower(line), '[_\p{{L}}\p{{M}}\p{{N}}]+') END) AS token FROM l
        UNION ALL SELECT path, pos, true, unnest(CASE WHEN ts THEN regexp_extract_all(line, '[.$_\p{{L}}\p{{M}}\p{{N}}]+') ELSE regexp_extract_all(line, '[._\p{{L}}\p{{M}}\p{{N}}]+') END) FROM l),
      h AS (SELECT item_id, path, string_agg(DISTINCT id, ',' ORDER BY id) AS ids, min(pos) AS line FROM names JOIN k USING (token, dotted) GROUP BY item_id, path),
      f AS (SELECT item_id, path, array_to_string(list_sort(list_filter(words, lambda x: contains(low, x))), ',') AS ws FROM i, (SELECT path, lower(content) AS low FROM source_texts WHERE content IS NOT NULL))
      SELECT item_id AS issue_id, path, coalesce(ids, '') AS identifiers, ws AS words, line FROM f LEFT JOIN h USING (item_id, path) WHERE ids IS NOT NULL OR ws <> ''""", "source_texts", "item_words"),
    "identifier_boundaries": with_views(f"""WITH c(k, name, script_name) AS (VALUES {", ".join(f"({k}, {str(n).lower()}, {str(s).lower()})" for k, (_, n, s) in enumerate(AROUND))})
      SELECT id, l, r, script, NOT (CASE WHEN script THEN a.script_name OR b.script_name ELSE a.name OR b.name END) AS hit FROM edge_cases JOIN c a ON a.k = l JOIN c b ON b.k = r""", "edge_cases"),
    "typed_imports": with_views(f"""WITH {_START}, u AS (SELECT path, target_file, kind, target_symbol, function_local FROM tuses WHERE path <> target_file),
      e AS (SELECT s.issue_id AS i, m.path, m.target_path AS t, k.test_file AS tf FROM seeds s JOIN timports m USING (path) JOIN tmarks k ON k.path = m.path JOIN tmarks g ON g.path = m.target_path WHERE NOT g.test_file),
      c AS (SELECT i, e.path, t, tf, list_sort(list_distinct(list(target_symbol) FILTER (kind = 'call'))) AS cs, list_sort(list_distinct(list(target_symbol) FILTER (kind = 'reference'))) AS rs, bool_and(function_local) FILTER (kind = 'call') AS loc,
        coalesce(bool_or({_is("target_symbol", "i")}) FILTER (kind = 'call'), false) AS ch, coalesce(bool_or({_is("target_symbol", "i")}) FILTER (kind = 'reference'), false) AS rh FROM e LEFT JOIN u ON u.path = e.path AND u.target_file = t GROUP BY i, e.path, t, tf),
      k AS (SELECT *, CASE WHEN tf THEN 'test_import' WHEN len(cs) > 0 AND loc THEN 'function_local' WHEN len(cs) > 0 THEN 'call' WHEN len(rs) > 0 THEN 'reference' ELSE 'import' END AS kind FROM c)
      SELECT DISTINCT i AS issue_id, t AS file_id, kind, CAST(CASE kind WHEN 'test_import' THEN 3.5 WHEN 'function_local' THEN 4.5 WHEN 'call' THEN CASE WHEN ch THEN 9 ELSE 8 END WHEN 'reference' THEN CASE WHEN rh THEN 8 ELSE 6 END ELSE 0.75 END AS DOUBLE) AS bonus,
        CASE WHEN kind IN ('call', 'function_local') THEN array_to_string(cs, ', ') WHEN kind = 'reference' THEN array_to_string(rs, ', ') ELSE path END AS via FROM k""", "scored", "tuses", "timports", "tmarks"),
    "typed_chains": with_views(f"""WITH {_START}, c AS (SELECT * FROM tuses WHERE kind = 'call' AND path <> target_file),
      f AS (SELECT DISTINCT c.path AS seed, target_file AS mid, target_symbol AS callee, function_local, g.concrete AS mc, function_local AND y.path IS NOT NULL AS made FROM c JOIN tmarks s ON s.path = c.path AND NOT s.test_file JOIN tmarks g ON g.path = target_file AND NOT g.test_file LEFT JOIN tclasses y ON y.path = target_file AND y.qualified_name = target_symbol AND y.kind = 'class'),
      n AS (SELECT DISTINCT c.path AS mid, caller, target_file AS t, target_symbol, g.concrete AS tc FROM c JOIN tmarks g ON g.path = target_file AND NOT g.test_file WHERE length(target_symbol) >= 5 AND NOT function_local),
      m AS (SELECT s.issue_id AS i, f.*, n.t, n.target_symbol, n.tc, {_is("n.target_symbol", "s.issue_id")} AS hit FROM seeds s JOIN f ON f.seed = s.path JOIN n ON n.mid = f.mid AND (n.caller = f.callee OR (f.made AND n.caller = f.callee || '.__init__')) WHERE n.t <> f.seed AND n.t <> f.mid)
      SELECT DISTINCT i AS issue_id, t AS file_id, CASE WHEN function_local THEN 'function_local_two_hop' ELSE 'two_hop' END AS kind, CASE WHEN hit THEN 9.0::DOUBLE ELSE 5.0 END AS bonus, target_symbol AS via FROM m
      UNION SELECT i, t, 'strong_two_hop', CASE WHEN hit THEN 9.0::DOUBLE ELSE 8.0 END, callee || ' reaches ' || target_symbol || ', defined here: ' || mid FROM m WHERE NOT function_local AND mc AND tc AND {_is("callee", "i", _SPECIAL)}""", "scored", "tuses", "tclasses", "tmarks"),
    "title_importers": with_views("""WITH i AS (SELECT DISTINCT issue_id FROM scored), m AS (SELECT * FROM tmarks WHERE production), s AS (SELECT issue_id, path FROM i JOIN m ON k % 4 = issue_id % 4),
      t AS (SELECT s.issue_id, s.path, name FROM s JOIN tfunctions f USING (path) WHERE starts_with(name, 'evict' || s.issue_id % 3 || '_')), o AS (SELECT issue_id, path, list_sort(list(DISTINCT name)) AS a FROM t GROUP BY ALL HAVING count(DISTINCT name) >= 2),
      e AS (SELECT o.issue_id, o.path, o.a, list_distinct(list(g.path)) AS im FROM o JOIN timports g ON g.target_path = o.path AND (g.a + g.b) % 151 = 0 JOIN s ON s.issue_id = o.issue_id AND s.path = g.path GROUP BY ALL)
      SELECT issue_id, unnest(im) AS file_id, 'reverse_import' AS kind, 5 + least(2.0::DOUBLE, 0.5::DOUBLE * (len(a) - 2)) AS bonus, path || ': ' || array_to_string(a[:3], ', ') || CASE WHEN len(a) > 3 THEN ' (+' || (len(a) - 3) || ' more)' ELSE '' END AS via FROM e WHERE len(im) <= 3""", "scored", "tmarks", "tfunctions", "timports"),
    "shared_call_gates": with_views(f"""WITH {_START}, c AS (SELECT path, k, o, caller, target FROM tcalls SEMI JOIN (SELECT path FROM tmarks WHERE NOT auxiliary) USING (path)), f AS (SELECT target FROM c GROUP BY 1 HAVING count(DISTINCT path) IN (2, 3)), d AS (SELECT * FROM c SEMI JOIN f USING (target) WHERE caller IS NOT NULL),
      o AS (SELECT path, target, string_agg(DISTINCT caller, ', ' ORDER BY caller) AS cs FROM d GROUP BY ALL)
      SELECT DISTINCT s.issue_id, o.path AS file_id, 'shared_call' AS kind, 5.0::DOUBLE AS bonus, d.target || ' with ' || d.caller || ' in ' || d.path || ': ' || cs AS via FROM seeds s JOIN d USING (path) JOIN o ON o.target = d.target AND o.path <> d.path WHERE d.o % 2 = 0 AND (d.k + issue_id) % 2 = 0 AND d.k % 3 <> 0""", "scored", "tmarks", "tcalls"),
    "facade_gates": with_views(f"""WITH {_START}, ok AS (SELECT path, k % 3 AS g FROM tmarks WHERE NOT auxiliary),
      w AS (SELECT DISTINCT facade, source, symbol FROM tbound WHERE read AND symbol <> 'Name3' AND NOT (symbol = 'Name2' AND starts_with(facade, 'p1'))),
      r AS (SELECT DISTINCT issue_id, b.path, b.symbol, w.source, w.facade FROM seeds s JOIN tbound b USING (path) JOIN ok a ON a.path = b.path JOIN w ON w.facade = b.facade AND w.symbol = b.symbol JOIN ok t ON t.path = w.source
        WHERE issue_id % 4 <> 0 AND t.g = a.g AND w.source <> b.path AND (b.path, b.symbol) IN (SELECT (path, symbol) FROM tbound WHERE read)),
      o AS (SELECT issue_id, path, symbol, any_value(source) AS source, any_value(facade) AS facade FROM r GROUP BY issue_id, path, symbol HAVING count(*) = 1)
      SELECT DISTINCT issue_id, source AS file_id, 'reexport' AS kind, 7.0::DOUBLE AS bonus, string_agg(symbol, ', ' ORDER BY symbol) || ' via ' || facade AS via FROM o GROUP BY issue_id, path, source, facade""", "scored", "tmarks", "tbound"),
    "symbol_tiers": with_views("""WITH n AS (SELECT path, w, count(*) AS n FROM tmatches WHERE kind = 'function' AND w <> 0 GROUP BY ALL),
      m AS (SELECT t.*, CASE WHEN kind = 'function' THEN coalesce(1 / n.n, 0) ELSE 0 END AS rare, CASE WHEN t.w = 9 THEN 4 ELSE 0 END AS rel, CASE WHEN t.w = 7 THEN 0.5 ELSE 0 END AS title, CASE WHEN frame_at IN (1, 2) THEN frame_at END AS f, CASE WHEN line_at IN (1, 2) THEN line_at END AS s, CASE WHEN text_at IN (1, 2) THEN text_at END AS x, unscoped_explicit OR unscoped_dotted AS un FROM tmatches t LEFT JOIN n ON n.path = t.path AND n.w = t.w),
      d AS (SELECT *, kind = 'function' AND (scoped_match OR qualified_match OR f IS NOT NULL OR s IS NOT NULL OR x IS NOT NULL) AS direct FROM m),
      k AS (SELECT *, row_number() OVER (PARTITION BY issue_id, path ORDER BY direct DESC, f IS NOT NULL DESC, coalesce(f, -1) DESC, s IS NOT NULL DESC, coalesce(s, 1000000), x IS NOT NULL DESC, coalesce(x, 1000000), qualified_match DESC, mentioned DESC, explicit_match DESC, scoped_match DESC, primary_match DESC, locals DESC, component_match DESC, line, symbol_id) AS a,
        row_number() OVER (PARTITION BY issue_id, path ORDER BY kind = 'function' DESC, rel DESC, title DESC, rare DESC, unscoped_explicit DESC, NOT starts_with(name, '_') DESC, component_match DESC, line, locals DESC, symbol_id) AS b,
        row_number() OVER (PARTITION BY issue_id, path ORDER BY primary_match DESC, qualified_match DESC, (local_match AND NOT un) DESC, CASE WHEN un THEN 0 ELSE locals END DESC, component_match DESC, line, symbol_id) AS c,
        bool_or(direct) OVER (PARTITION BY issue_id, path) AS dd, bool_or(kind = 'function' AND (rel > 0 OR title > 0 OR rare > 0)) OVER (PARTITION BY issue_id, path) AS tt FROM d)
      SELECT issue_id, path, symbol_id, CASE WHEN dd THEN 'direct' WHEN tt THEN 'semantic' ELSE 'fallback' END AS tier FROM k WHERE CASE WHEN dd THEN a = 1 WHEN tt THEN b = 1 ELSE c = 1 AND (primary_match OR (local_match AND NOT un) OR (shared > 0 AND NOT un)) END""", "tmatches"),
    "range_unique_names": with_views("SELECT case_id AS issue_id, name FROM ranked JOIN symbols USING (file_id) WHERE rank <= 3 GROUP BY case_id, name HAVING count(*) = 1", "ranked", "symbols"),
}
