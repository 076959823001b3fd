"""Queries: the code index over generated Python sources, one for each .py file of the files view."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import codeindex as C
from quarryline.operators import symbols as S
from quarryline.operators.tables import stored
from quarryline.plans.adapters import VIEWS, adapter, with_views

VIEWS["module_files"] = """
SELECT concat('pkg', CAST(p_partkey % 40 AS VARCHAR(9)), '/mod', CAST(p_partkey AS VARCHAR(9)), '.py') AS path, CAST(p_partkey % 40 AS VARCHAR(9)) AS g, CAST(p_partkey AS VARCHAR(9)) AS k, false AS part FROM part
UNION ALL SELECT concat('pkg', CAST(p_partkey % 40 AS VARCHAR(9)), '/mod', CAST(p_partkey AS VARCHAR(9)), '/deep.py'), 'x', 'x', true FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT DISTINCT concat('pkg', CAST(p_partkey % 40 AS VARCHAR(9)), '/twin.py'), 'x', 'x', true FROM part
UNION ALL SELECT DISTINCT concat('pkg', CAST(p_partkey % 40 AS VARCHAR(9)), '/twin/__init__.py'), 'x', 'x', true FROM part WHERE p_partkey % 40 < 20"""
VIEWS["nested_files"] = """
SELECT concat(CASE p_partkey % 9 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src/tests/unit/test/' WHEN 2 THEN 'node_modules/tests/' WHEN 3 THEN 'testing/' WHEN 4 THEN 'latests/' WHEN 5 THEN concat('lib', CAST(p_size AS VARCHAR(9)), '/test/') ELSE 'src/' END,
              'f', CAST(p_partkey AS VARCHAR(20)), '.py') AS path, p_partkey % 9 AS d, p_size AS n FROM part"""
VIEWS["twin_files"] = "SELECT concat('src/a', CAST(p_partkey % 7 AS VARCHAR(9)), '/f', CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS VARCHAR(20)), '.py') AS path, p_partkey AS k FROM part"
VIEWS["path_references"] = """
SELECT CASE p_partkey % 6 WHEN 0 THEN concat('src/a', CAST(p_partkey % 7 AS VARCHAR(9)), '/f', CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS VARCHAR(20)), '.py') WHEN 1 THEN concat('/home/me/SRC/a', CAST(p_partkey % 7 AS VARCHAR(9)), '/f', CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS VARCHAR(20)), '.py')
         WHEN 2 THEN concat('a', CAST(p_partkey % 7 AS VARCHAR(9)), '/f', CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS VARCHAR(20)), '.py') WHEN 3 THEN concat('f', CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS VARCHAR(20)), '.py') WHEN 4 THEN concat('./src/b/f', CAST(p_partkey AS VARCHAR(20)), '.py') ELSE concat('x/../src/a', CAST(p_partkey % 7 AS VARCHAR(9)), '/f', CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS VARCHAR(20)), '.py') END AS reference,
       p_partkey AS k, p_partkey % 6 AS sort FROM part"""


def sources(spark, sf_dir):
    """Each file imports a framework and its neighbour's function, which it calls."""
    files = adapter(spark, sf_dir, "files").withColumn("m", X.python_module(F.col("path"), F.array(F.lit("src"))))
    other = files.select((F.col("file_id") + 1).alias("file_id"), F.col("m").alias("neighbour"))
    rows = files.join(other, "file_id", "left")
    content = F.concat(
        F.element_at(F.array(*map(F.lit, ("import fastapi\n", "from flask import Flask\n", "import os\n"))), (F.col("weight") % 3 + 1).cast("int")),
        F.coalesce(F.concat(F.lit("from "), F.col("neighbour"), F.lit(" import fn as g\n")), F.lit("")),
        F.lit("def fn(x):\n    return x\n\ndef use(y):\n    return "),
        F.when(F.col("file_id") % 4 == 0, "fn(y)\n").otherwise("g(y)\n"),
    )
    return rows.select("path", content.alias("content"))


def framework_detect(spark, sf_dir):
    return C.frameworks(C.parse_python(sources(spark, sf_dir)))


def test_directories(spark, sf_dir):
    """Folders named test or tests at any depth, in one another too, but not in folders that aren't indexed, nor ones with longer names."""
    return C.test_directories(adapter(spark, sf_dir, "nested_files"))


def import_longest_prefix(spark, sf_dir):
    """Imports of all kinds in a layout of nested packages: of a module and of a symbol in it, of a name whose longer prefix is a module too, of a module of two files, relative ones to the own package and the one above, and ones that lead nowhere or over the top."""
    files = adapter(spark, sf_dir, "module_files")
    asked = files.where("NOT part").select("path", F.explode(F.expr("array(concat('pkg', g, '.mod', k), concat('pkg', g, '.mod', k, '.Thing.part'), concat('pkg', g, '.mod', k, '.deep.Thing'), concat('pkg', g, '.twin.Thing'), concat('.mod', k, '.Thing'), concat('..pkg', g, '.mod', k), concat('....pkg', g), 'nowhere.Thing', concat('pkg', g))")).alias("target"))
    return C.resolve_imports(asked, C.modules(files)).select("path", "target", "target_path", "imported_symbol", "paths")


def resolved_calls(spark, sf_dir):
    files = sources(spark, sf_dir)
    found = C.resolved_uses(stored(C.parse_python(files), "parsed"), C.modules(files))
    return found.where("kind = 'call'").select("path", "caller", "target_file", "target_symbol")


def symbol_table(spark, sf_dir):
    return C.children(C.parse_python(sources(spark, sf_dir)), "symbols").select("path", "qualified_name", "kind", "line", "end_line")


def scoped_paths(spark, sf_dir):
    """References to files by their whole path, from outside, by their end (which several files may have), by a bare name, in capitals with backslashes, and to none."""
    files = adapter(spark, sf_dir, "twin_files")
    return S.scoped_paths(adapter(spark, sf_dir, "path_references"), files.select("path"))


QUERIES = {f.__name__: f for f in (framework_detect, test_directories, import_longest_prefix, resolved_calls, symbol_table, scoped_paths)}


ORACLE = {
    "framework_detect": with_views("SELECT CASE weight % 3 WHEN 0 THEN 'FastAPI' ELSE 'Flask' END AS framework, count(*) AS files FROM files WHERE path LIKE '%.py' AND weight % 3 < 2 AND path NOT LIKE '% %' GROUP BY 1", "files"),
    "test_directories": with_views("SELECT DISTINCT unnest(CASE d WHEN 0 THEN ['tests'] WHEN 1 THEN ['src/tests', 'src/tests/unit/test'] WHEN 5 THEN ['lib' || n || '/test'] ELSE [] END) AS directory FROM nested_files", "nested_files"),
    "import_longest_prefix": with_views("""WITH m AS (SELECT *, 'pkg' || g || '/mod' || k AS b, k::BIGINT % 3 = 0 AS deep, g::BIGINT < 20 AS twin FROM module_files WHERE NOT part)
      SELECT path, 'pkg' || g || '.mod' || k AS target, path AS target_path, NULL AS imported_symbol, 1::BIGINT AS paths FROM m
      UNION ALL SELECT path, 'pkg' || g || '.mod' || k || '.Thing.part', path, 'Thing', 1 FROM m
      UNION ALL SELECT path, 'pkg' || g || '.mod' || k || '.deep.Thing', CASE WHEN deep THEN b || '/deep.py' ELSE path END, CASE WHEN deep THEN 'Thing' ELSE 'deep' END, 1 FROM m
      UNION ALL SELECT path, 'pkg' || g || '.twin.Thing', 'pkg' || g || t, 'Thing', CASE WHEN twin THEN 2 ELSE 1 END FROM m, (VALUES ('/twin.py', false), ('/twin/__init__.py', true)) v(t, second) WHERE twin OR NOT second
      UNION ALL SELECT path, '.mod' || k || '.Thing', path, 'Thing', 1 FROM m
      UNION ALL SELECT path, '..pkg' || g || '.mod' || k, path, NULL, 1 FROM m""", "module_files"),
    "symbol_table": with_views("""WITH s AS (SELECT path, CASE WHEN file_id > (SELECT min(file_id) FROM files) THEN 3 ELSE 2 END AS a FROM files WHERE path LIKE '%.py')
      SELECT path, 'fn' AS qualified_name, 'function' AS kind, a AS line, a + 1 AS end_line FROM s UNION ALL SELECT path, 'use', 'function', a + 3, a + 4 FROM s""", "files"),
    "resolved_calls": with_views("""SELECT path, 'use' AS caller, path AS target_file, 'fn' AS target_symbol FROM files WHERE path LIKE '%.py' AND file_id % 4 = 0
      UNION ALL SELECT f.path, 'use', n.path, 'fn' FROM files f JOIN files n ON n.file_id = f.file_id - 1 WHERE f.path LIKE '%.py' AND n.path LIKE '%.py' AND f.file_id % 4 <> 0""", "files"),
    "scoped_paths": with_views("""WITH f AS (SELECT path, count(*) AS n FROM twin_files GROUP BY path), r AS (SELECT DISTINCT reference, k, sort FROM path_references), w AS (SELECT reference, 'src/a' || k % 7 || '/f' || k // 2 || '.py' AS path, 'f' || k // 2 || '.py' AS name, sort FROM r)
      SELECT DISTINCT reference, w.path FROM w JOIN f USING (path) WHERE n = 1 AND (sort IN (0, 1, 2, 5) OR (sort = 3 AND (SELECT count(*) FROM twin_files t WHERE t.path LIKE '%/' || name) = 1))""", "twin_files", "path_references"),
}
