"""Queries: text, identifier and path functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.plans.adapters import adapter, with_views

_JOIN = lambda c: F.array_join(c, "|")


def _urls(spark, sf_dir):
    return adapter(spark, sf_dir, "urls")


def _docs(spark, sf_dir):
    return adapter(spark, sf_dir, "docs")


def _files(spark, sf_dir):
    return adapter(spark, sf_dir, "files")


def term_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("number", F.size(X.ordered_terms(F.col("body"))).alias("n"), F.md5(_JOIN(X.ordered_terms(F.col("body"))).cast("binary")).alias("terms_md5"))


def camel_split_terms(spark, sf_dir):
    """Words with an inner capital, made of each url's parts."""
    made = F.regexp_replace(F.initcap(F.regexp_replace("url", "[^A-Za-z0-9]+", " ")), " ", "")
    return _urls(spark, sf_dir).select("page_id", _JOIN(X.terms(F.concat(made, F.lit(" HTTPServer ParseURL")))).alias("terms"))


def identifier_variants(spark, sf_dir):
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return _urls(spark, sf_dir).select("page_id", _JOIN(X.identifier_variants(host)).alias("variants"), _JOIN(X.compact_variants(host)).alias("compact"))


def stem_terms(spark, sf_dir):
    words = F.array_distinct(F.regexp_extract_all(F.lower("body"), F.lit("[a-z][a-z0-9]+"), F.lit(0)))
    return _docs(spark, sf_dir).select(F.explode(words).alias("word")).distinct().select("word", X.semantic_term(F.col("word")).alias("stem"))


def title_bigrams(spark, sf_dir):
    """Neighbouring stems of every whole text, as of a title."""
    return _docs(spark, sf_dir).where("body IS NOT NULL").select("number", F.md5(_JOIN(X.bigrams(X.semantic_sequence(F.col("body")))).cast("binary")).alias("bigrams_md5"))


def path_normalize(spark, sf_dir):
    return _files(spark, sf_dir).select("file_id", X.normalize_path(F.concat(F.lit("./"), F.upper("path"), F.lit("//"))).alias("path"))


def path_suffix_scope(spark, sf_dir):
    """References (the last two parts of a path) to the one file they can mean: an equi-join on exploded suffixes."""
    files = _files(spark, sf_dir)
    suffixes = files.select("file_id", F.explode(X.path_suffixes(F.col("path"))).alias("reference"))
    asked = files.select(F.array_join(F.slice(F.split("path", "/"), -1, 1), "/").alias("reference")).distinct()
    found = suffixes.join(asked, "reference").withColumn("n", F.count("*").over(Window.partitionBy("reference")))
    return found.where("n = 1").select("reference", "file_id")


def test_path_flag(spark, sf_dir):
    return _files(spark, sf_dir).select("file_id", X.is_test_path(F.col("path")).alias("is_test"))


def excluded_path_reason(spark, sf_dir):
    return _files(spark, sf_dir).select("file_id", X.excluded_path_reason(F.col("path")).alias("reason"))


def path_term_df(spark, sf_dir):
    """Terms of paths, in how many files, and whether that is specific (3 at most)."""
    terms = _files(spark, sf_dir).select("file_id", F.explode(X.terms(F.col("path"))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("files")).withColumn("specific", F.col("files") <= 3)


def closing_reference(spark, sf_dir):
    word = F.element_at(F.array(*map(F.lit, ("Fixes", "closes:", "see", "Resolved"))), (F.col("page_id") % 4 + 1).cast("int"))
    body = F.concat(word, F.lit(" #"), (F.col("page_id") + F.col("page_id") % 3).cast("string"), F.lit(" in passing"))
    return _urls(spark, sf_dir).select("page_id", X.closing_reference(body, F.col("page_id")).alias("closes"))


def _api(spark, sf_dir):
    """Addresses of an interface: with a repository, with half of one, with /repos/ twice, and of something else."""
    n = F.col("page_id")
    path = F.concat(F.lit("Own"), (n % 9).cast("string"), F.lit("/name-"), n.cast("string"))
    ends = F.when(n % 3 == 0, F.concat(F.lit("/pulls/"), n.cast("string"), F.lit("?x"))).when(n % 3 == 1, F.concat(F.lit("/pull/"), n.cast("string"))).otherwise(F.concat(F.lit("/issues/"), n.cast("string")))
    url = F.when(n % 5 == 1, F.lit("https://api.host/repos/alone")).when(n % 5 == 2, F.concat(F.lit("https://api.host/repos/"), path, F.lit("/repos/x/y"), ends)).when(n % 5 == 3, F.concat(F.lit("https://host/"), path, ends)).otherwise(F.concat(F.lit("https://api.host/repos/"), path, ends))
    return _urls(spark, sf_dir).select("page_id", url.alias("url"))


def api_url_repository(spark, sf_dir):
    return _api(spark, sf_dir).select("page_id", X.api_repository(F.col("url")).alias("repository"))


def url_number(spark, sf_dir):
    return _api(spark, sf_dir).select("page_id", X.pull_number(F.col("url")).alias("number"))


def case_slug(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", X.slug(F.col("url")).alias("slug"))


def file_confidence(spark, sf_dir):
    return _files(spark, sf_dir).select("file_id", X.confidence(F.col("weight") * 0.7).alias("confidence"))


def language_counts(spark, sf_dir):
    return _files(spark, sf_dir).select(X.language(F.col("path")).alias("language")).where("language IS NOT NULL").groupBy("language").agg(F.count("*").alias("files"))


def module_names(spark, sf_dir):
    return _files(spark, sf_dir).where("path LIKE '%.py'").select("file_id", X.python_module(F.col("path"), F.array(F.lit("src"), F.lit("lib"))).alias("module"))


def rank_line_parse(spark, sf_dir):
    """Answers of which some have two lines, unknown, repeated or too many ids."""
    n = F.col("page_id")
    answer = F.concat(F.lit("Thinking.\nRANK: E"), (n % 5 + 1).cast("string"), F.lit(", E2 ,E"), (n % 3 + 1).cast("string"), F.when(n % 7 == 0, "\nRANK: E1").otherwise(""), F.when(n % 11 == 0, ", E9").otherwise(""))
    return _urls(spark, sf_dir).select("page_id", _JOIN(X.rank_line(answer, F.array(*[F.lit(f"E{i}") for i in range(1, 6)]))).alias("ids"))


QUERIES = {f.__name__: f for f in (term_tokens, camel_split_terms, identifier_variants, stem_terms, title_bigrams, path_normalize, path_suffix_scope, test_path_flag, excluded_path_reason, path_term_df, closing_reference, api_url_repository, url_number, case_slug, file_confidence, language_counts, module_names, rank_line_parse)}

_GEN = "(" + ", ".join(f"'{t}'" for t in X.GENERIC_TERMS) + ")"
_CAMEL = lambda e: f"regexp_replace(regexp_replace({e}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
_TERMS = lambda e: f"list_filter(regexp_extract_all(lower({_CAMEL(e)}), '[a-z][a-z0-9]+'), lambda w: w NOT IN {_GEN})"
_STEM0 = lambda w: f"CASE WHEN length({w}) > 5 AND {w} LIKE '%ized' THEN left({w}, length({w}) - 4) WHEN length({w}) > 5 AND {w} LIKE '%ing' THEN left({w}, length({w}) - 3) WHEN length({w}) > 4 AND {w} LIKE '%ed' THEN left({w}, length({w}) - 2) WHEN length({w}) > 5 AND regexp_matches({w}, '(ches|ses|shes|xes|zes)$') THEN left({w}, length({w}) - 2) WHEN length({w}) > 3 AND {w} LIKE '%s' THEN left({w}, length({w}) - 1) ELSE {w} END"
_E = lambda s: f"CASE WHEN length({s}) > 4 AND {s} LIKE '%e' THEN left({s}, length({s}) - 1) ELSE {s} END"

ORACLE = {
    "term_tokens": with_views(f"WITH t AS (SELECT number, {_TERMS('body')} AS w FROM docs) SELECT number, CAST(len(w) AS INT) AS n, md5(array_to_string(w, '|')) AS terms_md5 FROM t", "docs"),
    "camel_split_terms": with_views("WITH m AS (SELECT page_id, array_to_string(list_transform(regexp_extract_all(url, '[A-Za-z0-9]+'), lambda w: upper(w[1]) || lower(w[2:])), '') || ' HTTPServer ParseURL' AS v FROM urls) " + f"SELECT page_id, array_to_string(list_sort(list_distinct({_TERMS('v')})), '|') AS terms FROM m", "urls"),
    "identifier_variants": with_views(f"""WITH h AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS v, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS low FROM urls), p AS (SELECT *, {_TERMS('v')} AS w, regexp_replace(low, '[^a-z0-9]', '', 'g') AS f FROM h)
      SELECT page_id, array_to_string(list_sort(list_distinct(list_filter([low, CASE WHEN contains(low, '.') THEN string_split(low, '.')[-1] END, array_to_string(w, '_'), array_to_string(w, '')], lambda x: length(x) >= 3))), '|') AS variants,
        array_to_string(list_sort(list_distinct(list_filter([f, CASE WHEN f LIKE '%s' AND length(f) > 4 THEN left(f, length(f) - 1) END], lambda x: length(x) >= 4))), '|') AS compact FROM p""", "urls"),
    "stem_terms": with_views(f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(body), '[a-z][a-z0-9]+')) AS word FROM docs), s AS (SELECT word, {_STEM0('word')} AS s FROM w) SELECT word, {_E('s')} AS stem FROM s", "docs"),
    "title_bigrams": with_views(f"""WITH w AS (SELECT number, list_transform(regexp_extract_all(lower({_CAMEL("body")}), '[a-z][a-z0-9]+'), lambda x: {_STEM0('x')}) AS s0 FROM docs WHERE body IS NOT NULL),
      s AS (SELECT number, list_transform(s0, lambda x: {_E('x')}) AS s FROM w)
      SELECT number, md5(CASE WHEN len(s) < 2 THEN '' ELSE array_to_string(list_transform(range(1, len(s)), lambda i: s[i] || ' ' || s[i + 1]), '|') END) AS bigrams_md5 FROM s""", "docs"),
    "path_normalize": with_views("SELECT file_id, lower(path) AS path FROM files", "files"),
    "path_suffix_scope": with_views("SELECT string_split(path, '/')[-1] AS reference, min(file_id) AS file_id FROM files GROUP BY 1 HAVING count(*) = 1", "files"),
    "test_path_flag": with_views("WITH p AS (SELECT file_id, string_split(lower(path), '/') AS s FROM files) SELECT file_id, len(list_intersect(s[:-2], ['t', 'test', 'testing', 'tests'])) > 0 OR s[-1] = 'conftest.py' OR starts_with(s[-1], 'test_') OR ends_with(s[-1], '_test.py') AS is_test FROM p", "files"),
    "excluded_path_reason": with_views("SELECT file_id, CASE WHEN starts_with(path, 'tests/') OR starts_with(path, 'docs/') THEN 'test, documentation, example, generated, or vendored path' WHEN path LIKE '%.md' THEN 'unsupported source suffix' END AS reason FROM files", "files"),
    "path_term_df": with_views(f"WITH t AS (SELECT file_id, unnest(list_distinct({_TERMS('path')})) AS term FROM files) SELECT term, count(*) AS files, count(*) <= 3 AS specific FROM t GROUP BY term", "files"),
    "closing_reference": with_views("SELECT page_id, page_id % 4 <> 2 AND page_id % 3 = 0 AS closes FROM urls", "urls"),
    "api_url_repository": with_views("SELECT page_id, CASE WHEN page_id % 5 NOT IN (1, 3) THEN 'Own' || page_id % 9 || '/name-' || page_id END AS repository FROM urls", "urls"),
    "url_number": with_views("SELECT page_id, CASE WHEN page_id % 5 <> 1 AND page_id % 3 < 2 THEN page_id END AS number FROM urls", "urls"),
    "case_slug": with_views("SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM urls", "urls"),
    "file_confidence": with_views("SELECT file_id, round(least(0.98::DOUBLE, 0.2::DOUBLE + weight * 0.7::DOUBLE / 30), 2) AS confidence FROM files", "files"),
    "language_counts": with_views("SELECT CASE WHEN path LIKE '%.py' THEN 'Python' ELSE 'TypeScript' END AS language, count(*) AS files FROM files WHERE path LIKE '%.py' OR path LIKE '%.ts' GROUP BY 1", "files"),
    "module_names": with_views("SELECT file_id, replace(regexp_replace(regexp_replace(path, '[.]py$', ''), '^src/', ''), '/', '.') AS module FROM files WHERE path LIKE '%.py'", "files"),
    "rank_line_parse": with_views("""WITH a AS (SELECT page_id, list_distinct(['E' || (page_id % 5 + 1), 'E2', 'E' || (page_id % 3 + 1)]) AS d, 'E' || (page_id % 5 + 1) AS x, 'E' || (page_id % 3 + 1) AS y FROM urls)
      SELECT page_id, CASE WHEN page_id % 7 = 0 OR page_id % 11 = 0 THEN NULL ELSE x || CASE WHEN x <> 'E2' THEN '|E2' ELSE '' END || CASE WHEN y <> x AND y <> 'E2' THEN '|' || y ELSE '' END END AS ids FROM a""", "urls"),
}
