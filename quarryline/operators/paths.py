"""Typed relations between files, for the files that an issue starts from: imports by what is done with them, two-step call chains, importers, facades and shared calls, with their gates.

Tables, all keyed by path: an index (repository_map()) and `marks`, what is known of each path. issues are issue_signals(); seeds (issue_id, file_id) come from graph_seeds().
Every function gives issue_id, file_id, kind, bonus and via, the part of the evidence that tells relations apart (see EVIDENCE). Gates are tables that rows
have to meet, or must not meet; no pair of all issues and files is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import symbols as S
from quarryline.operators.tables import stored

# Folders that are no production code, words that tell no subsystem, stems of files that only declare.
AUXILIARY = ("docs", "docs_src", "examples", "scripts")
TESTS = ("t", "test", "tests")
GENERIC_SUBSYSTEMS = ("common", "core", "shared", "util", "utils")
DECLARING = ("abc", "interface", "interfaces", "protocol", "protocols")
# Shortest words, names and called symbols that count; most importers and files that share a call; bonuses.
LONG_WORD, LONG_NAME, LONG_CALL, MOST_IMPORTERS, MOST_SHARED = 5, 5, 5, 3, 3
LEAST_EXPANSION, REEXPORT, TEST_IMPORT, IMPORT = 5.0, 7.0, 3.5, 0.75
# Evidence of each kind, before via.
EVIDENCE = {
    "test_import": "Matching test imports this source file: ",
    "call": "Related source calls imported symbols defined here: ",
    "function_local": "Function-local import calls symbols defined here: ",
    "reference": "Related source references imported symbols defined here: ",
    "import": "Related source imports this file: ",
    "two_hop": "Two-hop source relation calls imported symbols defined here: ",
    "function_local_two_hop": "Two-hop function-local import chain calls symbols defined here: ",
    "strong_two_hop": "Two-hop source call chain via ",
    "shared_call": "Shares issue-referenced qualified call ",
    "reverse_import": "Imports title-matching source module ",
    "reexport": "Issue-referenced source imports re-exported symbols defined here: ",
}


def marks(files: DataFrame) -> DataFrame:
    """path, test_file, auxiliary, production, concrete, scope (stems of five letters or more of what follows its package) and subsystem (words of the folders below its package), of indexed files (path, test_file).

    A package begins at the first folder that holds an __init__.py; paths in none leave out src or lib and one folder.
    """
    parts = F.split("path", "/")
    depths = F.sequence(F.lit(1), F.size(parts) - 1)
    folders = F.when(F.size(parts) > 1, F.transform(depths, lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("folder"), k.alias("depth"))))
    packages = files.where("path LIKE '%/__init__.py'").select(F.regexp_replace("path", "/__init__.py$", "").alias("folder"))
    inside = files.select("path", F.explode(folders).alias("f")).select("path", "f.*").join(packages, "folder").groupBy("path").agg(F.min("depth").alias("depth"))
    rows = files.select("path", "test_file").join(inside, "path", "left").withColumn("parts", F.split("path", "/"))
    bare = F.when(F.get("parts", F.lit(0)).isin("src", "lib"), F.slice("parts", F.lit(2), F.size("parts"))).otherwise(F.col("parts"))
    below = F.when(F.col("depth").isNotNull(), F.slice("parts", F.col("depth") + 1, F.size("parts"))).when(F.size(bare) > 1, F.slice(bare, F.lit(2), F.size(bare))).otherwise(bare)
    rows = rows.withColumn("below", below)
    stem = lambda c: F.when(F.col(c).rlike(r"^.+\.[^.]+$"), F.regexp_replace(c, r"\.[^.]+$", "")).otherwise(F.col(c))
    scoped = rows.withColumn("last", F.element_at("below", -1)).withColumn("last", stem("last"))
    scope = F.filter(F.array_distinct(F.transform(X.terms(F.array_join(F.concat(F.slice("below", F.lit(1), F.size("below") - 1), F.array("last")), "/")), X.semantic_term)), lambda t: F.length(t) >= LONG_WORD)
    # a path outside of packages with one folder or none has no subsystem
    folders_below = F.when(F.col("depth").isNotNull() | (F.size(bare) > 1), F.slice("below", F.lit(1), F.greatest(F.lit(0), F.size("below") - 1))).otherwise(F.array().cast("array<string>"))
    subsystem = F.filter(X.terms(F.array_join(folders_below, "/")), lambda t: (F.length(t) >= 3) & ~t.isin(*GENERIC_SUBSYSTEMS))
    auxiliary = F.col("test_file") | F.arrays_overlap("parts", F.array(*map(F.lit, AUXILIARY)))
    plain = F.transform("parts", lambda p: F.lower(F.ltrim(F.when(p.rlike(r"^.+\.[^.]+$"), F.regexp_replace(p, r"\.[^.]+$", "")).otherwise(p), F.lit("_"))))
    return scoped.select(
        "path", "test_file", auxiliary.alias("auxiliary"), (~auxiliary & ~F.get("parts", F.lit(0)).isin(*TESTS)).alias("production"),
        (~auxiliary & ~F.arrays_overlap(plain, F.array(*map(F.lit, DECLARING)))).alias("concrete"), scope.alias("scope"), subsystem.alias("subsystem"),
    )


def _long(word: Column) -> Column:
    return F.length(word) >= LONG_WORD


def related_specifically(value: Column, primary: Column) -> Column:
    """A long word of value holds a long primary word, or lies in one."""
    return F.exists(F.filter(X.terms(value), _long), lambda a: F.exists(F.filter(primary, _long), lambda b: a.contains(b) | b.contains(a)))


def related(value: Column, primary: Column) -> Column:
    return F.arrays_overlap(X.terms(value), primary) | related_specifically(value, primary)


def _row(kind: Column | str, bonus: Column, via: Column, target: str = "target") -> list[Column]:
    return [F.col("issue_id"), F.col(target).alias("file_id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), bonus.cast("double").alias("bonus"), via.alias("via")]


def one_step(seeds: DataFrame, issues: DataFrame, index: dict[str, DataFrame], marked: DataFrame) -> DataFrame:
    """Files that seeds import, by the closest of what they do with them: a test imports, symbols are called (in functions only: less), read, or none of it."""
    uses = index["uses"].where("path <> target_file").groupBy("path", F.col("target_file").alias("target"))
    used = uses.agg(F.collect_set(F.when(F.col("kind") == "call", F.col("target_symbol"))).alias("called"), F.collect_set(F.when(F.col("kind") == "reference", F.col("target_symbol"))).alias("read"), F.bool_and(F.when(F.col("kind") == "call", F.col("function_local"))).alias("local"))
    edges = index["imports"].select("path", F.col("target_path").alias("target")).distinct().join(used, ["path", "target"], "left")
    edges = edges.join(marked.where("NOT test_file").select(F.col("path").alias("target")), "target", "left_semi").join(marked.select("path", "test_file"), "path")
    met = seeds.select("issue_id", F.col("file_id").alias("path")).join(edges, "path").join(issues.select("issue_id", "primary_terms"), "issue_id")
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    hit = lambda c: F.exists(c, lambda s: related(s, F.col("primary_terms")))
    call = F.when(hit("called"), 9.0).otherwise(8.0)
    kind = F.when(F.col("test_file"), "test_import").when(some("called"), F.when(F.col("local"), "function_local").otherwise("call")).when(some("read"), "reference").otherwise("import")
    bonus = F.when(kind == "test_import", TEST_IMPORT).when(kind == "function_local", F.least(call, F.lit(LEAST_EXPANSION - 0.5))).when(kind == "call", call).when(kind == "reference", F.when(hit("read"), 8.0).otherwise(6.0)).otherwise(IMPORT)
    listed = lambda c: F.array_join(F.array_sort(c), ", ")
    via = F.when(kind.isin("call", "function_local"), listed("called")).when(kind == "reference", listed("read")).otherwise(F.col("path"))
    return met.select(*_row(kind, bonus, via)).distinct()


def two_steps(seeds: DataFrame, issues: DataFrame, index: dict[str, DataFrame], marked: DataFrame) -> DataFrame:
    """Seed -> first file -> second file, where what the seed calls makes the second call itself; a class that a function imports and calls does so in its __init__.

    Function-local calls are no second step. Chains whose first symbol meets the title specifically, through concrete files both, are strong ones besides.
    """
    calls = index["uses"].where("kind = 'call' AND path <> target_file")
    code = marked.where("NOT test_file")
    classes = index["symbols"].where("kind = 'class'").select(F.col("path").alias("mid"), F.col("qualified_name").alias("callee"), F.lit(True).alias("constructed")).distinct()
    first = calls.join(code.select("path"), "path", "left_semi").select(F.col("path").alias("seed"), F.col("target_file").alias("mid"), F.col("target_symbol").alias("callee"), "function_local").distinct()
    first = first.join(code.select(F.col("path").alias("mid"), F.col("concrete").alias("mid_concrete")), "mid").join(classes, ["mid", "callee"], "left")
    steps = F.array_compact(F.array(F.col("callee"), F.when(F.col("function_local") & F.col("constructed"), F.concat("callee", F.lit(".__init__")))))
    first = first.withColumn("caller", F.explode(steps))
    second = calls.where((F.length("target_symbol") >= LONG_CALL) & ~F.col("function_local")).select(F.col("path").alias("mid"), "caller", F.col("target_file").alias("target"), "target_symbol").distinct()
    second = second.join(code.select(F.col("path").alias("target"), F.col("concrete").alias("target_concrete")), "target")
    start = seeds.select("issue_id", F.col("file_id").alias("seed")).join(issues.select("issue_id", "primary_terms"), "issue_id")
    met = start.join(first, "seed").join(second, ["mid", "caller"]).where("target <> seed AND target <> mid").withColumn("hit", related(F.col("target_symbol"), F.col("primary_terms")))
    plain = met.select(*_row(F.when(F.col("function_local"), "function_local_two_hop").otherwise("two_hop"), F.when(F.col("hit"), 9.0).otherwise(5.0), F.col("target_symbol")))
    strong = met.where(~F.col("function_local") & F.col("mid_concrete") & F.col("target_concrete") & related_specifically(F.col("callee"), F.col("primary_terms")))
    via = F.concat("callee", F.lit(" reaches "), "target_symbol", F.lit(", defined here: "), "mid")
    return plain.unionByName(strong.select(*_row("strong_two_hop", F.when(F.col("hit"), 9.0).otherwise(8.0), via))).distinct()


def title_scopes(issues: DataFrame, marked: DataFrame) -> DataFrame:
    """issue_id, path, term: words of a title (stems of five letters or more) that production paths have below their packages; met on words."""
    asked = issues.select("issue_id", F.explode(F.array_distinct(F.transform("title_text_terms", X.semantic_term))).alias("term")).where(_long(F.col("term")))
    return marked.where("production").select("path", F.explode("scope").alias("term")).join(asked, "term").select("issue_id", "path", "term")


def importers(issues: DataFrame, index: dict[str, DataFrame], marked: DataFrame) -> DataFrame:
    """One to three importers in a title's scope of a file in that scope, two functions of which share a further title word; half a point for each function over two."""
    asked = issues.select("issue_id", F.explode(F.array_distinct(F.transform("title_text_terms", X.semantic_term))).alias("term")).where(_long(F.col("term")))
    # issues of the same words have the same importers
    titles = asked.where("issue_id IS NOT NULL").groupBy("issue_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    kinds = titles.groupBy("terms").agg(F.min("issue_id").alias("kind_id"))
    asked = kinds.select("kind_id", F.explode("terms").alias("term"))
    # what doesn't depend on the issue comes first: importers by the scope word they share, and words that two functions or more have
    held = marked.where("production").select("path", F.explode(F.array_distinct("scope")).alias("term"))
    edges = index["imports"].where("path <> target_path").select(F.col("path").alias("importer"), F.col("target_path").alias("path")).distinct()
    shared = edges.join(held, "path").join(held.withColumnRenamed("path", "importer"), ["importer", "term"])
    functions = index["symbols"].where("kind = 'function'").select("path", F.coalesce("qualified_name", "name").alias("identity"), F.explode(F.array_distinct(F.transform(X.terms(F.col("name")), X.semantic_term))).alias("term"))
    often = functions.join(shared.select("path"), "path", "left_semi").join(held, ["path", "term"], "left_anti").groupBy("path", "term").agg(F.collect_set("identity").alias("all")).where(F.size("all") >= 2)
    sources = often.join(asked, "term").groupBy("kind_id", "path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("all")))).alias("all"))
    few = shared.join(asked, "term").groupBy("kind_id", "path").agg(F.collect_set("importer").alias("importers")).where(F.size("importers").between(1, MOST_IMPORTERS))
    few = few.join(sources, ["kind_id", "path"]).join(kinds, "kind_id").join(titles, "terms")
    rest = F.when(F.size("all") > 3, F.concat(F.lit(" (+"), (F.size("all") - 3).cast("string"), F.lit(" more)"))).otherwise("")
    via = F.concat("path", F.lit(": "), F.array_join(F.slice("all", 1, 3), ", "), rest)
    return few.withColumn("target", F.explode("importers")).select(*_row("reverse_import", LEAST_EXPANSION + F.least(F.lit(2.0), 0.5 * (F.size("all") - 2)), via))


def named_callers(issues: DataFrame, index: dict[str, DataFrame], marked: DataFrame) -> DataFrame:
    """issue_id, caller: functions of one production file alone that an issue names, dotted ones by their end."""
    own = index["symbols"].where("kind = 'function'").join(marked.where("NOT auxiliary"), "path", "left_semi").groupBy(F.coalesce("qualified_name", "name").alias("caller")).agg(F.count_distinct("path").alias("n")).where("n = 1").drop("n")
    asked = issues.select("issue_id", F.explode(F.array_union("explicit_identifiers", "primary_identifiers")).alias("i"))
    dotted = F.col("caller").contains(".")
    whole = asked.select("issue_id", F.col("i").alias("caller")).join(own.where(~dotted & (F.length(F.translate("caller", "_", "")) >= LONG_NAME)), "caller", "left_semi")
    plain = F.btrim("i", F.lit(X.QUOTES))
    parts = F.split(plain, r"\.")
    ends = asked.select("issue_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))).alias("caller"))
    return whole.unionByName(ends.join(own.where(dotted), "caller", "left_semi").select("issue_id", "caller")).distinct()


def shared_calls(seeds: DataFrame, issues: DataFrame, index: dict[str, DataFrame], marked: DataFrame) -> DataFrame:
    """Other files with a qualified call that the issue names, where two or three production files have it and the issue names the seed's caller too."""
    code = marked.where("NOT auxiliary").select("path")
    calls = index["external"].select("path", "caller", F.col("target").alias("call")).join(code, "path", "left_semi").distinct()
    few = calls.groupBy("call").agg(F.count_distinct("path").alias("files")).where(F.col("files").between(2, MOST_SHARED)).select("call")
    calls = calls.join(few, "call", "left_semi").where("caller IS NOT NULL")
    named = issues.select("issue_id", F.explode("explicit_identifiers").alias("call"))
    start = seeds.select("issue_id", F.col("file_id").alias("path")).join(calls, "path").join(named, ["issue_id", "call"], "left_semi").join(named_callers(issues, index, marked), ["issue_id", "caller"], "left_semi")
    others = calls.groupBy("call", F.col("path").alias("target")).agg(F.array_join(F.array_sort(F.collect_set("caller")), ", ").alias("callers"))
    met = start.join(others, "call").where("target <> path")
    return met.select(*_row("shared_call", F.lit(LEAST_EXPANSION), F.concat("call", F.lit(" with "), "caller", F.lit(" in "), "path", F.lit(": "), "callers"))).distinct()


def reexports(seeds: DataFrame, referenced: DataFrame, index: dict[str, DataFrame], marked: DataFrame) -> DataFrame:
    """Where a name comes from that a seed, which the issue references (referenced: issue_id, path), imports from a package's __init__.py and reads: the one file that the facade has it from, defines it once, and lies in the seed's subsystem."""
    code = marked.where("NOT auxiliary").select("path", "subsystem")
    bound = index["bound"].select("path", "target_path", "symbol").distinct()
    facades = bound.where("path LIKE '%/__init__.py' OR path = '__init__.py'").join(code.select("path"), "path", "left_semi").select(F.col("path").alias("facade"), F.col("target_path").alias("target"), "symbol")
    identity = F.coalesce("qualified_name", "name").alias("symbol")
    defined = index["symbols"].select(F.col("path").alias("facade"), identity).distinct()
    once = index["symbols"].groupBy(F.col("path").alias("target"), identity).agg(F.count("*").alias("n")).where("n = 1").drop("n")
    facades = facades.join(defined, ["facade", "symbol"], "left_anti").join(once, ["target", "symbol"], "left_semi").join(code.select(F.col("path").alias("target"), F.col("subsystem").alias("theirs")), "target").where("target <> facade")
    read = index["names"].select("path", F.col("value").alias("symbol")).distinct()
    own = bound.select("path", F.col("target_path").alias("facade"), "symbol").join(read, ["path", "symbol"], "left_semi").join(code, "path")
    start = seeds.select("issue_id", F.col("file_id").alias("path")).join(referenced.select("issue_id", "path"), ["issue_id", "path"], "left_semi")
    routes = start.join(own, "path").join(facades, ["facade", "symbol"]).where((F.col("target") != F.col("path")) & F.arrays_overlap("subsystem", "theirs"))
    only = routes.groupBy("issue_id", "path", "symbol").agg(F.collect_set(F.struct("target", "facade")).alias("ways")).where(F.size("ways") == 1).select("issue_id", "path", "symbol", F.col("ways")[0]["target"].alias("target"), F.col("ways")[0]["facade"].alias("facade"))
    told = only.groupBy("issue_id", "path", "target", "facade").agg(F.array_join(F.array_sort(F.collect_set("symbol")), ", ").alias("symbols"))
    return told.select(*_row("reexport", F.lit(REEXPORT), F.concat("symbols", F.lit(" via "), "facade"))).distinct()


def referenced_paths(issues: DataFrame, files: DataFrame) -> DataFrame:
    """issue_id, path: the files that an issue's paths mean."""
    asked = issues.select("issue_id", F.explode("paths").alias("reference")).distinct()
    return asked.join(S.scoped_paths(asked.select("reference").distinct(), files.select("path")), "reference").select("issue_id", "path").distinct()


def relations(seeds: DataFrame, issues: DataFrame, index: dict[str, DataFrame], marked: DataFrame, referenced: DataFrame) -> DataFrame:
    """All typed relations of issues whose files lie in the index, to any file of it; the caller limits them to the issue's pool."""
    parts = (
        one_step(seeds, issues, index, marked), two_steps(seeds, issues, index, marked), importers(issues, index, marked),
        shared_calls(seeds, issues, index, marked), reexports(seeds, referenced, index, marked),
    )
    # one plan of them all is more than a small driver holds
    out, *rest = [stored(x, "relation") for x in parts]
    for more in rest:
        out = out.unionByName(more)
    return out


def evidence(kind: Column, via: Column) -> Column:
    """The text of a relation; kinds that are not here speak for themselves."""
    texts = F.create_map(*[F.lit(x) for kv in EVIDENCE.items() for x in kv])
    return F.concat(F.coalesce(texts[kind], F.lit("")), via)
