"""Symbols of files: uniqueness, enclosing spans, scoped references, features of symbols for an issue, and their selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import text as X

# Method words that tell nothing in a title.
GENERIC_METHODS = ("build", "call", "creat", "get", "handl", "init", "is", "main", "make", "new", "proces", "run", "set")


def unique_names(symbols: DataFrame) -> DataFrame:
    """Names that one symbol alone has."""
    return symbols.groupBy("name").agg(F.count("*").alias("n")).where("n = 1").drop("n")


def enclosing(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """lines (file_id, line) with the symbol of the smallest span (line to end_line) around each; lines with two smallest ones have none."""
    spans = symbols.select("file_id", "symbol_id", F.col("line").alias("a"), F.col("end_line").alias("b"))
    met = lines.join(spans, "file_id").where(F.col("line").between(F.col("a"), F.col("b"))).withColumn("span", F.col("b") - F.col("a"))
    least = Window.partitionBy("file_id", "line")
    small = met.withColumn("m", F.min("span").over(least)).where("span = m").withColumn("n", F.count("*").over(least))
    return small.where("n = 1").select("file_id", "line", "symbol_id")


def best(rows: DataFrame, group: list[str], keys: list[Column]) -> DataFrame:
    """The row of each group with the largest keys, compared one after the other; a partial aggregate, no sort."""
    order = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    others = [c for c in rows.columns if c not in group]
    return rows.groupBy(*group).agg(F.max_by(F.struct(*others), order).alias("r")).select(*group, "r.*")


def related_callers(calls: DataFrame) -> DataFrame:
    """file_id, target_symbol, callers, relation_score: symbols with two callers or more that share two terms or more with the issue (overlap), as calls (file_id, caller, target_symbol, overlap) in one file."""
    some = calls.where("caller <> target_symbol AND overlap >= 2").select("file_id", "caller", "target_symbol", F.least("overlap", F.lit(4)).alias("o")).distinct()
    return some.groupBy("file_id", "target_symbol").agg(F.count_distinct("caller").alias("callers"), F.sum("o").alias("relation_score")).where("callers >= 2")


def scoped_paths(references: DataFrame, files: DataFrame) -> DataFrame:
    """references (reference) to the one file (path) each can mean: the same path, else the longest path that the reference ends with, else the one path that ends with
    the reference; where a step has several there is none. Equi-joins on exploded suffixes, no pair of all paths and references."""
    paths = files.select("path", X.normalize_path(F.col("path")).alias("p"))
    asked = references.select("reference", X.normalize_path(F.col("reference")).alias("r")).distinct()
    one = Window.partitionBy("reference")
    exact = asked.join(paths, F.expr("r = p")).withColumns({"n": F.count("*").over(one), "tier": F.lit(1), "size": F.lit(0)})
    inner = asked.select("reference", F.explode(F.slice(X.path_suffixes(F.col("r")), F.lit(2), F.greatest(F.lit(0), F.size(F.split("r", "/")) - 1))).alias("s"))
    longer = inner.join(paths, F.expr("s = p")).withColumn("size", F.length("p"))
    longer = longer.withColumn("m", F.max("size").over(one)).where("size = m").withColumns({"n": F.count("*").over(one), "tier": F.lit(2)})
    tails = paths.select("path", F.explode(F.slice(X.path_suffixes(F.col("p")), F.lit(2), F.greatest(F.lit(0), F.size(F.split("p", "/")) - 1))).alias("s"))
    shorter = asked.join(tails, F.expr("r = s")).withColumns({"n": F.count("*").over(one), "tier": F.lit(3), "size": F.lit(0)})
    found = exact.select("reference", "path", "tier", "n").unionByName(longer.select("reference", "path", "tier", "n")).unionByName(shorter.select("reference", "path", "tier", "n"))
    # an ambiguous exact match still tries the others; an ambiguous longer one ends the search
    usable = found.where("NOT (tier = 1 AND n > 1)").withColumn("first", F.min("tier").over(one)).where("tier = first AND n = 1")
    return usable.select("reference", "path")


def symbol_features(issue_terms: DataFrame, symbols: DataFrame) -> DataFrame:
    """Features of the symbols that share a term or identifier with an issue.

    issue_terms: one row for each issue with arrays terms, primary_identifiers, identifiers, explicit_identifiers, mentions, title_terms (stems), title_sequence;
    symbols: (path, name, qualified_name, kind, line, docstring). Candidates meet on exploded terms and identifier spellings first, so features are made for those alone.
    """
    identity = F.coalesce("qualified_name", "name")
    local = F.array_union(X.terms(F.col("name")), X.terms(F.coalesce("docstring", F.lit(""))))
    owner = F.regexp_replace(identity, r"\.?[^.]*$", "")
    own = symbols.withColumns({"symbol_id": F.xxhash64("path", identity, "line"), "identity": identity, "owner": owner, "local_terms": local, "all_terms": F.array_union(local, X.terms(identity)), "variants": X.identifier_variants(F.col("name")), "compact": X.compact_variants(F.col("name"))})
    spelled = lambda c, f: F.array_distinct(F.flatten(F.transform(c, f)))
    issues = issue_terms.withColumns({
        "spellings": spelled("identifiers", X.identifier_variants),
        "primary_compact": spelled("primary_identifiers", X.compact_variants),
    })
    by = lambda df, key, cols: df.select(key, F.explode(F.array_distinct(F.concat(*cols))).alias("token"))
    pairs = by(issues, "issue_id", ["terms", "spellings", "primary_compact"]).join(by(own, "symbol_id", ["all_terms", "variants", "compact"]), "token").select("issue_id", "symbol_id").distinct()
    met = pairs.join(issues, "issue_id").join(own, "symbol_id")
    owner_stems = F.array_distinct(F.transform(X.terms(F.col("owner")), X.semantic_term))
    method_stems = F.array_except(F.array_except(F.array_distinct(X.semantic_sequence(F.col("name"))), F.array(*map(F.lit, GENERIC_METHODS))), F.col("owner_stems"))
    met = met.withColumn("owner_stems", owner_stems).withColumn("method_stems", method_stems).withColumn("method_hits", F.array_intersect("method_stems", "title_terms"))
    neighbours = F.arrays_zip(F.slice("title_sequence", 1, F.greatest(F.lit(0), F.size("title_sequence") - 1)).alias("a"), F.slice("title_sequence", 2, F.size("title_sequence")).alias("b"))
    phrase = F.exists(neighbours, lambda x: F.array_contains("owner_stems", x.a) & F.array_contains("method_hits", x.b))
    strong = (F.col("owner") != "") & (F.size("owner_stems") >= 2) & F.arrays_overlap("owner_stems", "title_terms") & (F.size("method_hits") > 0) & phrase & ~X.is_test_path(F.col("path"))
    named = lambda c: F.exists(c, lambda i: (i == F.col("identity")) | i.endswith(F.concat(F.lit("."), F.col("identity"))))
    return met.select(
        "issue_id", "path", "name", "identity", "kind", "line",
        F.size(F.array_intersect("terms", "all_terms")).alias("overlap"),
        F.size(F.array_intersect("terms", "local_terms")).alias("local_overlap"),
        F.arrays_overlap("compact", "primary_compact").alias("primary_match"),
        F.exists(F.filter("identifiers", lambda i: ~i.contains(".")), lambda i: F.arrays_overlap("variants", X.identifier_variants(i))).alias("exact_match"),
        ((F.col("identity") != F.col("name")) & named("explicit_identifiers")).alias("qualified_match"),
        F.array_contains("explicit_identifiers", F.col("name")).alias("explicit_match"),
        F.size(F.filter("mentions", lambda m: m == F.col("name"))).alias("mentions"),
        F.when(strong, F.size("method_hits") / F.size("method_stems")).otherwise(0.0).alias("title_strength"),
    )


def select_symbols(features: DataFrame, unique: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """For each issue and path the function to show: those that the issue points at by place (all_positions() of the same symbols) first, then
    directly named ones, then those whose terms meet the issue."""
    # titles speak for the one symbol of a file that they match most, or for none
    file = Window.partitionBy("issue_id", "path")
    rows = features.where("kind = 'function'").withColumn("_most", F.max("title_strength").over(file)).withColumn("_ties", F.count_if(F.col("title_strength") == F.col("_most")).over(file))
    rows = rows.withColumn("title_strength", F.when((F.col("title_strength") == F.col("_most")) & (F.col("_ties") == 1), F.col("title_strength")).otherwise(0.0)).drop("_most", "_ties")
    rows = rows.join(unique.withColumn("unique_name", F.lit(True)), "name", "left")
    places = ("frame", "source_line", "snippet", "constructor")
    if positions is None:
        rows = rows.withColumns({k: F.lit(None).cast("int") for k in places})
    else:
        rows = rows.join(positions, ["issue_id", "path", "identity"], "left")
    at = {k: F.col(k).isNotNull() for k in places}
    first = lambda k: -F.coalesce(k, F.lit(1_000_000))
    direct = F.col("qualified_match") | (F.col("exact_match") & F.coalesce("unique_name", F.lit(False)) & (F.length("name") >= 5)) | at["frame"] | at["source_line"] | at["snippet"] | at["constructor"]
    keys = [direct, at["frame"], F.coalesce("frame", F.lit(-1)), at["source_line"], first("source_line"), at["snippet"], first("snippet"), F.col("qualified_match"), at["constructor"], first("constructor"), F.col("mentions"), F.col("explicit_match"), F.col("title_strength"), F.col("primary_match"), F.col("local_overlap"), ~F.col("name").startswith("_"), -F.col("line")]
    return best(rows.where(direct | F.col("primary_match") | (F.col("overlap") > 0)), ["issue_id", "path"], keys)


def strongest_titles(matches: DataFrame) -> DataFrame:
    """matches (issue_id, symbol_id, title_strength) that alone have their issue's greatest strength over 0; issues with several such ones have none."""
    best = matches.where("title_strength > 0").groupBy("issue_id").agg(F.max(F.struct("title_strength", "symbol_id")).alias("x"), F.min(F.struct(-F.col("title_strength"), "symbol_id")).alias("y"))
    # of the strongest ones the last and the first by id: the same where there is one
    return best.where("x.symbol_id = y.symbol_id").select("issue_id", "x.symbol_id", "x.title_strength")


def shared_callers(external: DataFrame, relations: DataFrame) -> DataFrame:
    """issue_id, file_id, caller: the one function of a file with the qualified calls (file_id, caller, target) that relate it to an issue (issue_id, file_id, target); none where there are several."""
    met = relations.join(external.where("caller IS NOT NULL"), ["file_id", "target"])
    found = met.groupBy("issue_id", "file_id").agg(F.min("caller").alias("caller"), F.max("caller").alias("last"))
    return found.where("caller = last").drop("last")


def evidence() -> Column:
    """What is said of a chosen symbol, in order; columns label, name, overlap, qualified_match, exact_match, unscoped_match, constructor, title_match, frame, source_line, snippet, primary_match, component_match and callers."""
    known = lambda flag, words: F.when(flag, F.concat(F.lit(words), F.col("label")))
    listed = lambda start, items: F.when(F.size(items) > 0, F.concat(start, F.array_join(F.array_sort(items), ", ")))
    return F.array_compact(F.array(
        listed(F.concat(F.lit("Symbol "), F.col("label"), F.lit(" matches: ")), "overlap"),
        known(F.col("qualified_match") | (F.col("exact_match") & ~F.col("unscoped_match")), "Issue references symbol "),
        known(F.col("constructor").isNotNull(), "Issue title and code call constructor "),
        known(F.col("title_match"), "Issue title matches owner and method "),
        known(F.col("frame").isNotNull(), "Traceback frame points to symbol "),
        known(F.col("source_line").isNotNull(), "Issue source line points to symbol "),
        known(F.col("snippet").isNotNull(), "Issue source snippet matches symbol "),
        known(F.col("primary_match"), "Issue title strongly matches symbol "),
        F.when(F.col("component_match"), F.concat(F.lit("Issue references owning symbol "), F.regexp_replace("label", r"\.[^.]*$", ""))),
        listed(F.concat(F.lit("Issue-matching symbols call "), F.col("name"), F.lit(": ")), "callers"),
    ))
