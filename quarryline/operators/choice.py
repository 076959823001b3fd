"""The symbol to show for an issue in a file, in tiers: what the issue points at or names, else what its rarest words tell, else an admissible fallback.

matches() says all of a symbol and an issue that no other symbol changes; in_scope() adds what depends on which names are unique, in the whole repository first and then
among the files that are shown; choose() takes the best of each tier in one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import symbols as S

# Shortest name that counts where it is unique; the place of what the issue doesn't point at.
LONG_NAME, NOWHERE = 5, 1_000_000
PLACES = ("frame", "source_line", "snippet", "constructor")


def _stems(words: Column) -> Column:
    return F.array_distinct(F.transform(words, X.semantic_term))


def _ends_with(identifier: Column, identity: Column) -> Column:
    """An identifier without quotes is the identity or ends with it after a dot."""
    bare = F.btrim(identifier, F.lit(X.QUOTES))
    return (bare == identity) | bare.endswith(F.concat(F.lit("."), identity))


def described(symbols: DataFrame) -> DataFrame:
    """symbols (path, name, qualified_name, kind, line, end_line, docstring) with identity, owner and their words."""
    identity = F.coalesce("qualified_name", "name")
    local = F.array_union(X.terms(F.col("name")), X.terms(F.coalesce("docstring", F.lit(""))))
    own = symbols.withColumns({"identity": identity, "owner": F.regexp_replace(identity, r"\.?[^.]*$", ""), "local_terms": local})
    return own.withColumns({"symbol_id": F.xxhash64("path", "identity", "kind", "line"), "all_terms": F.array_union("local_terms", X.terms(F.col("identity"))), "stems": _stems(F.col("local_terms")), "variants": X.identifier_variants(F.col("name")), "compact": X.compact_variants(F.col("name"))})


def word_counts(symbols: DataFrame) -> DataFrame:
    """path, term, n: how many functions of a file have each stem."""
    rows = described(symbols.where("kind = 'function'")).select("path", "symbol_id", F.explode("stems").alias("term"))
    return rows.groupBy("path", "term").agg(F.count("*").alias("n"))


def shape() -> Column:
    """What symbols say of themselves, whatever their file: those of one shape match an issue alike, but for places and titles."""
    return F.md5(F.to_json(F.struct("name", "qualified_name", "kind", "docstring")).cast("binary"))


def shapes(symbols: DataFrame) -> DataFrame:
    """One symbol of each shape(), with the shape for its path."""
    one = symbols.groupBy(shape().alias("path")).agg(*[F.first(c).alias(c) for c in ("name", "qualified_name", "kind", "docstring")])
    return one.withColumns({"line": F.lit(0), "end_line": F.lit(0)})


def matches(signals: DataFrame, symbols: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """A row for each issue and symbol that share a word, a stem of the title's, an identifier or a place (places: all_positions())."""
    own = described(symbols)
    all_names = F.array_union("identifiers", "explicit_identifiers")
    spelled = lambda c, f: F.array_distinct(F.flatten(F.transform(c, f)))
    primary = _stems(F.col("primary_terms"))
    components = _stems(spelled("primary_identifiers", X.terms))
    specific = F.array_except(primary, components)
    issues = signals.select(
        "issue_id", "terms", "primary_identifiers", "identifiers", "explicit_identifiers", "mentions", "title_terms", "title_sequence",
        F.array_union("explicit_identifiers", "primary_identifiers").alias("scoped_names"), all_names.alias("all_names"), F.filter(all_names, lambda i: ~i.contains(".")).alias("bare_names"),
        F.when(F.size(specific) > 0, specific).otherwise(primary).alias("title_stems"),
    )
    issues = issues.withColumns({"spellings": spelled("all_names", X.identifier_variants), "primary_compact": spelled("primary_identifiers", X.compact_variants), "scoped_compact": spelled("scoped_names", X.compact_variants)})
    tag = lambda mark, c: F.transform(c, lambda x: F.concat(F.lit(mark), x))
    keyed = lambda df, key, parts: df.select(key, F.explode(F.array_distinct(F.concat(*[tag(m, c) for m, c in parts]))).alias("token"))
    asked = keyed(issues, "issue_id", (("w:", "terms"), ("v:", "spellings"), ("c:", "primary_compact"), ("s:", "title_stems")))
    held = keyed(own, "symbol_id", (("w:", "all_terms"), ("v:", "variants"), ("c:", "compact"), ("s:", "stems")))
    pairs = asked.join(held, "token").select("issue_id", "symbol_id")
    if places is not None:
        pairs = pairs.unionByName(places.join(own.select("path", "identity", "symbol_id"), ["path", "identity"]).select("issue_id", "symbol_id"))
    met = pairs.distinct().join(issues, "issue_id").join(own, "symbol_id")
    if places is None:
        met = met.withColumns({k: F.lit(None).cast("int") for k in PLACES})
    else:
        met = met.join(places.select("issue_id", "path", "identity", *PLACES), ["issue_id", "path", "identity"], "left")
    owner_name = F.element_at(F.split("owner", r"\."), -1)
    has_owner = F.col("owner") != ""
    met = met.withColumns({
        "owner_stems": _stems(X.terms(F.col("owner"))),
        "local_match": F.exists("bare_names", lambda i: F.arrays_overlap("variants", X.identifier_variants(i))),
        "exact_local": F.array_contains("bare_names", F.col("name")),
        "qualified_match": (F.col("identity") != F.col("name")) & F.exists("scoped_names", lambda i: _ends_with(i, F.col("identity"))),
        "bare_explicit": F.array_contains(F.filter("explicit_identifiers", lambda i: ~i.contains(".")), F.col("name")),
        "exact_owner": has_owner & F.exists("scoped_names", lambda i: _ends_with(i, F.col("owner")) | _ends_with(i, owner_name)),
        "class_owner": has_owner & F.exists("identifiers", lambda i: ~i.contains(".") & F.substring(i, 2, 1 << 30).rlike(r"\p{Lu}") & ((i == owner_name) | (i == F.concat(owner_name, F.lit("s"))))),
        "primary_match": F.arrays_overlap("compact", "primary_compact"),
        "component_match": (F.col("identity") != F.col("name")) & F.arrays_overlap(X.compact_variants(F.col("owner")), F.col("scoped_compact")),
        "mentioned": F.size(F.filter("mentions", lambda m: m == F.col("name"))),
    })
    last = lambda i: F.lower(F.substring_index(i, ".", -1))
    met = met.withColumn("unscoped_dotted", ~F.col("qualified_match") & ~F.col("local_match") & F.exists("all_names", lambda i: i.contains(".") & (last(i) == F.lower("name"))))
    less = lambda words: F.when(F.col("unscoped_dotted"), F.array_except(words, X.terms(F.col("name")))).otherwise(words)
    met = met.withColumns({"overlap": less(F.array_intersect("terms", "all_terms")), "local_overlap": less(F.array_intersect("terms", "local_terms"))})
    told = F.array_intersect("title_stems", "stems")
    met = met.withColumn("told", F.when(F.col("unscoped_dotted"), F.array_except(told, _stems(X.terms(F.col("name"))))).otherwise(told))
    method = F.array_except(F.array_except(F.array_distinct(X.semantic_sequence(F.col("name"))), F.array(*map(F.lit, S.GENERIC_METHODS))), F.col("owner_stems"))
    met = met.withColumn("method_stems", method).withColumn("method_hits", F.array_intersect("method_stems", "title_terms"))
    neighbours = F.arrays_zip(F.slice("title_sequence", 1, F.greatest(F.lit(0), F.size("title_sequence") - 1)).alias("a"), F.slice("title_sequence", 2, F.size("title_sequence")).alias("b"))
    phrase = F.exists(neighbours, lambda x: F.array_contains("owner_stems", x.a) & F.array_contains("method_hits", x.b))
    strong = has_owner & ~X.is_test_path(F.col("path")) & (F.size("owner_stems") >= 2) & F.arrays_overlap("owner_stems", "title_terms") & (F.size("method_hits") > 0) & phrase
    met = met.withColumn("title_strength", F.when(strong, F.size("method_hits") / F.size("method_stems")).otherwise(0.0))
    # a title speaks for the one function of a file that it matches most, or for none
    function = F.col("kind") == "function"
    file = Window.partitionBy("issue_id", "path")
    most = F.max(F.when(function, F.col("title_strength"))).over(file)
    ties = F.count_if(function & (F.col("title_strength") == F.col("_most"))).over(file)
    met = met.withColumn("_most", most).withColumn("_ties", ties).withColumn("title_strength", F.when(function & (F.col("title_strength") == F.col("_most")) & (F.col("_ties") == 1), F.col("title_strength")).otherwise(0.0))
    kept = ("issue_id", "path", "symbol_id", "name", "identity", "kind", "line", "end_line", "overlap", "local_overlap", "told", "local_match", "exact_local", "qualified_match", "bare_explicit", "exact_owner", "class_owner", "primary_match", "component_match", "mentioned", "unscoped_dotted", "title_strength", *PLACES)
    return met.select(*kept)


def unique_in_files(symbols: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """name (or, for each issue's shown files (issue_id, path), issue_id and name) of functions whose name is borne once."""
    functions = symbols.where("kind = 'function'").select("path", "name")
    if shown is None:
        return functions.groupBy("name").agg(F.count("*").alias("n")).where("n = 1").select("name")
    # a file's names travel together; null ones are names too
    nulls = F.array_repeat(F.lit(None).cast("string"), F.count_if(F.isnull("name")).cast("int"))
    held = functions.groupBy("path").agg(F.concat(F.collect_list("name"), nulls).alias("names"))
    lists = shown.select("issue_id", "path").join(held, "path").groupBy("issue_id").agg(F.array_sort(F.flatten(F.collect_list("names"))).alias("s"))
    lone = F.filter("s", lambda x, i: ((i == 0) | ~x.eqNullSafe(F.get("s", i - 1))) & ((i == F.size("s") - 1) | ~x.eqNullSafe(F.get("s", i + 1))))
    return lists.select("issue_id", F.explode(lone).alias("name"))


def in_scope(met: DataFrame, unique: DataFrame, referenced: DataFrame) -> DataFrame:
    """matches with scoped_match, explicit_match and unscoped_explicit: bare names count where they are unique (unique_in_files()), or their file (referenced: issue_id, path) or owner is named as well."""
    on = ["issue_id", "name"] if "issue_id" in unique.columns else ["name"]
    rows = met.join(unique.withColumn("unique_name", F.lit(True)), on, "left").join(referenced.select("issue_id", "path").distinct().withColumn("path_scoped", F.lit(True)), ["issue_id", "path"], "left")
    single, placed = F.coalesce("unique_name", F.lit(False)), F.coalesce("path_scoped", F.lit(False)) | F.col("exact_owner") | F.col("class_owner")
    long = F.length(F.btrim("name", F.lit("_"))) >= LONG_NAME
    explicit = F.col("bare_explicit") & (single | placed)
    return rows.withColumns({"scoped_match": F.col("exact_local") & (placed | (long & single)), "explicit_match": explicit, "unscoped_explicit": F.col("bare_explicit") & ~explicit}).drop("unique_name", "path_scoped")


def callers(met: DataFrame, uses: DataFrame) -> DataFrame:
    """issue_id, path, identity, callers (sorted), relation_score: functions that two or more functions of their file call which share two words or more with the issue."""
    functions = met.where("kind = 'function'")
    calling = functions.where(F.size("local_overlap") >= 2).select("issue_id", "path", F.col("identity").alias("caller"), F.least(F.size("local_overlap"), F.lit(4)).alias("score")).dropDuplicates(["issue_id", "path", "caller"])
    own = uses.where("kind = 'call' AND caller IS NOT NULL AND path = target_file AND caller <> target_symbol").select("path", "caller", F.col("target_symbol").alias("identity")).distinct()
    made = calling.join(own, ["path", "caller"]).groupBy("issue_id", "path", "identity").agg(F.array_sort(F.collect_set("caller")).alias("callers"), F.sum("score").alias("relation_score"))
    return made.where(F.size("callers") >= 2)


def rarity(met: DataFrame, counts: DataFrame) -> DataFrame:
    """issue_id, path, symbol_id, rarest, rarities: the largest and the sum of 1/n over the title words that a function tells, n functions of its file having each."""
    told = met.where("kind = 'function'").select("issue_id", "symbol_id", "path", F.explode("told").alias("term")).join(counts, ["path", "term"])
    # dealt by file, as choose() groups them
    return told.repartition("issue_id", "path").groupBy("issue_id", "path", "symbol_id").agg(F.max(1 / F.col("n")).alias("rarest"), F.sum(1 / F.col("n")).alias("rarities"))


def choose(scoped: DataFrame, counts: DataFrame, related: DataFrame) -> DataFrame:
    """issue_id, path and the chosen match, with tier (direct, semantic or fallback): in_scope() rows, word_counts() and callers().

    What other tables say of a file's symbols comes as a map for each issue and file, so that the matches are exchanged once.
    """
    file = Window.partitionBy("issue_id", "path")
    mapped = lambda df, key, *values: df.where(F.col(key).isNotNull()).groupBy("issue_id", "path").agg(F.map_from_entries(F.collect_list(F.struct(key, F.struct(*values)))).alias(f"_{key}"))
    rows = scoped.join(mapped(rarity(scoped, counts), "symbol_id", "rarest", "rarities"), ["issue_id", "path"], "left").join(mapped(related, "identity", "callers", "relation_score"), ["issue_id", "path"], "left")
    rare, calling = F.col("_symbol_id")[F.col("symbol_id")], F.col("_identity")[F.col("identity")]
    rows = rows.withColumns({"rarest": F.coalesce(rare["rarest"], F.lit(0.0)), "rarities": F.coalesce(rare["rarities"], F.lit(0.0)), "callers": calling["callers"], "relation_score": F.coalesce(calling["relation_score"], F.lit(0).cast("long"))}).drop("_symbol_id", "_identity")
    at = {k: F.col(k).isNotNull() for k in PLACES}
    early = lambda k: -F.coalesce(F.col(k), F.lit(NOWHERE))
    function = F.col("kind") == "function"
    direct = function & (F.col("scoped_match") | F.col("qualified_match") | at["frame"] | at["source_line"] | at["snippet"] | at["constructor"])
    unscoped = F.col("unscoped_explicit") | F.col("unscoped_dotted")
    key = lambda *c: F.struct(*[x.alias(f"k{i}") for i, x in enumerate((*c, -F.col("symbol_id")))])  # noqa: E731  the last for the sake of order alone
    pointed = key(
        at["frame"], F.coalesce("frame", F.lit(-1)), at["source_line"], early("source_line"), at["snippet"], early("snippet"), F.col("qualified_match"), at["constructor"], early("constructor"), F.col("mentioned"),
        F.col("explicit_match"), F.col("scoped_match"), F.col("primary_match"), F.size("local_overlap"), F.col("component_match"), -F.col("line"),
    )
    first = (F.col("relation_score"), F.col("title_strength"), F.round("rarest", 12), F.round("rarities", 12))
    meaning = key(*first, F.col("unscoped_explicit"), ~F.col("name").startswith("_"), F.col("component_match"), -F.col("line"), F.size("local_overlap"))
    exact = F.col("local_match") & ~unscoped
    last = key(F.col("primary_match"), F.col("qualified_match"), exact, F.when(unscoped, 0).otherwise(F.size("local_overlap")), F.col("component_match"), -F.col("line"))
    admissible = F.col("primary_match") | exact | ((F.size("overlap") > 0) & ~unscoped)
    tells = (F.col("relation_score") > 0) | (F.col("title_strength") > 0) | (F.col("rarest") > 0)
    others = [c for c in rows.columns if c not in ("issue_id", "path")]
    keys = {"_direct": F.when(direct, pointed), "_meaning": F.when(function, meaning), "_last": last}
    best = rows.withColumns(keys).withColumns({"_tells": F.bool_or(function & tells).over(file), **{f"{k}_most": F.max(k).over(file) for k in keys}})
    is_best = lambda k: F.col(k).isNotNull() & (F.col(k) == F.col(f"{k}_most"))
    tier = F.when(F.col("_direct_most").isNotNull(), F.when(is_best("_direct"), "direct")).when(F.col("_tells"), F.when(is_best("_meaning"), "semantic")).when(is_best("_last") & admissible, "fallback")
    # rows of one symbol may be as good as each other
    chosen = best.withColumn("tier", tier).where("tier IS NOT NULL").groupBy("issue_id", "path").agg(F.first(F.struct("tier", *others)).alias("p"))
    return chosen.select("issue_id", "path", "p.*")


def explained(chosen: DataFrame) -> DataFrame:
    """issue_id, path, identity, name, line, end_line, tier, pointed (by a frame, line or excerpt), said (the evidence)."""
    none = F.array().cast("array<string>")
    rows = chosen.withColumns({"label": F.col("identity"), "exact_match": F.col("local_match"), "unscoped_match": F.col("unscoped_explicit"), "title_match": F.col("title_strength") > 0, "callers": F.coalesce("callers", none)})
    pointed = F.col("frame").isNotNull() | F.col("source_line").isNotNull() | F.col("snippet").isNotNull()
    return rows.select("issue_id", "path", "identity", "name", "line", "end_line", "tier", pointed.alias("pointed"), S.evidence().alias("said"))
