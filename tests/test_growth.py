"""Plans whose exchanges and broadcasts stay within what the tables call for."""

from pyspark.sql import functions as F

from quarryline.operators import choice, codeindex, paths, similarity


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lists_of_files_are_not_broadcast(spark):
    # as many files as there may be look short to the optimizer
    files = spark.range(40).select(F.concat(F.lit("pkg/mod"), F.col("id").cast("string"), F.lit(".py")).alias("path"))
    asked = files.select("path", F.explode(F.array(F.lit(".mod1.Thing"), F.lit("pkg.mod2"))).alias("target"))
    found = codeindex.resolve_imports(asked, codeindex.modules(files))
    joins = [x for x in plan(found).splitlines() if "BroadcastHashJoin" in x]
    assert not [x for x in joins if "root" not in x]
    assert {(r.target, r.target_path, r.imported_symbol) for r in found.collect()} == {(".mod1.Thing", "pkg/mod1.py", "Thing"), ("pkg.mod2", "pkg/mod2.py", None)}


def test_importers_are_found_once_for_issues_of_the_same_words(spark):
    marked = spark.createDataFrame([(f"f{i}", True, ["alpha"] if i < 3 else ["gamma"]) for i in range(4)], "path string, production boolean, scope array<string>")
    symbols = spark.createDataFrame([("f0", n, n, "function") for n in ("evict_one", "evict_two")], "path string, name string, qualified_name string, kind string")
    imports = spark.createDataFrame([("f1", "f0"), ("f2", "f0"), ("f3", "f0")], "path string, target_path string")
    issues = spark.createDataFrame([(i, ["alpha", "evict"] if i < 50 else ["alpha"]) for i in range(60)], "issue_id long, title_text_terms array<string>")
    found = paths.importers(issues, {"symbols": symbols, "imports": imports}, marked)
    # files meet with kinds of titles, not with issues
    assert not [x for x in plan(found).splitlines() if "Join" in x and "issue_id" in x]
    assert sorted((r.issue_id, r.file_id, r.via) for r in found.collect()) == [(i, f, "f0: evict_one, evict_two") for i in range(50) for f in ("f1", "f2")]


def test_matches_are_exchanged_once_to_be_chosen_from(spark):
    fields = "issue_id long, path string, symbol_id long, name string, identity string, kind string, line int, end_line int, overlap array<string>, local_overlap array<string>, told array<string>, local_match boolean, qualified_match boolean, primary_match boolean, component_match boolean, mentioned int, unscoped_dotted boolean, title_strength double, frame int, source_line int, snippet int, constructor int, scoped_match boolean, explicit_match boolean, unscoped_explicit boolean"
    row = lambda k, told: (1, "f", k, f"fn_{k}", f"fn_{k}", "function", k, k, [], [], told, False, False, False, False, 0, False, 0.0, None, None, None, None, False, False, False)
    scoped = spark.createDataFrame([row(1, ["a"]), row(2, ["b"]), row(3, [])], fields)
    counts = spark.createDataFrame([("f", "a", 2), ("f", "b", 1)], "path string, term string, n long")
    related = spark.createDataFrame([], "issue_id long, path string, identity string, callers array<string>, relation_score long")
    found = choice.choose(scoped, counts, related)
    assert "symbol_id" not in "".join(x.split("hashpartitioning(")[1].split(")")[0] for x in plan(found).splitlines() if "hashpartitioning(" in x)
    assert [(r.symbol_id, r.tier, r.rarest) for r in found.collect()] == [(2, "semantic", 1.0)]


def test_names_of_shown_files_are_not_exchanged_one_by_one(spark):
    symbols = spark.createDataFrame([("f", "x", "function"), ("f", "y", "function"), ("f", "y", "function"), ("g", "x", "function"), ("g", "z", "function"), ("g", None, "function")], "path string, name string, kind string")
    shown = spark.createDataFrame([(1, "f"), (1, "g"), (2, "f")], "issue_id long, path string")
    found = choice.unique_in_files(symbols, shown)
    assert "hashpartitioning(issue_id" in plan(found)
    assert not [x for x in plan(found).splitlines() if "hashpartitioning(issue_id" in x and "name#" in x]
    assert {(r.issue_id, r.name) for r in found.collect()} == {(1, "z"), (1, None), (2, "x")}


def test_sketches_and_places_lose_no_pair_of_token_sets(spark):
    import random

    r = random.Random(5)
    sets = [set(r.sample([f"w{i}" for i in range(30)], r.randint(1, 12))) for _ in range(60)]
    sets += [s ^ {f"w{r.randrange(30)}"} for s in sets[:30]]
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "ord long, tokens array<string>")
    # sets differ in as many elements as their sketches in bits, or more
    bits = rows.select("ord", *similarity.sketch(F.transform("tokens", lambda x: F.xxhash64(x)))).orderBy("ord").collect()
    assert all(sum(((a[k] ^ b[k]) & ((1 << 64) - 1)).bit_count() for k in range(1, len(a))) <= len(sets[a.ord] ^ sets[b.ord]) for a in bits for b in bits)
    first = {}
    for i, s in enumerate(sets):
        if s:
            first.setdefault(frozenset(s), i)
    for least in (0.3, 0.8):
        want = {(min(i, j), max(i, j)) for a, i in first.items() for b, j in first.items() if i != j and len(a & b) >= least * len(a | b) - 1e-12}
        got = similarity.duplicate_classes(rows, least).collect()
        assert sorted((x.left_number, x.right_number) for x in got) == sorted(want)
