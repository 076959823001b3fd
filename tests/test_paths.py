"""Typed relations with their gates, each with the cases that it has to refuse, and the choice of symbols in tiers."""

import pytest
from pyspark.sql import functions as F

from quarryline.functions import signals as G
from quarryline.operators import choice, codeindex, graph, locate, paths

FILES = {
    "pkg/__init__.py": "from pkg.net.client import Client\nfrom pkg.util.misc import helper\n",
    "pkg/net/__init__.py": "",
    "pkg/net/client.py": "class Client:\n    def __init__(self):\n        open_socket_now()\n\ndef open_socket_now():\n    pass\n",
    "pkg/net/caller.py": "from pkg import Client, helper\nimport requests\n\ndef fetch_pages():\n    Client()\n    helper()\n    return requests.get('x')\n",
    "pkg/net/other.py": "import requests\n\ndef download_all():\n    return requests.get('y')\n",
    "pkg/util/misc.py": "def helper():\n    return 1\n",
    "pkg/store/writer.py": "from pkg.store.codec import encode_block, WIDTH\nfrom pkg.store.base import Base\n\ndef write_block(x):\n    return encode_block(x) + WIDTH\n",
    "pkg/store/codec.py": "from pkg.store.bits import shift_bits\n\nWIDTH = 1\n\ndef encode_block(x):\n    return shift_bits(x)\n",
    "pkg/store/bits.py": "def shift_bits(x):\n    return x\n",
    "pkg/store/base.py": "class Base:\n    pass\n",
    "pkg/store/protocol.py": "from pkg.store.bits import shift_bits\n\ndef encode_frame(x):\n    return shift_bits(x)\n",
    "pkg/store/lazy.py": "def run_lazy():\n    from pkg.store.codec import encode_block\n    return encode_block(1)\n",
    "pkg/store/made.py": "def make_lazy():\n    from pkg.store.thing import Thing\n    return Thing()\n",
    "pkg/store/thing.py": "from pkg.store.bits import shift_bits\n\nclass Thing:\n    def __init__(self):\n        shift_bits(2)\n",
    "pkg/caching/layers.py": "def evict_entry():\n    pass\n\ndef evict_many():\n    pass\n\ndef layer_count():\n    pass\n",
    "pkg/caching/layer_policy.py": "from pkg.caching.layers import evict_entry\n",
    "pkg/disk/policy.py": "from pkg.caching.layers import evict_many\n",
    "tests/test_codec.py": "from pkg.store.codec import encode_block\n",
}


def issue(n, title, body="", labels=()):
    return (n, "r", title, body, list(labels))


ISSUES = [
    issue(1, "encode block fails"),
    issue(2, "Buffer layers should evict entries sooner", ""),
    issue(3, "Slow", "`requests.get(1)` in `fetch_pages()` and `pkg/net/caller.py`"),
    issue(4, "Slow", "`requests.get(1)` alone"),
]


@pytest.fixture(scope="module")
def world(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, content string")
    index = {k: v.cache() for k, v in codeindex.repository_map(files).items()}
    signals = G.issue_signals(spark.createDataFrame(ISSUES, "issue_id long, repository string, title string, body string, labels array<string>")).cache()
    return index, paths.marks(index["files"]).cache(), signals


def seeds(spark, *rows):
    return spark.createDataFrame(list(rows), "issue_id long, file_id string")


def rows(df):
    return {(r.issue_id, r.file_id, r.kind, r.bonus, r.via) for r in df.collect()}


def test_marks_tell_packages_tests_and_declarations(world):
    marked = {r.path: r for r in world[1].collect()}
    assert marked["tests/test_codec.py"].auxiliary and not marked["tests/test_codec.py"].production
    assert not marked["pkg/store/protocol.py"].concrete and marked["pkg/store/codec.py"].concrete
    assert marked["pkg/net/client.py"].subsystem == ["net"] and marked["pkg/store/codec.py"].subsystem == ["store"] and marked["pkg/util/misc.py"].subsystem == []
    assert sorted(marked["pkg/caching/layers.py"].scope) == ["layer"]  # the stem "cach" is short


def test_imports_by_what_is_done_with_them(spark, world):
    index, marked, signals = world
    start = seeds(spark, (1, "pkg/store/writer.py"), (1, "pkg/store/lazy.py"), (1, "tests/test_codec.py"), (2, "pkg/store/writer.py"))
    got = rows(paths.one_step(start, signals, index, marked))
    assert (1, "pkg/store/codec.py", "call", 9.0, "encode_block") in got and (2, "pkg/store/codec.py", "call", 8.0, "encode_block") in got
    assert (1, "pkg/store/base.py", "import", 0.75, "pkg/store/writer.py") in got
    assert (1, "pkg/store/codec.py", "function_local", 4.5, "encode_block") in got
    assert (1, "pkg/store/codec.py", "test_import", 3.5, "tests/test_codec.py") in got and len(got) == 6


def test_chains_go_through_the_callee(spark, world):
    index, marked, signals = world
    got = rows(paths.two_steps(seeds(spark, (1, "pkg/store/writer.py"), (2, "pkg/store/writer.py"), (1, "pkg/store/lazy.py"), (1, "pkg/store/made.py"), (1, "tests/test_codec.py")), signals, index, marked))
    assert got == {
        (1, "pkg/store/bits.py", "two_hop", 5.0, "shift_bits"),
        (1, "pkg/store/bits.py", "strong_two_hop", 8.0, "encode_block reaches shift_bits, defined here: pkg/store/codec.py"),
        (2, "pkg/store/bits.py", "two_hop", 5.0, "shift_bits"),
        (1, "pkg/store/bits.py", "function_local_two_hop", 5.0, "shift_bits"),  # from lazy.py, and from made.py through Thing.__init__
    }


def test_importers_lie_in_the_titles_scope(world):
    index, marked, signals = world
    # disk/policy.py imports the file as well, but its path has no word of the title
    assert rows(paths.importers(signals, index, marked)) == {(2, "pkg/caching/layer_policy.py", "reverse_import", 5.0, "pkg/caching/layers.py: evict_entry, evict_many")}


def test_shared_calls_need_their_caller_named(spark, world):
    index, marked, signals = world
    got = rows(paths.shared_calls(seeds(spark, (3, "pkg/net/caller.py"), (4, "pkg/net/caller.py"), (3, "pkg/net/other.py")), signals, index, marked))
    assert got == {(3, "pkg/net/other.py", "shared_call", 5.0, "requests.get with fetch_pages in pkg/net/caller.py: download_all")}


def test_facades_lead_within_the_subsystem(spark, world):
    index, marked, signals = world
    referenced = seeds(spark, (3, "pkg/net/caller.py")).withColumnRenamed("file_id", "path")
    # pkg is the package, so net is the subsystem of client.py and caller.py, and util another one
    got = rows(paths.reexports(seeds(spark, (3, "pkg/net/caller.py"), (4, "pkg/net/caller.py")), referenced, index, marked))
    assert got == {(3, "pkg/net/client.py", "reexport", 7.0, "Client via pkg/__init__.py")}


def test_displayed_relations_make_room_for_special_ones(spark):
    rel = [("call", 9.0, "a"), ("call", 8.5, "b"), ("strong_two_hop", 8.0, "s"), ("shared_call", 5.0, "q"), ("reexport", 7.0, "x")]
    cases = {1: rel[:2], 2: rel[:3], 3: rel[:2] + rel[3:4], 4: rel[:4], 5: rel, 6: rel[:2] + rel[4:], 7: rel[:2] + rel[3:], 8: rel[2:4]}
    df = spark.createDataFrame([(k, "f", *r) for k, rs in cases.items() for r in rs], "issue_id long, file_id string, kind string, bonus double, text string")
    got = {r.issue_id: r.shown for r in graph.displayed(df).collect()}
    assert got == {1: ["a", "b"], 2: ["a", "s"], 3: ["a", "q"], 4: ["s", "q"], 5: ["s", "x"], 6: ["a", "x"], 7: ["q", "x"], 8: ["s", "q"]}


SYMBOLS = [
    ("a.py", "load", "Store.load", "function", 1, 3, "Load the table."),
    ("a.py", "save", "Store.save", "function", 5, 7, "Save the table to disk."),
    ("a.py", "flush_table", "flush_table", "function", 9, 12, None),
    ("a.py", "Store", "Store", "class", 1, 8, None),
    ("b.py", "load", "load", "function", 1, 2, None),
    ("b.py", "start", "start", "function", 4, 6, "Table of parts."),
    ("c.py", "Table", "Table", "class", 1, 9, "The table."),
    ("d.py", "load", "Other.load", "function", 1, 2, None),
]
NO_PLACES = "issue_id long, path string, identity string, frame int, source_line int, snippet int, constructor int"


def picked(spark, title, body="", places=(), shown=None):
    symbols = spark.createDataFrame(SYMBOLS, "path string, name string, qualified_name string, kind string, line int, end_line int, docstring string")
    signals = G.issue_signals(spark.createDataFrame([(1, "r", title, body, [])], "issue_id long, repository string, title string, body string, labels array<string>"))
    met = choice.matches(signals, symbols, spark.createDataFrame(list(places), NO_PLACES)).cache()
    unique = choice.unique_in_files(symbols) if shown is None else choice.unique_in_files(symbols, spark.createDataFrame([(1, p) for p in shown], "issue_id long, path string"))
    uses = spark.createDataFrame([], "path string, kind string, caller string, target_file string, target_symbol string")
    referenced = paths.referenced_paths(signals, symbols.select("path").distinct())
    return {r.path: (r.tier, r.identity) for r in choice.choose(choice.in_scope(met, unique, referenced), choice.word_counts(symbols), choice.callers(met, uses)).collect()}


def test_rare_words_decide_before_common_ones(spark):
    # all three functions of a.py tell "tabl"; only save tells "disk"
    assert picked(spark, "Table on disk is broken")["a.py"] == ("semantic", "Store.save")
    # ties on rarity go to the first public function
    assert picked(spark, "Table is broken")["a.py"] == ("semantic", "Store.load")


def test_places_and_qualified_names_come_first(spark):
    assert picked(spark, "Table on disk", "see `Store.load`")["a.py"] == ("direct", "Store.load")
    assert picked(spark, "Table on disk", "", [(1, "a.py", "flush_table", 1, None, None, None)])["a.py"] == ("direct", "flush_table")


def test_names_that_are_borne_twice_count_in_scope_only(spark):
    # load is in three files: not direct, and an unscoped name is no fallback either
    found = picked(spark, "Broken", "call `load()`")
    assert "d.py" not in found or found["d.py"][0] != "direct"
    assert picked(spark, "Broken", "call `flush_table()`")["a.py"] == ("direct", "flush_table")
    assert picked(spark, "Broken", "call `start()`")["b.py"] == ("direct", "start")
    # named together with its path it counts
    assert picked(spark, "Broken", "call `load()` in b.py")["b.py"] == ("direct", "load")


def test_inadmissible_fallbacks_give_nothing(spark):
    found = picked(spark, "Odd", "see `other.thing.start`")
    assert "b.py" not in found
    assert picked(spark, "Odd parts table")["c.py"] == ("fallback", "Table")


def test_second_pass_takes_names_unique_among_the_shown(spark):
    symbols = spark.createDataFrame(SYMBOLS, "path string, name string, qualified_name string, kind string, line int, end_line int, docstring string")
    two = choice.unique_in_files(symbols, spark.createDataFrame([(1, "b.py"), (1, "c.py"), (2, "b.py"), (2, "d.py")], "issue_id long, path string"))
    assert {tuple(r) for r in two.collect()} == {(1, "load"), (1, "start"), (2, "start")}


def test_every_kind_of_relation_reaches_the_ranking(spark):
    issues = spark.createDataFrame([issue(1, "encode block fails in writer", "`write_block(1)` in pkg/store/writer.py"), issue(2, "Buffer layers should evict entries sooner"), issue(3, "Slow", "`requests.get(1)` in `fetch_pages()` of pkg/net/caller.py")], "issue_id long, repository string, title string, body string, labels array<string>")
    files = spark.createDataFrame([("r", p, c) for p, c in FILES.items()], "repository string, path string, content string")
    commits = spark.createDataFrame([(1, "pkg/store/writer.py"), (1, "pkg/util/misc.py"), (2, "pkg/store/writer.py"), (2, "pkg/util/misc.py")], "commit_ord long, file_id string")
    blamed = spark.createDataFrame([("pkg/store/writer.py", i, 2) for i in range(1, 9)], "path string, line int, commit_ord long")
    found = locate.locate(G.issue_signals(issues), files, codeindex.repository_map(files.select("path", "content")), commits=commits, blamed=blamed)
    said = {(r.issue_id, r.path): " | ".join(r.evidence) for r in found.collect()}
    assert "Two-hop source call chain via encode_block reaches shift_bits" in said[1, "pkg/store/bits.py"]
    assert "calls imported symbols defined here: encode_block" in said[1, "pkg/store/codec.py"]
    assert "Changed with lexical seed files in 2 prior commits (latest 1)" in said[1, "pkg/util/misc.py"] and "Blame-selected seed line" in said[1, "pkg/util/misc.py"]
    assert "Imports title-matching source module pkg/caching/layers.py" in said[2, "pkg/caching/layer_policy.py"]
    assert "Shares issue-referenced qualified call requests.get" in said[3, "pkg/net/other.py"] and "re-exported symbols defined here: Client via" in said[3, "pkg/net/client.py"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
