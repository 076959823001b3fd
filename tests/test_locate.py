"""Signals of issue texts and the location of files on a small repository."""

import pytest
from pyspark.sql import functions as F

from quarryline.functions import signals as G
from quarryline.operators import codeindex, locate
from quarryline.operators.graph import merge_lists

ISSUES = [
    (1, "demo", "Parser fails on empty header", "Call `parse_header(None)`:\n```python\nfrom demo.parser import parse_header\nparse_header('')\n```\n  File \"src/demo/parser.py\", line 3, in parse_header\n", ["bug"]),
    (2, "demo", "Slow startup", "Nothing more.", []),
]
FILES = [
    ("demo", "src/demo/parser.py", "from demo.util import clean\n\ndef parse_header(line):\n    '''Parse a header.'''\n    return clean(line)\n"),
    ("demo", "src/demo/util.py", "def clean(x):\n    return x.strip()\n"),
    ("demo", "src/demo/server.py", "from demo.parser import parse_header\n\ndef serve(x):\n    return parse_header(x)\n"),
    ("demo", "tests/test_parser.py", "from demo.parser import parse_header\n"),
    *[("demo", f"src/demo/other_{i}.py", f"def other_{i}():\n    pass\n") for i in range(30)],
]


def test_names_in_code():
    text = "Use `a.b(1)` and `Name`, not `def made(x)`.\n```\nx.y\n__all__\nclass Z(object): pass\nrun(q(2))\n```\nin __main__ and in pkg.mod"
    assert G.explicit_identifiers(text) == ["Name", "__all__", "__main__", "a.b", "b", "pkg.mod", "q", "run", "x.y"]
    assert G.called_identifiers(text) == ["a.b", "run", "q"]


def test_frames_and_lines():
    sha = "a" * 40
    text = f'  File "src\\a.py", line 3, in f\nat lib/b.py:7 in C.m\nsee https://github.com/o/r/blob/{sha}/src/c.py#L9-L11 and d.py#L2, ../e.py#L1'
    assert G.traceback_frames(text) == [{"path": "src/a.py", "symbol": "f"}, {"path": "lib/b.py", "symbol": "C.m"}]
    assert G.line_references(text) == [{"path": "src/c.py", "line": 9, "revision": sha}, {"path": "d.py", "line": 2, "revision": None}]
    assert len(G.line_references(" ".join(f"f{i}.py#L{i + 1}" for i in range(12)))) == 8


@pytest.fixture(scope="module")
def found(spark):
    issues = spark.createDataFrame(ISSUES, "issue_id long, repository string, title string, body string, labels array<string>")
    files = spark.createDataFrame(FILES, "repository string, path string, content string")
    index = codeindex.repository_map(files.select("path", "content"))
    return locate.locate(G.issue_signals(issues), files, index).cache()


def test_the_named_file_comes_first(found):
    first = found.where("issue_id = 1 AND rank = 1").first()
    assert first.path == "src/demo/parser.py" and first.symbol == "parse_header" and first.lines == "3-5"
    assert "Issue references this exact source path" in first.evidence
    rank = {r.path: r["rank"] for r in found.where("issue_id = 1").collect()}
    assert rank["src/demo/util.py"] == 10  # from outside the shortlist: the strong chain server -> parse_header -> clean takes the first band's last place
    assert "Two-hop source call chain via parse_header reaches clean, defined here: src/demo/parser.py" in found.where("issue_id = 1 AND rank = 10").first().evidence
    assert rank["src/demo/server.py"] < 10


def test_limits_and_order(found):
    rows = found.groupBy("issue_id").agg(F.count("*").alias("n"), F.max("rank").alias("m"), F.count_distinct("path").alias("p")).collect()
    assert {(r.n, r.m, r.p) for r in rows} == {(20, 20, 20)}


def test_lists_merge():
    base = list(range(1, 21))
    assert merge_lists(base, set(), [], [30], 20) == [*range(1, 20), 30]
    assert merge_lists(base, {20}, [], [30], 20) == [*range(1, 19), 20, 30]
    assert merge_lists(base, set(), [40], [], 20) == [*range(1, 10), 40, *range(10, 20)]
    assert merge_lists(base, set(base), [], [30], 20) == base
