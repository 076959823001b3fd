"""The Python parser and the index tables on small trees."""

import pytest

from quarryline.operators import codeindex as C
from quarryline.operators.pyparse import parse

TREE = {
    "src/pkg/__init__.py": "from .core import run\n",
    "src/pkg/core.py": 'import os.path\nfrom pkg.util import helper as h, other\nfrom . import util\n\nclass Job:\n    """A job."""\n    def start(self):\n        return h(1)\n\ndef run(x):\n    """Run it."""\n    other(x)\n    return Job().start()\n\ndef lazy():\n    from pkg.util import other\n    return other(2)\n',
    "src/pkg/util.py": "def helper(a):\n    return a\n\ndef other(b):\n    return helper(b)\n",
    "tests/test_core.py": "import pytest\nimport fastapi\nfrom pkg import core\n\ndef test_run():\n    assert core.run(1)\n",
    "build/skip.py": "def x():\n    pass\n",
    "broken.py": "def x(:\n",
    "pyproject.toml": "",
    "web/app.ts": "",
}


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame(list(TREE.items()), "path string, content string")


@pytest.fixture(scope="module")
def index(tree):
    return C.repository_map(tree)


def test_symbols_and_modules(index):
    got = {(r.path, r.qualified_name, r.kind, r.line) for r in index["symbols"].collect()}
    assert ("src/pkg/core.py", "Job.start", "function", 7) in got and ("src/pkg/core.py", "Job", "class", 5) in got
    assert not any(p.startswith(("build", "broken")) for p, *_ in got)
    assert {r.path: (r.module, r.package) for r in index["modules"].collect()}["src/pkg/core.py"] == ("pkg.core", "pkg")
    assert {r.path: (r.module, r.package) for r in index["modules"].collect()}["src/pkg/__init__.py"] == ("pkg", "pkg")


def test_calls_resolve_across_files(index):
    got = {(r.path, r.caller, r.target_file, r.target_symbol, r.function_local) for r in index["uses"].where("kind = 'call'").collect()}
    assert got == {
        ("src/pkg/core.py", "Job.start", "src/pkg/util.py", "helper", False),
        ("src/pkg/core.py", "run", "src/pkg/util.py", "other", False),
        ("src/pkg/core.py", "lazy", "src/pkg/util.py", "other", True),
        ("src/pkg/util.py", "other", "src/pkg/util.py", "helper", False),
    }


def test_imports_frameworks_and_folders(index):
    got = {(r.path, r.target_path): r.symbols for r in index["imports"].collect()}
    assert got["src/pkg/core.py", "src/pkg/util.py"] == ["helper", "other"]
    assert got["tests/test_core.py", "src/pkg/core.py"] == [] and got["src/pkg/__init__.py", "src/pkg/core.py"] == ["run"]
    assert [tuple(r) for r in index["frameworks"].collect()] == [("FastAPI", 1)]
    assert [r.directory for r in index["test_directories"].collect()] == ["tests"]
    assert [r.path for r in index["runtime_files"].collect()] == ["pyproject.toml"]
    assert {r.language: r.files for r in index["languages"].collect()} == {"Python": 5, "TypeScript": 1}


def calls(source):
    return {(u[1], u[3], u[4], u[5]) for u in parse(source)["uses"] if u[0] == "call"}


@pytest.mark.parametrize(
    "source",
    [
        "from a import f\nf = 1\ndef g():\n    f()\n",
        "from a import f\nfrom b import f\ndef g():\n    f()\n",
        "from a import f\ndef g(f):\n    f()\n",
        "from a import f\ndef g():\n    f = 2\n    f()\n",
        "from a import f\ndef h():\n    global f\n    f = 1\ndef g():\n    f()\n",
        "from a import f\nfor f in []:\n    pass\ndef g():\n    f()\n",
        "from a import f\ndef k(x=(f := 3)):\n    pass\ndef g():\n    f()\n",
        "from a import f\ntry:\n    pass\nexcept E as f:\n    pass\ndef g():\n    f()\n",
        "if x:\n    from a import f\ndef g():\n    f()\n",
        "def g():\n    if x:\n        from a import f\n    f()\n",
        "def g():\n    from a import f\n    f = 1\n    f()\n",
        "def g(f):\n    from a import f\n    f()\n",
        "def g():\n    x = 1\n    from a import f\n    f()\n",
        "def out():\n    from a import f\n    def inner():\n        f()\n",
        "from a import f\ndef g():\n    f()\ndef g():\n    f()\n",
    ],
)
def test_uncertain_names_are_left_out(source):
    assert not calls(source)


def test_certain_names():
    assert calls("from a.b import f as k\ndef g():\n    k()\n") == {("g", "a.b.f", "f", False)}
    assert calls("def g():\n    'doc'\n    import os\n    from .a import f\n    f()\n") == {("g", ".a.f", "f", True)}
    assert calls("def f():\n    pass\nclass A:\n    def f(self):\n        f()\n") == {("A.f", "", "f", False)}
    assert calls("from a import f\nf()\nx = [f(y) for y in z]\n") == {(None, "a.f", "f", False)}


def test_external_calls_and_overloads():
    got = parse("import numpy as np\nfrom typing import overload\nimport os\n@overload\ndef g(a: int): ...\n@overload\ndef g(a: str): ...\ndef g(a):\n    return np.linalg.norm(os.getcwd())\n")
    assert got["external"] == [("g", "numpy.linalg.norm"), ("g", "os.getcwd")] or set(got["external"]) >= {("g", "numpy.linalg.norm"), ("g", "os.getcwd")}
    assert parse("def x(:")["symbols"] == []
