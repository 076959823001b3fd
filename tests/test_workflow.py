"""Runs that stop and go on, and workers that have no copy of the package."""

import datetime as dt
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from quarryline.operators import runs, workflow


def clock():
    return dt.datetime(2024, 5, 1)


def test_a_stopped_run_goes_on_after_its_last_node(spark, tmp_path):
    calls = []

    def nodes(fail):
        def double(state):
            calls.append("double")
            return {"rows": state["start"].select((F.col("id") * 2).alias("x")), "n": 4}

        def total(state):
            calls.append("total")
            if fail:
                raise RuntimeError("killed")
            return {"sum": state["rows"].agg(F.sum("x")).first()[0] + state["n"]}

        return [("double", double), ("total", total)]

    store, state = runs.RunStore(spark, f"file://{tmp_path}/s"), {"start": spark.range(5)}
    with pytest.raises(RuntimeError):
        runs.run_workflow(store, "r", workflow.durable(store, "r", nodes(True)), state, clock)
    assert store.run("r").status == "failed"
    again = runs.run_workflow(store, "r", workflow.durable(store, "r", nodes(False)), state, clock)
    assert calls == ["double", "total", "total"] and again["sum"] == 24 and store.run("r").status == "awaiting_review"
    other = runs.run_workflow(store, "other", workflow.durable(store, "other", nodes(False)), state, clock)
    assert other["sum"] == again["sum"] and sorted(r.x for r in other["rows"].collect()) == sorted(r.x for r in again["rows"].collect())


def test_triage_goes_from_issues_to_evidence_and_resumes(spark, tmp_path):
    files = spark.createDataFrame([("demo", "src/demo/parser.py", "def parse_header(line):\n    return line\n"), ("demo", "src/demo/util.py", "def clean(x):\n    return x\n")], "repository string, path string, content string")
    rows = [(1, "Crash in `parse_header`", "data loss", ["bug"], 3, dt.datetime(2024, 4, 1), dt.datetime(2024, 4, 2), 0, "demo"), (2, "Typo", "small", [], 0, dt.datetime(2024, 4, 1), dt.datetime(2024, 4, 2), 1, "demo")]
    issues = spark.createDataFrame(rows, "number long, title string, body string, labels array<string>, comments_count int, created_at timestamp, updated_at timestamp, ord long, repository string")
    store, asked = runs.RunStore(spark, f"file://{tmp_path}/s"), []

    def answer(state):
        asked.append(sorted(state))
        if len(asked) == 1:
            raise RuntimeError("the model is away")
        return {"answer": {"said": state["evidence"].count()}}

    with pytest.raises(RuntimeError):
        workflow.triage(store, "t", issues, files, "2024-05-01 00:00:00", clock, chosen=1, answer=answer)
    state = workflow.triage(store, "t", issues, files, "2024-05-01 00:00:00", clock, chosen=1, answer=answer)
    assert [r.number for r in state["chosen"].collect()] == [1] and state["awaiting"] == 1 and state["answer"] == {"said": 1}
    first = state["candidates"].where("rank = 1").first()
    assert (first.path, first.symbol) == ("src/demo/parser.py", "parse_header")
    assert "1: def parse_header(line):" in state["evidence"].first().evidence[0].content
    tried = [r.node_name for r in store.traces("t").where("status = 'completed'").collect()]
    assert tried.count("evidence") == 2 and tried.count("model") == 1  # the second pass only read what the first had stored


SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
sys.path.insert(0, {root!r})
from quarryline.operators.codeindex import parse_python
files = spark.createDataFrame([("a.py", "def f():\\n    return 1\\n")], "path string, content string")
print("SYMBOLS", [s.name for s in parse_python(files).first().symbols])
"""


def test_workers_parse_without_a_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "SYMBOLS ['f']" in done.stdout, done.stderr[-2000:]
