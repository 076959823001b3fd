"""The git data source against git itself, on a small repository."""

import subprocess

import pytest
from pyspark.sql import functions as F

from quarryline.sources.git import register


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("history")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True).stdout.decode()
    git("init", "-q")
    for k in range(12):
        (root / f"f{k % 4}.py").write_text("".join(f"line {i} of {k}\n" for i in range(k + 1)))
        (root / "a b\tc.txt").write_text(f"{k}\n")
        (root / "raw.bin").write_bytes(b"\xff\xfe\x00" + bytes([k]))
        git("add", "-A")
        git("commit", "-qm", f"change {k}")
    (root / "f1.py").unlink()
    git("add", "-A")
    git("commit", "-qm", "drop")
    register(spark)
    load = lambda table, **o: spark.read.format("git_history").options(path=str(root), table=table, **o).load()
    return git, load


def test_commits_equal_the_log_in_several_partitions(history):
    git, load = history
    found = load("commits", commits_each="3")
    want = set()
    for k, part in enumerate(git("log", "--name-status", "-z", "--format=%x01%H").split("\x01")[1:]):
        sha, *fields = [x.strip("\n") for x in part.split("\0") if x.strip("\n")]
        want |= {(k, sha, c, p) for c, p in zip(fields[::2], fields[1::2])}
    assert {tuple(r) for r in found.collect()} == want and len(want) == 12 * 3 + 1
    assert found.rdd.getNumPartitions() == 5
    assert load("commits", most="2").select("commit_ord").distinct().count() == 2


def test_blame_and_revisions_equal_git(history):
    git, load = history
    blamed = {(r.path, r.line): r.sha for r in load("blame", files_each="2").where("path = 'f3.py'").collect()}
    want = {i: line.split()[0] for i, line in enumerate(git("blame", "-l", "-s", "--root", "HEAD", "--", "f3.py").splitlines(), 1)}
    assert {line: sha for (_, line), sha in blamed.items()} == want
    old, new = git("rev-list", "HEAD").split()[5], git("rev-list", "HEAD").split()[0]
    found = load("revisions").where(F.col("revision").isin(old, new) & (F.col("path") == "f2.py"))
    assert {(r.revision, r.content) for r in found.collect()} == {(r, git("show", f"{r}:f2.py")) for r in (old, new)}
    assert found.rdd.getNumPartitions() == 2
    assert {r.path for r in load("revisions").where(F.col("revision") == new).collect()} == {"a b\tc.txt", "f0.py", "f2.py", "f3.py"}
    few = load("commits", commits_each="1").where("commit_ord = 3 AND path = 'f2.py'")
    assert [(r.commit_ord, r.path) for r in few.collect()] in ([], [(3, "f2.py")]) and few.rdd.getNumPartitions() == 1


def test_files_of_blamed_commits(history):
    _, load = history
    blamed = load("blame").where("path = 'f3.py'").select("sha").distinct()
    files = load("commits").where("change IN ('A', 'M')").join(blamed, "sha", "left_semi").select("path").distinct()
    assert {r.path for r in files.collect()} == {"a b\tc.txt", "f3.py", "raw.bin"}
