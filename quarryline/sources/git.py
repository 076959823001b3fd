"""Git history as a partitioned data source: register(spark); spark.read.format('git_history').option('path', folder).option('table', name).load().

Tables, of a repository in a folder that all executors see:

* commits: commit_ord (0 is the latest of HEAD), sha, change (A, M, D, R, T), path; a partition for each `commits_each` commits. Merges have no files of their own.
* blame: path, line, sha of HEAD's text files; a partition for each `files_each` files.
* revisions: revision, path, content of UTF-8 files; a partition for each of the revisions that a filter names, HEAD without one.

Equality and IN filters on commit_ord, sha, path and revision are taken into the git commands (register() allows Python sources that, for the session); Spark applies them to the rows again in any
case. Options: most (of the latest commits; all without), commits_each, files_each. A git command that fails fails the read; paths are bytes that must be UTF-8.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

SCHEMAS = {"commits": "commit_ord long, sha string, change string, path string", "blame": "path string, line long, sha string", "revisions": "revision string, path string, content string"}


def run(root: str, *args: str, given: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", root, *args], input=given, capture_output=True, check=True).stdout


def _names(listing: bytes) -> list[str]:
    return [x.decode() for x in listing.split(b"\0") if x]


class Part(InputPartition):
    """What one task reads: (ord, sha) of commits, paths, or one revision."""

    def __init__(self, items: list):
        self.items = items


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.table = options["path"].removeprefix("file://"), options.get("table", "commits")
        self.most = int(options["most"]) if "most" in options else None
        self.commits_each, self.files_each = int(options.get("commits_each", 500)), int(options.get("files_each", 50))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in ("commit_ord", "sha", "path", "revision"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                old = self.wanted.get(f.attribute[0])
                self.wanted[f.attribute[0]] = values if old is None else old & values
            yield f

    def _kept(self, column: str, value) -> bool:
        return column not in self.wanted or value in self.wanted[column]

    def partitions(self) -> list[Part]:
        if self.table == "revisions":
            return [Part([r]) for r in sorted(self.wanted.get("revision", {"HEAD"}))]
        if self.table == "blame":
            items, each = [p for p in _names(run(self.root, "ls-tree", "-rz", "--name-only", "HEAD")) if self._kept("path", p)], self.files_each
        else:
            limit = [f"-n{self.most}"] if self.most is not None else []
            shas = run(self.root, "rev-list", *limit, "HEAD").decode().split()
            items, each = [(k, s) for k, s in enumerate(shas) if self._kept("commit_ord", k) and self._kept("sha", s)], self.commits_each
        return [Part(items[at : at + each]) for at in range(0, len(items), each)]

    def _paths(self) -> list[str]:
        """Pathspecs of the wanted paths, taken literally."""
        return [f":(literal){p}" for p in sorted(self.wanted.get("path", ()))]

    def read(self, partition: Part) -> Iterator[tuple]:
        yield from {"commits": self._commits, "blame": self._blame, "revisions": self._revisions}[self.table](partition.items)

    def _commits(self, items: list[tuple[int, str]]) -> Iterator[tuple]:
        order = {sha: k for k, sha in items}
        fields = iter(_names(run(self.root, "diff-tree", "--stdin", "--root", "-r", "-z", "--name-status", "--", *self._paths(), given="".join(f"{s}\n" for s in order).encode())))
        sha = ""
        for field in fields:
            if len(field.strip()) == 40 and field.strip() in order:
                sha = field.strip()
            else:
                yield order[sha], sha, field[:1], next(fields)

    def _blame(self, items: list[str]) -> Iterator[tuple]:
        for path in items:
            for head in run(self.root, "blame", "--porcelain", "HEAD", "--", path).split(b"\n"):
                parts = head.split(b" ")
                if len(parts) in (3, 4) and len(parts[0]) == 40 and parts[2].isdigit():
                    yield path, int(parts[2]), parts[0].decode()

    def _revisions(self, items: list[str]) -> Iterator[tuple]:
        for revision in items:
            paths = [p for p in _names(run(self.root, "ls-tree", "-rz", "--name-only", revision)) if self._kept("path", p)]
            for path in paths:
                try:
                    yield revision, path, run(self.root, "cat-file", "blob", f"{revision}:{path}").decode()
                except UnicodeDecodeError:
                    continue


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_history"

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def schema(self) -> str:
        return SCHEMAS[self._options().get("table", "commits")]

    def reader(self, schema) -> GitReader:
        return GitReader(self._options())


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitSource)
