"""A paged REST source, single objects and their lists. The data source gives items as JSON text. The transport is a function and can be replaced in tests."""

from __future__ import annotations

import json
import re
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE_SIZE = 100


def http_get(url: str, token: str | None = None, timeout: float = 30.0):
    request = urllib.request.Request(url, headers={"Accept": "application/json", **({"Authorization": f"Bearer {token}"} if token else {})})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


def pages(get: Callable[[str], list], url: str, first: int = 1, last: int | None = None, size: int = PAGE_SIZE) -> Iterator[tuple[int, list]]:
    """Pages of a list until one is short or last is reached."""
    page = first
    while last is None or page <= last:
        items = get(f"{url}{'&' if '?' in url else '?'}per_page={size}&page={page}")
        items = items.get("items", []) if isinstance(items, dict) else items
        yield page, items
        if len(items) < size:
            return
        page += 1


def open_issues(get: Callable[[str], list], url: str, limit: int = 100) -> list[dict]:
    """The first limit items that aren't pull requests; asks for no page more than that takes."""
    found: list[dict] = []
    for _, items in pages(get, url):
        found += [x for x in items if not x.get("pull_request")]
        if len(found) >= limit:
            break
    return found[:limit]


def linked_closed_issues(get: Callable[[str], dict], base: str, repository: str, limit: int = 50) -> list[dict]:
    """The first limit closed issues with a linked pull request, the last updated first; pull requests that the search gives don't count."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    query = urllib.parse.quote(f"repo:{owner_and_name(repository)} is:issue is:closed linked:pr")
    return open_issues(get, f"{base}/search/issues?q={query}&sort=updated&order=desc", limit)


#: Single objects: their place, the field that must repeat the key, and what keys look like.
LOOKUPS = {"issue": ("issues", "number", r"[1-9][0-9]*"), "pull": ("pulls", "number", r"[1-9][0-9]*"), "commit": ("commits", "sha", r"[0-9a-f]{40}")}
#: Lists that belong to one object.
CHILDREN = {"timeline": ("issues", "timeline"), "files": ("pulls", "files"), "commits": ("pulls", "commits")}


def owner_and_name(repository: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+", repository):
        raise ValueError(f"not owner/name: {repository}")
    return repository


def lookup(get: Callable[[str], dict], base: str, repository: str, kind: str, key: int | str) -> dict:
    """One issue, pull request or commit; an error if the answer is another one, or a pull request where an issue is asked for."""
    folder, name, form = LOOKUPS[kind]
    if not re.fullmatch(form, str(key)):
        raise ValueError(f"not a key of {kind}: {key}")
    found = get(f"{base}/repos/{owner_and_name(repository)}/{folder}/{key}")
    if not isinstance(found, dict) or found.get(name) != key or (kind == "issue" and "pull_request" in found):
        raise ValueError(f"the answer does not describe {kind} {key}")
    return found


def children(get: Callable[[str], list], base: str, repository: str, kind: str, key: int) -> list[dict]:
    """All items of an issue's timeline, or of a pull request's files or commits."""
    folder, name = CHILDREN[kind]
    if not isinstance(key, int) or key < 1:
        raise ValueError(f"not a number: {key}")
    found: list[dict] = []
    for _, items in pages(get, f"{base}/repos/{owner_and_name(repository)}/{folder}/{key}/{name}"):
        if not isinstance(items, list) or not all(isinstance(x, dict) for x in items):
            raise ValueError("the answer is not a list of objects")
        found += items
    return found


class Stride(InputPartition):
    """Pages first, first + step, ... up to last, or to the end of the list."""

    def __init__(self, first: int, step: int, last: int | None):
        self.first, self.step, self.last = first, step, last


class PagedReader(DataSourceReader):
    """Partitions take turns at the pages, and each ends at its first page that isn't full; so no number of pages has to be known."""

    def __init__(self, options: dict):
        self.url, self.token = options["url"], options.get("token")
        self.last = int(options["pages"]) if "pages" in options else None
        self.step = max(1, int(options.get("readers", 4)))

    def partitions(self) -> list[Stride]:
        return [Stride(k, self.step, self.last) for k in range(1, min(self.step, self.last or self.step) + 1)]

    def read(self, partition: Stride):
        page = partition.first
        while partition.last is None or page <= partition.last:
            _, items = next(pages(lambda u: http_get(u, self.token), self.url, page, page))
            for item in items:
                yield page, json.dumps(item)
            if len(items) < PAGE_SIZE:
                return
            page += partition.step


class PagedSource(DataSource):
    """spark.dataSource.register(PagedSource); spark.read.format('paged_rest').option('url', …).load() gives page and item (JSON); pages ends it early, readers is the number of partitions."""

    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return "page long, item string"

    def reader(self, schema) -> PagedReader:
        return PagedReader({k.lower(): v for k, v in self.options.items()})
