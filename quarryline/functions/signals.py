"""What an issue's text names: identifiers in code, calls in order, traceback frames and source lines.

Positions matter here, so it is plain Python behind one Arrow pass. A text is read once into code regions (backtick runs that
open and close) and words (names with what stands before and after them); identifiers and calls are chosen from these.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.functions import text as X

# What names, frames and references look like, and how many references count.
NAME = r"\b[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*\b"
FRAME = (
    r"""^\s*File\s+["'](.+?\.py)["'],\s+line\s+\d+,\s+in\s+((?:[A-Za-z_][A-Za-z0-9_]*\.)*[A-Za-z_][A-Za-z0-9_]*)\s*$"""
    r"""|^\s*(?:(?:\d+|at)\s+)?(.+?\.py):\d+\s+in\s+((?:[A-Za-z_][A-Za-z0-9_]*\.)*[A-Za-z_][A-Za-z0-9_]*)\s*$"""
)
LINE_REFERENCE = (
    r"https://github\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/blob/([0-9a-f]{40})/([A-Za-z0-9_.~%+/-]+\.py)#L([1-9][0-9]*)(?:-L[1-9][0-9]*)?"
    r"|(?<![A-Za-z0-9_./:\\-])((?:[A-Za-z0-9_.-]+[\\/])*[A-Za-z0-9_.-]+\.py)#L([1-9][0-9]*)(?:-L[1-9][0-9]*)?"
)
LINE_REFERENCES, SPAN_CHARS, LOOK_BACK = 8, 120, 12

_NAME, _FRAMES, _LINES = re.compile(NAME), re.compile(FRAME, re.MULTILINE), re.compile(LINE_REFERENCE, re.IGNORECASE)
_TICKS = re.compile("`+")


class Word(NamedTuple):
    """A name: where it begins, whether a parenthesis opens after it, and the keyword-like word right before it with the distance between their first letters."""

    start: int
    name: str
    called: bool
    before: str
    distance: int

    @property
    def defined(self) -> bool:
        return self.before in ("class", "def") and self.distance <= LOOK_BACK

    @property
    def marked(self) -> bool:
        """Dotted, or with two underscores at both ends."""
        return "." in self.name or (self.name[:2] == "__" == self.name[-2:])


def words(text: str, begin: int = 0, end: int | None = None) -> Iterator[Word]:
    """The names of text[begin:end] in order."""
    end = len(text) if end is None else end
    last, last_start, last_end = "", begin, begin
    for m in _NAME.finditer(text, begin, end):
        near = bool(last) and text[last_end : m.start()].isspace()
        after = m.end()
        while after < end and text[after].isspace():
            after += 1
        yield Word(m.start(), m[0], after < end and text[after] == "(", last if near else "", m.start() - last_start)
        last = m[0].rpartition(".")[2]
        last_start, last_end = m.end() - len(last), m.end()


def fences(text: str) -> Iterator[tuple[int, int]]:
    """Contents of fenced blocks: from the line after three ticks to the next three."""
    tick = text.find("```")
    while tick >= 0:
        line = text.find("\n", tick + 3)
        close = text.find("```", line + 1) if line >= 0 else -1
        if close < 0:
            return
        yield line + 1, close
        tick = text.find("```", close + 3)


def spans(text: str) -> Iterator[tuple[int, int]]:
    """Contents of code spans: between two single ticks of one line."""
    opened = None
    for run in _TICKS.finditer(text):
        single = run.end() - run.start() == 1
        if single and opened is not None and 0 < run.start() - opened <= SPAN_CHARS and "\n" not in text[opened : run.start()]:
            yield opened, run.start()
            opened = None
        else:
            opened = run.end() if single else None


def explicit_identifiers(text: str) -> list[str]:
    """Names that stand as code: whole spans and fences, calls in them, marked names in fences and after 'in'."""
    found = {w.name for w in words(text) if w.before == "in" and w.marked}
    for fenced, places in ((False, spans(text)), (True, fences(text))):
        for begin, end in places:
            region = text[begin:end].strip()
            if _NAME.fullmatch(region):
                found.add(region)
            for w in words(text, begin, end):
                if w.called and not w.defined:
                    found.update((w.name, w.name.rpartition(".")[2]))
                elif fenced and w.marked and not w.defined:
                    found.add(w.name)
    return sorted(found)


def called_identifiers(text: str) -> list[str]:
    """Calls in code, by position; one in a span and a fence counts for both."""
    calls = [(w.start, w.name) for place in (*spans(text), *fences(text)) for w in words(text, *place) if w.called and not w.defined]
    return [name for _, name in sorted(calls)]


def traceback_frames(text: str) -> list[dict]:
    return [{"path": (m[1] or m[3]).replace("\\", "/"), "symbol": m[2] or m[4]} for m in _FRAMES.finditer(text)]


def line_references(text: str) -> list[dict]:
    """Links to a line of an immutable revision, and path#Ln outside of those; without paths that lead up, eight at most."""
    found = []
    for m in _LINES.finditer(text):
        path = (m[2] or m[4]).replace("\\", "/")
        if ".." not in path.split("/"):
            found.append({"path": path, "line": int(m[3] or m[5]), "revision": m[1] and m[1].lower()})
    return found[:LINE_REFERENCES]


_FRAME = T.StructType([T.StructField("path", T.StringType()), T.StructField("symbol", T.StringType())])
_REFERENCE = T.StructType([T.StructField("path", T.StringType()), T.StructField("line", T.LongType()), T.StructField("revision", T.StringType())])
PLACED = T.StructType([
    T.StructField("explicit_identifiers", T.ArrayType(T.StringType())),
    T.StructField("called_identifiers", T.ArrayType(T.StringType())),
    T.StructField("traceback_frames", T.ArrayType(_FRAME)),
    T.StructField("line_references", T.ArrayType(_REFERENCE)),
])


def placed(text: Column, body: Column) -> Column:
    """PLACED of the text and the body alone."""
    @F.pandas_udf(PLACED)
    def work(texts: pd.Series, bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({
            "explicit_identifiers": texts.map(explicit_identifiers),
            "called_identifiers": texts.map(called_identifiers),
            "traceback_frames": bodies.map(traceback_frames),
            "line_references": bodies.map(line_references),
        })

    return work(text, body)


def issue_signals(issues: DataFrame) -> DataFrame:
    """issues (issue_id, repository, title, body, labels) with all signals; sets are sorted arrays."""
    body = F.coalesce("body", F.lit(""))
    text = F.concat_ws(" ", F.col("title"), body, F.array_join("labels", " "))
    primary = F.concat_ws(" ", F.col("title"), F.array_join("labels", " "))
    rows = issues.withColumns({"_text": text, "_p": placed(text, body)})
    plain = F.regexp_replace("_text", r"\b[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+\b", " ")
    bare = F.flatten(F.transform(F.filter(F.col("_p.explicit_identifiers"), lambda i: ~i.contains(".")), X.terms))
    return rows.select(
        "issue_id", "repository",
        X.terms(F.col("_text")).alias("terms"),
        F.array_sort(F.array_union(X.terms(plain), bare)).alias("content_terms"),
        F.array_sort(F.array_distinct(X.semantic_sequence(F.col("title")))).alias("title_terms"),
        X.semantic_sequence(F.col("title")).alias("title_sequence"),
        X.terms(F.col("title")).alias("title_text_terms"),
        X.terms(primary).alias("primary_terms"),
        X.identifiers(F.col("_text")).alias("identifiers"),
        X.identifiers(F.col("title")).alias("title_identifiers"),
        X.identifiers(primary).alias("primary_identifiers"),
        X.identifier_mentions(F.col("_text")).alias("mentions"),
        X.path_references(F.col("_text")).alias("paths"),
        X.source_snippets(body).alias("source_snippets"),
        "_p.*",
    )
