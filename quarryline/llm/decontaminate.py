"""Benchmark decontamination (operator 6): one Aho-Corasick automaton over normalised benchmark windows.

Normal form: A-Z lower-cased, words are runs of [0-9A-Za-z] and characters beyond ASCII. Words are those of UTF-8 bytes, where all
bytes from 0x80 belong to words, so nothing depends on a decoder. A window is WINDOW consecutive
words of an item, an item of fewer words (but some) is one window. Each word of the benchmark has a code of fixed width over an
alphabet of 64, all other words share one that no window holds; so a text becomes a line in which the n-th word stands at n times
the width, and the automaton takes a few steps for each word. Each text is normalised and
scanned once; matches are word intervals whose union gives the words hit, and for texts with
hits the words' places in the original are found, so that spans can be shown or cut.

There is one automaton, whatever the benchmark: about 2 KB for each of its words, built once in a worker process. It
is made from the items' texts, which are broadcast after their words are counted: a benchmark of over most_words words is refused
with an error (give a larger number to executors with more memory), never cut.

Null texts have no words and no hits. Repeated rows are judged alike, one result row each. Very long texts are scanned whole, in
time linear in their length. Null and empty benchmark items have no windows; an empty benchmark hits nothing. A null item_id counts as ''.
Tables may have other columns of any name; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import sys
from itertools import repeat
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import BOOL, LONG, STRING, annotate, only, struct, table

WINDOW = 13
#: Words of a benchmark, all items together: half a gigabyte for each worker.
MOST_WORDS = 250_000

_FOLD = bytes((b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


class Windows:
    """The automaton of items (item_id, text), and the codes of their words."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW):
        import ahocorasick

        texts = [(item, normal(text)) for item, text in items]
        names = dict.fromkeys(w for _, words in texts for w in words)
        self.width = next(k for k in range(1, 9) if 64**k > len(names))
        self.codes = {w: "".join(chr(48 + (n >> 6 * k & 63)) for k in range(self.width)) for n, w in enumerate(names)}
        self.other = "." * self.width
        owners: dict[str, set[str]] = {}
        for item, words in texts:
            line = "".join(map(self.codes.__getitem__, words))
            for at in range(max(1, len(words) - size + 1) if words else 0):
                owners.setdefault(line[at * self.width : (at + size) * self.width], set()).add(item)
        self.found = ahocorasick.Automaton()
        for window, own in owners.items():
            self.found.add_word(window, (len(window) // self.width, tuple(sorted(own))))
        self.found.make_automaton()
        self.empty = not owners

    @classmethod
    def of_worker(cls, items: list[tuple[str, str | None]]) -> Windows:
        """One for all tasks of a worker process; another benchmark takes its place."""
        held = sys.modules.setdefault("_quarryline_windows", ModuleType("_quarryline_windows")).__dict__
        key = hashlib.sha256(repr(items).encode("utf-8", "replace")).hexdigest()
        if held.get("key") != key:
            held.update(key=None, windows=None)
            held.update(windows=cls(items), key=key)
        return held["windows"]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words, disjoint word intervals [from, to) that windows cover, and the items they come from."""
        words = normal(text)
        if self.empty:
            return len(words), [], set()
        hits: dict[int, int] = {}
        items: set[str] = set()
        for end, (n, names) in self.found.iter("".join(map(self.codes.get, words, repeat(self.other)))):
            end += 1
            if end % self.width == 0:  # else it begins within a word's code
                end //= self.width
                hits[end - n] = max(hits.get(end - n, 0), end)
                items.update(names)
        joined: list[tuple[int, int]] = []
        for a, b in sorted(hits.items()):
            if joined and a <= joined[-1][1]:
                joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
            else:
                joined.append((a, b))
        return len(words), joined, items


def original(text: str, intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word intervals as character offsets [from, to) in the text itself."""
    raw = text.encode("utf-8", "replace")
    places = [m.span() for m in _WORD.finditer(raw)]
    chars = lambda b: len(raw[:b].decode("utf-8"))
    return [(chars(places[a][0]), chars(places[b - 1][1])) for a, b in intervals]


def contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


SCHEMA = struct(n_words=LONG, n_hit=LONG, n_items=LONG, items_sha256=STRING, contaminated=BOOL, spans=T.ArrayType(struct(start=LONG, end=LONG)))


def items_of(benchmark: DataFrame, most_words: int = MOST_WORDS) -> list[tuple[str, str]]:
    """The benchmark's items on the driver, after a count of their words has shown that they are few."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where("text IS NOT NULL")
    words = rows.agg(F.sum(F.size(F.split("text", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")))).first()[0] or 0
    if words > most_words:
        raise ValueError(f"the benchmark has {words} words, the automaton is meant for {most_words}; set most_words where executors have 2 KB for each word and worker")
    return sorted((r.item, r.text) for r in rows.collect())


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), spans: bool = True, most_words: int = MOST_WORDS) -> DataFrame:
    """One row per document: carry columns, n_words, n_hit, n_items, items_sha256, contaminated and, if asked for, the hit spans of the original text."""
    items = docs.sparkSession.sparkContext.broadcast(items_of(benchmark, most_words))
    schema = SCHEMA if spans else T.StructType(SCHEMA.fields[:-1])

    def make():
        windows = Windows.of_worker(items.value)

        def work(texts: list) -> list:
            rows = []
            for text in texts:
                n, joined, names = windows.scan(text)
                hit = sum(b - a for a, b in joined)
                row = (n, hit, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), contaminated(n, hit))
                rows.append((*row, [{"start": a, "end": b} for a, b in original(text, joined)] if joined else []) if spans else row)
            return [list(c) for c in zip(*rows)]

        return work

    return annotate(docs, make, schema, text, carry)


def clean(docs: DataFrame, benchmark: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    items = docs.sparkSession.sparkContext.broadcast(items_of(benchmark, most_words))

    def make():
        windows = Windows.of_worker(items.value)

        def good(text: str | None) -> bool:
            n, joined, _ = windows.scan(text)
            return not contaminated(n, sum(b - a for a, b in joined))

        return lambda texts: [good(t) for t in texts]

    return only(docs, make)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), spans=False)


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS k FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(d.w), 0) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
