"""Similarity join of token sets in blocks: sets are packed, a few thousand to a row, and every two rows are compared in NumPy.

A set travels as marks, BITS of each token's hash. At low thresholds most words of a set are in its prefix, so that a join on words exchanges every set many times; blocks are
written once and read for each other block, so that what is written grows with the sets and not with their pairs. Two tokens may have the same mark; what that can hide or add
is allowed for, so that no pair at the bound is lost, and a few may be too many: the caller compares the tokens of those that are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators.tables import stored

# Bits of a mark (whole bytes), marks of a block and pairs of equal marks that are looked at together.
BITS, BLOCK, AT_ONCE = 24, 1_000_000, 4_000_000
PACKED = "block long, ids binary, n binary, held binary, marks binary"
FOUND = "a long, b long, most double"


def marks(tokens: Column) -> Column:
    """The distinct marks of an array of strings, each as BITS / 4 digits, packed."""
    digits = F.transform(tokens, lambda x: F.lpad(F.hex(F.xxhash64(x).bitwiseAND((1 << BITS) - 1)), BITS // 4, "0"))
    return F.unhex(F.array_join(F.array_distinct(digits), ""))


def _numbers(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8).reshape(-1, BITS // 8).astype(np.int32)
    return raw @ (1 << np.arange(BITS - 8, -1, -8, dtype=np.int32))


def pack(sets: DataFrame) -> DataFrame:
    """sets (set_id, n, marks) as rows of PACKED: up to BLOCK marks each, or one set of more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def block():
            ids, n, own = zip(*rows)
            held = np.array([len(x) * 8 // BITS for x in own], np.int32)
            values = [[ids[0]], *[[x] for x in (np.array(ids, np.int64).tobytes(), np.array(n, np.int32).tobytes(), held.tobytes(), b"".join(own))]]
            return pa.RecordBatch.from_arrays([pa.array(values[0], pa.int64()), *[pa.array(x, pa.binary()) for x in values[1:]]], names=["block", "ids", "n", "held", "marks"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and size + len(row[2]) > BLOCK * BITS // 8:
                    yield block()
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2])
        if rows:
            yield block()

    return sets.select("set_id", "n", "marks").mapInArrow(run, PACKED)


class Side:
    """One of two blocks: its sets' marks as ranks, rarest first, and the prefixes in which a pair has to meet."""

    def __init__(self, ranks: np.ndarray, n: np.ndarray, held: np.ndarray, least: float):
        self.n, self.held = n, held
        self.start = np.concatenate([[0], np.cumsum(held, dtype=np.int64)])
        row = np.repeat(np.arange(len(held)), held)
        order = np.argsort(row * np.int64(ranks.max() + 1) + ranks)
        self.ranks = ranks[order]
        # tokens with one mark hide at most as many common ones
        need = np.maximum(1, np.ceil(least * n - 1e-9).astype(np.int64) - (n - held))
        self.prefix = held - need + 1
        inside = np.arange(len(row)) - self.start[row] < self.prefix[row]
        self.rows, self.words = row[inside], self.ranks[inside]
        self.last = self.ranks[self.start[:-1] + self.prefix - 1]


def near(x: Side, y: Side, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of x and y whose sets can have a Jaccard of least (> 0) or more, and the most that it can be."""
    by_word = np.argsort(y.words, kind="stable")
    words, rows = y.words[by_word], y.rows[by_word]
    low, high = np.searchsorted(words, x.words, "left"), np.searchsorted(words, x.words, "right")
    met = high > low
    own, low, many = x.rows[met], low[met], (high - low)[met]
    ends, at, wide = np.cumsum(many), 0, np.int64(len(y.n))
    seen = np.zeros(int(max(x.ranks.max(), y.ranks.max())) + 1, bool)
    while at < len(own):
        # whole rows of x: one of them meets each mark of y once at most
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")), at + 1)
        to = len(own) if to >= len(own) else int(np.searchsorted(own, own[to], "left")) if own[to] != own[at] else int(np.searchsorted(own, own[at], "right"))
        k = many[at:to]
        other = rows[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(low[at:to], k)]
        first = own[at]
        keys = (np.repeat(own[at:to], k) - first) * wide + other
        cells = int(own[to - 1] - first + 1) * int(wide)
        if cells <= 4 * len(keys) + AT_ONCE:
            counts = np.bincount(keys, minlength=cells)
            keys = np.flatnonzero(counts)
            counts = counts[keys]
        else:
            keys, counts = np.unique(keys, return_counts=True)
        at = to
        i, j = keys // wide + first, keys % wide
        na, nb = x.n[i], y.n[j]
        hidden = np.minimum(na - x.held[i], nb - y.held[j])
        # behind the prefix that ends first there are at most its set's other marks
        rest = np.where(x.last[i] <= y.last[j], (x.held - x.prefix)[i], (y.held - y.prefix)[j])
        need = (na + nb) * (least / (1 + least)) - 1e-6 - hidden
        good = (counts + rest >= need) & (np.minimum(na, nb) >= least * np.maximum(na, nb) - 1e-6)
        if same:
            good &= i < j
        i, j, need, hidden = i[good], j[good], need[good], hidden[good]
        common = np.zeros(len(i), np.int64)
        edges = np.flatnonzero(np.diff(i, prepend=-1, append=-1)) if len(i) else []
        for p, q in zip(edges[:-1], edges[1:]):
            mine = x.ranks[x.start[i[p]] : x.start[i[p] + 1]]
            seen[mine] = True
            for r in range(p, q):
                common[r] = np.count_nonzero(seen[y.ranks[y.start[j[r]] : y.start[j[r] + 1]]])
            seen[mine] = False
        good = common + hidden >= need
        i, j = i[good], j[good]
        na, nb = x.n[i], y.n[j]
        most = np.minimum((common + hidden)[good], np.minimum(na, nb))
        yield i, j, most / (na + nb - most)


def compare(left: tuple, right: tuple, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """near() for two rows of PACKED, without their first column: set_ids instead of rows."""
    parts = [[np.frombuffer(s[0], np.int64), np.frombuffer(s[1], np.int32).astype(np.int64), np.frombuffer(s[2], np.int32).astype(np.int64), _numbers(s[3])] for s in (left, right)]
    cut = len(parts[0][3])
    _, place, df = np.unique(np.concatenate([parts[0][3], parts[1][3]]), return_inverse=True, return_counts=True)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    ranks = rank[place.reshape(-1)]
    x, y = Side(ranks[:cut], *parts[0][1:3], least), Side(ranks[cut:], *parts[1][1:3], least)
    for i, j, most in near(x, y, least, same):
        yield parts[0][0][i], parts[1][0][j], most


def likely_pairs(sets: DataFrame, least: float) -> DataFrame:
    """a, b, most: the pairs of sets (set_id, n > 0 tokens, marks; each set_id once) that can have a Jaccard of least (> 0) or more, and the most that it can be."""
    packed = stored(pack(sets), "blocks")
    side = lambda p: packed.select(*[F.col(c).alias(f"{c}_{p}") for c in packed.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = [c[k].as_py() for c in batch.columns]
                for found in compare(row[1:5], row[6:], least, row[0] == row[5]):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], names=["a", "b", "most"])

    # each two blocks meet, whatever words they have
    return side("a").crossJoin(side("b")).where("block_a <= block_b").mapInArrow(run, FOUND)
