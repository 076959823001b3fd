"""Hashed byte n-grams of whole texts, many texts at a time with NumPy, and bounded training samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes counted at once; longer texts are counted in such parts (n-grams across their borders are left out).
PART = 1 << 20


def _folded(raw: np.ndarray) -> np.ndarray:
    """Latin letters lower-cased, all other ASCII as blanks."""
    fold = np.arange(256, dtype=np.uint8)
    fold[:128] = 32
    fold[97:123] = np.arange(97, 123)
    fold[65:91] = np.arange(97, 123)
    out = fold[raw]
    if len(raw) > 1:
        out[1:][(raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)] += 32
    return out


def _runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes with a blank before and after each text, and the number of its text for each byte."""
    parts, owners, size = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t), PART):
            piece = t[at : at + PART]
            parts.append(b" " + piece + b" ")
            owners.append((i, len(piece) + 2))
            size += len(piece) + 2
            if size >= PART:
                yield np.frombuffer(b"".join(parts), np.uint8), np.repeat([o[0] for o in owners], [o[1] for o in owners])
                parts, owners, size = [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.repeat([o[0] for o in owners], [o[1] for o in owners])


def gram_counts(texts: list[str | None], bins: int, sizes: tuple[int, ...] = (1, 2, 3), fold: bool = True, repeats: bool = False) -> np.ndarray:
    """A row of counts for each text (zeros for null and empty ones): its byte n-grams hashed to bins.

    fold: only letters count. repeats: two more columns, words and words equal to the one before.
    """
    raw = [t.encode("utf-8", "replace") if t else b"" for t in texts]
    n, width = len(raw), bins + 2 * repeats
    out = np.zeros((n, width), np.float64)
    shift = np.uint32(32 - (bins.bit_length() - 1))
    for data, owner in _runs(raw):
        data = _folded(data) if fold else data
        code = data.astype(np.uint32)
        low = int(owner[0])
        rows = owner - low
        span = int(rows[-1]) + 1
        value = np.zeros(len(code), np.uint32)
        for size in range(1, max(sizes) + 1):
            if len(code) < size:
                break
            value = (value[: len(code) - size + 1] if size > 1 else value) * np.uint32(257) + code[size - 1 :]
            if size not in sizes:
                continue
            inside = rows[: len(value)] == rows[size - 1 :]
            slot = (value * np.uint32(2654435761) + np.uint32(size * 97)) * np.uint32(2246822519) >> shift
            at = rows[: len(value)][inside] * width + slot[inside]
            out[low : low + span] += np.bincount(at, minlength=span * width).reshape(span, width)
        if repeats:
            words, same, who = _word_repeats(data, rows)
            out[low : low + span, bins] += np.bincount(who, minlength=span)[:span]
            out[low : low + span, bins + 1] += np.bincount(who, weights=same, minlength=span)[:span]
    return out


def _word_repeats(data: np.ndarray, rows: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Of each word: whether it equals the one before in its text, and its text."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    begin = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    end = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    if not len(begin):
        return 0, np.zeros(0), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        place = np.arange(len(data), dtype=np.uint64)
        mixed = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed * (place + np.uint64(1)))])
        plain = np.concatenate([[np.uint64(0)], np.cumsum(mixed)])
        flat = plain[end] - plain[begin]
        value = total[end] - total[begin] - begin.astype(np.uint64) * flat  # the same wherever the word stands
    who = rows[begin]
    same = np.zeros(len(begin))
    same[1:] = (value[1:] == value[:-1]) & (flat[1:] == flat[:-1]) & (end[1:] - begin[1:] == end[:-1] - begin[:-1]) & (who[1:] == who[:-1])
    return len(begin), same, who


def unit(counts: np.ndarray) -> np.ndarray:
    """Rows as square roots of shares: length 1, or zeros."""
    total = counts.sum(1, keepdims=True)
    return np.sqrt(counts / np.where(total > 0, total, 1)).astype(np.float32)


def learning() -> Column:
    """The rows that may be learned from, by doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded_sample(rows: DataFrame, by: str, most: int, seed: int) -> DataFrame:
    """About most rows in all (doc_id, text, by), shared evenly by the values of by: those whose hashed doc_id falls under a value's share.

    Works on counts by value and a filter; no row moves. Values with fewer rows give all they have.
    """
    counts = {r[by]: r["count"] for r in rows.groupBy(by).count().collect()}
    each = max(1, most // max(1, len(counts)))
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))
    keep = F.lit(False)
    for value, n in sorted(counts.items(), key=str):
        keep = keep | ((F.col(by) == F.lit(value)) & (place < int((1 << 30) * min(1.0, each / n))))
    return rows.where(keep).select("doc_id", "text", by)
