"""Repeated passages by prefix-free parsing (operator 12).

Texts are UTF-8 bytes. A byte goes if a string of WIDTH bytes covers it that also starts in a document with a smaller doc_id; strings lie within
one document and are judged on the input.

* Parsing: a rolling hash of WIDTH bytes, divisible by TRIGGER, starts a phrase; so does a document. A phrase runs on WIDTH - 1 bytes beyond the next
  trigger, so every string of WIDTH bytes lies in exactly one phrase occurrence and, phrases being set off by what they hold, copies
  of a passage are parsed alike. The parse of a document is the list of its phrases.
* Dictionary: the distinct phrases, each with the smallest doc_id in whose parse it occurs. A phrase in a document with a larger id is
  repeated from its first string to its last; nothing of it is looked at again, so copies cost a row for each phrase.
* Dictionary suffixes: suffixes of phrases are over WIDTH - 1 bytes, which makes them prefix-free: their order decides that of the corpus up to WIDTH bytes, and what the parse adds is the
  document of each phrase. Of the suffixes only those are sorted that can have an equal: the GRAM-byte hash that is least among those within
  a string of WIDTH bytes is the same in every equal string, so strings whose least one occurs in a single document are single themselves. Others are
  put in order, those of a piece first and then, in buckets, those of all pieces; a bucket has the suffixes of some least grams, so that strings that overlap travel together, but those of
  a gram that over SPREAD pieces have are dealt out by their whole strings. Neighbours that agree on WIDTH bytes
  are one string, and the smallest document among their phrases is compared with each phrase's own. Strings are compared by their bytes; phrases
  are told apart by 128 bits of XXH3.

Documents are packed into pieces of PIECE bytes (a longer one is a piece of its own), a table in the shared folder that is bucketed by piece:
the four passes read it where it lies and only what others have found travels. All three searches (phrases, least hashes, suffixes) are one exchange: each piece sends its distinct keys,
packed by bucket of a hash, and gets back which of them are elsewhere. So a key occurs once for each piece however often its text repeats, and no task holds the documents of a phrase.

Null texts count as empty. A null doc_id is neither smaller nor larger than any: such rows lose nothing and take nothing from others. Rows that share a
doc_id take nothing from each other, and each gets its row. Texts under WIDTH bytes stay whole. A very long text is hashed in chunks and its
suffixes are sorted in blocks. An empty table gives an empty result; columns besides doc_id and text are not read; doc_id is taken as a long.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import BATCH_ROWS, INT, LONG, STRING, give_back, map_in_arrow, new_path, stored, struct, table

WIDTH, GRAM, TRIGGER = 50, 24, 512
#: Bytes of a piece, of text for each bucket, and positions hashed at once and suffixes sorted at once.
PIECE, BUCKET, CHUNK, BLOCK = 2 << 20, 16 << 20, 1 << 18, 1 << 20
#: Pieces that may hold a least gram whose suffixes go to one bucket.
SPREAD = 64
BINARY = T.BinaryType()
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


# --- rolling hashes of a run of bytes ------------------------------------------------------------------------------------------------------


def _power_tables() -> list[np.ndarray]:
    """Powers of the base, of its inverse modulo 2**64, and a number for each byte."""
    if not _powers:
        n = CHUNK + WIDTH + 1
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _powers.append(np.multiply.accumulate(step))
        _powers.append((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MIX ^ np.uint64(_BASE >> 3))
    return _powers


def _windows(t: np.ndarray, widths: tuple[int, ...]) -> list[np.ndarray]:
    """For each width the hashes of all windows of it in t, at most CHUNK + WIDTH bytes; equal bytes give equal hashes wherever they lie."""
    up, down, of = _power_tables()
    total = np.zeros(len(t) + 1, np.uint64)
    np.cumsum(of[t] * up[: len(t)], out=total[1:])
    out = []
    for w in widths:
        h = (total[w:] - total[:-w]) * down[: len(t) - w + 1]
        h ^= h >> np.uint64(29)
        h *= _MIX
        h ^= h >> np.uint64(32)
        out.append(h)
    return out


def triggers_and_leasts(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all WIDTH-byte windows of t: where triggers are; where runs of windows with one least gram start; and those grams' hashes."""
    found, starts, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    span = WIDTH - GRAM + 1
    for at in range(0, len(t) - WIDTH + 1, CHUNK):
        part = t[at : at + CHUNK + WIDTH - 1]
        whole, gram = _windows(part, (WIDTH, GRAM))
        found.append(np.flatnonzero((whole >> np.uint64(20)) % np.uint64(TRIGGER) == 0) + at)
        # hash above, place below: of equal hashes the first is the least
        least = gram >> np.uint64(24) << np.uint64(24) | np.arange(len(gram), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        starts.append(new + at)
        grams.append(gram[place[new]])
    return np.concatenate(found), np.concatenate(starts), np.concatenate(grams)


# --- a piece: its documents, parse and dictionary ------------------------------------------------------------------------------------------


class Piece:
    """Documents packed together: bytes, where each begins, their ids, and their parse into phrases (first window, end of windows, document)."""

    def __init__(self, ids: list[int | None], texts: pa.Array) -> None:
        import xxhash

        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.ids, self.bounds = ids, (offsets - offsets[0]).astype(np.int64)
        found, self.run_starts, self.run_grams = triggers_and_leasts(self.bytes)
        first, last, of, keys = [], [], [], []
        for k, doc_id in enumerate(ids):
            begin, end = int(self.bounds[k]), int(self.bounds[k + 1]) - WIDTH + 1
            if doc_id is None or end <= begin:
                continue
            inner = found[np.searchsorted(found, begin + 1) : np.searchsorted(found, end)]
            first.append(np.concatenate([[begin], inner]))
            last.append(np.concatenate([inner, [end]]))
            of.append(np.full(len(inner) + 1, k))
        none = [np.zeros(0, np.int64)]
        self.first, self.last, self.of = (np.concatenate(none + x).astype(np.int64) for x in (first, last, of))
        view = memoryview(self.bytes)
        for a, b in zip(self.first.tolist(), self.last.tolist()):
            keys.append(xxhash.xxh3_128_digest(view[a : b + WIDTH - 1]))
        self.docs = np.array([ids[k] for k in self.of.tolist()], np.int64)
        self.keys = Keys(np.frombuffer(b"".join(keys), "S16"), self.docs)

    def dictionary(self, smallest: np.ndarray) -> np.ndarray:
        """One occurrence of each phrase whose smallest document (given for each key) is here."""
        own = np.flatnonzero(self.docs == smallest[self.keys.inverse])
        return own[np.unique(self.keys.inverse[own], return_index=True)[1]]

    def windows(self, occurrences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, occurrence) of all windows of some occurrences."""
        n = self.last[occurrences] - self.first[occurrences]
        of = np.repeat(occurrences, n)
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.first[of], of

    def leasts(self, occurrences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(run, occurrence) of the runs of windows that some occurrences meet."""
        low = np.searchsorted(self.run_starts, self.first[occurrences], "right") - 1
        n = np.searchsorted(self.run_starts, self.last[occurrences]) - low
        of = np.repeat(occurrences, n)
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n), of


class Keys:
    """The distinct ones of some keys of equal width in their order, with the least and greatest number that each has."""

    def __init__(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        new = np.concatenate([np.ones(min(1, len(keys)), bool), ordered[1:] != ordered[:-1]])
        at = np.flatnonzero(new)
        self.inverse = np.empty(len(keys), np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        self.keys, self.occurs = ordered[at], order[at]
        self.least = np.minimum.reduceat(numbers[order], at) if len(at) else numbers[:0]
        self.most = np.maximum.reduceat(numbers[order], at) if len(at) else numbers[:0]

    def hashes(self) -> np.ndarray:
        """A hash of each distinct key."""
        raw = np.ascontiguousarray(self.keys).view(np.uint8).reshape(len(self.keys), self.keys.dtype.itemsize)
        wide = np.zeros((len(raw), -(-raw.shape[1] // 8) * 8), np.uint8)
        wide[:, : raw.shape[1]] = raw
        h = np.zeros(len(raw), np.uint64)
        for column in wide.view(np.uint64).T:
            h = (h ^ column) * _MIX
            h ^= h >> np.uint64(31)
        return h

    def places(self, buckets: int, hashes: np.ndarray | None = None) -> list[tuple[int, np.ndarray]]:
        """(bucket, the distinct keys that go there in order of occurrence)."""
        if not len(self.keys):
            return []
        to = ((self.hashes() if hashes is None else hashes) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((self.occurs, to))
        cuts = np.flatnonzero(np.diff(to[order])) + 1
        return [(int(to[at[0]]), at) for at in np.split(order, cuts)]


# --- the exchange of keys between pieces ---------------------------------------------------------------------------------------------------

SENT = struct(bucket=INT, piece=LONG, block=INT, keys=BINARY, least=BINARY, most=BINARY)
BACK = struct(bucket=INT, piece=LONG, block=INT, at=BINARY, told=BINARY)


def _packed(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unpacked(data: bytes, dtype: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def send(piece: int, block: int, keys: Keys, buckets: int, hashes: np.ndarray | None = None) -> list[tuple]:
    return [(bucket, piece, block, _packed(keys.keys[at]), _packed(keys.least[at]), _packed((keys.most - keys.least)[at])) for bucket, at in keys.places(buckets, hashes)]


def elsewhere(sent: DataFrame, dtype: str, holders: bool = False) -> DataFrame:
    """piece and what it gets back: of its keys, those that have a smaller number somewhere than the greatest that it has sent, with the smallest; or (holders) those
    that have different numbers anywhere, with how many pieces sent them.

    Numbers of a piece's keys are documents, or the piece itself where it matters only whether others have the key.
    """

    def run(_: tuple, group: pa.Table) -> pa.Table:
        rows = [dict(zip(group.column_names, r)) for r in zip(*[c.to_pylist() for c in group.columns])]
        keys = np.concatenate([_unpacked(r["keys"], dtype) for r in rows])
        least, more = (np.concatenate([_unpacked(r[c], "<i8") for r in rows]) for c in ("least", "most"))
        sizes = [len(_unpacked(r["most"], "<i8")) for r in rows]
        whole = Keys(keys, least)
        smallest, greatest = whole.least[whole.inverse], least + more
        told = smallest
        if holders:
            greatest = Keys(whole.inverse, greatest).most[whole.inverse]
            told = np.bincount(whole.inverse)[whole.inverse]
        out, low = [], 0
        for r, n in zip(rows, sizes):
            at = np.flatnonzero(smallest[low : low + n] < greatest[low : low + n])
            if len(at):
                out.append((r["bucket"], r["piece"], r["block"], _packed(at.astype("<u4")), _packed(told[low : low + n][at].astype(np.int64))))
            low += n
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], names=BACK.names)

    back = sent.groupBy("bucket").applyInArrow(run, BACK)
    return back.groupBy("piece").agg(F.collect_list(F.struct("bucket", "block", "at", "told")).alias("found"))


def received(keys: Keys, found: list[dict] | None, block: int, buckets: int, default: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """For each distinct key the number that came back, or the default."""
    out, places = default.copy(), dict(keys.places(buckets, hashes))
    for row in found or []:
        if row["block"] == block:
            out[places[row["bucket"]][_unpacked(row["at"], "<u4")]] = _unpacked(row["told"], "<i8")
    return out


# --- the four passes -----------------------------------------------------------------------------------------------------------------------


def pack(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """piece, ids and texts (their UTF-8 bytes): a table bucketed by piece in the shared folder."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"))
    schema = T.StructType([T.StructField("piece", LONG), T.StructField("ids", T.ArrayType(LONG)), T.StructField("texts", T.ArrayType(BINARY))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, ids, texts, size = None, [], [], 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.binary()))], names=schema.names)

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                for row, doc_id, data in zip(*[c.slice(at, BATCH_ROWS).to_pylist() for c in batch.columns]):
                    if ids and size + len(data) > PIECE:
                        yield packed()
                        first, ids, texts, size = None, [], [], 0
                    first = row if first is None else first
                    ids.append(doc_id)
                    texts.append(data)
                    size += len(data)
        if ids:
            yield packed()
        give_back()

    spark, name = docs.sparkSession, f"pieces_{uuid.uuid4().hex}"
    made = map_in_arrow(rows, run, schema)
    made.write.bucketBy(buckets, "piece").option("path", new_path(spark, name)).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.read.table(name)


def _passed(pieces: DataFrame, backs: list[DataFrame], work: Callable[..., Iterator[tuple]], schema: T.StructType) -> DataFrame:
    """work(piece's number, piece, what came back of each exchange) for each piece, its rows as a table of schema."""
    joined = pieces
    for k, back in enumerate(backs):
        joined = joined.join(back.select("piece", F.col("found").alias(f"found{k}")).hint("shuffle_hash"), "piece", "left")
    names = [f"found{k}" for k in range(len(backs))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                texts = row.column(2).flatten()
                piece = Piece(row.column(1).to_pylist()[0], texts.cast(pa.binary()))
                for rows in work(row.column(0)[0].as_py(), piece, *[row.column(3 + k).to_pylist()[0] for k in range(len(names))]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                piece = texts = row = None
            batch = None
        give_back()

    return map_in_arrow(joined.select("piece", "ids", "texts", *names), run, schema)


def _single(piece: int, numbers: np.ndarray) -> np.ndarray:
    return np.full(len(numbers), piece, np.int64)


def _least_keys(number: int, piece: Piece, own: np.ndarray) -> tuple[Keys, np.ndarray, np.ndarray]:
    """Keys of the least grams in a piece's dictionary, whose number is the piece, or the greatest there is for those in several of its documents."""
    runs, of = piece.leasts(own)
    keys = Keys(piece.run_grams[runs], piece.docs[of])
    several = keys.least < keys.most
    keys.least, keys.most = _single(number, keys.least), np.where(several, np.iinfo(np.int64).max, number)
    return keys, runs, of


def _suffixes(piece: Piece, grams: Keys, runs: np.ndarray, of: np.ndarray, holders: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, Keys, np.ndarray]]:
    """(block, windows, their documents, the suffix array of their strings, hashes that deal it out) of the windows in a piece's dictionary whose least gram others have too."""
    kept = holders[grams.inverse] > 0
    gram, spread = grams.hashes()[grams.inverse][kept], (holders > SPREAD)[grams.inverse][kept]
    low = np.maximum(piece.run_starts[runs[kept]], piece.first[of[kept]])
    after = np.append(piece.run_starts, np.int64(len(piece.bytes)))
    high = np.minimum(after[runs[kept] + 1], piece.last[of[kept]])
    n = high - low
    ends, block, at = np.cumsum(n), 0, 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
        size = n[at:to]
        windows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[at:to], size)
        docs = np.repeat(piece.docs[of[kept][at:to]], size)
        strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(piece.bytes, WIDTH)[windows]).view(f"S{WIDTH}").ravel()
        keys = Keys(strings, docs)
        run = np.repeat(np.arange(at, to), size)[keys.occurs]
        yield block, windows, docs, keys, np.where(spread[run], keys.hashes(), gram[run])
        block, at = block + 1, to


def repeated_passages(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start and end of the removed runs, in bytes) for every document."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(spark.sparkContext.defaultParallelism, -(-size // BUCKET))
    pieces = pack(docs, text, buckets)

    def phrases(number, piece):
        rows = send(number, 0, piece.keys, buckets)
        return [rows] if rows else []

    smallest = stored(elsewhere(_passed(pieces, [], phrases, SENT), "S16"), "phrases")

    def dictionary(piece, found):
        return piece.dictionary(received(piece.keys, found, 0, buckets, piece.keys.least))

    def grams(number, piece, found):
        rows = send(number, 0, _least_keys(number, piece, dictionary(piece, found))[0], buckets)
        return [rows] if rows else []

    shared = stored(elsewhere(_passed(pieces, [smallest], grams, SENT), "<u8", True), "grams")

    def sorted_suffixes(number, piece, found, common):
        keys, runs, of = _least_keys(number, piece, dictionary(piece, found))
        holders = received(keys, common, 0, buckets, np.zeros(len(keys.keys), np.int64))
        return _suffixes(piece, keys, runs, of, holders)

    def suffixes(number, piece, found, common):
        for block, _, _, keys, hashes in sorted_suffixes(number, piece, found, common):
            rows = send(number, block, keys, buckets, hashes)
            if rows:
                yield rows

    earlier = stored(elsewhere(_passed(pieces, [smallest, shared], suffixes, SENT), f"S{WIDTH}"), "suffixes")
    out = T.StructType([*struct(doc_id=LONG, n_bytes=LONG, n_removed=LONG, n_spans=LONG, kept_sha256=STRING).fields, T.StructField("spans", T.ArrayType(T.ArrayType(LONG)))])

    def judged(number, piece, found, common, before):
        n = len(piece.bytes)
        least = received(piece.keys, found, 0, buckets, piece.keys.least)
        marked = np.zeros(n + 1, np.int8)
        for a, b in zip(*[x[piece.docs > least[piece.keys.inverse]].tolist() for x in (piece.first, piece.last)]):
            marked[a:b] = 1
        for block, windows, ids, keys, hashes in sorted_suffixes(number, piece, found, common):
            first = received(keys, before, block, buckets, keys.least, hashes)
            marked[windows[first[keys.inverse] < ids]] = 1
        # what one occurrence of a phrase has, the others in its document have too
        own = piece.dictionary(least)
        of_key = np.full(len(piece.keys.keys), -1)
        of_key[piece.keys.inverse[own]] = own
        for k in np.flatnonzero(piece.docs == least[piece.keys.inverse]).tolist():
            model = of_key[piece.keys.inverse[k]]
            if model != k:
                marked[piece.first[k] : piece.last[k]] = marked[piece.first[model] : piece.last[model]]
        edge = np.zeros(n + WIDTH + 2, np.int32)
        starts = np.flatnonzero(marked)
        edge[starts] += 1
        edge[starts + WIDTH] -= 1
        gone = np.cumsum(edge[:n]) > 0
        rows = []
        for k, doc_id in enumerate(piece.ids):
            a, b = int(piece.bounds[k]), int(piece.bounds[k + 1])
            there = gone[a:b]
            turns = np.flatnonzero(np.diff(np.concatenate([[0], there.astype(np.int8), [0]])))
            spans = turns.reshape(-1, 2).tolist()
            kept = piece.bytes[a:b][~there] if spans else piece.bytes[a:b]
            rows.append((doc_id, b - a, int(there.sum()), len(spans), hashlib.sha256(np.ascontiguousarray(kept).data).hexdigest(), spans))
        yield rows

    return _passed(pieces, [smallest, shared, earlier], judged, out)


def op12_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("spans")
