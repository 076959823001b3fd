"""Token ids in independent zstandard frames with a trailing seek table (operator 3).

A shard file: zstandard frames of little-endian uint32 ids (whole documents, about FRAME_BYTES
each, content checksum on), a skippable frame with the document index, and a skippable
frame with the seek table of the public zstd seekable format (compressed size, decompressed
size and the low 32 bits of the XXH64 of each frame's content). Any zstd tool decompresses
the file; a reader that wants some documents fetches the tail, then only the frames that hold them.

Documents are dealt to shards by ranges of doc_id (ties by a hash of the text), so shard after
shard the ids ascend. A null text counts as empty, an empty one is the end id alone. Null ids
come first. Repeated rows are written again. A task writes under a name of its own and moves the
file into place at the end, so a task that runs again after an executor is lost replaces it whole. There are as many
shards as shuffle partitions, and more where they would take over SHARD_BYTES of input each. A very long document is one frame.
Strings of special tokens in a text get those tokens' ids, as the library has it by default. An empty table gives no file and no row.
"""

from __future__ import annotations

import struct as packing
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import LONG, STRING, give_back, map_in_arrow, new_path, pieces, stored, struct, table

VOCABULARY, END_ID = "byte_bpe_50k.json", 2
FRAME_BYTES = 256 << 10
#: Input of a shard by Spark's statistics.
SHARD_BYTES = 512 << 20
#: In the document index: the bit of the number of ids that tells a null doc_id.
NULL_ID = 1 << 31
#: What a worker remembers: pieces of text and their ids. Pieces that are encoded as one text, and texts that are encoded together.
CACHE_BYTES, TOGETHER, TEXTS = 24 << 20, 200, 500
#: New pieces that are handed to the library at once, and pieces whose ids are gathered at once (one longer text goes alone).
LEARNED, GATHERED = 25 * TOGETHER, 1 << 15
SEEKABLE_MAGIC, TABLE_MAGIC, INDEX_MAGIC = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
#: Bits of a piece's number of ids; pieces with so many characters are left to the library.
_LONG = 20


class Encoder:
    """ids(texts) as bytes of uint32, through the tokenizers library.

    A byte-level BPE never merges across a border between a visible character and a space
    after it, so texts are cut there, Arrow finds the distinct pieces of many texts, and each of those is encoded once. New pieces are
    encoded many to a text; there the tokens that begin with a space are the first of each piece. Those that occur twice among the texts are
    remembered. The ids of all pieces lie in one array, from which those of a text are gathered. Texts with other white space beside a space, and those that hold a special token's
    string, are left to the library whole.
    """

    def __init__(self, path: str):
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.model.get_added_tokens_decoder().values())
        self.begins = np.zeros(self.model.get_vocab_size() + 1, bool)
        self.begins[[i for t, i in self.model.get_vocab().items() if t.startswith("\u0120")]] = True
        self.clear()

    def clear(self) -> None:
        import numpy as np

        # known pieces, and for each where its ids (with a space before it) begin in pool and how many they are
        self.known, self.places = pa.array([], pa.string()), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, "<u4"), 0

    @classmethod
    def of_worker(cls, path: str) -> Encoder:
        """One for all tasks of a worker process, with what it has learned."""
        import sys
        from types import ModuleType

        held = sys.modules.setdefault("_quarryline_encoders", ModuleType("_quarryline_encoders")).__dict__
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def _keep(self, ids) -> int:
        import numpy as np

        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _learn(self, new: list[str]):
        """Places of pieces that follow a space; -1 for those that hold or touch white space, which are left to the library with their texts."""
        import numpy as np

        good = np.array([bool(p) and not p[0].isspace() and not p[-1].isspace() and len(p) < 1 << _LONG for p in new], bool)
        new = new if good.all() else [p for p, g in zip(new, good) if g]
        groups, out, places = [new[at : at + TOGETHER] for at in range(0, len(new), TOGETHER)], [], np.full(len(good), -1, np.int64)
        for some, made in zip(groups, self.model.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(made.ids, "<u4")
            first = np.flatnonzero(self.begins[ids])
            if len(first) != len(some):
                each = [self.model.encode(" " + p, add_special_tokens=False).ids for p in some]
                ids = np.array([i for x in each for i in x], "<u4")
                first = np.cumsum([0, *map(len, each)])[:-1]
            out.append((self._keep(ids) + first) << _LONG | np.diff(first, append=len(ids)))
        places[good] = np.concatenate(out) if out else -1
        return places

    def _whole(self, texts: list[str], end: int) -> list[bytes]:
        made = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [packing.pack(f"<{len(x.ids) + 1}I", *x.ids, end) for x in made]

    def ids(self, texts, end: int = END_ID) -> list[bytes]:
        """texts: a list or an Arrow array of strings and nulls."""
        import numpy as np
        import pyarrow.compute as pc

        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        n = len(texts)
        if self.known.nbytes + self.places.nbytes + self.pool.nbytes > CACHE_BYTES:
            self.clear()
        lists = pc.split_pattern(texts, " ")
        edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        found, code = pc.index_in(coded.dictionary, value_set=self.known), coded.indices.to_numpy()
        place = np.full(len(found), -1, np.int64)
        place[found.is_valid().to_numpy(zero_copy_only=False)] = self.places[found.drop_null().to_numpy()]
        fresh = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        often = np.bincount(code, minlength=len(found))[fresh] > 1
        # pieces that occur once are written behind the pool for now; by runs, as what the library returns takes many times the ids' bytes
        used = self.used
        for some, keep in ((fresh[often], True), (fresh[~often], False)):
            unknown = coded.dictionary.take(pa.array(some))
            place[some] = learned = np.concatenate([np.zeros(0, np.int64), *(self._learn(unknown.slice(at, LEARNED).to_pylist()) for at in range(0, len(unknown), LEARNED))])
            if keep:
                good, used = learned >= 0, self.used
                self.known, self.places = pa.concat_arrays([self.known, unknown.filter(pa.array(good))]), np.concatenate([self.places, learned[good]])
        alone = np.zeros(n, bool)
        if (place[fresh] < 0).any():
            alone[np.searchsorted(edges, np.flatnonzero(place[code] < 0), "right") - 1] = True
        for x in self.special:
            alone |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        # the first piece of a text has no space before it; it and the end id are written behind the pool for now
        place[place < 0] = 0
        heads = self.model.encode_batch_fast(coded.take(edges[:-1]).cast(pa.string()).to_pylist(), add_special_tokens=False)
        many = np.array([len(h.ids) for h in heads], np.int64)
        base = self._keep([i for h in heads for i in h.ids])
        first = (base + np.cumsum(many) - many) << _LONG | many
        closing = self._keep([end]) << _LONG | 1
        out, at = [], 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + GATHERED, "right")) - 1)
            begin, ends = edges[at], edges[at + 1 : to + 1] - edges[at]
            segments = place[code[begin : edges[to]]]
            segments[edges[at:to] - begin] = first[at:to]
            segments = np.insert(segments, ends, closing)
            length, start = segments & (1 << _LONG) - 1, segments >> _LONG
            stop = np.cumsum(length)
            ids = self.pool[np.repeat(start - (stop - length), length) + np.arange(stop[-1])]
            bounds = [0, *stop[ends + np.arange(to - at)].tolist()]
            out += [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
            at = to
        self.used = used
        if alone.any():
            rows = np.flatnonzero(alone).tolist()
            for i, made in zip(rows, self._whole([texts[i].as_py() for i in rows], end)):
                out[i] = made
        return out


class ShardWriter:
    """Frames, document index and seek table into an open binary file."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.out, self.limit = out, frame_bytes
        self.zip = zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((0, len(ids) // 4 | NULL_ID) if doc_id is None else (doc_id, len(ids) // 4))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.limit:
            self.flush()

    def flush(self) -> None:
        import xxhash

        if not self.size:
            return
        raw = b"".join(self.held)
        packed = self.zip.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        index = self.zip.compress(b"".join(packing.pack("<qI", *d) for d in self.docs))
        self.out.write(packing.pack("<II", INDEX_MAGIC, len(index) + 8) + index + packing.pack("<II", len(self.docs), len(index)))
        entries = b"".join(packing.pack("<III", *f) for f in self.frames)
        self.out.write(packing.pack("<II", TABLE_MAGIC, len(entries) + 9) + entries + packing.pack("<IBI", len(self.frames), 0x80, SEEKABLE_MAGIC))


class ShardReader:
    """Random access to the documents of a shard file opened for reading and seeking."""

    def __init__(self, file):
        import zstandard

        self.file, self.unzip = file, zstandard.ZstdDecompressor()
        end = file.seek(0, 2) if not hasattr(file, "size") else file.size()
        n, flags, magic = packing.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != 0x80:
            raise ValueError("no seek table at the end of the file")
        at = end - 9 - 12 * n
        entries = self._at(at, 12 * n)
        self.frames, place, start = [], 0, 0
        for packed, raw, check in packing.iter_unpack("<III", entries):
            self.frames.append((place, packed, start, raw, check))
            place, start = place + packed, start + raw
        docs, size = packing.unpack("<II", self._at(at - 8 - 8, 8))
        self.docs, start = [], 0
        for doc_id, tokens in packing.iter_unpack("<qI", self.unzip.decompress(self._at(at - 16 - size, size), max_output_size=12 * docs)) if docs else ():
            self.docs.append((None if tokens & NULL_ID else doc_id, start, tokens & ~NULL_ID))
            start += tokens & ~NULL_ID
        self.opened: tuple[int, bytes] = (-1, b"")

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        import xxhash

        if self.opened[0] != k:
            place, packed, _, raw, check = self.frames[k]
            data = self.unzip.decompress(self._at(place, packed), max_output_size=raw)
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} is damaged")
            self.opened = (k, data)
        return self.opened[1]

    def ids(self, number: int) -> bytes:
        """Ids of the number-th document as uint32 bytes; only its own frame is decompressed."""
        import bisect

        _, start, tokens = self.docs[number]
        k = bisect.bisect_right(self.frames, 4 * start, key=lambda f: f[2]) - 1
        data, base = self.frame(k), self.frames[k][2]
        return data[4 * start - base : 4 * (start + tokens) - base]


def open_shard(path: str):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


MANIFEST = struct(shard=LONG, path=STRING, n_docs=LONG, n_tokens=LONG)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = END_ID, shards: int | None = None) -> DataFrame:
    """Write docs' token ids to folder and return the manifest: shard, path, documents, ids and start (ids in all shards before it).

    vocabulary: path of a tokenizers file on every executor; the installed byte_bpe_50k.json by default.
    """
    spark = docs.sparkSession
    if not shards:
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        known = size // SHARD_BYTES if size < 1 << 60 else 0  # Spark puts 8 EiB where it can't tell
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), known)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = dealt.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        at = TaskContext.get()
        shard, attempt = at.partitionId(), at.taskAttemptId()
        encoder, writer = None, None
        n_docs = n_tokens = 0
        for batch in batches:
            for part in pieces(batch, 1, TEXTS):
                if writer is None:
                    import public_tokenizers

                    encoder = Encoder.of_worker(vocabulary or public_tokenizers.path(VOCABULARY))
                    store, base = fs.FileSystem.from_uri(folder)
                    store.create_dir(base, recursive=True)
                    own, name = f"{base}/.{shard:06d}-{attempt}", f"{base}/{shard:06d}.ids.zst"
                    file = store.open_output_stream(own)
                    writer = ShardWriter(file)
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.ids(part.column(1), end)):
                    writer.add(doc_id, ids)
                    n_docs, n_tokens = n_docs + 1, n_tokens + len(ids) // 4
        if writer is not None:
            writer.close()
            file.close()
            store.move(own, name)
            give_back()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{folder}/{shard:06d}.ids.zst", "n_docs": n_docs, "n_tokens": n_tokens}])

    # one row a shard: small enough for one window
    manifest = stored(map_in_arrow(dealt, run, MANIFEST), "manifest")
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("start", F.coalesce(before, F.lit(0)))


DIGEST = struct(doc_id=LONG, start=LONG, n_tokens=LONG, ids_crc32=LONG)


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files that the manifest names."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with open_shard(row["path"]) as file:
                    reader = ShardReader(file)
                    for k in range(0, len(reader.docs), 10_000):
                        rows = [(d, row["start"] + start, n, zlib.crc32(reader.ids(k + i))) for i, (d, start, n) in enumerate(reader.docs[k : k + 10_000])]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=DIGEST.names)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_in_arrow(manifest.repartition(n, "shard"), run, DIGEST)


def op3_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def token_digests(docs: DataFrame) -> DataFrame:
    return read_digests(write_tokens(docs, new_path(docs.sparkSession, "tokens")))
