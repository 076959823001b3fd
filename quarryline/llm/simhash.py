"""SimHash near-duplicates through Golay-code fuzzy hashing (operator 9).

Fingerprint: A-Z lower-cased, words are runs of anything but ASCII white space, 3-word shingles with
repeats (fewer words: the whole sequence), XXH64 with seed 42 of each; a bit is 1 if over
half of the hashes have it. A text without words (null and empty ones too) has fingerprint zero and is
linked like any other.

Search for pairs of different fingerprints with at most RADIUS = 2 differing bits:
a fingerprint is cut into segments of 22, 21 and 21 bits. Of three segments that share two errors
there is always one, in cyclic order, without errors whose successor has at most one
(pigeonhole). The successor, padded to 23 bits, is decoded with the perfect Golay code: one
side files each segment under the one codeword within distance 3, the other side asks under all
codewords within distance 4 (one, or six where the nearest is at distance 3), which meets every word
one error away. A key is (form, exact segment, codeword), 33 bits or more; candidates are verified on
all 64 bits. Keys under which over HOT fingerprints are filed are cut finer without loss: the
other 43 bits in five parts, of which two errors leave three alone, so each row of such a key turns to
ten rows with three exact parts each.

Copies meet in their fingerprint first, so only distinct fingerprints are searched. Components are
found by large-star and small-star rounds over the verified links, each round a table in the shared folder.
An empty table gives an empty result; very long texts are hashed in pieces; columns besides doc_id and text are not read. Rows with a null doc_id take part; component_id ignores null ids. Repeated rows get equal results.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import LONG, annotate, discard, lookup, map_in_arrow, stored, struct, table

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Segments of a fingerprint as (lowest bit, bits).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Filed fingerprints from which a key is cut finer.
HOT = 256
#: Generator polynomial of the binary Golay code [23, 12, 7] (fixed value).
GOLAY = 0b101011100011


def fingerprint(text: str | None) -> int:
    """64 bits, unsigned."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), max(1, len(words) - SHINGLE + 1)
    for at in range(0, n, 1 << 16):
        part = words[at : at + (1 << 16) + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(SHINGLE)))) if len(part) >= SHINGLE else [b" ".join(part)]
        hashes = np.array([digest(s, SEED) for s in shingles], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry and fp, the fingerprint as a signed long."""

    def make():
        return lambda texts: [pa.array(np.array([fingerprint(t) for t in texts], "<u8").view("<i8"))]

    return annotate(docs, make, struct(fp=LONG), text, carry)


def _remainder(words: np.ndarray) -> np.ndarray:
    """Of 23-bit words divided by the generator: 11 bits, zero for codewords."""
    out = words.copy()
    for bit in range(22, 10, -1):
        out ^= np.where(out >> bit & 1, GOLAY << (bit - 11), 0)
    return out


def code_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each remainder: the error pattern of at most 3 bits, and where it has 3 bits the five codewords of weight 7 that hold them (else zeros)."""
    patterns = np.array([sum(1 << b for b in c) for n in range(4) for c in itertools.combinations(range(23), n)], np.int64)
    leader = np.zeros(2048, np.int64)
    leader[_remainder(patterns)] = patterns
    shifted = np.arange(4096, dtype=np.int64) << 11
    words = shifted ^ _remainder(shifted)
    sevens = words[np.bitwise_count(words) == 7]
    more = np.zeros((2048, 5), np.int64)
    for r in np.flatnonzero(np.bitwise_count(leader) == 3):
        more[r] = sevens[(sevens & leader[r]) == leader[r]]
    return leader, more


KEYS = struct(fp=LONG, asks=LONG, key=LONG)


def _keys(fps: DataFrame) -> DataFrame:
    """fp, asks (0: filed under key, 1: asks under key), key."""

    def run(batches):
        leader, more = code_tables()
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                fp = batch.column(0).slice(at, 20_000).to_numpy()
                bits, out = fp.view(np.uint64), []
                parts = [(bits >> np.uint64(low) & np.uint64((1 << n) - 1)).astype(np.int64) for low, n in SEGMENTS]
                for k in range(3):
                    exact, word = parts[k], parts[(k + 1) % 3]
                    r = _remainder(word)
                    near = word ^ leader[r]
                    base = np.int64(k) << 34 | exact << 12
                    out.append((fp, 0, base | near >> 11))
                    out.append((fp, 1, base | near >> 11))
                    far = np.flatnonzero(np.bitwise_count(leader[r]) == 3)
                    others = near[far, None] ^ more[r[far]]
                    out.append((np.repeat(fp[far], 5), 1, (base[far, None] | others >> 11).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([o[0] for o in out], [np.full(len(o[0]), o[1], np.int64) for o in out], [o[2] for o in out])], names=KEYS.names)

    return map_in_arrow(fps, run, KEYS)


def _finer(rows: DataFrame) -> DataFrame:
    """Ten rows for each row of a hot key: fine is the choice of three parts of the other 43 bits and their values."""
    cuts = (0, 9, 18, 27, 35, 43)
    # the 43 bits that are not the exact segment, as one number
    form = F.expr("shiftrightunsigned(key, 34)")
    other = F.when(form == 0, F.expr("shiftrightunsigned(fp, 22) & 8796093022207")).when(form == 1, F.expr("(shiftrightunsigned(fp, 43) << 22) | (fp & 4194303)")).otherwise(F.expr("fp & 8796093022207"))
    wide = rows.withColumn("other", other)
    choices = []
    for i, three in enumerate(itertools.combinations(range(5), 3)):
        mask = sum(((1 << (cuts[p + 1] - cuts[p])) - 1) << cuts[p] for p in three)
        choices.append(f"(other & {mask}L) | {i << 43}L")
    return wide.withColumn("fine", F.explode(F.expr(f"array({', '.join(choices)})"))).drop("other")


def links(fps: DataFrame) -> DataFrame:
    """a, b: all pairs of the distinct fingerprints in fps.fp with 1 to RADIUS differing bits, once each."""
    keys = stored(_keys(fps), "keys")
    filed, asks = keys.where("asks = 0").select("key", "fp"), keys.where("asks = 1").select("key", "fp")
    hot = stored(filed.groupBy("key").count().where(F.col("count") > HOT).select("key"), "hot")
    near = f"a.fp <> b.fp AND bit_count(a.fp ^ b.fp) <= {RADIUS}"

    def meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        same = " AND ".join(f"a.{c} = b.{c}" for c in on)
        found = left.alias("a").join(right.alias("b"), F.expr(f"{same} AND {near}"))
        return found.select(F.least("a.fp", "b.fp").alias("a"), F.greatest("a.fp", "b.fp").alias("b"))

    if hot.isEmpty():
        found = meet(filed, asks, ["key"])
    else:
        cold = [x.join(hot, "key", "left_anti") for x in (filed, asks)]
        cut = [_finer(x.join(hot, "key", "left_semi")) for x in (filed, asks)]
        found = meet(*cold, ["key"]).unionByName(meet(*cut, ["key", "fine"]))
    out = stored(found.distinct(), "links")
    discard(keys)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for all nodes of the edge table (a, b)."""
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large.where("u <> v"), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = stored(small.distinct(), "small")
        discard(now)
        discard(large)
        now, held = after, mark(after)
        if held == before:
            break
        before = held
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fp (signed long), component_id for every document."""
    rows = stored(fingerprints(docs, text), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = components(links(distinct.select("fp")))
    # fingerprints without links are their own component
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    linked = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("prints"))
    named = stored(lookup(placed, linked, ["root"], "prints").select("fp", "n", "component_id"), "named")
    # all empty documents, and all copies of one, have one fingerprint
    return lookup(rows, named, ["fp"], "n").select("doc_id", "fp", "component_id")


def op9_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
