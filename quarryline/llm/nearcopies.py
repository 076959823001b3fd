"""Near copies by five-word Jaccard, for the pipeline's second stage.

Words are those of the fingerprint (A-Z lower-cased, split at ASCII white space); two texts are near copies where the sets
of their WORDS-word shingles (fewer words: the whole sequence) have a Jaccard of SIMILARITY (4/5) or more. Groups are the connected
components of near copies; texts with the same words are one node, those without words too.

Candidates are op9's links (at most simhash.RADIUS differing bits) and pairs that agree in one of BANDS bands of ROWS MinHash
values. A pair at exactly 0.8 shares no band with a chance of (1 - 0.8**4)**32 = 5e-8.
A band's members are first compared with its smallest one; then members of a band that still lie in different groups
meet each other. So no pair is left out by a cap, and a large group of near copies makes no square of its size.

Candidates pass an exact bound before their sets are fetched. Jaccard of 4/5 or more means that the sets differ in
at most a ninth of the sum of their sizes. Each set has a parity sketch: shingles are dealt to two to four times as many
bits as there are shingles, a bit tells whether it got an odd number of them. Sketches differ in no more bits than their sets
do in shingles, so pairs whose sketches differ in more are surely not near copies. The bound is part of the join's
condition, as is that the band is the first which the two share: other pairs never become rows. What is left
is verified on the whole sets.

Null texts and texts without words are alike; repeated rows go as copies do; very long texts are hashed in pieces and their sketch
grows with them; columns of any name are carried along; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm import simhash
from quarryline.llm.common import INT, LONG, STRING, annotate, discard, give_back, lookup, map_in_arrow, pieces, stored, struct

WORDS, SIMILARITY, BANDS, ROWS, SEED = 5, 0.8, 32, 4, 11
#: Row numbers that are broadcast at most, 16 bytes each in a join's table.
BROADCAST_ROWS = 4_000_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def copy_of(words: list[bytes]) -> str:
    """The same for texts with the same words."""
    import xxhash

    return xxhash.xxh3_128_hexdigest(b" ".join(words))


def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    if len(words) < WORDS:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    count = len(words) - WORDS + 1
    return np.unique(np.fromiter((digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(WORDS)))), np.uint64, count))


def parities(hashes: np.ndarray) -> np.ndarray:
    """The parity sketch as signed 64-bit words: a power of two of them, at least twice as many bits as there are shingles."""
    bits = 1 << max(6, (2 * len(hashes) - 1).bit_length())
    place = (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=bits) & 1, bitorder="little").view("<i8")


def _mixers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return tuple(rng.integers(0, 2**64, BANDS * ROWS // 2, np.uint64, endpoint=False)[:, None] | np.uint64(1) for _ in range(2))


def bands(hashes: np.ndarray, mixers: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """A key for each band, signed; none without shingles."""
    import xxhash

    if not len(hashes):
        return []
    add, times = mixers
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for at in range(0, len(hashes), 4096):
        x = (hashes[None, at : at + 4096] ^ add) * times
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        # each mixed hash is two values of 32 bits
        least = np.minimum(least, x.view(np.uint32).reshape(len(add), -1, 2).min(1).ravel())
    keys = [xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


SKETCH = struct(rid=LONG, copy=STRING, fp=LONG, n=INT, odd=T.ArrayType(LONG), bands=T.ArrayType(LONG))


def sketches(docs: DataFrame) -> DataFrame:
    """The columns of docs as c0, c1, ..., a number for each row (rid) and, from the text, copy, fp, n (distinct shingles), odd (parity sketch) and bands."""
    from pyspark.sql.pandas.types import to_arrow_schema

    at = docs.columns.index("text")
    full = T.StructType([*[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)], *SKETCH.fields])

    def run(batches):
        from pyspark import TaskContext

        mixers, arrow, rid = _mixers(), to_arrow_schema(full), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in pieces(batch, at):
                made = []
                for t in part.column(at).to_pylist():
                    words = words_of(t)
                    hashes = shingles(words)
                    fp = simhash.fingerprint(t)
                    made.append((rid, copy_of(words), fp - (fp >> 63 << 64), len(hashes), parities(hashes), bands(hashes, mixers)))
                    rid += 1
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(x, f.type) for x, f in zip(zip(*made), list(arrow)[part.num_columns :])]], schema=arrow)
            part = batch = made = None
        give_back()

    return map_in_arrow(docs.toDF(*full.names[: len(docs.columns)]), run, full)


def possible(left: str, right: str) -> Column:
    """Whether the n and odd of two rows leave room for a Jaccard of SIMILARITY: false only where there is none."""
    x, y = f"{left}.odd", f"{right}.odd"
    # the longer sketch is folded: its upper half gives the same places as the shorter one's
    part = f"get({x}, i) ^ get({y}, i) ^ IF(size({x}) > size({y}), get({x}, i + size({y})), 0L) ^ IF(size({y}) > size({x}), get({y}, i + size({x})), 0L)"
    differ = f"""CASE WHEN size({x}) = size({y}) THEN aggregate(zip_with({x}, {y}, (p, q) -> bit_count(p ^ q)), 0, (s, z) -> s + z)
        ELSE aggregate(transform(sequence(0, least(size({x}), size({y})) - 1), i -> bit_count({part})), 0, (s, z) -> s + z) END"""
    return F.expr(f"5 * least({left}.n, {right}.n) >= 4 * greatest({left}.n, {right}.n) AND 9 * ({differ}) <= {left}.n + {right}.n")


def _few(ids: DataFrame) -> DataFrame:
    """A stored table of one long column, to be broadcast if it is short; else it is joined by shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def verified(marked: DataFrame, text: str, pairs: DataFrame) -> DataFrame:
    """Of the pairs of classes (a, b) those with a Jaccard of SIMILARITY or more; text is marked's column of texts."""
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "wanted")

    def make():
        return lambda texts: [[shingles(words_of(t)).view(np.int64) for t in texts]]

    texts = marked.select("rid", text).join(_few(wanted), "rid", "left_semi")
    sets = stored(annotate(texts, make, struct(s=T.ArrayType(LONG)), text, ("rid",)), "sets")
    side = lambda p: sets.select(F.col("rid").alias(p), F.col("s").alias(f"s{p}"))
    common = F.size(F.array_intersect("sa", "sb"))
    near = stored(pairs.join(side("a"), "a").join(side("b"), "b").where(9 * common >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b"), "near")
    discard(sets)
    discard(wanted)
    return near


def groups(marked: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """id, copy of all classes of copies (id: the least rid of a class), and node, root for the ids that have near copies; marked are the stored sketches."""
    classes = marked.groupBy("copy").agg(F.min("rid").alias("id"), F.first(F.struct("fp", "n", "odd", "bands")).alias("s"))
    classes = stored(classes.select("id", "copy", "s.*"), "classes")
    filed = classes.select("id", F.explode("bands").alias("key"))
    shared = filed.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    members = stored(filed.join(shared.select("key", "least"), "key"), "members")
    prints = classes.groupBy("fp").agg(F.min("id").alias("least"))
    linked = simhash.links(prints.select("fp"))
    end = lambda p: prints.select(F.col("fp").alias(p), F.col("least").alias(f"{p}_id"))
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    first = members.select(*pair("id", "least"))
    first = first.unionByName(classes.join(prints, "fp").select(*pair("id", "least")))
    first = first.unionByName(linked.join(end("a"), "a").join(end("b"), "b").select(*pair("a_id", "b_id")))
    first = first.where("a <> b").distinct()
    first = first.join(classes.select("id", "n", "odd").alias("l"), F.expr("a = l.id")).join(classes.select("id", "n", "odd").alias("r"), F.expr("b = r.id") & possible("l", "r"))
    first = stored(first.select("a", "b"), "first")
    edges = verified(marked, text, first)
    roots = simhash.components(edges)
    placed = stored(members.join(roots, members["id"] == roots["node"], "left").select("key", "id", F.coalesce("root", "id").alias("root")), "placed")
    open_keys = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    left = stored(placed.join(open_keys, "key", "left_semi").join(classes.select("id", "n", "odd", "bands"), "id"), "open")
    met = left.alias("l").join(left.alias("r"), F.expr("l.key = r.key AND l.id < r.id AND l.root <> r.root") & possible("l", "r") & F.expr("array_intersect(l.bands, r.bands)[0] = l.key"))
    rest = stored(met.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).join(first, ["a", "b"], "left_anti"), "rest")
    for done in (members, linked, first, placed, left):
        discard(done)
    if not rest.isEmpty():
        roots = simhash.components(edges.unionByName(verified(marked, text, rest)))
    return classes.select("id", "copy"), roots


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, with all its columns: the one with the smallest doc_id (null only where all are), then of the smallest copy, then the first read."""
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    marked = stored(sketches(docs), "sketches")
    classes, roots = groups(marked, own["text"])
    named = classes.join(roots, classes["id"] == roots["node"]).select("copy", F.lit("r").alias("kind"), F.col("root").cast("string").alias("name"))
    rows = marked.select("rid", F.col(own["doc_id"]).alias("doc_id"), "copy").join(named, "copy", "left")
    # rows of a class without near copies are of one group too
    rows = stored(rows.select("rid", "doc_id", "copy", F.coalesce("kind", F.lit("c")).alias("kind"), F.coalesce("name", "copy").alias("name")), "rows")
    best = rows.groupBy("kind", "name").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy", "rid")).alias("best"), F.count("*").alias("n"))
    best = stored(best.where("n > 1").select("kind", "name", F.col("best.rid").alias("stays"), "n"), "best")
    gone = stored(lookup(rows, best, ["kind", "name"], "n").where("rid <> stays").select("rid"), "gone")
    return marked.select("rid", *own.values()).join(_few(gone), "rid", "left_anti").select(*own.values()).toDF(*docs.columns)
