"""Exact deduplication on an extendible-hash index (operator 8). DataFrame functions only.

Equal: identical after lower-casing A-Z; null counts as empty. The 64-bit hash of the normal text is its key, the key's
leading bits are a place in the directory. A bucket holds the texts whose keys share a prefix; while it holds over
CAPACITY of them it is split in two and, where it is as deep as the directory, the directory doubles. Since the count of a
prefix is the sum of those below it, all splits within WIDTHS[0] bits are found at once from the counts of its places; only
the places that are overfull there are counted again by more bits, up to the whole key. Nothing ends the doubling but the
key itself: texts of one key are one bucket and one chain, however many they are.

What is dealt to the owners of buckets, by ranges of (bucket, key), is up to SPLIT entries for each key and SHA-256, with
the count and the largest doc_id of some of its rows: 100 bytes each, not the text. The owner puts the entries of a key in its chain and those of one text together; groups and the row that stays
come from there, and each row finds them through the directory, its bucket and the chain. Bytes are compared wherever a text of a chain has more than one row: the texts of these alone are fetched, and their
least and greatest must be the same bytes (copies are reduced to two texts in the task that reads them). For that join Spark exchanges the texts of all rows, unless the keys that it asks for are short
enough to broadcast. A text that is several is replaced by one for each of them. Directory and buckets are Parquet in the shared folder.

The row with the largest doc_id stays. Null ids count as less than all others; a group of null ids alone has
keep_id null and keeps its rows. Rows that repeat the doc_id and text are one document and are marked alike.
An empty table gives an empty result; columns besides doc_id and text are not read. A very long text is
hashed and compared whole; no list of texts is ever made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.common import lookup, new_path, stored, table
from quarryline.llm.sqltext import SQL_FOLD, fold

BUCKET_BYTES, ENTRY_BYTES = 1 << 20, 128
CAPACITY = BUCKET_BYTES // ENTRY_BYTES
#: Entries that the rows of one text are first counted in.
SPLIT = 16
#: Leading bits of a key that the directory's levels look at.
WIDTHS = (16, 24, 32, 40, 48, 56, 64)


def directory(keys: DataFrame, capacity: int = CAPACITY, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """width, place (the leading width bits of a key), depth and deeper of all places in use, from one row (key) for each text.

    A place with deeper is overfull at this width: its keys are found at the next one. Otherwise depth leading bits are its bucket.
    """
    done, base = None, 0
    for width in widths:
        counts = stored(keys.groupBy(_leading(width).alias("place")).agg(F.count("*").alias("n")), "places")
        levels = counts.select("place", "n", F.explode(F.sequence(F.lit(base), F.lit(width - 1))).alias("d")).withColumn("prefix", F.expr(f"shiftrightunsigned(place, {width} - d)"))
        split = levels.groupBy("d", "prefix").agg(F.sum("n").alias("n")).where(F.col("n") > capacity).select("d", "prefix")
        depth = levels.join(split, ["d", "prefix"], "left_semi").groupBy("place").agg(F.count("*").cast("int").alias("more"))
        full = (F.col("n") > capacity) & F.lit(width < widths[-1])
        own = counts.join(depth, "place", "left").select(F.lit(width).alias("width"), "place", (F.lit(base) + F.coalesce("more", F.lit(0))).cast("int").alias("depth"), full.alias("deeper"))
        own = stored(own, "directory")
        done = own if done is None else done.unionByName(own)
        over = own.where("deeper").select("place")
        if width == widths[-1] or over.isEmpty():
            return done
        keys, base = keys.withColumn("place", _leading(width)).join(over, "place", "left_semi").select("key"), width
    raise AssertionError("no widths")


def _leading(width: int) -> Column:
    return F.shiftrightunsigned("key", 64 - width)


def _placed(rows: DataFrame, places: DataFrame) -> DataFrame:
    """rows (key and more) with bucket and depth, from the directory's levels; places of a level that are few are broadcast, which those of the first always are."""
    left, found, own = rows, None, rows.columns
    for width, n in sorted((r.width, r["count"]) for r in places.groupBy("width").count().collect()):
        level = places.where(F.col("width") == width).select("place", "depth", "deeper")
        met = left.withColumn("place", _leading(width)).join(F.broadcast(level) if n <= 1 << WIDTHS[0] else level, "place")
        bucket = F.expr("CASE WHEN depth = 0 THEN 0 ELSE shiftleft(shiftrightunsigned(key, 64 - depth), 64 - depth) END")
        here = met.where("NOT deeper").select(*own, "depth", bucket.alias("bucket"))
        found = here if found is None else found.unionByName(here)
        left = met.where("deeper").select(*own)
    return rows.withColumns({"depth": F.lit(0), "bucket": F.lit(0).cast("long")}) if found is None else found


def build_index(entries: DataFrame, folder: str, capacity: int = CAPACITY) -> DataFrame:
    """Write directory and buckets of entries (key, text_sha256, part, keep_id, group_size: some of a text's rows each) and return the buckets, with bucket (its smallest key), depth and chain.

    The owner of a key range puts the entries of one text together: their rows are counted there, and the row that stays is found there.
    """
    spark = entries.sparkSession
    directory(entries.select("key"), capacity).write.parquet(f"{folder}/directory")
    owned = _placed(entries, spark.read.parquet(f"{folder}/directory")).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket", "key")
    # owners have all of a bucket's key, so this moves nothing further
    texts = owned.groupBy("bucket", "key", "depth", "text_sha256", "part").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").cast("long").alias("group_size"))
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("text_sha256", "part"))
    texts.withColumn("chain", chain).write.parquet(f"{folder}/buckets")
    return spark.read.parquet(f"{folder}/buckets")


def _entries(rows: DataFrame, part: Column) -> DataFrame:
    """Entries of rows (doc_id, key, text_sha256): up to SPLIT of them for a text, so that no task counts a large group alone."""
    return rows.groupBy("key", "text_sha256", part.alias("part"), F.pmod(F.hash("doc_id"), F.lit(SPLIT)).alias("_split")).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).drop("_split")


def exact_groups(
    docs: DataFrame, text: str = "text", folder: str | None = None, capacity: int = CAPACITY,
    key: Callable[[Column], Column] = F.xxhash64, digest: Callable[[Column], Column] = lambda t: F.sha2(t, 256),
) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of docs.

    key and digest only say where texts lie; groups are right for any function of the text.
    """
    spark, on = docs.sparkSession, ["key", "text_sha256"]
    norm = docs.select("doc_id", fold(F.coalesce(F.col(text), F.lit(""))).alias("norm"))
    named = norm.select("doc_id", key(F.col("norm")).alias("key"), digest(F.col("norm")).alias("text_sha256"), "norm")
    rows, none = stored(named.drop("norm"), "rows"), F.lit(None).cast("string")
    folder = folder or new_path(spark, "exact")
    entries = stored(_entries(rows, none), "entries")
    buckets = build_index(entries, f"{folder}/digests", capacity)
    # bytes are compared in chains whose texts have several rows
    several = buckets.where("group_size > 1").select(*on)
    fetched = named.select(*on, "norm").join(several, on, "left_semi")
    differ = stored(fetched.groupBy(*on).agg((F.min("norm") < F.max("norm")).alias("differ")).where("differ").select(*on), "differ")
    at = f"{folder}/digests"
    if not differ.isEmpty():
        # what differs is one text of the chain for each of its texts
        apart = _entries(named.join(differ, on, "left_semi"), F.col("norm"))
        at = f"{folder}/texts"
        buckets = build_index(entries.join(differ, on, "left_anti").unionByName(apart), at, capacity)
        alike = rows.join(differ, on, "left_anti").withColumn("part", none)
        rows = alike.unionByName(named.join(differ, on, "left_semi").select(*rows.columns, F.col("norm").alias("part")))
    else:
        rows = rows.withColumn("part", none)
    # every row goes through the directory to its bucket and there down the chain
    part = F.coalesce("part", F.lit("")).alias("_part")
    asked = _placed(rows, spark.read.parquet(f"{at}/directory")).select("doc_id", "bucket", *on, part, F.col("part").isNull().alias("_whole"))
    chains = buckets.select("bucket", *on, part, F.col("part").isNull().alias("_whole"), "keep_id", "group_size")
    found = lookup(asked, chains, ["bucket", *on, "_part", "_whole"], "group_size")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP8_SQL = f"""
WITH d AS (SELECT doc_id, {SQL_FOLD.format("coalesce(text, '')")} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g USING (t)
"""
