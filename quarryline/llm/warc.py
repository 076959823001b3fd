"""WARC files and their Merkle fixity audit (operator 1).

A replica is a set of WARC files, one gzip member for each record where they are compressed (write_warc). Reading one
(read_warc) hashes every byte and gives its records: file, offset and length in the plain stream, member (where the record's gzip
member begins in the file), digest (SHA-256 of the record's bytes), record_id and url. Each file's records are leaves; the leaves of an
offset range of RANGE bytes make a node, FAN ranges each the node above, up to the file's root after LEVELS
levels; the roots of the files in one of GROUPS groups make a group's node, those the replica's root. A node is the SHA-256 of its
children's positions and hashes in order, so no list grows beyond what a range, a file of bounded size or a group holds.

The audit compares roots, then goes down only where both replicas' nodes differ or one has none, and ends with the
records of ranges that differ. These are matched in their file: first those with equal place and digest (intact), then by digest ('moved': intact, at
another offset since something before it was lost or cut), then by record_id ('changed'); the rest is 'missing' (only in the first)
or 'extra' (only in the second). Equal replicas end at the root. Each level is a table in the shared folder, a lost executor costs one level at most.

Reading keeps a piece of a file in memory, never a file or a record: very long records are hashed in pieces. A damaged header, length or gzip
member makes a stretch without record_id that ends where the next record begins.
Null urls and texts are empty in a record; pages without page_id lie in files below 0 by a hash of their content. Repeated rows are records of their own,
ordered by digest. An empty replica has no root: all records of the other are missing or extra. Columns besides page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import io
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.common import LONG, STRING, delete, discard, map_in_arrow, new_path, stored, struct, table

#: Bytes of the lowest offset ranges, ranges in one above, levels of ranges, groups of files, pages in a file.
RANGE, FAN, LEVELS, GROUPS, FILE_PAGES = 64 << 10, 16, 3, 256, 1000
#: Bytes read at once, and those within which a record's header ends.
PIECE, HEAD_BYTES = 256 << 10, 64 << 10

_HEAD = "WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:%s>\r\nWARC-Target-URI: %s\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n"


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    body = (html or "").encode("utf-8", "replace")
    return (_HEAD % ("" if page_id is None else page_id, url or "", len(body))).encode() + body + b"\r\n\r\n"


def record_column(page_id: Column, url: Column, html: Column) -> Column:
    """record() as a column."""
    body = F.coalesce(html, F.lit(""))
    parts = _HEAD.replace("%d", "%s").split("%s")
    filled = zip(parts, [F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(url, F.lit("")), F.octet_length(body).cast("string")])
    return F.concat(*[x for p, c in filled for x in (F.lit(p), c)], F.lit(parts[-1]), body, F.lit("\r\n\r\n"))


def layout(pages: DataFrame, file_pages: int = FILE_PAGES) -> DataFrame:
    """page_id, file, offset, length, digest and record_id of the records that files of file_pages ids each hold, in order of page_id."""
    text = record_column(F.col("page_id"), F.col("url"), F.col("html"))
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    sized = pages.select("page_id", F.octet_length(text).cast("long").alias("length"), F.sha2(text, 256).alias("digest"), name.alias("record_id"))
    lost = -1 - F.pmod(F.xxhash64("digest"), F.lit(1 << 16))
    sized = sized.withColumn("file", F.coalesce(F.floor(F.col("page_id") / file_pages), lost).cast("long"))
    line = Window.partitionBy("file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("offset", F.coalesce(F.sum("length").over(line), F.lit(0)))


def _node(position: str, digest: str):
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, digest))), lambda x: F.concat_ws(":", x[position].cast("string"), x[digest])), ","), 256)


def tree(records: DataFrame, name: str = "tree") -> list[DataFrame]:
    """Node tables from the records up: leaves (file, place, digest), ranges, files, groups and the root, each with the keys of the node above."""
    leaves = records.select("file", "offset", "length", "digest", "record_id", F.concat_ws(":", F.col("length").cast("string"), "digest").alias("hash"))
    leaves = leaves.withColumn("range0", F.floor(F.col("offset") / RANGE).cast("long"))
    levels = [stored(leaves, f"{name}-leaves")]
    for k in range(LEVELS):
        nodes = levels[-1].groupBy("file", f"range{k}").agg(_node("offset" if k == 0 else f"range{k - 1}", "hash").alias("hash"))
        levels.append(stored(nodes.withColumn(f"range{k + 1}", F.floor(F.col(f"range{k}") / FAN).cast("long")), f"{name}-ranges{k}"))
    files = levels[-1].groupBy("file").agg(_node(f"range{LEVELS - 1}", "hash").alias("hash"))
    levels.append(stored(files.withColumn("group", F.pmod(F.xxhash64("file"), F.lit(GROUPS))), f"{name}-files"))
    groups = levels[-1].groupBy("group").agg(_node("file", "hash").alias("hash"))
    levels.append(stored(groups.withColumn("all", F.lit(0)), f"{name}-groups"))
    levels.append(stored(levels[-1].groupBy("all").agg(_node("group", "hash").alias("hash")), f"{name}-root"))
    return levels


#: Keys of the nodes of each level, leaves first.
KEYS = [["file", "offset"], *[["file", f"range{k}"] for k in range(LEVELS)], ["file"], ["group"], ["all"]]


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """file, offset, length, record_id and status of the records in which two replicas differ; an extra one's place is that in the second."""
    one, two = tree(first, "first"), tree(second, "second")
    wrong = None
    for level in range(len(KEYS) - 1, 0, -1):
        a, b = _under(one[level], wrong, level), _under(two[level], wrong, level)
        a, b = (x.select(*KEYS[level], F.col("hash").alias(h)) for x, h in ((a, "hash1"), (b, "hash2")))
        wrong = stored(a.join(b, KEYS[level], "full_outer").where("NOT (hash1 <=> hash2)").select(*KEYS[level]), "wrong")
    out = stored(_matched(_under(one[0], wrong, 0), _under(two[0], wrong, 0)), "audit")
    for level in [*one, *two]:
        discard(level)
    return out


def _under(nodes: DataFrame, wrong: DataFrame | None, level: int) -> DataFrame:
    """The children of nodes that differ; the list of those is far shorter than the level."""
    return nodes if wrong is None else nodes.join(wrong, KEYS[level + 1], "left_semi")


def _matched(first: DataFrame, second: DataFrame) -> DataFrame:
    """Records of two replicas' ranges that differ, with their status. Every round pairs the n-th of a kind in a file with the n-th there."""
    sides = [x.select("file", "offset", "length", "digest", "record_id").withColumn("side", F.lit(k)) for k, x in ((1, first), (2, second))]
    rows = sides[0].unionByName(sides[1])
    # equal place and content, however often: intact
    same = Window.partitionBy("file", "offset", "digest", "record_id", "side").orderBy("length")
    rows = rows.withColumn("n", F.row_number().over(same)).withColumn("met", F.count("*").over(Window.partitionBy("file", "offset", "digest", "record_id", "n")))
    rows = rows.where("met = 1").drop("n", "met")
    for status, key in (("moved", "digest"), ("changed", "record_id")):
        turn = Window.partitionBy("file", key, "side").orderBy("offset", "digest")
        numbered = rows.withColumn("n", F.row_number().over(turn))
        both = F.count("*").over(Window.partitionBy("file", key, "n"))
        numbered = numbered.withColumn(status, (both == 2) & F.col(key).isNotNull())
        rows = numbered if status == "changed" else numbered.drop("n")
        if status == "moved":
            found = rows.where("moved AND side = 1").select("file", "offset", "length", "record_id", F.lit("moved").alias("status"))
            rows = rows.where("NOT moved").drop("moved")
    rest = rows.where("NOT (changed AND side = 2)").select("file", "offset", "length", "record_id", F.expr("CASE WHEN changed THEN 'changed' WHEN side = 1 THEN 'missing' ELSE 'extra' END").alias("status"))
    return found.unionByName(rest)


WRITTEN = struct(file=LONG, path=STRING, n_records=LONG)


def write_warc(pages: DataFrame, folder: str, file_pages: int = FILE_PAGES, data: Column | None = None, compress: bool = False) -> DataFrame:
    """Write the records of layout() as <file>.warc(.gz) under folder, with Spark's tasks; returns file, path and n_records.

    data: the bytes to write, of the columns record and size (of the body), if not just those (null writes none). compress: one gzip member for each record.
    A task that runs again writes under another name first and then replaces the file.
    """
    from pyspark.sql import types as T

    text = record_column(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select("page_id", text.cast("binary").alias("record"), F.octet_length("html").alias("size"), F.sha2(text, 256).alias("digest"))
    rows = rows.withColumn("data", F.col("record") if data is None else data)
    lost = -1 - F.pmod(F.xxhash64("digest"), F.lit(1 << 16))
    rows = rows.withColumn("file", F.coalesce(F.floor(F.col("page_id") / file_pages), lost).cast("long"))
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "file").sortWithinPartitions("file", "page_id", "digest").select("file", "data")

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        attempt, now, out, n = TaskContext.get().taskAttemptId(), None, None, 0
        end = ".warc.gz" if compress else ".warc"

        def done():
            out.close()
            store.move(f"{base}/.{now}-{attempt}", f"{base}/{now}{end}")
            return pa.RecordBatch.from_pylist([{"file": now, "path": f"{folder}/{now}{end}", "n_records": n}])

        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if file != now:
                    if out:
                        yield done()
                    now, n = file, 0
                    out = store.open_output_stream(f"{base}/.{now}-{attempt}")
                raw = data.as_py()
                if raw is not None:
                    out.write(_member(raw) if compress else raw)
                    n += 1
        if out:
            yield done()

    return stored(map_in_arrow(rows, run, T.StructType(WRITTEN.fields)), "written")


RECORDS = struct(file=LONG, offset=LONG, length=LONG, digest=STRING, record_id=STRING, url=STRING, member=LONG)


def _member(raw: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _fields(head: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}


def _names(fields: dict[bytes, bytes]) -> tuple[str | None, str]:
    text = {k: v.decode("utf-8", "replace") for k, v in fields.items()}
    return text.get(b"warc-record-id"), text.get(b"warc-target-uri", "")


def _run(stream, at: int, until: int | None = None, mark: bytes = b"") -> tuple[int, str]:
    """Length and SHA-256 of the stream's bytes from at to until, or to where mark begins again, or to its end, read in pieces."""
    stream.seek(at)
    digest, length, held = hashlib.sha256(), 0, b""
    while until is None or at + length < until:
        more = stream.read(PIECE if until is None else min(PIECE, until - at - length))
        if not more:
            break
        if mark:
            held += more
            found = held.find(mark, 0 if length else 1)
            if found >= 0:
                digest.update(held[:found])
                return length + found, digest.hexdigest()
            more, held = held[: -len(mark)], held[-len(mark) :]
        digest.update(more)
        length += len(more)
    digest.update(held)
    return length + len(held), digest.hexdigest()


def parse_warc(stream):
    """(offset, length, digest, record_id, url, member) of each record of a seekable stream of plain WARC bytes."""
    at = 0
    while True:
        stream.seek(at)
        head = stream.read(HEAD_BYTES)
        if not head:
            return
        end = head.find(b"\r\n\r\n") if head.startswith(b"WARC/") else -1
        fields = _fields(head[:end]) if end >= 0 else {}
        size = fields.get(b"content-length", b"")
        length, good = 0, False
        if size.isdigit() and len(size) < 19:
            length = end + 4 + int(size) + 4
            # a record ends with two line ends, or another one or nothing follows; otherwise its length is not to be trusted
            stream.seek(at + length - 4)
            after = stream.read(9)
            good = after[:4] == b"\r\n\r\n" or len(after) >= 4 and after[4:] in (b"", b"WARC/")
        if good:
            length, digest = _run(stream, at, at + length)
        else:
            length, digest = _run(stream, at, mark=b"WARC/1.")
        yield (at, length, digest, *_names(fields), at)
        at += length


def parse_members(stream):
    """The same of a stream of gzip members, each of them one record; offset and length are those of the plain bytes."""
    plain, at, held = 0, 0, b""
    while True:
        held = held or stream.read(PIECE)
        if not held:
            return
        unzip, digest, head, length, used = zlib.decompressobj(31), hashlib.sha256(), b"", 0, 0
        try:
            while not unzip.eof:
                out = unzip.decompress(held, PIECE)
                digest.update(out)
                length += len(out)
                head += out[: HEAD_BYTES - len(head)]
                rest = unzip.unused_data if unzip.eof else unzip.unconsumed_tail
                used += len(held) - len(rest)
                held = rest or (b"" if unzip.eof else stream.read(PIECE))
                if not held and not unzip.eof and not out:
                    break  # cut off
        except zlib.error:
            # the packed bytes up to what may be the next member
            length, name = _run(stream, at, mark=b"\x1f\x8b\x08")
            yield plain, length, name, None, "", at
            plain, at, held = plain + length, at + length, b""
            stream.seek(at)
            continue
        end = head.find(b"\r\n\r\n")
        yield (plain, length, digest.hexdigest(), *_names(_fields(head[:end]) if end >= 0 and head.startswith(b"WARC/") else {}), at)
        plain, at = plain + length, at + used


def fetch(stream, member: int) -> bytes:
    """The plain bytes of the gzip member that begins there."""
    stream.seek(member)
    unzip, out = zlib.decompressobj(31), io.BytesIO()
    while not unzip.eof and (more := stream.read(PIECE)):
        out.write(unzip.decompress(more))
    return out.getvalue()


def read_warc(files: DataFrame) -> DataFrame:
    """RECORDS of the WARC files (file, path) of a table."""

    def run(batches):
        from itertools import batched

        from pyarrow import fs
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(RECORDS)
        for batch in batches:
            for row in batch.to_pylist():
                store, name = fs.FileSystem.from_uri(row["path"])
                with store.open_input_file(name) as raw:
                    for rows in batched((parse_members if name.endswith(".gz") else parse_warc)(raw), 10_000):
                        yield pa.RecordBatch.from_arrays([pa.array([row["file"]] * len(rows), pa.int64()), *[pa.array(c, f.type) for c, f in zip(zip(*rows), list(arrow)[1:])]], schema=arrow)

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_in_arrow(files.select("file", "path").repartition(n, "path"), run, RECORDS)


#: Damage that the query plans: of so many page ids in a row one page's record is lost, and one has a changed byte.
LOST, CHANGED = 5003, 101


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages are written as WARC files twice, the second time with planned damage to the bytes; both are read back, hashed and audited.

    Damage: the record of page ids that leave 8 by LOST is not written, the last byte of the body of those that leave 7 by CHANGED is another one.
    """
    pages = table(spark, sf_dir, "pages")
    at = F.octet_length("record") - 4
    spoiled = F.overlay("record", F.when(F.substring(F.col("record"), at, F.lit(1)) == F.lit(b"#"), F.lit(b"$")).otherwise(F.lit(b"#")), at, F.lit(1))
    hurt = (F.col("page_id") % CHANGED == 7) & (F.col("size") > 0)  # an empty body has no byte to change
    data = F.when(F.col("page_id") % LOST == 8, F.lit(None)).when(hurt, spoiled).otherwise(F.col("record"))
    folder = new_path(spark, "warc")
    replicas = []
    for name, what in (("first", None), ("second", data)):
        replicas.append(stored(read_warc(write_warc(pages, f"{folder}/{name}", data=what, compress=True)), name))
        delete(spark, f"{folder}/{name}")  # its records are all that the audit needs
    found = audit(*replicas)
    for records in replicas:
        discard(records)
    return found.select(F.regexp_extract("record_id", "<urn:page:(-?[0-9]+)>", 1).try_cast("long").alias("page_id"), "file", "offset", "length", "status")


OP1_SQL = f"""
WITH r AS (SELECT page_id, page_id // {FILE_PAGES} AS file, coalesce(html, '') <> '' AS full_body,
  strlen('WARC/1.1__WARC-Type: resource__WARC-Record-ID: <urn:page:>__WARC-Target-URI: __Content-Type: text/html__Content-Length: ____' || '____') + strlen(CAST(page_id AS VARCHAR)) + strlen(coalesce(url, '')) + strlen(CAST(strlen(coalesce(html, '')) AS VARCHAR)) + strlen(coalesce(html, '')) AS length FROM pages),
o AS (SELECT *, sum(length) OVER w - length AS o, sum(CASE WHEN page_id % {LOST} = 8 THEN 1 ELSE 0 END) OVER w > 0 AS late FROM r WINDOW w AS (PARTITION BY file ORDER BY page_id)),
s AS (SELECT *, CASE WHEN page_id % {LOST} = 8 THEN 'missing' WHEN page_id % {CHANGED} = 7 AND full_body THEN 'changed' WHEN late THEN 'moved' END AS status FROM o)
SELECT page_id, file, CAST(o AS BIGINT) AS "offset", length, status FROM s WHERE status IS NOT NULL
"""
