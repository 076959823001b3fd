"""What the operators share: tables in the shared folder and Arrow passes over texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts handed to a Python function at once: rows and bytes at most (one longer text goes alone).
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20
#: Rows that Spark sends to a Python worker at once. Its default of 10,000 whole texts takes tens of MB on both sides of every task.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that is unset and Spark runs in one process (tests) is a local folder made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarryline-")
        spark.sparkContext.setCheckpointDir(root)
    return root if "://" in root or root.startswith("file:") else "file://" + root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/quarryline/{uuid.uuid4().hex}/{name}"


#: Tables that the running stages have made, by stage (see stage_tables).
recorded: list[list[str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and a lost executor loses none of it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    for made in recorded[-1:]:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by stored() that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


#: Keys that may count as hot in lookup(), and the rows below which none does.
HOT_KEYS, HOT_LEAST = 1000, 1000


def lookup(rows: DataFrame, found: DataFrame, on: list[str], n: str) -> DataFrame:
    """rows joined with found, which has one row for each key (on, without nulls) and in n how many rows have it.

    Keys of more than a HOT_KEYS-th of all rows, so fewer than HOT_KEYS of them, are broadcast with the number of
    tasks that each is dealt to; found's row of such a key goes to all of those.
    """
    total = found.agg(F.sum(n)).first()[0] or 0
    most = max(HOT_LEAST, total // HOT_KEYS)
    hot = stored(found.where(F.col(n) > most).select(*on, F.ceil(F.col(n) / most).alias("_parts")), "hot")
    if hot.isEmpty():
        return rows.join(found, on)
    few = F.broadcast(hot)
    dealt = rows.join(few, on, "left").withColumn("_salt", F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("_parts")))).drop("_parts")
    copied = found.join(few, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copied, [*on, "_salt"]).drop("_salt")


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def stage_tables(spark: SparkSession, docs: DataFrame, old: list[str]) -> list[str]:
    """Delete the tables that a finished stage has made, but for those that docs reads; returns the list for the next stage's."""
    read = docs.inputFiles() if old else []
    for path in old:
        if not any(path.split("://")[-1] in f for f in read):
            delete(spark, path)
    return [path for path in old if any(path.split("://")[-1] in f for f in read)]


def pieces(batch: pa.RecordBatch, text: int, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in runs of bounded rows and text bytes."""
    column, at = batch.column(text), 0
    while at < batch.num_rows:
        n = min(rows, batch.num_rows - at)
        while n > 1 and column.slice(at, n).nbytes > BATCH_BYTES:
            n = max(1, n // 2)
        yield batch.slice(at, n)
        at += n


def map_in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """mapInArrow with batches of ARROW_ROWS, which holds for the session unless it has a setting of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name) == "10000":
        df.sparkSession.conf.set(name, str(ARROW_ROWS))
    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return memory that a task has freed to the system; workers live on for other stages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def annotate(df: DataFrame, make: Callable[[], Callable[[list], list]], schema: T.StructType, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry and schema columns for every row: make() gives, once a task, the function from a list of texts (None for null) to schema's columns as Arrow arrays or lists."""
    taken = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(text).alias("t"))
    kept = T.StructType([T.StructField(c, df.schema[c].dataType) for c in carry])
    full = T.StructType(kept.fields + schema.fields)
    n = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        work, arrow = make(), to_arrow_schema(full)
        for batch in batches:
            for part in pieces(batch, n):
                made = work(part.column(n).to_pylist())
                columns = [*part.columns[:n], *made]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, arrow)], schema=arrow)
            part = batch = made = columns = None
        give_back()

    return map_in_arrow(taken, run, full)


def only(df: DataFrame, make: Callable[[], Callable[[list], list]], text: str = "text") -> DataFrame:
    """The rows of df, with all their columns, for which make()'s function of the texts is true."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in pieces(batch, at):
                yield part.filter(pa.array(work(part.column(at).to_pylist()), pa.bool_()))
            part = batch = None
        give_back()

    return map_in_arrow(df, run, df.schema)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


LONG, DOUBLE, INT, STRING, BOOL = T.LongType(), T.DoubleType(), T.IntegerType(), T.StringType(), T.BooleanType()
