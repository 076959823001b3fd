"""Tables between steps: written to the folder that driver and executors share, so that a lost executor loses none of them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a table that is broadcast.
FEW = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where that is unset and Spark runs in one process (tests) is a local one made."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarryline-")
        spark.sparkContext.setCheckpointDir(root)
    return root if "://" in root or root.startswith("file:") else "file://" + root


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder; its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/quarryline/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt to as many tasks as there are shuffle partitions, or cores if those are more. Spark sizes tasks by bytes, of which rows that take long to work on may have few."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


def small(df: DataFrame, name: str, few: int = FEW) -> DataFrame:
    """df as a stored table, to be broadcast if it has few rows."""
    table = stored(df, name)
    return F.broadcast(table) if table.limit(few + 1).count() <= few else table
