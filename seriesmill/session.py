"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own, once; on
    a cluster a machine-local folder would not survive its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="seriesmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small table between the rounds of a loop."""
    spark: SparkSession = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: later steps start from files
    that outlive any executor, and read only the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a table of one small row per group is sent to every task.
SENT = 100_000


def per_group(df: DataFrame) -> DataFrame:
    """A table of one row per group, computed once and kept; sent to every task if it is small.

    Joined with rows, a small one spares them the exchange.  One of more than
    ``SENT`` rows is joined as Spark sees fit, which splits groups that stand out.
    """
    kept = stored(df)
    return F.broadcast(kept) if kept.limit(SENT + 1).count() <= SENT else kept
