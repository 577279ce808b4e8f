"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as all operators here count them: a run of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a small side (one row per source, rule or stratum) is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where it is unset, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: the lineage is cut, and a lost executor costs nothing but a reread. codec: Parquet's, if not the session's."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """small with a broadcast hint if a count shows at most limit rows, else as it is. small should be a written table."""
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small
