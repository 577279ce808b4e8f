"""Sessions for tests, benchmarks and local work."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def found_by_workers(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine find the package, wherever the driver was started. On a cluster it is installed or added to the job."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join([here, *filter(None, paths)])
    return spark


def local_session(name: str = "corpusmill", cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    return found_by_workers(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
