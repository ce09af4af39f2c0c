"""Session for local use; on a cluster the session comes from outside."""

from __future__ import annotations

from pyspark import SparkConf
from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, name: str = "loam", memory: str = "16g", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def outer_session(master: str | None = None) -> SparkSession:
    """The session that is there, or one as ``spark-submit`` or ``master`` say; a local one only where nothing names a cluster."""
    if (active := SparkSession.getActiveSession()) is not None:
        return active
    if master or SparkConf().contains("spark.master"):
        builder = SparkSession.builder.appName("loam")
        return (builder.master(master) if master else builder).getOrCreate()
    return local_session("*")
