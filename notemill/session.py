"""Session helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut by files in the folder of ``spark.checkpoint.dir``, or in the one that is set on the
    context. Only on one machine (a ``local`` master) and with neither set, as in tests, in a folder of our own."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if context.master.split("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            path = "file://" + tempfile.mkdtemp(prefix="notemill-")
        context.setCheckpointDir(path)
    return df.checkpoint()
