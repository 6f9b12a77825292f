"""Session defaults for runs that do not bring their own session (tests, bench)."""

import os
import re
import tempfile

from pyspark.sql import SparkSession


def local_session(cores="8", shuffle_partitions=8, memory="8g"):
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("faultline")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark, label):
    """A fresh folder for tables an operator writes.

    On a cluster this is the shared folder the cluster names in
    spark.checkpoint.dir; a local temporary folder is used only where that
    setting is absent, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # one process; not local-cluster
        base = os.path.join(tempfile.gettempdir(), "faultline")
        os.makedirs(base, exist_ok=True)
        return tempfile.mkdtemp(prefix=f"{label}-", dir=base)
    if base is None:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{base.rstrip('/')}/{label}-{os.urandom(8).hex()}"


def materialize(df, label):
    """Write df once to the shared work folder and go on from there: later steps neither repeat
    its lineage nor lose it with an executor."""
    folder = work_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
