"""Intermediate tables in the folder that the cluster shares.

A table written here cuts the lineage: whatever executor is lost later, the rows are read again from
the shared folder. The folder is `spark.checkpoint.dir`; only a local session without that setting gets
one of its own.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_FOLDER = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables; an error on a cluster that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = LOCAL_FOLDER
    return found.rstrip("/")


def written(df: DataFrame, name: str, compression: str = "zstd", parts: str | None = None) -> DataFrame:
    """df, computed once and read back from the shared folder; with parts, in folders by that column, its last one."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tallyline-{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", compression)
    (out.partitionBy(parts) if parts else out).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def released(*tables: DataFrame, below: str = "") -> None:
    """Deletes tables that `written` made and nothing will read again, or only their folder `below`."""
    for df in tables:
        if path := getattr(df, "written_path", None):
            jvm = df.sparkSession.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(f"{path}/{below}" if below else path)
            place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def shuffles_dropped(df: DataFrame) -> None:
    """Spark deletes the files of finished shuffles when the driver has collected their plans: here and now."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
