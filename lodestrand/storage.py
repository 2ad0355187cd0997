"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a temporary
    folder takes its place in local mode, where all is one machine; on a cluster the
    executors could not read it, and the missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='lodestrand-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts lineage: a lost executor costs no more than the tasks it ran, and no
    later job repeats the work. The files live as long as the shared folder.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lodestrand/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
