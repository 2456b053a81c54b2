"""Tables written on the way: durable cuts of lineage in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a row group. A reader takes a column of one at once, and so keeps a buffer of this size in each of its threads.
ROW_GROUP = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local one, if driver and executors are one process; on a cluster an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file:///tmp/checkpoints/sentinela-{os.getpid()}"
    return where.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lost executors cost no recomputation.

    The files stay until ``discard`` or until the shared folder is emptied.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sentinela_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove what ``materialise`` wrote, when nothing that is still to run reads it."""
    path = getattr(df, "_sentinela_path", None)
    if path:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
