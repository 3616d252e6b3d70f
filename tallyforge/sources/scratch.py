"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a row group.
ROW_GROUP = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset: a new local one in local mode, an error on a cluster."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or (held.get() if held.isDefined() else None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
    if not held.isDefined():
        context.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: cuts lineage and survives lost executors.

    Unlike a checkpoint, the table read again carries nothing of the plan it came from. Row groups are small, so that
    writers hold little and a file can be dealt to several tasks. The files stay for the session.
    """
    spark, path, schema = df.sparkSession, scratch(df.sparkSession, name), df.schema
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # Spark removes shuffle files once their plan is collected: what is on disk here needs them no more
    return spark.read.schema(schema).parquet(path)
