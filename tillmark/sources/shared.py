"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import gc
import uuid
from tempfile import mkdtemp

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``; without that only where all runs in one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
    return f"{(found or 'file://' + mkdtemp(prefix='tillmark-')).rstrip('/')}/tillmark-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: survives lost executors, and is computed once. Its path is added to ``made``."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, made: list[str]) -> None:
    """Deletes written tables that nothing will read again."""
    for path in made:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    made.clear()


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that are done with; it acts when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
