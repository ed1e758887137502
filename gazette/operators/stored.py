"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset and Spark runs in one process, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gazette-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stored-{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written as Parquet to the shared folder and read from there: lineage ends, lost executors lose nothing, and what
    reads them takes the columns that it needs."""
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Deletes all tables that ``stored`` has written in this application, once their results have been written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
