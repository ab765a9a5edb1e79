"""Tables staged in the folder that all executors share, to cut lineage or to read a result more than once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees. A temporary one only in local mode; a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stage_dir(spark: SparkSession) -> str:
    """Where this application stages tables; results that were not written yet still read them."""
    return f"{shared_dir(spark)}/paperloom/{spark.sparkContext.applicationId}"


def clear_stages(spark: SparkSession) -> None:
    """Remove all tables this application staged, once its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(stage_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write `df` once to the shared folder and read it back.

    A lost executor then costs a re-read of one file, not a re-run of the plan.
    """
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
