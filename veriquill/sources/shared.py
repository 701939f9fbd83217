"""Tables in the folder that driver and executors share: how lineage is cut and work kept for several uses."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir. Unset, it becomes a local folder in local mode (tests) and is an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="veriquill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/veriquill-{uuid.uuid4().hex}"


def materialize(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, so that later jobs neither recompute it nor depend on one executor."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Remove a table that materialize() wrote and that nothing reads any more."""
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.shared_path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
