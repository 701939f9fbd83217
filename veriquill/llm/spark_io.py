"""What the operators here share: tables in the shared folder, inputs, partitions and spare names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import drop_table, materialize, shared_dir  # noqa: F401


def spare_name(df: DataFrame) -> str:
    """A column name that df does not have."""
    return f"c_{uuid.uuid4().hex}"


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
