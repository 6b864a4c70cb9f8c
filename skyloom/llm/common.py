"""What the operators of this package share: tables, shared folders, checkpoints and the workers' import path."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.common import session_of, shared_folder
from ..operators.common import settled as settle

__all__ = ["session_of", "settle", "shared_folder", "shuffle_partitions", "table", "work_path"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for one run's files in the shared folder."""
    return f"{shared_folder(spark)}/skyloom/{name}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
