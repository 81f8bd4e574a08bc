"""Materialised intermediate tables.

Iterative and multi-consumer steps cut their lineage by writing a Parquet table
into the shared folder the cluster names in ``spark.checkpoint.dir``. The table
outlives any executor, keeps column pruning and gives the optimiser real sizes.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables; a temporary one only in local mode."""
    path = spark.conf.get(_SETTING, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"Set {_SETTING} to a folder all executors can reach.")
        path = tempfile.mkdtemp(prefix="tersa-")
        spark.conf.set(_SETTING, path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a frame that reads it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
