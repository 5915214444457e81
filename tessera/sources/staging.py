"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources import files


class Staging:
    """Stages written as Parquet and read back, under ``spark.checkpoint.dir`` or, where that is unset,
    the warehouse. What is written is computed once, and a lost executor costs the running stage only."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"
        self.folder = f"{base.rstrip('/')}/stages-{uuid.uuid4().hex}"

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        df, path = make(), f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Remove the stages; what was read from them can't be read again."""
        files.remove(self.spark, self.folder)
