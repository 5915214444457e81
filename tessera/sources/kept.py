"""Results kept by what they were made of, so that an attempt pays only for what no earlier one has made."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import files

#: A task's rows are in the folder as soon as it ends, also if the job fails later.
_AS_TASKS_END = ("mapreduce.fileoutputcommitter.algorithm.version", "2")


class Kept:
    """Rows (key, entry, columns of ``schema``) in a folder of Parquet files that only grows. A key is a hash of
    everything that a result depends on; entry names one making of it, so that a bad one can be told off.
    Of several good entries of a key any will do, and the least is taken."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schema = f"key string, entry string, {schema}"

    def _read(self, name: str, schema: str) -> DataFrame:
        there = any(n.startswith("part-") for n in files.names(self.spark, f"{self.folder}/{name}"))
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        """The good result of each key."""
        good = self._read("made", self.schema).join(self._read("rejected", "entry string"), "entry", "left_anti")
        columns = [c for c in good.columns if c != "key"]
        return good.groupBy("key").agg(F.min_by(F.struct(*columns), "entry").alias("r")).select("key", "r.*")

    def missing(self, wanted: DataFrame) -> DataFrame:
        """Rows of ``wanted`` (key, ...) without a good result, one for each key."""
        return wanted.join(self.rows().select("key"), "key", "left_anti").dropDuplicates(["key"])

    def fill(self, wanted: DataFrame, make: Callable[[DataFrame], DataFrame], rows_a_task: int = 256) -> DataFrame:
        """What is missing of ``wanted`` is made, in tasks of about ``rows_a_task`` rows each of which keeps what it made;
        returns the good results. ``make`` takes rows of ``wanted`` and gives the same ones (key) with the
        columns of the schema; what it says of a row must not depend on the others."""
        left = self.missing(wanted)
        if n := left.count():
            dealt = left.repartition(max(1, -(-n // rows_a_task)), "key")
            made = make(dealt).withColumn("entry", F.uuid())
            names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
            made.select(names).write.mode("append").option(*_AS_TASKS_END).parquet(f"{self.folder}/made")
        return self.rows()

    def reject(self, entries: DataFrame) -> None:
        """Results (entry) that aren't good; they will be made anew."""
        entries.select("entry").distinct().write.mode("append").parquet(f"{self.folder}/rejected")
