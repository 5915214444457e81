"""What changed between two complete snapshots of sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import TesseraError


def change_plan(before: DataFrame, after: DataFrame) -> DataFrame:
    """section_id and change: added, modified (revision), removed, source_only (detail) or unchanged.

    Both sides have section_id, revision, detail (a hash of all else). rebuild says whether chunks and
    enrichment are made anew, invalidate whether knowledge of the old revision is withdrawn."""
    joined = before.select("section_id", F.col("revision").alias("old"), F.col("detail").alias("old_detail"), F.lit(True).alias("was")).join(
        after.select("section_id", "revision", "detail", F.lit(True).alias("is")), "section_id", "full_outer"
    )
    change = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("is").isNull(), "removed")
        .when(F.col("old") != F.col("revision"), "modified")
        .when(F.col("old_detail") != F.col("detail"), "source_only")
        .otherwise("unchanged")
    )
    out = joined.select("section_id", change.alias("change"))
    return out.withColumns({"rebuild": F.col("change").isin("added", "modified"), "invalidate": F.col("change").isin("modified", "removed")})


def check_unique(sections: DataFrame, key: str = "section_id", code: str = "INVALID_SNAPSHOT") -> None:
    if not sections.groupBy(key).count().where("count > 1").isEmpty():
        raise TesseraError(code, f"{key} repeats")


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def same_keys(a: DataFrame, b: DataFrame, key: str) -> bool:
    return difference(a, b, key).isEmpty() and difference(b, a, key).isEmpty()
