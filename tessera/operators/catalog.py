"""The catalog of knowledge bases: their documents, embedding space and description."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attributed_documents(records: DataFrame) -> DataFrame:
    """Documents that records (knowledge_base_id, sources) come from, a label each: the least path that
    isn't empty, or the id."""
    sources = records.select("knowledge_base_id", F.explode("sources").alias("s")).select("knowledge_base_id", "s.document_id", F.nullif("s.source_path", F.lit("")).alias("path"))
    return sources.groupBy("knowledge_base_id", "document_id").agg(F.coalesce(F.min("path"), F.col("document_id")).alias("label"))


def document_lists(documents: DataFrame) -> DataFrame:
    """Each knowledge base's documents (label, id) in one sorted array."""
    return documents.groupBy("knowledge_base_id").agg(F.array_sort(F.collect_list(F.struct("label", F.col("document_id").alias("id")))).alias("documents"))


def catalog(snapshots: DataFrame, records: DataFrame, metadata: DataFrame) -> DataFrame:
    """Every knowledge base that has a snapshot or metadata: description (metadata's, else empty),
    embedding space (null without a snapshot) and documents, newest snapshot first."""
    lists = document_lists(attributed_documents(records))
    spaces = snapshots.select("knowledge_base_id", "updated_at", F.struct("provider", "model", "dimensions").alias("embedding"))
    known = spaces.join(lists, "knowledge_base_id", "left").join(metadata.select("knowledge_base_id", "description"), "knowledge_base_id", "full_outer")
    empty = F.array().cast("array<struct<label:string,id:string>>")
    out = known.select("knowledge_base_id", F.coalesce("description", F.lit("")).alias("description"), "embedding", F.coalesce("documents", empty).alias("documents"), "updated_at")
    return out.withColumn("document_count", F.size("documents").cast("bigint")).orderBy(F.desc_nulls_last("updated_at"), "knowledge_base_id")


def records_of_document(records: DataFrame, document_id: str) -> DataFrame:
    return records.where(F.exists("sources", lambda s: s["document_id"] == document_id))


def shared_with_others(records: DataFrame, document_id: str) -> DataFrame:
    """Records of the document that other documents are sources of too."""
    return records_of_document(records, document_id).where(F.exists("sources", lambda s: s["document_id"] != document_id))
