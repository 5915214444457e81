"""Continuous ingestion: files of documents that arrive in a folder become new snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.indexing import Embedder, embedded
from tessera.plans.ingest import build_index
from tessera.sources.staging import Staging
from tessera.sources.store import SnapshotStore

DOCUMENTS = "document_id string, content string, path string"


def document_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Documents from files of JSON lines."""
    return spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).json(folder)


def start_ingestion(stream: DataFrame, store: SnapshotStore, knowledge_base: str, embedder: Embedder, checkpoint: str, adapter: str = "markdown", once: bool = True) -> StreamingQuery:
    """Each micro-batch's documents replace their earlier versions. The batch's number is the write key, so
    a batch that is run again after a failure isn't applied twice."""

    def apply(batch: DataFrame, number: int) -> None:
        staging = Staging(batch.sparkSession)
        try:
            row = F.max_by(F.struct("content", "path"), F.struct("path", "content")).alias("d")
            latest = staging.stage("documents", lambda: batch.groupBy("document_id").agg(row).select("document_id", "d.*"))
            if latest.isEmpty():
                return
            documents = build_index(latest, None, knowledge_base, adapter, staging=staging)
            fresh = embedded(documents, embedder).drop("usage", "provider", "model")
            current = store.snapshot(knowledge_base)
            store.replace_documents(knowledge_base, latest, fresh, embedder.provider, embedder.model, current.revision if current else None, f"batch:{checkpoint}:{number}"[-256:])
        finally:
            staging.close()

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def log_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)
