"""From documents to a searchable snapshot, a stage after another."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import TesseraError
from tessera.functions.canon import is_blank, utf16_length
from tessera.operators import enrichment as en
from tessera.operators import graph as g
from tessera.operators import indexing, sections
from tessera.sources.jobs import Job
from tessera.sources.staging import Staging
from tessera.sources.store import Snapshot, SnapshotStore

MAX_ID, MAX_CONTENT, MAX_PATH, MAX_SECTIONS = 256, 200_000, 2048, 100


def checked_documents(docs: DataFrame) -> DataFrame:
    """Documents (document_id, content, path) within the limits, or an error."""
    bad = docs.where(is_blank(F.col("document_id")) | (utf16_length(F.col("document_id")) > MAX_ID) | F.col("content").isNull() | (utf16_length(F.col("content")) > MAX_CONTENT) | (utf16_length(F.coalesce("path", F.lit(""))) > MAX_PATH))
    if not bad.isEmpty():
        raise TesseraError("INVALID_INPUT", "a document is over a limit")
    return docs


def section_rows(normal: DataFrame) -> DataFrame:
    """Sections of normalized documents with revision, where they come from, document title, metadata and path."""
    split = sections.sections(normal, content="content")
    about = normal.select("document_id", F.col("title").alias("document_title"), "metadata", F.col("path").alias("source_path"))
    return sections.section_revision(split.hint("merge").join(about, "document_id"))


def readable(normal: DataFrame) -> DataFrame:
    """Normalized documents, or an error that says where the first unreadable one, by id, can't be read."""
    bad = normal.where("error IS NOT NULL").orderBy("document_id").select("document_id", "error.*").limit(1).collect()
    if bad:
        raise TesseraError("PARSE_FAILED", "a document can't be read", f"{bad[0]['document_id']}:{bad[0]['line']}:{bad[0]['column']}", bad[0]["reason"])
    return normal


def contributions_of(section_rows_df: DataFrame) -> DataFrame:
    return section_rows_df.select(F.col("id").alias("section_id"), F.col("revision").alias("section_revision"), "document_id", "source_path", "heading_path")


def empty_knowledge(spark: SparkSession) -> dict[str, DataFrame]:
    return {"nodes": spark.createDataFrame([], en.NODE_SCHEMA), "relations": spark.createDataFrame([], en.RELATION_SCHEMA), "facts": spark.createDataFrame([], en.FACT_SCHEMA)}


def finalized(knowledge: dict[str, DataFrame], markdown: DataFrame, staging: Staging) -> dict[str, DataFrame]:
    """Knowledge validated, deduplicated, and validated again: merged evidence may be too much."""
    for attempt in range(2):
        bad = en.violations(knowledge["nodes"], knowledge["relations"], knowledge["facts"], markdown).orderBy("section_id", "path").limit(1).collect()
        if bad:
            raise TesseraError("INVALID_OUTPUT", "knowledge doesn't validate", bad[0]["path"], bad[0]["reason"])
        nodes, ids = en.deduplicated_nodes(knowledge["nodes"])
        knowledge = {"nodes": nodes, "relations": en.deduplicated_relations(knowledge["relations"], ids), "facts": en.deduplicated_facts(knowledge["facts"], ids)}
        knowledge = {name: staging.stage(f"known-{attempt}-{name}", lambda df=df: df) for name, df in knowledge.items()}
    return knowledge


def build_index(docs: DataFrame, knowledge: dict[str, DataFrame] | None, knowledge_base: str, adapter: str = "markdown", max_tokens: int = sections.MAX_TOKENS, job: Job | None = None, staging: Staging | None = None) -> DataFrame:
    """Index documents of both kinds for ``docs`` and the knowledge extracted from their sections. Sections,
    chunks, graph and index documents are written out: to the job's stages, or to ``staging``."""
    spark = docs.sparkSession
    staging = staging or Staging(spark)
    keep = (job or staging).stage
    # Documents are read once; whatever follows sees the same ones.
    normal = keep("normalize", lambda: sections.normalized(docs.select("document_id", "content", "path"), adapter))
    readable(checked_documents(normal))
    split = keep("sections", lambda: section_rows(normal))
    if not split.groupBy("document_id").count().where(F.col("count") > MAX_SECTIONS).isEmpty():
        raise TesseraError("INVALID_INPUT", "a document has too many sections")
    pieces = keep("chunks", lambda: sections.chunks(split, max_tokens))
    mine = split.select(F.col("id").alias("section_id"), F.col("revision").alias("section_revision"), "document_id", "document_title", "source_path", "heading_path")
    pieces = pieces.select("id", "section_id", "markdown").join(mine, "section_id")
    known = finalized(knowledge or empty_knowledge(spark), split.select(F.col("id").alias("section_id"), "markdown"), staging)
    no_mappings = spark.createDataFrame([], "section_id string, section_revision string, local_id string, canonical_id string")
    no_canonical = spark.createDataFrame([], "id string, kind string, title string")
    built = g.build_graph(contributions_of(split), known["nodes"], known["relations"], known["facts"], knowledge_base, no_mappings, no_canonical)
    graph = {name: staging.stage(name, lambda df=df: df) for name, df in built.items()}
    pending = spark.createDataFrame([], "section_id string, section_revision string")
    return keep("indexing", lambda: indexing.index_documents(pieces, graph, pending, knowledge_base))


def index_and_store(documents: DataFrame, embedder: indexing.Embedder, store: SnapshotStore, knowledge_base: str, expected_revision: str | None, write_key: str | None = None, document_id: str | None = None, job: Job | None = None) -> Snapshot:
    """Embed index documents and store them, as the whole knowledge base or as one document's part. Each text
    is embedded once: the store, or the job's stage, evaluates the vectors in one write."""
    embed = lambda: indexing.embedded(documents, embedder).drop("usage")
    vectors = job.stage("embedding", embed) if job else embed()
    records = vectors.drop("provider", "model")
    if document_id is None:
        return store.replace_snapshot(knowledge_base, records, embedder.provider, embedder.model, expected_revision, write_key)
    return store.replace_document(knowledge_base, document_id, records, embedder.provider, embedder.model, expected_revision, write_key)


def ingest(docs: DataFrame, knowledge: dict[str, DataFrame] | None, knowledge_base: str, embedder: indexing.Embedder, store: SnapshotStore, adapter: str = "markdown", job: Job | None = None) -> dict[str, Any]:
    """Documents to a new snapshot. With a job, stages that an earlier attempt finished are taken over, and
    a finished job answers with its result."""
    if job and (state := job.state())["status"] == "succeeded":
        return state["result"]
    if job:
        job.restart()
    staging = Staging(docs.sparkSession)
    try:
        before = store.snapshot(knowledge_base)
        documents = build_index(docs, knowledge, knowledge_base, adapter, job=job, staging=staging)
        done = index_and_store(documents, embedder, store, knowledge_base, before.revision if before else None, f"job:{job.id}" if job else None, job=job)
        result = {"revision": done.revision, "chunks": done.chunks, "nodes": done.nodes}
        if job:
            job.finish(status="succeeded", result=result)
        return result
    except TesseraError as e:
        if job:
            job.finish(status="failed", code=e.code)
        raise
    finally:
        staging.close()
