"""Embedding texts of chunks and knowledge nodes, their identities, and batched embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import TesseraError
from tessera.functions.canon import hashed, index_id, is_blank, json_array, json_string, sorted_unique, text_revision
from tessera.operators.graph import incident_edges
from tessera.operators.sections import approximate_tokens

MAX_TOKENS, BATCH = 8000, 32


def describe_node(kind: Column, title: Column, descriptions: Column) -> Column:
    """Kind and title, other names, and sorted descriptions, a line each."""
    names = F.flatten(F.transform(descriptions, lambda d: F.concat(F.array(d["name"]), d["aliases"])))
    names = sorted_unique(F.filter(names, lambda n: n != title))
    texts = sorted_unique(F.transform(descriptions, lambda d: F.concat(F.when(F.length(d["type"]) > 0, F.concat(d["type"], F.lit("："))).otherwise(""), d["description"])))
    label = F.when(kind == "entity", "实体").otherwise("概念")
    return F.concat_ws("\n", F.concat(label, F.lit("："), title), F.when(F.size(names) > 0, F.concat(F.lit("别名："), F.array_join(names, "、"))), F.array_join(texts, "\n"))


def _relation_texts(graph: dict[str, DataFrame]) -> DataFrame:
    """node_id, relations: sorted texts of a node's edges with readable names."""
    titles = graph["nodes"].select(F.col("node_id").alias("_n"), F.col("title").alias("_t"))
    named = graph["edges"].join(titles.select(F.col("_n").alias("source_id"), F.col("_t").alias("source_title")), "source_id")
    named = named.join(titles.select(F.col("_n").alias("target_id"), F.col("_t").alias("target_title")), "target_id")
    text = F.format_string("%s → %s（%s）：%s", "source_title", "target_title", "type", "description")
    return incident_edges(named.withColumn("text", text)).groupBy("node_id").agg(F.array_sort(F.collect_set("text")).alias("relations"))


def _block(label: str, text: Column) -> Column:
    return F.when(F.length(text) > 0, F.concat(F.lit(label), text))


def node_documents(graph: dict[str, DataFrame], knowledge_base: str) -> DataFrame:
    source = F.struct("section_id", "document_id", "section_revision", "source_path", "heading_path")
    sources = graph["sources"].groupBy("node_id").agg(F.array_sort(F.collect_list(source)).alias("sources"))
    df = graph["nodes"].join(_relation_texts(graph), "node_id", "left").join(sources, "node_id", "left")
    statements = F.array_join(sorted_unique(F.transform("facts", lambda f: f["statement"])), "\n")
    text = F.concat_ws("\n\n", describe_node(F.col("kind"), F.col("title"), F.col("descriptions")), _block("事实：\n", statements), _block("关系：\n", F.array_join("relations", "\n")))
    return df.select(F.lit("wiki").alias("kind"), F.col("node_id").alias("source_id"), F.col("revision").alias("source_revision"), "title", text.alias("text"), "sources", F.array(F.struct(F.col("node_id").alias("id"), "revision")).alias("nodes"), F.lit("ready").alias("knowledge_status"))


def chunk_documents(chunks: DataFrame, graph: dict[str, DataFrame], pending: DataFrame, knowledge_base: str) -> DataFrame:
    """Chunks (id, section_id, section_revision, document_id, document_title, source_path, heading_path,
    markdown) with what their own section says about its nodes. Fails for a chunk of a stale section."""
    links = graph["links"].select("section_id", F.col("section_revision").alias("linked"), "node_ids")
    waiting = pending.select("section_id", F.col("section_revision").alias("waited"))
    df = chunks.join(links, "section_id", "left").join(waiting, "section_id", "left")
    if not df.where("linked <> section_revision OR waited <> section_revision").isEmpty():
        raise TesseraError("STALE_SOURCE", "chunks and graph are of different revisions")
    # What a section says of a node comes from its own claims, however many other sections say something of it.
    said = graph["claims"].groupBy("node_id", "section_id").agg(F.collect_list(F.struct("name", "type", "aliases", "description")).alias("own"))
    described = said.join(graph["nodes"].select("node_id", "kind", "title", "revision"), "node_id")
    described = described.withColumn("about", describe_node(F.col("kind"), F.col("title"), F.col("own")))
    knowledge = described.groupBy("section_id").agg(sorted_unique(F.collect_list("about")).alias("knowledge"), F.array_sort(F.collect_list(F.struct(F.col("node_id").alias("id"), "revision"))).alias("nodes"))
    df = df.join(knowledge, "section_id", "left")
    heading = F.array_join("heading_path", " / ")
    named = F.when(~is_blank(F.col("document_title")), F.concat(F.lit("文档："), "document_title"))
    text = F.concat_ws("\n\n", named, _block("章节：", heading), F.concat(F.lit("原文：\n"), "markdown"), _block("本节知识信息：\n", F.array_join("knowledge", "\n\n")))
    status = F.when(F.col("linked").isNotNull(), "ready").when(F.col("waited").isNotNull(), "pending").otherwise("unavailable")
    source = F.struct("section_id", "document_id", "section_revision", "source_path", "heading_path")
    no_nodes = F.array().cast("array<struct<id:string,revision:string>>")
    return df.select(F.lit("chunk").alias("kind"), F.col("id").alias("source_id"), F.col("section_revision").alias("source_revision"), F.coalesce("document_title", heading).alias("title"), text.alias("text"), F.array(source).alias("sources"), F.coalesce("nodes", no_nodes).alias("nodes"), status.alias("knowledge_status"))


def index_documents(chunks: DataFrame, graph: dict[str, DataFrame], pending: DataFrame, knowledge_base: str, max_tokens: int = MAX_TOKENS, tokens: Callable[[Column], Column] = approximate_tokens) -> DataFrame:
    """Both indexes' documents with id, text_revision and token_count. A text over the budget fails; none
    is cut."""
    df = chunk_documents(chunks, graph, pending, knowledge_base).unionByName(node_documents(graph, knowledge_base))
    df = df.withColumns({"knowledge_base_id": F.lit(knowledge_base), "id": index_id(F.lit(knowledge_base), F.col("kind"), F.col("source_id")), "text_revision": text_revision(F.col("text")), "token_count": tokens(F.col("text"))})
    if not df.where(F.col("token_count") > max_tokens).isEmpty():
        raise TesseraError("INPUT_TOO_LARGE", "an embedding text is over the token budget")
    return df


def invalid_index_documents(df: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Documents whose identity, revision, budget, sources or status is wrong."""
    right_id = F.col("id") == index_id(F.col("knowledge_base_id"), F.col("kind"), F.col("source_id"))
    right = right_id & (F.col("text_revision") == text_revision(F.col("text"))) & (F.col("token_count") <= max_tokens) & (F.size("sources") > 0) & F.col("knowledge_status").isin("ready", "pending", "unavailable")
    return df.where(~right)


class Embedder(Protocol):
    """Called on executors with up to BATCH texts; returns float32 rows, and tokens used: one number for each
    text, or one for all of them, or None."""

    provider: str
    model: str

    def embed(self, texts: list[str]) -> tuple[np.ndarray, Sequence[int] | int | None]: ...


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2 to the 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(4096, 2 * n)
        _POWERS[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, b, np.uint64)))) for b in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64)))]
    return _POWERS[0][:n], _POWERS[1][:n]


_BASE = np.uint64(0x9E3779B97F4A7C15)


def term_hashes(text: str) -> tuple[np.ndarray, int]:
    """64-bit hashes of a text's words (between white space) and of its character triples, and the number of
    words. A term's hash is a polynomial of its code points, so all come from one running sum."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes)
    powers, inverse = _powers(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * powers[:n])))
    space = np.isin(codes, _SPACES)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    terms = [(sums[ends] - sums[starts]) * inverse[starts] + np.uint64(7)]
    if n > 2:
        at = np.arange(n - 2)
        terms.append((sums[at + 3] - sums[at]) * inverse[at])
    found = np.concatenate(terms)
    found = (found ^ (found >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return found ^ (found >> np.uint64(29)), len(starts)


_SPACES = np.array([ord(c) for c in map(chr, range(0x3001)) if c.isspace()], np.uint64)


class HashEmbedder:
    """A deterministic embedder without a model: signed hashes of words and character triples."""

    provider, model = "local", "hashed-terms"

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        out, used = np.zeros((len(texts), self.dimensions), np.float32), []
        for row, text in zip(out, texts, strict=True):
            found, n_words = term_hashes(text)
            signs = 1.0 - 2.0 * (found & np.uint64(1)).astype(np.float64)
            row += np.bincount(((found >> np.uint64(1)) % np.uint64(self.dimensions)).astype(np.int64), signs, self.dimensions)
            if not row.any():
                row[0] = 1
            used.append(n_words)
        return out, used


def embedded(df: DataFrame, embedder: Embedder, batch: int = BATCH) -> DataFrame:
    """Adds vector, model, usage (tokens of the row's text where the embedder tells; else those of the row's
    batch, on its first row; null where not reported) and embedding_revision. A null text counts as empty.
    Fails if the embedder answers with another number of vectors or bad ones."""
    names = [*df.columns, "vector", "usage"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for all_rows in batches:
            for begin in range(0, all_rows.num_rows, batch):
                part = all_rows.slice(begin, batch)
                vectors, usage = embedder.embed([t or "" for t in part.column(at).to_pylist()])
                vectors = np.asarray(vectors, np.float32)
                if vectors.ndim != 2 or len(vectors) != part.num_rows or not np.isfinite(vectors).all() or not vectors.any(axis=1).all():
                    raise TesseraError("INVALID_RESPONSE", "embedding")
                used = [usage] + [None if usage is None else 0] * (part.num_rows - 1) if usage is None or isinstance(usage, int) else list(usage)
                flat = pa.array(vectors.reshape(-1), pa.float32())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * vectors.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(used, pa.int64())], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", vector array<float>, usage bigint"
    out = df.mapInArrow(run, schema)
    dimensions = F.size("vector")
    revision = hashed(json_array(json_string(F.col("text_revision")), *(json_string(F.lit(x)) for x in (embedder.provider, embedder.model, embedder.model)), dimensions.cast("string")))
    return out.withColumns({"model": F.lit(embedder.model), "provider": F.lit(embedder.provider), "embedding_revision": revision})


def check_one_space(df: DataFrame) -> None:
    if df.select("provider", "model", F.size("vector").alias("d")).distinct().limit(2).count() > 1:
        raise TesseraError("INCONSISTENT_BATCH", "vectors of more than one space")
