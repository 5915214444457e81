"""Exact vector search over chunk and knowledge-node records, merging and selection of evidence."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import TesseraError
from tessera.functions.canon import is_blank
from tessera.operators import markdown as md
from tessera.operators.batches import sliced

PER_ROUTE, SELECTED = 30, 5
MAX_DIMENSIONS = 16_000
#: Query vectors of one block of a batch search: the driver ships a block at a time to the executors.
BLOCK_BYTES = 32 << 20
#: Queries and records whose scores a task holds at a time.
TILE = (512, 2048)
_CITATION = re.compile(r"\[S[0-9]+\]")
_LARGEST = 3.4028234663852886e38


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Of float32 vectors, computed in double; null if either has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def is_valid_vector(v: Column) -> Column:
    """1 to 16000 finite float32 numbers, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= _LARGEST))
    return v.isNotNull() & F.size(v).between(1, MAX_DIMENSIONS) & finite & F.exists(v, lambda x: x.cast("float") != 0)


def top_k(records: DataFrame, vector: Sequence[float], k: int = 5, id_column: str = "id", vector_column: str = "vector") -> DataFrame:
    """The k records most like ``vector``: score descending, then id. Plans as TakeOrderedAndProject."""
    if not 1 <= k <= 100:
        raise TesseraError("INVALID_INPUT", "limit is from 1 to 100")
    query = F.array(*(F.lit(float(np.float32(x))) for x in vector))
    return records.withColumn("score", cosine(F.col(vector_column), query)).where("score IS NOT NULL").orderBy(F.desc("score"), id_column).limit(k)


def dual_search(records: DataFrame, vector: Sequence[float], k: int = PER_ROUTE, id_column: str = "id", vector_column: str = "vector") -> DataFrame:
    """The k best of each kind, with score and rank. The window's limit is applied before the shuffle."""
    query = F.array(*(F.lit(float(np.float32(x))) for x in vector))
    scored = records.withColumn("score", cosine(F.col(vector_column), query)).where("score IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), id_column))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def batch_search(records: DataFrame, queries: DataFrame, k: int = PER_ROUTE, id_column: str = "id", vector_column: str = "vector") -> DataFrame:
    """The k best records for each query (query_id, vector): query_id, id, score, rank.

    Queries, whose ids differ, are taken in blocks of at most BLOCK_BYTES of vectors; each task multiplies a
    block with its records and keeps k for each query (ties by id), so what is shuffled is k rows a query
    and task."""
    width = queries.select(F.max(F.size("vector"))).first()[0]
    if not width:
        return records.sparkSession.createDataFrame([], "query_id bigint, id bigint, score double, rank int")
    if not queries.groupBy("query_id").count().where("query_id IS NULL OR count > 1").isEmpty():
        raise TesseraError("INVALID_INPUT", "a query's id is missing or repeats")
    per_block = max(1, BLOCK_BYTES // (8 * width))
    numbered = queries.select("query_id", "vector").orderBy("query_id")
    found, last = None, None
    while True:
        block = numbered if last is None else numbered.where(F.col("query_id") > last)
        rows = block.limit(per_block).collect()
        if not rows:
            break
        last = rows[-1]["query_id"]
        part = _block_search(records, rows, k, id_column, vector_column)
        found = part if found is None else found.unionByName(part)
        if len(rows) < per_block:
            break
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _best_of(own: np.ndarray, best: np.ndarray, ids_of: np.ndarray, vectors: np.ndarray, rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best scores and ids of each query, after records were added: score descending, then id. Only what scores as
    the k-th best or better, ties included, is put in order."""
    k, scores = best.shape[1], own @ vectors.T
    least = best[:, -1]
    if len(rec) > k:
        least = np.maximum(least, np.partition(scores, len(rec) - k, axis=1)[:, len(rec) - k])
    q, at = np.nonzero(scores >= least[:, None])
    held, place = np.nonzero(best > -np.inf)
    rows = np.concatenate((held, q))
    found, ids = np.concatenate((best[held, place], scores[q, at])), np.concatenate((ids_of[held, place], rec[at]))
    order = np.lexsort((ids, -found, rows))
    rows = rows[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    kept = rank < k
    out, named = np.full_like(best, -np.inf), np.full_like(ids_of, np.iinfo(np.int64).max)
    out[rows[kept], rank[kept]], named[rows[kept], rank[kept]] = found[order][kept], ids[order][kept]
    return out, named


def _block_search(records: DataFrame, rows: list, k: int, id_column: str, vector_column: str) -> DataFrame:
    ids = np.array([r["query_id"] for r in rows], np.int64)
    matrix = np.array([r["vector"] for r in rows], np.float32).astype(np.float64)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    shared = records.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, own = shared.value
        # The best so far of each query: scores, and ids; unused places have no score.
        best, ids_of = np.full((len(own_ids), k), -np.inf), np.full((len(own_ids), k), np.iinfo(np.int64).max)
        for batch in batches:
            rec = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            vectors = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rec), -1) if len(rec) else np.empty((0, own.shape[1]))
            norms = np.linalg.norm(vectors, axis=1)
            rec, vectors = rec[norms > 0], vectors[norms > 0] / norms[norms > 0, None]
            for some in range(0, len(rec), TILE[1]):
                for few in range(0, len(own), TILE[0]):
                    at = slice(few, few + TILE[0])
                    best[at], ids_of[at] = _best_of(own[at], best[at], ids_of[at], vectors[some : some + TILE[1]], rec[some : some + TILE[1]])
        q, at = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(own_ids[q]), pa.array(ids_of[q, at]), pa.array(best[q, at])], ["query_id", "id", "score"])

    return records.select(F.col(id_column).cast("bigint"), vector_column).mapInArrow(run, "query_id bigint, id bigint, score double")


def invalid_candidates(hits: DataFrame, knowledge_base: str, per_route: int = PER_ROUTE) -> DataFrame:
    """Reasons why hits (knowledge_base_id, kind, id, text, score) can't be merged; no rows if they can."""
    bad = hits.where((F.col("knowledge_base_id") != knowledge_base) | is_blank(F.col("id")) | is_blank(F.col("text")) | F.col("score").isNull() | F.isnan("score"))
    reasons = bad.select(F.lit("candidate").alias("reason"), "id")
    texts = hits.groupBy("id").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select(F.lit("conflicting text").alias("reason"), "id")
    counts = hits.groupBy("kind").count().where(F.col("count") > per_route).select(F.lit("too many").alias("reason"), F.col("kind").alias("id"))
    return reasons.unionByName(texts).unionByName(counts)


def merge_candidates(hits: DataFrame, order: Column) -> DataFrame:
    """Hits with the same text become one candidate, in the order of their first: id and title of the
    first, and all matches (a match per id, the first one) in order."""
    ordered = hits.withColumn("ord", order)
    one = ordered.groupBy("text", "id").agg(F.min_by(F.struct("ord", "title", "kind", "source_id", "score"), "ord").alias("m"))
    match = F.struct("m.ord", F.col("id").alias("index_id"), "m.kind", "m.source_id", F.col("m.score").alias("vector_score"))
    merged = one.groupBy("text").agg(F.min("m.ord").alias("ord"), F.min_by("id", "m.ord").alias("id"), F.min_by("m.title", "m.ord").alias("title"), F.array_sort(F.collect_list(match)).alias("matches"))
    return merged.select("ord", "id", "title", "text", F.transform("matches", lambda m: F.struct(m["index_id"].alias("index_id"), m["kind"].alias("kind"), m["source_id"].alias("source_id"), m["vector_score"].alias("vector_score"))).alias("matches"))


def select_evidence(candidates: DataFrame, scores: DataFrame, n: int = SELECTED) -> DataFrame:
    """Candidates with a rerank score (ord, rerank_score), best first, ties by place; labels S1, S2, ..."""
    ranked = candidates.join(scores, "ord").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rerank_score"), "ord"))).where(F.col("rank") <= n)
    return ranked.withColumn("label", F.concat(F.lit("S"), F.col("rank").cast("string")))


def query_counts(hits: DataFrame, candidates: DataFrame, selected: DataFrame) -> dict[str, int]:
    routes = {r["kind"]: r["count"] for r in hits.groupBy("kind").count().collect()}
    merged, chosen = candidates.count(), selected.count()
    chunks, nodes = routes.get("chunk", 0), routes.get("wiki", 0)
    return {"chunks": chunks, "nodes": nodes, "merged": merged, "duplicates": chunks + nodes - merged, "selected": chosen}


def cited_labels(answer: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(S[0-9]+)\]"), F.lit(1)))


def is_valid_answer(answer: Column, labels: Column) -> Column:
    """Not blank, and citing nothing but the labels."""
    return ~is_blank(answer) & (F.size(F.array_except(cited_labels(answer), labels)) == 0)


def _segments(answers: pa.Array) -> pa.Array:
    out = []
    for text in answers.to_pylist():
        if text is None:
            out.append(None)
            continue
        root = md.outline(text)
        whole = [(b.start, b.end) for b in root.walk() if b.kind in ("code", "html")]
        for block in root.children:
            whole += [(block.start + x.start, block.start + x.end) for x in md.inlines(text[block.start : block.end], set()) if x.kind in ("code", "link", "image", "tag")]
        cited = [m.span() for m in _CITATION.finditer(text) if not any(a < m.end() and m.start() < b for a, b in whole)]
        parts, at = [], 0
        for a, b in cited:
            parts += [("text", text[at:a]), ("citation", text[a:b])]
            at = b
        out.append([{"type": kind, "value": value} for kind, value in [*parts, ("text", text[at:])] if value])
    return pa.array(out, pa.list_(pa.struct([("type", pa.string()), ("value", pa.string())])))


def answer_segments(text: Column) -> Column:
    """An answer cut into citations and the text between them, for display. What looks like a citation in code or in a
    link is text."""
    return F.arrow_udf(sliced(_segments), "array<struct<type:string,value:string>>")(text)
