"""From a question to cited evidence, and to an answer."""

from __future__ import annotations

import re
from typing import Any, Protocol

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.errors import TesseraError
from tessera.operators import search
from tessera.operators.indexing import Embedder
from tessera.sources.store import SnapshotStore

MAX_QUESTION, MAX_CONTEXT, MAX_RERANKED = 4000, 60_000, 60
NO_RESULTS = "当前知识库没有可检索的资料。"


class Reranker(Protocol):
    """Scores for at most 60 texts: (place, score) of the best ``top_n``."""

    def rerank(self, question: str, texts: list[str], top_n: int) -> list[tuple[int, float]]: ...


class Generator(Protocol):
    """An answer and why it ended: stop, length, content_filter, refusal or unknown."""

    def generate(self, question: str, evidence: list[dict[str, Any]]) -> tuple[str, str]: ...


class OverlapReranker:
    """Without a model: the share of the question's terms that a text has."""

    def rerank(self, question: str, texts: list[str], top_n: int) -> list[tuple[int, float]]:
        terms = set(re.findall(r"\w+", question.lower())) or {question}
        scores = [(i, sum(t in text.lower() for t in terms) / len(terms)) for i, text in enumerate(texts)]
        return sorted(scores, key=lambda x: (-x[1], x[0]))[:top_n]


def check_ranking(ranking: list[tuple[int, float]], count: int, top_n: int) -> None:
    places = [i for i, _ in ranking]
    if len(ranking) != min(count, top_n) or len(set(places)) != len(places) or any(not 0 <= i < count for i in places) or any(s != s or abs(s) == float("inf") for _, s in ranking):
        raise TesseraError("INVALID_RESPONSE", "ranking")


def search_evidence(store: SnapshotStore, knowledge_base: str, question: str, embedder: Embedder, reranker: Reranker) -> dict[str, Any]:
    """Both routes' best records, merged by text, reranked; at most five sources with labels. What comes to
    the driver is at most 60 candidates."""
    if not knowledge_base.strip() or len(knowledge_base) > 256 or not question.strip() or len(question) > MAX_QUESTION:
        raise TesseraError("INVALID_INPUT", "knowledge base or question")
    counts = dict.fromkeys(("chunks", "nodes", "merged", "duplicates", "selected"), 0)
    snapshot = store.snapshot(knowledge_base)
    empty = {"status": "no_results", "sources": [], "revision": snapshot.revision if snapshot else None, "counts": counts}
    if snapshot is None or snapshot.chunks + snapshot.nodes == 0:
        return empty
    if embedder.provider != snapshot.provider:
        raise TesseraError("INCONSISTENT_SPACE", "the knowledge base was embedded by another provider")
    vector = embedder.embed([question])[0][0].tolist()
    hits = store.search_dual(knowledge_base, embedder.provider, embedder.model, vector, snapshot.revision)
    hits = hits.select("id", "kind", "title", "text", "source_id", "score", "rank", "knowledge_base_id", "sources")
    route = F.when(F.col("kind") == "chunk", 0).otherwise(1)
    ordered = hits.withColumn("place", F.row_number().over(Window.orderBy(route, "rank")))
    found = ordered.cache()
    try:
        if not search.invalid_candidates(found, knowledge_base).isEmpty():
            raise TesseraError("INVALID_RESULTS", "search candidates")
        merged = search.merge_candidates(found, F.col("place")).orderBy("ord").collect()
        routes = {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}
    finally:
        found.unpersist()
    counts |= {"chunks": routes.get("chunk", 0), "nodes": routes.get("wiki", 0), "merged": len(merged)}
    counts["duplicates"] = counts["chunks"] + counts["nodes"] - counts["merged"]
    ranking = reranker.rerank(question, [m["text"] for m in merged], min(search.SELECTED, len(merged)))
    check_ranking(ranking, len(merged), search.SELECTED)
    best = sorted(ranking, key=lambda x: (-x[1], x[0]))
    sources = [{"label": f"S{n}", "rerankScore": s, "id": merged[i]["id"], "title": merged[i]["title"], "text": merged[i]["text"], "matches": [m.asDict() for m in merged[i]["matches"]]} for n, (i, s) in enumerate(best, 1)]
    return {"status": "found", "sources": sources, "revision": snapshot.revision, "counts": counts | {"selected": len(sources)}}


def answer(question: str, evidence: dict[str, Any], generator: Generator) -> dict[str, Any]:
    """An answer that cites nothing but the evidence's labels; without evidence a fixed text."""
    if evidence["status"] == "no_results":
        return {"status": "no_results", "answer": NO_RESULTS}
    shown = [{"label": s["label"], "title": s["title"], "kinds": sorted({m["kind"] for m in s["matches"]}), "text": s["text"]} for s in evidence["sources"]]
    if sum(len(s["text"]) for s in shown) > MAX_CONTEXT:
        raise TesseraError("INPUT_TOO_LARGE", "evidence")
    text, reason = generator.generate(question, shown)
    if reason != "stop":
        raise TesseraError({"refusal": "REFUSED", "length": "TRUNCATED", "content_filter": "FILTERED"}.get(reason, "INVALID_RESPONSE"), "the answer isn't whole")
    if not text.strip() or not set(re.findall(r"\[(S\d+)\]", text)) <= {s["label"] for s in shown}:
        raise TesseraError("INVALID_RESPONSE", "the answer is blank or cites what isn't there")
    return {"status": "answered", "answer": text}
