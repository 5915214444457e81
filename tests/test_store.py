import json
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.errors import TesseraError
from tessera.operators import indexing, logs, search
from tessera.plans import ask, ingest
from tessera.sources import files
from tessera.sources.jobs import Job, read_ndjson
from tessera.sources.store import KnowledgeBases, SnapshotStore, revision_of
from tessera.streaming.ingest import document_stream, start_ingestion

SCHEMA = "id string, kind string, title string, text string, source_id string, knowledge_base_id string, sources array<struct<document_id:string>>, vector array<float>"
SPACE = ("p", "m")


def records(spark, *rows, document="d1"):
    return spark.createDataFrame([(i, kind, i, f"text {i}", i, "kb", [(document,)], vector) for i, kind, vector in rows], SCHEMA)


def two(spark, document="d1", start=0):
    return records(spark, (f"c{start}", "chunk", [1.0, 0.5]), (f"w{start}", "wiki", [0.0, 1.0]), document=document)


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, f"file://{tmp_path}/store")


def test_write_replay_and_conflict(spark, store):
    first = store.replace_snapshot("kb", two(spark), *SPACE, None, "key")
    assert (first.chunks, first.nodes, first.dimensions) == (1, 1, 2)
    assert store.replace_snapshot("kb", two(spark), *SPACE, None, "key") == first
    with pytest.raises(TesseraError, match="CONFLICT"):
        store.replace_snapshot("kb", two(spark, start=1), *SPACE, first.revision, "key")
    with pytest.raises(TesseraError, match="CONFLICT"):
        store.replace_snapshot("kb", two(spark, start=1), *SPACE, None)
    again = store.replace_snapshot("kb", two(spark), *SPACE, first.revision)
    assert again.revision == first.revision and again.version == 2


def test_documents_are_replaced_alone(spark, store):
    done = store.replace_document("kb", "d1", two(spark), *SPACE, None)
    done = store.replace_document("kb", "d2", records(spark, ("c5", "chunk", [1.0, 1.0]), ("w5", "wiki", [2.0, 1.0]), ("w6", "wiki", [2.0, 2.0]), document="d2"), *SPACE, done.revision)
    assert (done.chunks, done.nodes) == (2, 3)
    done = store.replace_document("kb", "d2", records(spark, ("c5", "chunk", [1.0, 1.0]), document="d2"), *SPACE, done.revision)
    assert (done.chunks, done.nodes) == (2, 1)
    with pytest.raises(TesseraError, match="INCONSISTENT_SPACE"):
        store.replace_document("kb", "d3", records(spark, ("c9", "chunk", [1.0, 1.0, 1.0]), document="d3"), *SPACE, done.revision)
    with pytest.raises(TesseraError, match="CONFLICT"):
        store.replace_document("kb", "d3", records(spark, ("c0", "chunk", [1.0, 1.0]), document="d3"), *SPACE, done.revision)


def test_one_of_two_writers_wins(spark, store):
    base = store.replace_snapshot("kb", two(spark), *SPACE, None)
    results = []
    current = store.snapshot("kb")
    for start in (1, 2):
        try:
            part, buckets, dimensions = store._write("kb", two(spark, start=start), current.n_buckets)
            results.append(store._commit("kb", current, part, buckets, current.n_buckets, current.schema, *SPACE, dimensions, None, str(start)))
        except TesseraError as e:
            results.append(e.code)
    assert results[1] == "CONFLICT" and store.snapshot("kb") == results[0] != base


def test_a_lost_receipt_is_no_conflict(spark, store, monkeypatch):
    """A writer that dies between the receipt and the manifest, and one that dies after both."""
    real = files.create
    monkeypatch.setattr(files, "create", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        store.replace_snapshot("kb", two(spark), *SPACE, None, "key")
    monkeypatch.setattr(files, "create", real)
    assert store.snapshot("kb") is None
    done = store.replace_snapshot("kb", two(spark), *SPACE, None, "key")
    assert store.replace_snapshot("kb", two(spark), *SPACE, None, "key") == done


def test_only_a_documents_bucket_is_rewritten(spark, store):
    rows = [(f"c{i}", "chunk", [1.0, i / 7]) for i in range(40)]
    every = None
    for i, row in enumerate(rows):
        one = records(spark, row, document=f"d{i}")
        every = one if every is None else every.unionByName(one)
    base = store.replace_snapshot("kb", every.coalesce(1), *SPACE, None)
    done = store.replace_document("kb", "d3", records(spark, ("c3", "chunk", [5.0, 5.0]), document="d3"), *SPACE, base.revision)
    changed = [b for b in done.buckets if done.buckets[b]["part"] != base.buckets[b]["part"]]
    assert len(changed) == 1 and len(base.buckets) > 4
    assert done.revision == revision_of(store.records(done)) != base.revision
    assert sorted(r["id"] for r in store.records(done).collect()) == sorted(r[0] for r in rows)


def test_bad_vectors_leave_the_snapshot(spark, store):
    base = store.replace_snapshot("kb", two(spark), *SPACE, None)
    for bad in ([0.0, 0.0], [float("nan"), 1.0], [1.0]):
        with pytest.raises(TesseraError, match="INVALID_INPUT"):
            store.replace_snapshot("kb", two(spark).unionByName(records(spark, ("x", "chunk", bad))), *SPACE, base.revision)
    assert store.snapshot("kb") == base


def test_search_pins_a_version(spark, store):
    rows = [(f"c{i:02d}", "chunk", [1.0, i / 10]) for i in range(35)] + [(f"w{i:02d}", "wiki", [i / 10, 1.0]) for i in range(35)]
    done = store.replace_snapshot("kb", records(spark, *rows), *SPACE, None)
    hits = store.search_dual("kb", *SPACE, [1.0, 0.0], done.revision).collect()
    assert len(hits) == 60 and sum(h["kind"] == "chunk" for h in hits) == 30
    best = store.search("kb", "chunk", *SPACE, [1.0, 0.0], 3).collect()
    assert [r["id"] for r in best] == ["c00", "c01", "c02"] and best[0]["score"] == pytest.approx(1.0, abs=1e-6)
    assert store.search("none", "chunk", *SPACE, [1.0, 0.0]) is None
    with pytest.raises(TesseraError, match="CONFLICT"):
        store.search_dual("kb", *SPACE, [1.0, 0.0], "old")
    with pytest.raises(TesseraError, match="INCONSISTENT_SPACE"):
        store.search("kb", "chunk", "p", "other", [1.0, 0.0])


def test_knowledge_base_descriptions(spark, store):
    bases = KnowledgeBases(store)
    bases.create("a", "first")
    with pytest.raises(TesseraError, match="CONFLICT"):
        bases.create("a")
    with pytest.raises(TesseraError, match="NOT_FOUND"):
        bases.describe("b", "x")
    bases.describe("a", "second")
    assert bases.all() == [{"knowledge_base_id": "a", "description": "second"}]


def test_merge_has_one_duplicate(spark):
    hits = [(kind, i, f"{kind}-{i}", "shared text" if i == 0 else f"{kind} {i}", 1 - i / 100) for kind in ("chunk", "wiki") for i in range(30)]
    df = spark.createDataFrame([("kb", k, i + (30 if k == "wiki" else 0), x, x, t, x, s) for k, i, x, t, s in hits], "knowledge_base_id string, kind string, place int, id string, title string, text string, source_id string, score double")
    assert search.invalid_candidates(df, "kb").count() == 0
    merged = search.merge_candidates(df, F.col("place"))
    scores = merged.select("ord", F.col("ord").cast("double").alias("rerank_score"))
    selected = search.select_evidence(merged, scores)
    assert search.query_counts(df, merged, selected) == {"chunks": 30, "nodes": 30, "merged": 59, "duplicates": 1, "selected": 5}
    first = selected.where("label = 'S1'").first()
    assert first["id"] == "wiki-29"
    both = merged.where("text = 'shared text'").first()
    assert both["id"] == "chunk-0" and [m["kind"] for m in both["matches"]] == ["chunk", "wiki"]


class Echo:
    def __init__(self, text="It is so [S1].", reason="stop"):
        self.text, self.reason = text, reason

    def generate(self, question, evidence):
        return self.text, self.reason


def test_ingest_and_ask(spark, store):
    docs = spark.createDataFrame([("d1", "# Atlas\n\nAtlas calls the gateway.\n\n# Ports\n\nThe port is 443.", "a.md")], "document_id string, content string, path string")
    embedder = indexing.HashEmbedder(32)
    result = ingest.ingest(docs, None, "kb", embedder, store)
    assert result["chunks"] == 2
    evidence = ask.search_evidence(store, "kb", "Which port?", embedder, ask.OverlapReranker())
    assert evidence["status"] == "found" and "443" in evidence["sources"][0]["text"] and evidence["counts"]["merged"] == 2
    assert ask.answer("Which port?", evidence, Echo())["status"] == "answered"
    for generator, code in ((Echo("[S9]"), "INVALID_RESPONSE"), (Echo(reason="length"), "TRUNCATED"), (Echo(" "), "INVALID_RESPONSE")):
        with pytest.raises(TesseraError, match=code):
            ask.answer("q", evidence, generator)
    assert ask.answer("q", ask.search_evidence(store, "none", "q", embedder, ask.OverlapReranker()), Echo())["status"] == "no_results"


def test_each_text_is_embedded_once(spark, store, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    class Counting(indexing.HashEmbedder):
        def embed(self, texts):
            for text in texts:
                (calls / uuid.uuid4().hex).write_text(text)
            return super().embed(texts)

    docs = spark.createDataFrame([(f"d{i}", f"# A\n\ntext {i}", None) for i in range(5)], "document_id string, content string, path string")
    ingest.ingest(docs, None, "kb", Counting(16), store)
    texts = [f.read_text() for f in calls.iterdir()]
    assert len(texts) == len(set(texts)) == 5


def test_documents_are_read_once(spark, store):
    """A source that gives other rows each time it is read: all stages see those of one reading."""
    rows = spark.range(200).select(F.concat(F.lit("d"), "id").alias("document_id"), F.concat(F.lit("# T\n\n"), F.rand().cast("string")).alias("content"), F.lit(None).cast("string").alias("path"))
    result = ingest.ingest(rows.where(F.rand() < 0.5), None, "kb", indexing.HashEmbedder(8), store)
    kept = store.records(store.snapshot("kb")).count()
    assert 50 < result["chunks"] == kept < 150


def test_job_resumes_and_replays(spark, store, tmp_path):
    docs = spark.createDataFrame([("d1", "# A\n\nx", None)], "document_id string, content string, path string")

    class Failing(indexing.HashEmbedder):
        def embed(self, texts):
            raise TesseraError("RATE_LIMITED")

    job = Job(spark, f"file://{tmp_path}/jobs", given={"document": "d1"})
    with pytest.raises(Exception, match="RATE_LIMITED"):
        ingest.ingest(docs, None, "kb", Failing(16), store, job=job)
    result = ingest.ingest(docs, None, "kb", indexing.HashEmbedder(16), store, job=Job(spark, f"file://{tmp_path}/jobs", job.id))
    reused = {e["stage"] for e in job.events() if e["reused"]}
    assert {"normalize", "sections", "chunks", "indexing"} <= reused
    assert ingest.ingest(docs, None, "kb", Failing(16), store, job=job) == result
    assert read_ndjson(job.ndjson())["result"] == result
    with pytest.raises(TesseraError, match="CONFLICT"):
        Job(spark, f"file://{tmp_path}/jobs", job.id, given={"document": "d2"})
    with pytest.raises(TesseraError, match="interrupted"):
        read_ndjson(json.dumps({"type": "start"}))


def test_cancelled_job(spark, store, tmp_path):
    job = Job(spark, f"file://{tmp_path}/jobs", given={})
    job.cancel()
    with pytest.raises(TesseraError, match="ABORTED"):
        job.stage("chunks", lambda: spark.range(1))


def test_stream_replaces_documents(spark, store, tmp_path):
    inbox, embedder = tmp_path / "inbox", indexing.HashEmbedder(16)
    inbox.mkdir()
    for name, rows in (("1.json", [("d1", "# A\n\none"), ("d2", "# B\n\ntwo")]), ("2.json", [("d1", "# A\n\nnew text")])):
        (inbox / name).write_text("".join(json.dumps({"document_id": d, "content": c, "path": d}) + "\n" for d, c in rows))
        start_ingestion(document_stream(spark, str(inbox)), store, "kb", embedder, f"{tmp_path}/checkpoint").awaitTermination()
    texts = [r["text"] for r in store.records(store.snapshot("kb")).collect()]
    assert len(texts) == 2 and any("new text" in t for t in texts) and not any("one" in t for t in texts)


def test_log_filters():
    assert logs.parse_filters({"limit": "5", "type": "query", "from": "2026-01-01T00:00:00Z"})["limit"] == 5
    for bad in ({"x": "1"}, {"limit": "0"}, {"from": "2026-02-30T00:00:00Z"}, {"from": "2026-01-01T24:00:00Z"}, {"cursor": "01"}, {"cursor": str(2**63)}, {"from": "2026-01-02T00:00:00Z", "to": "2026-01-01T00:00:00Z"}):
        with pytest.raises(TesseraError):
            logs.parse_filters(bad)


def test_pages_are_stable_and_order_by_number(spark):
    df = spark.createDataFrame([(i, "query", "succeeded") for i in range(1, 13)], "id bigint, type string, status string")
    rows = logs.page(df, {"limit": 4}).collect()
    first = logs.page_result(rows, 4)
    assert [r["id"] for r in first["items"]] == ["12", "11", "10", "9"] and first["nextCursor"] == "9"
    more = df.unionByName(spark.createDataFrame([(13, "query", "running")], df.schema))
    rows = logs.page(more, {"limit": 4, "cursor": int(first["nextCursor"])}).collect()
    assert [r["id"] for r in rows[:4]] == [8, 7, 6, 5]
