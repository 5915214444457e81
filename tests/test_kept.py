"""Work that is kept by what it was made of: a retry pays for what is left only."""

import json
import time
import uuid

import pytest

from tessera.errors import TesseraError
from tessera.operators import indexing
from tessera.plans import enrich, ingest

TEXTS = [f"# T{i}\n\nAtlas number {i} calls the Gateway." for i in range(12)]


class Model:
    """An answer for each prompt that names a file of its call; some sections fail, or get no good answer."""

    provider, model = "local", "test"

    def __init__(self, folder, fails=(), bad=()):
        self.folder, self.fails, self.bad = folder, fails, bad

    def extract(self, instructions, prompts):
        assert "knowledgeType" in instructions and "incident" in instructions
        out = []
        for prompt in prompts:
            text = json.loads(prompt)["markdown"]
            if any(f"number {i} " in text for i in self.fails):
                # The other tasks end in the meantime.
                time.sleep(20)
                raise RuntimeError("disconnected")
            (self.folder / uuid.uuid4().hex).write_text(text)
            node = {"id": "e1", "name": "Atlas", "type": "t", "aliases": [], "description": "d", "evidence": ["not there" if any(f"number {i} " in text for i in self.bad) else "calls the Gateway"]}
            out.append(json.dumps({"summary": "s", "keywords": [], "aliases": [], "questions": [], "entities": [node], "concepts": [], "relations": [], "facts": [], "knowledgeType": "guide"}))
        return out


def rows_of(spark, texts=TEXTS):
    from tessera.operators import sections

    docs = spark.createDataFrame([(f"d{i}", t, None) for i, t in enumerate(texts)], "document_id string, content string, path string")
    return ingest.section_rows(sections.normalized(docs, "markdown"))


@pytest.fixture
def calls(tmp_path):
    (tmp_path / "calls").mkdir()
    return tmp_path / "calls"


def test_a_retry_asks_for_what_is_left(spark, tmp_path, calls):
    split = rows_of(spark)
    kept = enrich.kept_answers(spark, f"file://{tmp_path}/kept")
    with pytest.raises(Exception, match="disconnected"):
        enrich.enriched(split, Model(calls, fails=(7,)), kept, rows_a_task=1)
    before = [f.read_text() for f in calls.iterdir()]
    found = enrich.enriched(split, Model(calls), kept)
    assert found["nodes"].count() == 12 and {r["section_id"] for r in found["summaries"].collect()} == {r["id"] for r in split.collect()}
    after = [f.read_text() for f in calls.iterdir()]
    # What shared the failing task is asked again, other tasks had kept their answers.
    assert 6 <= len(before) <= 11 and 12 <= len(after) <= 12 + 12 - len(before)
    n = len(after)
    enrich.enriched(split, Model(calls, fails=range(12)), kept)
    assert len(list(calls.iterdir())) == n
    enrich.enriched(rows_of(spark, [*TEXTS[:11], TEXTS[11] + " More."]), Model(calls), kept)
    assert len(list(calls.iterdir())) == n + 1


def test_bad_answers_are_asked_again(spark, tmp_path, calls):
    split = rows_of(spark)
    kept = enrich.kept_answers(spark, f"file://{tmp_path}/kept")
    with pytest.raises(TesseraError, match="INVALID_OUTPUT") as e:
        enrich.enriched(split, Model(calls, bad=(3,)), kept)
    assert (e.value.path, e.value.reason) == ("entity[0]", "evidence_not_in_section")
    assert enrich.enriched(split, Model(calls), kept)["nodes"].count() == 12
    asked = [f.read_text() for f in calls.iterdir()]
    assert len(asked) == 13 and sum("number 3 " in t for t in asked) == 2


def test_vectors_are_kept_by_text(spark, tmp_path, calls):
    class Counting(indexing.HashEmbedder):
        def embed(self, texts):
            for t in texts:
                (calls / uuid.uuid4().hex).write_text(t)
            return super().embed(texts)

    rows = [(f"i{i}", f"text {i % 4}", f"r{i % 4}") for i in range(10)]
    df = spark.createDataFrame(rows, "id string, text string, text_revision string")
    kept = enrich.kept_vectors(spark, f"file://{tmp_path}/kept")
    want = sorted(map(str, indexing.embedded(df, indexing.HashEmbedder(8)).select("id", "vector", "embedding_revision", "provider", "model").collect()))
    for _ in range(2):
        got = enrich.embedded_once(df, Counting(8), kept)
        assert sorted(map(str, got.select("id", "vector", "embedding_revision", "provider", "model").collect())) == want
        assert sorted(f.read_text() for f in calls.iterdir()) == [f"text {i}" for i in range(4)]
    more = spark.createDataFrame([*rows, ("new", "other", "r9")], "id string, text string, text_revision string")
    assert enrich.embedded_once(more, Counting(8), kept).count() == 11 and len(list(calls.iterdir())) == 5


def test_nothing_to_keep(spark, tmp_path, calls):
    kept = enrich.kept_answers(spark, f"file://{tmp_path}/kept")
    assert enrich.enriched(rows_of(spark).where("false"), Model(calls), kept)["nodes"].count() == 0
    assert kept.rows().count() == 0
