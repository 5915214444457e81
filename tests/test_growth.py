"""What grows with the tables stays out of the driver, and out of single batches of Python's."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tessera.operators import batches, search
from tessera.operators import sections as s
from tessera.plans import document_queries as q
from tessera.plans import operator_queries

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["chunk_definitions", "section_sources"])
def test_no_table_of_documents_is_broadcast(spark, name):
    assert "Join" not in plan(getattr(q, name)(spark, SMALL))


def test_sources_in_the_row_are_those_of_the_joins(spark):
    texts = [
        (1, "---\ntitle: t\n---\nimport a from 'b'\n\n# A\n\n<Tip>one</Tip> and {'two'}\n\n# B\n\nplain 🙂\n\n## C\n\n{f(x)}\n"),
        (2, "no heading <b>x</b>\n\n# D"),
        (3, None),
        (4, ""),
        (5, "<Tip>never closed"),
        (6, "# E\n\n[r] [^n]\n\n# F\n\n[r]: /x\n[^n]: note\n"),
    ]
    normal = s.normalized(spark.createDataFrame(texts, "document_id int, content string"), "mdx")
    joined = s.with_sources(s.sections(normal), normal)
    assert "Broadcast" not in plan(joined)
    columns = ["document_id", "id", "start_offset", "end_offset", "source_start", "source_stop", "source", "exact"]
    in_row = s.sections(normal, content="content").select(columns)
    found = sorted(map(tuple, in_row.collect()), key=str)
    assert found == sorted(map(tuple, joined.select(columns).collect()), key=str)
    assert len(found) == 7 and any(f[-1] for f in found) and not all(f[-1] for f in found)


def test_chunks_keep_columns_of_their_section(spark):
    docs = spark.createDataFrame([(1, "# A\n\none\n\ntwo\n\n# B\n\nthree"), (2, "# C")], "document_id int, markdown string")
    got = s.chunks(s.sections(docs), 2, tokens=lambda t: len(t.split("\n\n")), keep=("document_id", "title")).select("document_id", "title", "index", "markdown").collect()
    assert sorted(map(tuple, got)) == [(1, "A", 0, "# A\n\none"), (1, "A", 1, "# A\n\ntwo"), (1, "B", 0, "# B\n\nthree"), (2, "C", 0, "# C")]


def test_texts_are_read_once_whatever_is_asked_of_their_errors(spark):
    assert plan(q.mdx_warnings(spark, SMALL)).count("ArrowEvalPython") == 1


def test_versions_are_read_in_their_row_and_merged(spark):
    found = plan(q.changed_sections(spark, SMALL))
    assert "Broadcast" not in found and found.count("SortMergeJoin") == 1


def test_a_file_of_one_row_group_is_dealt_to_all_cores(spark):
    assert "Exchange RoundRobinPartitioning" in plan(operator_queries.code_and_text(spark, SMALL))


def test_batches_are_gone_through_in_slices():
    texts = pa.array(["x" * 50_000, None, *["y" * 900] * 2000, "z" * 900_000, ""])
    parts = batches.cuts(texts)
    assert [a for a, _ in parts] == [0, *(b for _, b in parts[:-1])] and parts[-1][1] == len(texts)
    sizes = [sum(len(t or "") for t in texts.slice(a, b - a).to_pylist()) for a, b in parts]
    assert len(parts) > 8 and all(n <= 2 * batches.SLICE_BYTES or b - a <= 3 for n, (a, b) in zip(sizes, parts, strict=True))
    seen = []
    lengths = batches.sliced(lambda t: seen.append(len(t)) or pc.fill_null(pc.binary_length(t), -1))(texts)
    assert lengths.to_pylist() == [-1 if t is None else len(t) for t in texts.to_pylist()] and len(seen) == len(parts)
    assert batches.sliced(lambda t: t)(texts[:0]).to_pylist() == []


def test_best_of_tiles_are_the_best_of_all():
    rng = np.random.default_rng(1)
    for _ in range(100):
        k, n, step = (int(rng.integers(1, m)) for m in (6, 40, 20))
        own, vectors, rec = rng.integers(-1, 2, (5, 2)) * 1.0, rng.integers(-1, 2, (n, 2)) * 1.0, rng.permutation(n)
        best, ids = np.full((5, k), -np.inf), np.full((5, k), np.iinfo(np.int64).max)
        for a in range(0, n, step):
            best, ids = search._best_of(own, best, ids, vectors[a : a + step], rec[a : a + step])
        for i, scores in enumerate(own @ vectors.T):
            assert [(-b, c) for b, c in zip(best[i], ids[i], strict=True) if b > -np.inf] == sorted(zip(-scores, rec, strict=True))[:k]
