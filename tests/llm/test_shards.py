import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tessera.errors import TesseraError
from tessera.llm import shards
from tests.llm.conftest import ODD

SMALL = "/root/testdata/sf0.001"


def brute(rows, n, parts):
    """Shard of each text: the largest item first, to the least load, by plain search."""
    sizes = Counter()
    for _, text, *_ in rows:
        sizes[text or ""] += len((text or "").encode()) + shards.OVERHEAD
    crc = {t: zlib.crc32(t.encode()) for t in sizes}
    total = sum(sizes.values())
    bundles, items = defaultdict(list), []
    for t, size in sizes.items():
        if size * n * parts > total:
            items.append((-size, 0, crc[t], [t]))
        else:
            bundles[crc[t] % (n * parts)].append(t)
    items += [(-sum(sizes[t] for t in texts), 1, b, texts) for b, texts in bundles.items()]
    loads, of = [0] * n, {}
    for size, _, _, texts in sorted(items):
        shard = loads.index(min(loads))
        loads[shard] -= size
        of |= dict.fromkeys(texts, shard)
    return of, loads, max(-x[0] for x in items)


def texts(n, seed, hot=0):
    rng = random.Random(seed)
    rows = [(i, "x" * rng.randint(0, 30) + rng.choice(["", "é漢", "b"]) * rng.randint(0, 300), "s") for i in range(n)]
    return rows + [(n + i, "a text that many documents are copies of", "s") for i in range(hot)]


@pytest.mark.parametrize("rows, n, parts", [(texts(400, 1), 5, 250), (texts(400, 2), 5, 4), (texts(300, 3, hot=600), 40, 3), (texts(3, 4), 7, 10), (texts(60, 5), 1, 1)])
def test_is_the_greedy_schedule(frame, rows, n, parts):
    got = shards.shard_documents(frame(rows), n, parts).collect()
    want, loads, largest = brute(rows, n, parts)
    text = {r[0]: r[1] for r in rows}
    assert {r["doc_id"]: (r["shard"], r["size"], r["text_crc32"]) for r in got} == {i: (want[t], len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in text.items()}
    assert max(loads) - min(loads) <= largest
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_sizes_are_nearly_equal(frame):
    rows = texts(3000, 6)
    loads = Counter()
    for r in shards.shard_documents(frame(rows), 8).collect():
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) - min(loads.values()) <= 0.01 * sum(loads.values()) / 8


def test_same_as_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    ours = shards.op12_shards(spark, SMALL)
    theirs = con.sql(f"SELECT {', '.join(ours.columns)} FROM ({shards.ORACLE_SQL})").fetchall()
    assert sorted(map(str, (tuple(r) for r in ours.collect()))) == sorted(map(str, theirs))


def test_odd_rows(frame, odd, nothing):
    again = frame(ODD * 3)
    for df, n in ((odd, len(ODD)), (again, 3 * len(ODD))):
        got = shards.shard_documents(df, 4).collect()
        assert len(got) == n and {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
        assert len({r["shard"] for r in got if r["size"] == shards.OVERHEAD}) == 1
        assert len({(r["shard"], r["slot"]) for r in got}) == n and max(r["slot"] for r in got) < n
    first = sorted(map(str, shards.shard_documents(again, 4).collect()))
    assert first == sorted(map(str, shards.shard_documents(again.repartition(7), 4).collect()))
    assert shards.shard_documents(nothing).count() == 0
    with pytest.raises(TesseraError):
        shards.shard_documents(odd, 0)


def test_a_row_that_repeats_without_end(frame):
    got = shards.shard_documents(frame([(None, "the same", "s")] * 500 + texts(20, 8)), 3).collect()
    same = [r for r in got if r["doc_id"] is None]
    assert len(same) == 500 and len({r["shard"] for r in same}) == 1 and len({r["slot"] for r in same}) == 500


def test_written_shards_hold_all_rows(frame, odd, nothing, tmp_path):
    for name, df in (("odd", odd), ("many", frame(texts(200, 9, hot=100))), ("none", nothing)):
        out = shards.write_shards(df, f"file://{tmp_path}/{name}", 4)
        assert out.columns == [*df.columns, "shard"]
        assert sorted(map(str, out.drop("shard").collect())) == sorted(map(str, df.collect()))
        plan = {r["doc_id"]: r["shard"] for r in shards.shard_documents(df, 4).collect() if r["doc_id"] is not None}
        assert {r["doc_id"]: r["shard"] for r in out.collect() if r["doc_id"] is not None} == plan


def test_schedule():
    assert shards.schedule([3, 3, 2, 2, 2], 2) == [0, 1, 0, 1, 0]
    assert shards.schedule([], 3) == [] and shards.schedule([5, 1], 4) == [0, 1]
