import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from tessera.errors import TesseraError
from tessera.llm import resample
from tests.llm.conftest import ODD

SMALL = "/root/testdata/sf0.001"


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(rows, target, most=1, buckets=10_000, percent=10, least=20, seed=2024):
    """(doc_id, n_features, weight, score, rank) of each row."""

    def grams(text):
        w = words_of(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    all_s, all_t = Counter(b for _, t in rows for b in grams(t)), Counter(b for t in target for b in grams(t))
    s_sum, t_sum = sum(all_s.values()) + buckets, sum(all_t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((all_t[b] + 1.0) * float(s_sum) / ((all_s[b] + 1.0) * float(t_sum)))) for b in all_s}
    out = []
    for doc_id, text in rows:
        found = grams(text)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))))
    may = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], r[1]))
    drawn = may[: percent * len(may) // 100]
    rest = (Counter(out) - Counter(drawn)).elements()
    return sorted(map(str, [(*r[:4], k + 1) for k, r in enumerate(drawn)] + [(*r[:4], None) for r in rest]))


def texts(n, seed):
    rng = random.Random(seed)
    pieces = ["alpha", "Beta", "été", "ÉTÉ", "漢字", "x1", "-", ",", "_", "\n", " ", "  ", "\x00", "\x85", "😀", "İ"]
    return [(i, "".join(rng.choice(pieces) + rng.choice([" ", "", " . "]) for _ in range(rng.randint(0, 60))), "s") for i in range(n)]


def got(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in df.dtypes} == {"bigint"}
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("most, buckets, percent, least", [(1, 10_000, 10, 20), (3, 50, 35, 5), (2, 1, 100, 0), (1, 7, 0, 1)])
def test_is_brute_force(spark, frame, monkeypatch, most, buckets, percent, least):
    monkeypatch.setattr(resample, "_BLOCK", 7)
    rows = texts(120, most) + ODD
    target = [t for _, t, _ in texts(20, 77)] + [None, ""]
    asked = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    out = got(resample.resample(frame(rows), asked, most, buckets, percent, least))
    assert out == brute([r[:2] for r in rows], target, most, buckets, percent, least)


def test_same_as_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    theirs = con.sql(f"SELECT doc_id, n_features, weight, score, rank FROM ({resample.ORACLE_SQL})").fetchall()
    assert got(resample.op13_importance_resampling(spark, SMALL)) == sorted(map(str, theirs))


def test_matches_overlap_at_word_borders():
    data = resample.collapsed("One, two;three  --four\n")
    assert data == b"one two three four"
    found = [[data[slice(*m.span())].decode() for m in p.finditer(data, overlapped=True)] for p in resample.ngram_patterns(3)]
    assert found == [["one", "two", "three", "four"], ["one two", "two three", "three four"], ["one two three", "two three four"]]


def test_repeated_rows_and_ties(spark, frame):
    text = " ".join(["same"] * 25)
    rows = [(3, text, "s")] * 30 + [(None, text, "s")] * 30 + texts(60, 5)
    asked = spark.createDataFrame([(text,)], "text string")
    out = got(resample.resample(frame(rows), asked, percent=40))
    assert out == brute([r[:2] for r in rows], [text], percent=40)
    assert out == got(resample.resample(frame(rows).repartition(9), asked, percent=40))


def test_drawn_documents_are_those_ranked(spark, frame):
    rows = texts(80, 6) + [(500, "the same words again " * 20, "s")] * 6 + [(500, "other words of that id " * 9, "s"), (None, "no id here at all " * 20, "s")]
    asked = spark.createDataFrame([("the same words again no id",)], "text string")
    df = frame(rows)
    ranked = sorted((r["rank"], r["doc_id"]) for r in resample.resample(df, asked, percent=60).collect() if r["rank"])
    out = resample.drawn_documents(df, asked, percent=60)
    assert out.columns == df.columns
    there = out.collect()
    assert [r["doc_id"] for r in there] == [i for _, i in ranked] and len(there) > 20
    assert {(r["doc_id"], r["text"]) for r in there} <= {r[:2] for r in rows}


def test_empty_tables_and_bounds(spark, frame, odd, nothing):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(nothing, none).count() == 0 and resample.drawn_documents(nothing, none).count() == 0
    assert got(resample.resample(odd, none)) == brute([r[:2] for r in ODD], [])
    with pytest.raises(TesseraError):
        resample.resample(odd, none, percent=101)
