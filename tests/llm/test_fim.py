import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.errors import TesseraError
from tessera.llm import fim
from tests.llm.conftest import ODD

SMALL = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


def brute(doc_id, text, seed=42, rate=50, spm=80, marks=("<P>", "<S>", "<M>")):
    """(n, form, prefix_chars, middle_chars, output), a character at a time."""
    text = text or ""
    starts = [k for k, c in enumerate(text) if k == 0 or (c in SPACES and text[k - 1] not in SPACES)]
    units = [text[i:j] for i, j in zip(starts, [*starts[1:], len(text)], strict=False)]
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), marks[1] + s + marks[0] + p + marks[2] + m
    return n, "psm", len(p), len(m), marks[0] + p + marks[1] + s + marks[2] + m


def texts(n, seed):
    rng = random.Random(seed)
    pieces = [" ", "\n", "\t\r", "\x0b\x0c", "a", "été", "漢", "😀", " ", "$1", "\\", "{2}", "<", "S>", "<P", "(", "\x1c", "\x85"]
    return [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))), "s") for i in range(n)]


@pytest.mark.parametrize("rate, spm", [(50, 80), (100, 0), (100, 100), (0, 50)])
def test_is_brute_force_and_restores(frame, rate, spm):
    rows = texts(300, rate + spm) + ODD + [(900, "it has a <S> in it", "s"), (901, "<M>", "s")]
    out = fim.fill_in_middle(frame(rows), rate=rate, spm_share=spm).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted((tuple(r) for r in out.collect()), key=str)
    want = sorted(((r[0], *brute(r[0], r[1], rate=rate, spm=spm), r[1] or "") for r in rows), key=str)
    assert got == want
    forms = {r[2] for r in got}
    assert forms == {(50, 80): {"plain", "spm", "psm"}, (100, 0): {"plain", "psm"}, (100, 100): {"plain", "spm"}, (0, 50): {"plain"}}[rate, spm]


def test_same_as_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    ours = fim.op11_fill_in_middle(spark, SMALL)
    theirs = con.sql(f"SELECT {', '.join(ours.columns)} FROM ({fim.ORACLE_SQL})").fetchall()
    assert sorted(map(str, (tuple(r) for r in ours.collect()))) == sorted(map(str, theirs))


def test_very_long_texts_need_no_stack(frame):
    rows = [(i, t, "s") for i in range(3) for t in ("w " * 400_000, "x" * 1_000_000, " " * 1_000_000, "a" + "\n" * 700_000 + "b")]
    out = fim.fill_in_middle(frame(rows), rate=100).withColumn("back", F.sha2(fim.restored(F.col("output"), F.col("form")), 256)).drop("output")
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted(((i, *brute(i, t, rate=100)[:4], hashlib.sha256(t.encode()).hexdigest()) for i, t, _ in rows), key=str)


def test_marks_of_ones_own(frame):
    marks = fim.Marks("[PRE]", "[SUF]", "[MID]")
    rows = texts(60, 3)
    out = fim.fill_in_middle(frame(rows), seed=7, rate=100, marks=marks).withColumn("back", fim.restored(F.col("output"), F.col("form"), marks))
    assert {r["doc_id"]: (r["output"], r["back"]) for r in out.collect()} == {i: (brute(i, t, 7, 100, marks=marks)[4], t) for i, t, _ in rows}
    for bad in (fim.Marks("<P>", "<P>", "<M>"), fim.Marks("", "<S>", "<M>"), fim.Marks("aba", "<S>", "<M>"), fim.Marks("<x", "x>", "<M>"), fim.Marks("$1", "<S>", "<M>")):
        with pytest.raises(TesseraError):
            fim.fill_in_middle(frame(rows), marks=bad)


def test_one_match_captures_the_parts():
    """The pattern's own parts, by Python's engine, which has possessive quantifiers too."""
    text = "  one two\nthree   four "
    found = re.match(rf"(?s)\A((?:{fim.UNIT}){{1}}+)((?:{fim.UNIT}){{2}}+)(.*+)", text)
    assert found.groups() == ("  one", " two\nthree", "   four ")


def test_empty_table(nothing):
    assert fim.fill_in_middle(nothing).count() == 0
